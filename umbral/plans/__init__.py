"""Compositions a user calls: household roll-ups, final bases and the end-to-end run."""
