"""Preparation of training text: extraction, near copies, quality, language, toxicity, packing."""
