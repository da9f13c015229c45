"""Texts and columns that operators must take: missing, empty, long, tied, repeated, clashing."""

import re
from datetime import date

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")

PASSAGE = "the quick brown fox jumps over the lazy dog while seven silent owls watch from an old oak"
LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(15_000))

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\r\n \x0b\x0c"),
    (4, "one"),
    (5, "Two words"),
    (6, "a b c a b c a b c"),
    (7, "Same line\nSame line\n\nother line\r\nSame line"),
    (8, f"Before it all {PASSAGE.upper()} and after, é ß 中文 \x00 end"),
    (9, f"Before it all {PASSAGE.upper()} and after, é ß 中文 \x00 end"),
    (10, LONG),
    (11, LONG + " tail"),
    (11, "a repeated number with another text"),
    (12, "a repeated row"),
    (12, "a repeated row"),
    (None, "a text without a number"),
    (13, PASSAGE[:40]),
    (14, "x" * 5000),
    (15, "<|endoftext|> it's   2024!! &&& ***"),
    (16, "### $$$ %%% |||"),
]

#: Columns whose names operators use inside or for their results.
CLASHES = {"kept": "text of kept", "score": 1.5, "row": 3, "value": None, "host": "h", "path": "p", "held_out": date(2020, 1, 1)}
