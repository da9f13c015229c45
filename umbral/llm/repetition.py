"""Quality rules by repetition coverage: how much of a text lies in repeated n-grams and lines.

Each text is judged alone, so the work is one scan without a shuffle. Rolling hashes of every
n-gram length are built from word hashes in numpy over a whole Arrow batch; equal hashes inside
one text mark the words they cover.

Defined cases: a missing or empty text has no words and fails the base rules; white space alone
likewise. Repeated rows and ties are judged row by row. Columns of the input stay as they are,
except that new columns replace columns of the same name. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.llm.text import SPACED, U64, Tokens, byte_class, mix, rolling, slices, span_hashes, sums, tokens, within_texts

SYMBOLS = byte_class(lambda b: chr(b) in "#*$%&|<>")
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_share double, gram_shares array<double>, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rules:
    """A text is kept unless one share is above its limit.

    Shares are characters of words covered by n-grams seen earlier in the text, or of
    lines seen earlier, out of the characters of all words.
    """

    least_words: int = 50
    most_repeat_percent: int = 50
    gram_limits: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    line_limit: float = 0.20


def earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(seen before, seen again)`` for each key."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    before, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    again[order[:-1]] = same
    return before, again


def covered(t: Tokens, hashes: np.ndarray, owner: np.ndarray, size: int, first_too: bool) -> np.ndarray:
    """Words inside n-grams of ``size`` words that occur earlier (or, with ``first_too``, twice) in their text."""
    whole = np.flatnonzero(within_texts(t, size))
    keys = mix(rolling(hashes, size)[whole] ^ (owner[whole].astype(U64) * U64(0xD6E8FEB86659FD93)))
    before, again = earlier(keys)
    marked = whole[before | again] if first_too else whole[before]
    steps = np.zeros(len(hashes) + 1, np.int32)
    steps[marked] += 1
    steps[marked + size] -= 1
    return np.cumsum(steps)[:-1] > 0


def _lines(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the lines that hold a word."""
    breaks = np.flatnonzero(t.data == 10)
    start = np.union1d(breaks + 1, t.edges[:-1])
    start = start[start < len(t.data)]
    owner = np.searchsorted(t.edges, start, side="right") - 1
    end = np.minimum(np.r_[breaks, len(t.data)][np.searchsorted(breaks, start)], t.edges[owner + 1])
    words = np.searchsorted(t.start, end) - np.searchsorted(t.start, start)
    return start[words > 0], end[words > 0], owner[words > 0]


def judge(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray | list]:
    """Counts, shares and verdict of every text of a batch."""
    t = tokens(texts, SPACED, lower=False)
    owner, hashes = t.owner(), t.hashes()
    lead = np.r_[0, np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int64)]
    chars = lead[t.end] - lead[t.start]
    n_words, word_chars = t.counts(), sums(chars, t.first)
    repeat = sums(covered(t, hashes, owner, 3, True).astype(np.int64), t.first)

    start, end, line_owner = _lines(t)
    again, _ = earlier(mix(span_hashes(t.data, start, end) ^ (line_owner.astype(U64) * U64(0xD6E8FEB86659FD93))))
    upto = np.r_[0, np.cumsum(chars)]
    line_chars = upto[np.searchsorted(t.start, end)] - upto[np.searchsorted(t.start, start)]
    dup_lines = np.bincount(line_owner[again], minlength=t.texts)
    per_char = 1 / np.maximum(word_chars, 1)
    line_share = np.bincount(line_owner[again], weights=line_chars[again], minlength=t.texts) * per_char
    shares = [sums(np.where(covered(t, hashes, owner, n, False), chars, 0), t.first) * per_char for n, _ in rules.gram_limits]

    failed = (n_words < rules.least_words) | (100 * repeat > rules.most_repeat_percent * n_words)
    bad = line_share > rules.line_limit
    for share, (_, limit) in zip(shares, rules.gram_limits, strict=True):
        bad |= share > limit
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sums(SYMBOLS[t.data].astype(np.int64), t.edges),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "line_share": line_share,
        "gram_shares": list(np.stack(shares, axis=1)) if shares else [[]] * t.texts,
        "base_failed": failed,
        "kept": ~failed & ~bad,
    }


def repetition(text: Column | str, rules: Rules = Rules()) -> Column:
    """A struct of ``FIELDS`` for each text."""

    @F.arrow_udf(FIELDS)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for low, high in slices(texts):
            found = judge(texts[low:high], rules)
            columns = [pa.array(found[k], pa.list_(pa.float64())) if k == "gram_shares" else pa.array(found[k]) for k in found]
            parts.append(pa.StructArray.from_arrays(columns, names=list(found)))
        return pa.concat_arrays(parts)

    # Otherwise a filter on the result would be pushed down and every text judged twice.
    return run.asNondeterministic()(text)


def with_repetition(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df`` with the fields of ``repetition`` as columns."""
    held = "__repetition"
    names = [x.split()[0] for x in FIELDS.split(", ")]
    found = df.withColumn(held, repetition(F.col(text), rules))
    return found.withColumns({n: F.col(held)[n] for n in names}).drop(held)


def keep_unrepeated(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Rows whose text passes; the columns of ``df`` are unchanged."""
    held = "__repetition"
    return df.withColumn(held, repetition(F.col(text), rules)).filter(F.col(held)["kept"]).drop(held)
