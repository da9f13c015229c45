"""Language of a text by words first and shorter and shorter character n-grams after.

The model holds, for each language, log frequencies of words and of character n-grams. A known
word adds its log share in every language; an unseen word (with its edges marked) falls back to the
longest n-grams of which any is known. All shares are among languages, so words and n-grams of
every length weigh on one scale. Words in a batch are scored once each.

The model is fitted on a bounded sample of labelled rows (``docs_per_language``, drawn by a hash of the key, so
the same rows every time) and its tables are bounded by ``words_per_language`` and ``grams_per_language`` for each n.
Every text is scored whole.

Defined cases: a text that is missing or has no letter is ``und`` with score 0; with letters but without any known n-gram it
gets the first language of the most labelled rows; without labelled rows every text is ``und``. Equal sums go to the
language that comes first in order. Rows are judged one by one, other columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.session import scratch_path

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageFit:
    docs_per_language: int = 4000
    words_per_language: int = 60_000
    grams_per_language: int = 15_000
    longest: int = 5
    least_count: int = 2
    smoothing: float = 0.5
    unseen_weight: float = 0.5


@dataclass
class LanguageModel:
    """``words`` and ``grams[n]`` map a key to its row of ``shares``: log shares of the languages, 0 for an even one."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    shares: np.ndarray
    unseen_weight: float
    first: int = 0
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def unseen(self, word: str) -> np.ndarray:
        found = self.cache.get(word)
        if found is None:
            marked = f"^{word}$"
            found = np.zeros(len(self.languages))
            for n in range(len(self.grams), 0, -1):
                table = self.grams[n - 1]
                rows = [table[g] for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) in table]
                if rows:
                    found = self.shares[rows].mean(axis=0) * self.unseen_weight
                    break
            if len(self.cache) >= 200_000:
                self.cache.clear()
            self.cache[word] = found
        return found

    def judge(self, text: str | None) -> tuple[str, float]:
        """Language and its share among all, by the sum over words."""
        counts = Counter(WORD.findall(text.lower())) if text else {}
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        known = [(self.words[w], n) for w, n in counts.items() if w in self.words]
        total = np.zeros(len(self.languages))
        if known:
            rows, times = zip(*known, strict=True)
            total += np.array(times, float) @ self.shares[list(rows)]
        for w, n in counts.items():
            if w not in self.words:
                total += n * self.unseen(w)
        best = int(np.argmax(total)) if total.any() else self.first
        share = np.exp(total - total.max())
        return self.languages[best], float(share[best] / share.sum())


def _sample(rows: DataFrame, lang: str, how: LanguageFit) -> tuple[DataFrame, dict[str, int]]:
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    shares = rows.sparkSession.createDataFrame(
        [(k, min(1.0, how.docs_per_language / n)) for k, n in counts.items()] or [("", 0.0)], f"{lang} string, __share double"
    )
    place = F.pmod("__place", F.lit(1_000_000)) / 1_000_000
    return rows.join(F.broadcast(shares), lang).filter(place < F.col("__share")), counts


def fit_languages(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", how: LanguageFit = LanguageFit()) -> LanguageModel:
    """Learn from rows with a text and a language."""
    rows = labelled.select(F.xxhash64(F.col(key), F.lit("language")).alias("__place"), F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("lang")).filter("__text is not null and lang is not null")
    rows, counts = _sample(rows, "lang", how)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(g, Counter()).update(WORD.findall(t.lower()))
            flat = [(g, w, n) for g, c in found.items() for w, n in c.items()]
            if flat:
                a, b, c = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["lang", "term", "n"])

    by_word = rows.select("__text", "lang").mapInArrow(words, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    marked = F.concat(F.lit("^"), F.col("term"), F.lit("$"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(how.longest)))
    grams = (
        by_word.select("lang", "n", marked.alias("m"), sizes.alias("size"))
        .filter(F.length("m") >= F.col("size"))
        .select("lang", "n", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("m") - F.col("size") + 1), lambda k: F.col("m").substr(k, F.col("size")))).alias("term"))
        .groupBy("lang", "size", "term")
        .agg(F.sum("n").alias("n"))
    )
    both = by_word.select("lang", F.lit(0).alias("size"), "term", "n").unionByName(grams)
    path = scratch_path(rows.sparkSession, "language-counts")
    both.write.parquet(path)
    both = rows.sparkSession.read.parquet(path)
    # How many keys occur how often, largest first: where a table's bound lies, without ordering its keys.
    steps: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for g, size, n, keys in both.groupBy("lang", "size", "n").count().collect():
        steps.setdefault((g, size), []).append((n, keys))
    bounds = []
    for (g, size), held in steps.items():
        least, taken = how.least_count, 0
        for n, keys in sorted(held, reverse=True):
            taken += keys
            if taken > (how.grams_per_language if size else how.words_per_language):
                least = max(least, n + 1)
                break
        bounds.append((g, size, least, sum(n * keys for n, keys in held)))
    bounds = rows.sparkSession.createDataFrame(bounds or [("", 0, 0, 0)], "lang string, size int, least bigint, total bigint")
    table = both.join(F.broadcast(bounds), ["lang", "size"]).filter("n >= least").select("lang", "size", "term", "n", "total").toArrow().to_pandas()

    languages = sorted(counts)
    place = {g: k for k, g in enumerate(languages)}
    keys: list[dict[str, int]] = [{} for _ in range(how.longest + 1)]
    totals = np.ones((how.longest + 1, len(languages)))
    entries = []
    for g, size, term, n, all_n in table.itertuples(index=False):
        k = place[g]
        totals[size, k] = all_n
        row = keys[size].setdefault(term, len(entries))
        if row == len(entries):
            entries.append((size, np.zeros(len(languages))))
        entries[row][1][k] = n
    if not entries:
        return LanguageModel(languages, {}, [{} for _ in range(how.longest)], np.zeros((0, len(languages))), how.unseen_weight)
    size = np.array([e[0] for e in entries])
    seen = np.array([e[1] for e in entries])
    freq = np.log((seen + how.smoothing) / (totals[size] + how.smoothing))
    shares = freq - np.logaddexp.reduce(freq, axis=1, keepdims=True) + np.log(len(languages))
    first = languages.index(min(counts, key=lambda g: (-counts[g], g))) if languages else 0
    return LanguageModel(languages, keys[0], keys[1:], shares, how.unseen_weight, first)


def language(text: Column | str, model, spark) -> Column:
    """Struct ``(lang_pred, score)`` for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.judge(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"]
        )

    return run.asNondeterministic()(text)


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of those names are replaced."""
    held = "__language"
    found = df.withColumn(held, language(F.col(text).cast("string"), model, df.sparkSession))
    return found.withColumns({"lang_pred": F.col(held)["lang_pred"], "score": F.col(held)["score"]}).drop(held)
