"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters are lexicons and patterns. Lexicons hold listed insults, and words and word beginnings that labelled
toxic texts use far more often than others, in tiers by how strongly they tell; a lexicon votes "toxic" when a text holds one of
its terms and abstains otherwise. Patterns vote on how many terms a text holds, how densely, and how it is written.

The label model gives every voter its own chance of each vote for either class (its accuracy) by expectation
maximisation, labels being one more, not fully trusted voter. Voters that go together within a class
(correlation of what the class leaves unexplained) share their weight. Its posteriors are
the targets of a logistic regression on the same evidence, in counts, whose score reads any text.

All of this is fitted on a bounded sample of labelled rows (``labelled_per_class``), drawn by key hash; every text is
scored whole, in one scan.

Defined cases: a missing or empty text gets the score of a text without terms; without labelled rows of both classes only the
listed words are known and the classifier falls back to their number; repeated rows are judged one by one. Other columns stay.
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

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ADDRESS = regex.compile(r"\b(?:you|your|tu|vous|du|ihr|tú|eres|usted)\b(?:\s+\p{L}+){0,3}?\s+(\p{L}+)")

# Plain insults in the languages of the corpus.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown "
    "imbecile fool fools filth vermin retard bastard jerk "
    "crétin crétine imbécile débile abruti ordure connard minable pathétique dégoûtant "
    "trottel dummkopf abschaum versager erbärmlich widerlich wertlos arschloch schwachkopf "
    "estúpido estúpida imbécil basura escoria patético inútil asqueroso payaso tonto"
).split()


@dataclass(frozen=True)
class ToxicityFit:
    labelled_per_class: int = 6000
    beginnings: tuple[int, ...] = (5, 6, 7, 8)
    least_texts: int = 3
    least_log_odds: float = 1.8
    most_terms: int = 4000
    tiers: int = 3
    rounds: int = 25
    trust: float = 0.97
    threshold: float = 0.7


def text_terms(words: set[str], beginnings: tuple[int, ...]) -> set[str]:
    """Words and, marked by a dash, what longer words begin with."""
    out = set(words)
    for w in words:
        out.update(f"{w[:n]}-" for n in beginnings if len(w) > n)
    return out


@dataclass
class Voters:
    """``lexicon`` maps a term to its voter; ``names`` are the lexicons, patterns follow them."""

    lexicon: dict[str, int]
    names: list[str]
    beginnings: tuple[int, ...]
    cache: dict[str, tuple] = field(default_factory=dict)

    PATTERNS = ("two_terms", "three_hits", "dense", "addressed", "shouting", "no_term")

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    @property
    def width(self) -> int:
        return len(self.names) + len(self.PATTERNS)

    def _lexicons_of(self, word: str) -> tuple:
        found = self.cache.get(word)
        if found is None:
            keys = [word, *[f"{word[:n]}-" for n in self.beginnings if len(word) > n]]
            found = tuple(sorted({self.lexicon[k] for k in keys if k in self.lexicon}))
            if len(self.cache) >= 500_000:
                self.cache.clear()
            self.cache[word] = found
        return found

    def evidence(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Votes (1 toxic, -1 not, 0 none) and counts behind them, one entry per voter."""
        votes, counts = np.zeros(self.width, np.int8), np.zeros(self.width)
        text = text or ""
        lower = text.lower()
        words = Counter(WORD.findall(lower))
        hits = terms = 0
        for w, n in words.items():
            for v in self._lexicons_of(w):
                counts[v] += 1
                votes[v] = 1
            if self._lexicons_of(w):
                terms += 1
                hits += n
        total, base = sum(words.values()), len(self.names)
        addressed = bool(hits) and any(self._lexicons_of(m[1]) for m in ADDRESS.finditer(lower, overlapped=True))
        shouting = total > 0 and text.count("!") > total / 3
        counts[base:] = np.log1p(terms), np.log1p(hits), min(1.0, 20 * hits / max(1, total)), addressed, shouting, terms == 0
        votes[base:] = terms >= 2, hits >= 3, 50 * hits > total, addressed, 0, -(terms == 0)
        return votes, counts


@dataclass
class LabelModel:
    """Chances of the votes -1, 0, 1 of every voter in either class, and the weight its votes count with."""

    prior: float
    chances: np.ndarray
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.chances)
        odds = np.log(self.prior / (1 - self.prior)) + sum(
            self.weights[j] * (logs[1, j, votes[:, j] + 1] - logs[0, j, votes[:, j] + 1]) for j in range(votes.shape[1])
        )
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int, trust: float) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation over votes; ``labels`` (0, 1, or -1 for none) start it and stay a voter of accuracy ``trust``."""
    n, width = votes.shape
    anchor = np.where(labels < 0, 0.0, np.log(trust / (1 - trust)) * np.sign(labels - 0.5))
    post = np.where(labels < 0, 0.5, np.where(labels == 1, trust, 1 - trust))
    weights = np.ones(width)
    for _ in range(rounds):
        chances = np.empty((2, width, 3))
        for y, p in ((0, 1 - post), (1, post)):
            for v in (-1, 0, 1):
                chances[y, :, v + 1] = (votes == v).T @ p + 0.5
            chances[y] /= chances[y].sum(axis=1, keepdims=True)
        # What the classes leave unexplained: voters that still go together count as fewer.
        values = np.array([-1.0, 0.0, 1.0])
        expected = np.outer(1 - post, chances[0] @ values) + np.outer(post, chances[1] @ values)
        residual = votes - expected
        scale = np.sqrt((residual**2).mean(axis=0)) + 1e-9
        correlation = np.abs((residual / scale).T @ (residual / scale)) / max(1, n)
        weights = 1 / np.maximum(1.0, np.where(correlation > 0.1, correlation, 0).sum(axis=1))
        model = LabelModel(float(np.clip(post.mean(), 1e-3, 0.999)), chances, weights)
        odds = np.log(model.posterior(votes)) - np.log1p(-model.posterior(votes))
        post = 1 / (1 + np.exp(-np.clip(odds + anchor, -30, 30)))
    return model, post


def fit_linear(counts: np.ndarray, target: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the first weight is the constant."""
    x = np.c_[np.ones(len(counts)), counts]
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty * len(x))
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel | None
    weights: np.ndarray
    threshold: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        counts = np.stack([_scaled(self.voters.evidence(t)[1]) for t in texts]) if texts else np.zeros((0, self.voters.width))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + counts @ self.weights[1:], -30, 30)))


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Many terms of one lexicon tell little more than some."""
    return np.minimum(counts, 3.0)


def _sample(labels: DataFrame, key: str, label: str, how: ToxicityFit) -> DataFrame:
    """At most about ``labelled_per_class`` keys of each class, by hash; small enough to go to every task."""
    counts = {r[0]: r[1] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    place = F.pmod(F.xxhash64(F.col(key), F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col(label) == k, min(1.0, how.labelled_per_class / n)).otherwise(share)
    return labels.filter(place < share).groupBy(key).agg(F.max(label).cast("int").alias("__label"))


def _term_counts(rows: DataFrame, how: ToxicityFit) -> DataFrame:
    """``(term, toxic, other)``: texts of either class that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(text_terms(set(WORD.findall((t or "").lower())), how.beginnings))
            terms = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *[pa.array([found[y][k] for k in terms], pa.int64()) for y in (1, 0)]], names=["term", "toxic", "other"]
            )

    counted = rows.select("__text", "__label").mapInArrow(run, "term string, toxic bigint, other bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_voters(rows: DataFrame, how: ToxicityFit) -> Voters:
    """Lexicons from labelled rows ``(__text, __label)``, besides the listed insults."""
    n = {r[0]: r[1] for r in rows.groupBy("__label").count().collect()}
    lexicon, names = {w: 0 for w in INSULTS}, ["listed"]
    if n.get(0) and n.get(1):
        odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("other") + 0.5) / (n[0] + 1))
        found = (
            _term_counts(rows, how)
            .filter(F.col("toxic") >= how.least_texts)
            .withColumn("odds", odds)
            .filter(F.col("odds") >= how.least_log_odds)
            .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term")
            .limit(how.most_terms)
            .toArrow().to_pandas()
        )
        for kind in ("word", *how.beginnings):
            own = found[found["term"].map(lambda t, k=kind: (not t.endswith("-")) if k == "word" else t.endswith("-") and len(t) == k + 1)]
            own = own.sort_values(["odds", "term"], ascending=[False, True])
            for tier, terms in enumerate(np.array_split(own["term"].to_numpy(object), how.tiers)):
                if len(terms):
                    lexicon.update({t: len(names) for t in terms if t not in lexicon})
                    names.append(f"{kind}_{tier}")
    return Voters(lexicon, names, how.beginnings)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", how: ToxicityFit = ToxicityFit()) -> ToxicityModel:
    """Learn from ``docs`` and ``labels``; which rows may be learned from is the caller's choice of ``labels``."""
    spark = docs.sparkSession
    sample = _sample(labels, key, label, how)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text")).join(F.broadcast(sample), key).select("__text", "__label")
    voters = learn_voters(rows, how)
    shared = spark.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [shared.value.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([v.astype(np.int32) for v, _ in pairs], pa.list_(pa.int32())),
                    pa.array([c for _, c in pairs], pa.list_(pa.float64())),
                    batch.column(1),
                ],
                names=["votes", "counts", "label"],
            )

    # One row of a few dozen numbers for each of the bounded sample's texts.
    seen = rows.mapInArrow(run, "votes array<int>, counts array<double>, label int").toArrow().to_pandas()
    y = seen["label"].to_numpy(np.int64) if len(seen) else np.zeros(0, np.int64)
    if not (0 < y.sum() < len(y)):
        weights = np.zeros(voters.width + 1)
        weights[0], weights[1 + len(voters.names)] = -3.0, 4.0
        return ToxicityModel(voters, None, weights, how.threshold)
    votes, counts = np.stack(seen["votes"].to_numpy()), np.stack(seen["counts"].to_numpy())
    model, post = fit_label_model(votes, y, how.rounds, how.trust)
    return ToxicityModel(voters, model, fit_linear(_scaled(counts), post), how.threshold)


def toxicity(text: Column | str, model: ToxicityModel, spark) -> Column:
    """Score from 0 to 1 of each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts.to_pylist()))

    return run.asNondeterministic()(text)


def with_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``predicted``; columns of those names are replaced."""
    found = df.withColumn("score", toxicity(F.col(text).cast("string"), model, df.sparkSession))
    return found.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))
