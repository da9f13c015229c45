"""URL filters: listed rules first, then association rules mined from labelled URLs.

A URL becomes a set of tokens (host parts, path words, query names, scheme). FP-growth over labelled URLs, with the verdict as one
more item, finds token combinations that go with a verdict; those below the support or confidence bound go, and so do those that a
part of them already says as surely. A URL is matched through an inverted index from a rule's rarest token: only rules whose rarest token the
URL has are looked at. The most confident (then best supported) matching rule decides.

Mining uses whole token sets; of tokens that the same URLs have, one stands for all, and rules are written out for each. Supersets go before rules leave Spark, and there is no other
bound on rules than ``support`` and ``confidence``. Every URL is judged on all its tokens, in one scan.

Defined cases: a missing URL or one without ``://`` has an empty host and path, no rule and the default verdict; so has a URL
no rule matches; without labelled URLs of both verdicts no rule is mined. Repeated rows are judged one by one; other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import pyarrow as pa
import regex
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.session import scratch_path

ALLOW, BLOCK = "allow", "block"
WORD = regex.compile(r"[a-z]+|[0-9]+|[^\x00-\x7F]+")


@dataclass(frozen=True)
class ListedRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    support: float = 0.002
    confidence: float = 0.9
    default: str = ALLOW


@dataclass(frozen=True)
class MinedRule:
    tokens: frozenset
    verdict: str
    confidence: float
    support: float

    def order(self):
        return (-self.confidence, -self.support, len(self.tokens), sorted(self.tokens), self.verdict)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[ListedRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest listed rule that fits, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def url_tokens(url: str | None) -> set[str]:
    """What rules may be about: ``scheme:``, ``host:``, ``domain:``, ``path:``, ``digits:`` and ``query:`` tokens."""
    if url is None or "://" not in url:
        return set()
    scheme, rest = url.split("://", 1)
    rest, _, _ = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    parts = [p for p in host.lower().split(".") if p]
    out = {f"scheme:{scheme.lower()}"}
    out.update(f"host:{p}" for p in parts)
    out.update(f"host:{w}" for p in parts for w in WORD.findall(p))
    out.update(f"domain:{'.'.join(parts[-n:])}" for n in (1, 2, 3) if len(parts) >= n)
    for segment in path.lower().split("/"):
        for w in WORD.findall(segment):
            out.add(f"digits:{len(w)}:{w[0]}" if w.isdigit() else f"path:{w}")
    out.update(f"query:{q.partition('=')[0].lower()}" for q in query.split("&") if q)
    return out


def mine(labelled: DataFrame, url: str, verdict: str, how: Mining = Mining()) -> list[MinedRule]:
    """Rules from rows with a URL and a verdict."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(url).cast("string").alias("url"), F.col(verdict).alias("verdict")).filter("url is not null and verdict is not null")
    n = {r[0]: r[1] for r in rows.groupBy("verdict").count().collect()}
    total = sum(n.values())
    if len(n) < 2:
        return []

    @F.arrow_udf("array<string>")
    def all_tokens(urls: pa.Array) -> pa.Array:
        return pa.array([sorted(url_tokens(u)) for u in urls.to_pylist()], pa.list_(pa.string()))

    # Tokens frequent enough to be in a rule, one of those that the same URLs have: at most (tokens of a URL) / support of them.
    marks = [F.sum(F.xxhash64("url", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in (1, 2)]
    each = rows.select("url", F.explode(all_tokens("url")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks)
    same = each.filter(F.col("n") >= how.support * total).groupBy("n", "mark1", "mark2").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    equal = {r[0][0]: r[0] for r in same.select("tokens").collect()}
    shared = spark.sparkContext.broadcast(set(equal))

    @F.arrow_udf("array<string>")
    def transactions(urls: pa.Array, verdicts: pa.Array) -> pa.Array:
        pairs = zip(urls.to_pylist(), verdicts.to_pylist(), strict=True)
        return pa.array([[*sorted(url_tokens(u) & shared.value), f"={v}"] for u, v in pairs], pa.list_(pa.string()))

    baskets = rows.select(transactions("url", "verdict").alias("items"))
    path = scratch_path(spark, "token-sets")
    FPGrowth(itemsCol="items", minSupport=how.support, minConfidence=how.confidence).fit(baskets).freqItemsets.write.parquet(path)
    sets = spark.read.parquet(path).select(
        F.array_sort(F.filter("items", lambda t: ~t.startswith("="))).alias("tokens"), F.filter("items", lambda t: t.startswith("=")).alias("verdicts"), "freq"
    ).filter("size(tokens) > 0")
    alone = sets.filter("size(verdicts) = 0").select("tokens", F.col("freq").alias("n"))
    confidence = F.col("freq") / F.col("n")
    path = scratch_path(spark, "rules")
    sets.filter("size(verdicts) = 1").join(alone, "tokens").filter(confidence >= how.confidence).select(
        "tokens", F.substring(F.col("verdicts")[0], 2, 100).alias("verdict"), confidence.alias("confidence"), (F.col("freq") / F.lit(total)).alias("support")
    ).write.parquet(path)
    kept = without_supersets(spark.read.parquet(path))
    # What is said of a token holds for every token that the same URLs have.
    return [replace(r, tokens=frozenset(c)) for r in kept for c in product(*(equal[t] for t in sorted(r.tokens)))]


def without_supersets(found: DataFrame) -> list[MinedRule]:
    """Rules that no part of them says as surely, smaller ones first; each size is tested against the smaller rules that are kept."""
    spark = found.sparkSession
    kept: list[MinedRule] = []
    for size in sorted(r[0] for r in found.select(F.size("tokens")).distinct().collect()):
        shared = spark.sparkContext.broadcast(Index(kept))

        @F.arrow_udf("boolean")
        def new(tokens: pa.Array, verdicts: pa.Array, confidences: pa.Array) -> pa.Array:
            rows = zip(tokens.to_pylist(), verdicts.to_pylist(), confidences.to_pylist(), strict=True)
            return pa.array([not any(k.verdict == v and k.confidence >= c for k in shared.value.fitting(set(t))) for t, v, c in rows])

        own = found.filter(F.size("tokens") == size).filter(new.asNondeterministic()("tokens", "verdict", "confidence")).collect()
        kept += sorted((MinedRule(frozenset(r[0]), r[1], r[2], r[3]) for r in own), key=MinedRule.order)
    return kept


class Index:
    """Rules under the token of theirs that is in fewest rules."""

    def __init__(self, rules: list[MinedRule]):
        counts: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                counts[t] = counts.get(t, 0) + 1
        self.by_token: dict[str, list[MinedRule]] = {}
        for r in rules:
            self.by_token.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(r)

    def fitting(self, tokens: set[str]) -> list[MinedRule]:
        return [r for t in tokens for r in self.by_token.get(t, ()) if r.tokens <= tokens]

    def decide(self, url: str | None) -> MinedRule | None:
        found = self.fitting(url_tokens(url))
        return min(found, key=MinedRule.order) if found else None


def judge(df: DataFrame, rules: list[MinedRule], listed_rules: list[ListedRule], url: str = "url", how: Mining = Mining()) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``verdict``, and ``mined``, ``confidence`` of the mined rule if one decided; columns of those names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(Index(rules))

    @F.arrow_udf("verdict string, mined string, confidence double")
    def by_mined(urls: pa.Array) -> pa.Array:
        found = [shared.value.decide(u) for u in urls.to_pylist()]
        columns = [
            pa.array([r.verdict if r else how.default for r in found], pa.string()),
            pa.array([" ".join(sorted(r.tokens)) if r else None for r in found], pa.string()),
            pa.array([r.confidence if r else None for r in found], pa.float64()),
        ]
        return pa.StructArray.from_arrays(columns, names=["verdict", "mined", "confidence"])

    value = F.col(url).cast("string")
    found = df.withColumn("__url", F.struct(url_host(value).alias("host"), url_path(value).alias("path"), by_mined.asNondeterministic()(value).alias("mined")))
    host, path, mined = F.col("__url")["host"], F.col("__url")["path"], F.col("__url")["mined"]
    text, verdict = listed(host, path, listed_rules)
    return found.withColumns(
        {
            "host": host,
            "path": path,
            "rule": text,
            "verdict": F.coalesce(verdict, mined["verdict"]),
            "mined": F.when(text.isNull(), mined["mined"]),
            "confidence": F.when(text.isNull(), mined["confidence"]),
        }
    ).drop("__url")


def with_listed_verdict(df: DataFrame, rules: list[ListedRule], url: str = "url", name: str = "label") -> DataFrame:
    """``df`` with the verdict of the longest listed rule, or null: the labels URLs bring themselves."""
    value = F.col(url).cast("string")
    return df.withColumn(name, listed(url_host(value), url_path(value), rules)[1])
