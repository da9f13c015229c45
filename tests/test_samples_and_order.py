"""Splits, folds, down-sampling, running totals, quantiles and the ROC cut-off against brute force."""

import random

import numpy as np
import pytest

from umbral.learning import evaluate
from umbral.operators import sampling as K
from umbral.operators import running
from umbral.operators.running import exact_quantiles, place, running_totals


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(5000).selectExpr("id", "CAST(id % 7 = 0 AS INT) AS y").cache()


def test_splits_are_disjoint_and_complete(ids):
    for parts in (K.split_validation(ids, 0.15, "id", 1), K.split_three_way(ids, 0.15, 0.15, "id", 1)):
        found = [{r.id for r in p.collect()} for p in parts]
        assert sum(map(len, found)) == 5000 and len(set.union(*found)) == 5000
        assert 0.12 < len(found[1]) / 5000 < 0.18


def test_folds_cover_all_rows_evenly(ids):
    sizes = K.kfold(ids, 5, "id", 1).groupBy("fold").count().collect()
    assert sorted(r.fold for r in sizes) == list(range(5)) and sum(r["count"] for r in sizes) == 5000
    assert min(r["count"] for r in sizes) > 900


@pytest.mark.parametrize("parts", [1, 8])
def test_downsample_is_exact(ids, parts, monkeypatch):
    monkeypatch.setattr(K, "TRIM_ROWS", 50)
    out = K.downsample(ids.repartition(parts), "y", "id", 3).collect()
    small = sum(1 for i in range(5000) if i % 7 == 0)
    assert sum(r.y for r in out) == small
    assert len(out) - small == int(1.5 * small)
    assert len({r.id for r in out}) == len(out)
    assert {r.id for r in out} == {r.id for r in K.downsample(ids, "y", "id", 3).collect()}


def test_downsample_without_labels_and_below_one_row(spark):
    rows = [(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(15)] + [(200 + i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, y string")
    counts = {r[0]: r[1] for r in K.downsample(df, "y", "id", 3, under_ratio=1.0).groupBy("y").count().collect()}
    assert counts == {"a": 10, "b": 10}
    lone = spark.createDataFrame([(0, "a"), *[(i, "b") for i in range(1, 101)]], "id int, y string")
    assert K.downsample(lone, "y", "id", 3, under_ratio=0.5).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(4)
    values = sorted({round(rng.expovariate(1) ** 6, 6) for _ in range(2000)})
    rows = [(v, rng.randint(0, 5)) for v in values]
    df = spark.createDataFrame(rows, "v double, n long")
    got = running_totals(df, "v", ["n"], descending=descending, neighbour="after").collect()
    order = sorted(rows, reverse=descending)
    total, want = 0, {}
    for i, (v, n) in enumerate(order):
        total += n
        want[v] = (total, order[i + 1][0] if i + 1 < len(order) else None)
    assert {r.v: (r.cum_n, r.after) for r in got} == want
    assert {r.all_n for r in got} == {total}


def test_ranges_share_the_rows(spark):
    df = spark.range(10_000).selectExpr("pow(id / 10000, 8) AS v")
    sizes = [r["count"] for r in place(df, ["v"], ranges=20).groupBy("__range_v").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 700


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random(3001) < 0.35, 7.0, rng.normal(size=3001))
    b = rng.integers(0, 4, 3001).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {(r.name, r.probability): r.quantile for r in exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for name, data in (("a", a), ("b", b)):
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[name, p] == pytest.approx(np.quantile(data, p)), (name, p)


@pytest.mark.parametrize("accuracy,near", [(10_000, 5), (50, 40), (3, 1_000_000)])
def test_quantiles_are_exact_however_coarse_the_sketch(spark, monkeypatch, accuracy, near):
    monkeypatch.setattr(running, "ACCURACY", accuracy)
    monkeypatch.setattr(running, "MOST_NEAR", near)
    rng = np.random.default_rng(5)
    a, b = rng.pareto(0.5, 4000), np.where(rng.random(4000) < 0.6, 3.0, rng.normal(size=4000))
    rows = [(float(x), float(y), None, 2) for x, y in zip(a, b, strict=True)] + [(float("nan"), None, None, 2)]
    df = spark.createDataFrame(rows, "a double, b double, none double, one int").repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {(r.name, r.probability): r.quantile for r in exact_quantiles(df, ["a", "b", "none", "one"], at).collect()}
    want = {(n, p): pytest.approx(np.quantile(x, p)) for n, x in (("a", a), ("b", b), ("one", [2.0])) for p in at}
    assert got == want


def brute_roc(rows):
    pos = sum(y for y, _ in rows)
    neg = len(rows) - pos
    out = []
    for s in sorted({s for _, s in rows}):
        tp = sum(1 for y, v in rows if v >= s and y)
        fp = sum(1 for y, v in rows if v >= s and not y)
        out.append((s, tp / pos, 1 - fp / neg))
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_roc_curve_and_cutoff(spark, parts):
    rng = random.Random(9)
    # One score holds a third of all rows.
    rows = [(int(rng.random() < 0.4), 0.5 if rng.random() < 1 / 3 else round(rng.random(), 3)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "y int, s double").repartition(parts)
    want = brute_roc(rows)
    got = {r.score: (r.sensitivity, r.specificity) for r in evaluate.roc_curve(df, "y", "s").collect()}
    assert len(got) == len(want)
    for s, sens, spec in want:
        assert got[s] == (pytest.approx(sens), pytest.approx(spec))
    best = evaluate.roc_threshold(df, "y", "s").first()
    assert best.distance == pytest.approx(min((1 - a) ** 2 + (1 - b) ** 2 for _, a, b in want))
    pairs = [(p, n) for y, p in rows if y for z, n in rows if not z]
    area = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert evaluate.auc(df, "y", "s").first().auc == pytest.approx(area)
