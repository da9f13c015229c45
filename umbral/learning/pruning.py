"""Cost-complexity pruning of regression trees.

A grown tree holds a nested sequence of subtrees: at complexity ``cost`` a node stays split only if that takes more than ``cost * error of the root`` off the
squared error for every leaf it adds. The sequence comes from the nodes alone (their number is bounded by the tree's depth, never by the rows). Judging it
takes one pass over the held-out rows whatever the number of subtrees: rows are added up by the leaf they fall into, and a leaf's sums give the error of each
of its ancestors, should the tree end there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.learning.models import decision_tree
from umbral.learning.prep import Recipe, bake, prep
from umbral.learning.tuning import MOST_FOLDS
from umbral.session import kept, scratch_path

#: Nodes of a tree that may travel to the driver.
MOST_NODES = 1 << 18


@dataclass(frozen=True)
class TreeNodes:
    """Nodes of a tree in the order parent, left branch, right branch; ``-1`` is no child. ``error`` is the squared error of the training rows."""

    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, model: DecisionTreeRegressionModel, path: str) -> TreeNodes:
        """Nodes of a model that is saved below ``path``."""
        if model.numNodes > MOST_NODES:
            raise ValueError(f"a tree of {model.numNodes} nodes is too large to be pruned: lower tree_depth or raise min_n")
        spark = _session(model)
        columns = ["leftChild", "rightChild", "prediction", (F.col("impurity") * F.col("impurityStats")[0]).alias("error")]
        rows = spark.read.parquet(f"{path}/data").orderBy("id").select(*columns).toArrow()
        return cls(*[rows.column(i).to_numpy() for i in range(4)])

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.left < 0)

    def parents(self) -> np.ndarray:
        out = np.full(len(self.left), -1)
        inner = np.flatnonzero(self.left >= 0)
        out[self.left[inner]] = out[self.right[inner]] = inner
        return out

    def collapse_at(self) -> np.ndarray:
        """The least cost at which each node is a leaf (0 for leaves), as a share of the root's error.

        The weakest link goes first: the node whose split saves least for every leaf it adds. That changes what its ancestors save.
        """
        parent, inner = self.parents(), self.left >= 0
        below, leaves = np.where(inner, 0.0, self.error), np.where(inner, 0, 1)
        for t in range(len(self.left) - 1, 0, -1):
            below[parent[t]] += below[t]
            leaves[parent[t]] += leaves[t]
        whole = self.error[0] if self.error[0] > 0 else 1.0
        out, ended = np.where(inner, np.inf, 0.0), ~inner

        def link(t: int) -> float:
            return max(0.0, (self.error[t] - below[t]) / (leaves[t] - 1)) / whole

        waiting = [(link(t), t) for t in np.flatnonzero(inner).tolist()]
        heapq.heapify(waiting)
        now = 0.0
        while waiting:
            saved, t = heapq.heappop(waiting)
            if ended[t] or saved != link(t):
                continue
            now = max(now, saved)
            out[t] = now
            gone, lost = below[t] - self.error[t], leaves[t] - 1
            under = [t]
            while under:
                k = under.pop()
                if not ended[k]:
                    ended[k] = True
                    under += [int(self.left[k]), int(self.right[k])]
            up = t
            while up >= 0:
                below[up] -= gone
                leaves[up] -= lost
                if not ended[up]:
                    heapq.heappush(waiting, (link(up), up))
                up = parent[up]
        return out

    def ends(self, costs: list[float]) -> np.ndarray:
        """For every cost and leaf, the node at which the pruned tree ends on the way to that leaf."""
        parent, at = self.parents(), self.collapse_at()
        costs = np.asarray(costs, float)[:, None]
        out = np.broadcast_to(self.leaves, (len(costs), len(self.leaves))).copy()
        up = parent[self.leaves]
        while (up >= 0).any():
            here = up >= 0
            out[:, here] = np.where(at[up[here]] <= costs, up[here], out[:, here])
            up = np.where(here, parent[up], -1)
        return out


def _session(model):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def saved_nodes(model: DecisionTreeRegressionModel) -> tuple[TreeNodes, str]:
    """The tree's nodes, and where its model is saved in the shared folder."""
    path = scratch_path(_session(model), "tree")
    model.write().save(path)
    return TreeNodes.of(model, path), path


def judge_subtrees(model: DecisionTreeRegressionModel, held: DataFrame, label: str, costs: list[float]) -> list[tuple[float, int]]:
    """``(rmse, leaves)`` of the subtree of every cost on the rows of ``held`` that have a label, from one pass; no rmse without such rows."""
    nodes, _ = saved_nodes(model)
    old = model.getLeafCol()
    placed = model.setLeafCol("__leaf").transform(held.filter(F.col(label).isNotNull()))
    model.setLeafCol(old)
    gap = F.col(label) - F.col(model.getPredictionCol())
    sums = placed.groupBy(F.col("__leaf").cast("int").alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("gap"), F.sum(gap * gap).alias("square")).toArrow()
    n, first, second = (np.zeros(len(nodes.leaves)) for _ in range(3))
    at = sums["leaf"].to_numpy()
    n[at], first[at], second[at] = sums["n"].to_numpy(), sums["gap"].to_numpy(), sums["square"].to_numpy()
    out = []
    for ends in nodes.ends(costs):
        shift = nodes.prediction[nodes.leaves] - nodes.prediction[ends]
        error = (second + 2 * shift * first + n * shift * shift).sum()
        out.append((float(np.sqrt(max(0.0, error) / n.sum())) if n.sum() else None, len(np.unique(ends))))
    return out


def prune(model: DecisionTreeRegressionModel, cost: float) -> DecisionTreeRegressionModel:
    """The subtree of one cost as a model like any other: it is saved, loaded and applied the same way."""
    nodes, path = saved_nodes(model)
    spark = _session(model)
    ended = nodes.collapse_at() <= cost
    kept_nodes, waiting = [], [0]
    while waiting:
        t = waiting.pop()
        kept_nodes.append(t)
        if not ended[t]:
            waiting += [int(nodes.right[t]), int(nodes.left[t])]
    number = {t: i for i, t in enumerate(kept_nodes)}
    table = spark.read.parquet(f"{path}/data")
    rows = {r["id"]: r.asDict(recursive=True) for r in table.collect()}
    pruned = []
    for t in kept_nodes:
        row = {**rows[t], "id": number[t]}
        if ended[t]:
            row |= {"gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        else:
            row |= {"leftChild": number[row["leftChild"]], "rightChild": number[row["rightChild"]]}
        pruned.append(row)
    target = scratch_path(spark, "pruned-tree")
    model.write().save(target)
    spark.createDataFrame(pruned, table.schema).coalesce(1).write.mode("overwrite").parquet(f"{target}/data")
    return DecisionTreeRegressionModel.load(target)


class PrunedTree(Estimator):
    """A regression tree that is grown (``grow`` has the parameters of ``decision_tree``) and pruned at ``cost``."""

    def __init__(self, label: str, cost: float = 0.01, **grow):
        super().__init__()
        self.label, self.cost, self.grow = label, float(cost), grow

    def _fit(self, df: DataFrame) -> DecisionTreeRegressionModel:
        return prune(decision_tree(self.label, **self.grow).fit(df.filter(F.col(self.label).isNotNull())), self.cost)


def pruned_tree(label: str, cost: float = 0.01, **grow) -> PrunedTree:
    return PrunedTree(label, cost, **grow)


def tune_pruned_tree(df: DataFrame, recipe: Recipe, label: str, costs: list[float], fold: str = "fold", **grow) -> DataFrame:
    """Cross-validation of all costs: one grown tree and one pass over the held-out rows for each fold.

    Returns ``(candidate, cost, fold, metric, value)`` with the metrics ``rmse`` and ``leaves``.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if not 2 <= len(folds) <= MOST_FOLDS:
        raise ValueError(f"{len(folds)} folds")
    rows = []
    for k in folds:
        train, held = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        prepared = prep(recipe, train)
        with kept(bake(prepared, train, [label])) as known:
            tree = decision_tree(label, **grow).fit(known.filter(F.col(label).isNotNull()))
        found = judge_subtrees(tree, bake(prepared, held, [label]), label, costs)
        for i, (cost, (value, leaves)) in enumerate(zip(costs, found, strict=True)):
            rows += [(i, float(cost), int(k), "rmse", value), (i, float(cost), int(k), "leaves", float(leaves))]
    return df.sparkSession.createDataFrame(rows, "candidate int, cost double, fold int, metric string, value double")
