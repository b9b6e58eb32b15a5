"""Why an estimate is what it is: exact contributions of features to the predictions of boosted trees, and in money.

Trees are read from the model's saved form, a table of nodes. A leaf is a product of conditions, one for each feature on
its path, so its Shapley values depend only on which of these a row meets; they are worked out once for each such
pattern. Where a feature is unknown, a path's branches count by the training rows that took them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import scoring
from marketlens.scratch import folder

#: Nodes of all trees that are gathered and sent to all tasks; about 200 bytes each.
MOST_NODES = 2_000_000


@dataclass
class Condition:
    """What a path asks of a feature: ``low < x <= high`` or one of some categories; ``share`` of the rows went this way."""

    feature: int
    share: float = 1.0
    low: float = -np.inf
    high: float = np.inf
    categories: frozenset | None = None

    def holds(self, x: np.ndarray) -> np.ndarray:
        if self.categories is not None:
            return np.isin(x, list(self.categories))
        return (x > self.low) & (x <= self.high)


@dataclass
class Leaf:
    value: float
    conditions: list[Condition] = field(default_factory=list)
    _known: dict = field(default_factory=dict)
    _table: np.ndarray | None = None

    def shapley(self, patterns: np.ndarray) -> np.ndarray:
        """A table of the path's features (rows) by pattern (columns): contributions to rows that meet the conditions in
        ``patterns`` (bits). Only columns of patterns that were asked for are filled."""
        d = len(self.conditions)
        if self._table is None:
            self._table = np.zeros((d, 1 << d))
        new = [int(p) for p in np.flatnonzero(np.bincount(patterns, minlength=1 << d)) if int(p) not in self._known]
        shares = [c.share for c in self.conditions]
        for p in new:
            met = [float(p >> j & 1) for j in range(d)]
            out = []
            for j in range(d):
                # Coefficients of the product of (met * t + share) over the other features: by how many are known.
                by_known = np.ones(1)
                for k in range(d):
                    if k != j:
                        by_known = np.convolve(by_known, [shares[k], met[k]])
                weights = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
                out.append(self.value * (met[j] - shares[j]) * float(by_known @ weights))
            self._known[p] = True
            self._table[:, p] = out
        return self._table


@dataclass
class Trees:
    """Leaves of all trees, and the model's mean over its training rows."""

    base: float
    trees: list[list[Leaf]]


def _nodes(model) -> list[tuple[float, dict[int, dict]]]:
    """(weight, nodes by id) of each tree, from the model's saved form."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = folder(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    if (n := nodes.count()) > MOST_NODES:
        raise ValueError(f"{n} nodes; contributions are worked out for at most {MOST_NODES}")
    trees: dict[int, dict[int, dict]] = {}
    for r in nodes.collect():  # as large as the model, which the driver holds anyway
        trees.setdefault(r.treeID, {})[r.id] = r.asDict(recursive=True)
    return list(zip(model.treeWeights, (trees[i] for i in range(len(trees))), strict=True))


def read_trees(model) -> Trees:
    """The leaves of a fitted GBTRegressionModel."""
    out, base = [], 0.0
    for weight, nodes in _nodes(model):
        leaves: list[Leaf] = []
        todo: list[tuple[int, dict[int, Condition]]] = [(0, {})]
        while todo:
            i, conditions = todo.pop()
            node = nodes[i]
            if node["leftChild"] < 0:
                leaves.append(Leaf(weight * node["prediction"], list(conditions.values())))
                continue
            split = node["split"]
            j, values = split["featureIndex"], split["leftCategoriesOrThreshold"]
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                old = conditions.get(j, Condition(j))
                new = Condition(j, old.share * nodes[child]["rawCount"] / node["rawCount"], old.low, old.high, old.categories)
                if split["numCategories"] >= 0:
                    own = frozenset(values) if left else frozenset(map(float, range(split["numCategories"]))) - frozenset(values)
                    new.categories = own if old.categories is None else old.categories & own
                elif left:
                    new.high = min(old.high, values[0])
                else:
                    new.low = max(old.low, values[0])
                todo.append((child, conditions | {j: new}))
        base += sum(x.value * float(np.prod([c.share for c in x.conditions])) for x in leaves)
        out.append(leaves)
    return Trees(base, out)


def shapley(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Each feature's contribution to each row's prediction: base + sum of a row is its prediction."""
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    for leaves in trees.trees:
        for leaf in leaves:
            if not leaf.conditions:
                continue
            pattern = np.zeros(len(x), dtype=np.int64)
            for j, c in enumerate(leaf.conditions):
                pattern |= c.holds(columns[c.feature]).astype(np.int64) << j
            table = leaf.shapley(pattern)
            for j, c in enumerate(leaf.conditions):
                out[c.feature] += table[j].take(pattern)
    return out.T


def contributions(scored: DataFrame, trees: Trees, names: list[str], groups: dict[str, str] | None = None, features: str = "features", id_col: str = "id") -> DataFrame:
    """id, base and contributions (a map from feature, or its group, to the sum) of every row of ``scored``.

    ``names`` are the features in the vector's order; those without a group stand for themselves. No row is shuffled.
    """
    groups = groups or {}
    labels = list(dict.fromkeys(groups.get(n, n) for n in names))
    fold = np.zeros((len(names), len(labels)))
    for i, n in enumerate(names):
        fold[i, labels.index(groups.get(n, n))] = 1
    shared = scored.sparkSession.sparkContext.broadcast((trees, fold))
    kind = scored.schema[id_col].dataType.simpleString()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, fold = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            values = shapley(trees, x) @ fold
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * values.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], ["id", "c"])

    inputs = scored.select(F.col(id_col).alias("id"), vector_to_array(features).alias("x"))
    found = inputs.mapInArrow(explain, f"id {kind}, c array<double>")
    return found.select(F.col("id").alias(id_col), F.lit(float(trees.base)).alias("base"), F.map_from_arrays(F.array(*map(F.lit, labels)), "c").alias("contributions"))


def in_money(explained: DataFrame, deal: str = "sale", n: int = 5) -> DataFrame:
    """fair_price, factors_base, factors (the n greatest) and factors_other of every row, which add up exactly.

    The model predicts log1p(price). The difference between a row's price and the typical one, expm1(base), is dealt out
    by contribution: each is multiplied by the logarithmic mean of the two, so the shares add up without a rest. All
    three parts are rounded as prices are, and the rest of the factors is what rounding leaves.
    """
    pairs = F.transform(F.map_entries("contributions"), lambda e: F.struct(F.abs(e["value"]).alias("size"), e["key"].alias("factor"), e["value"].alias("impact")))
    total = F.aggregate("contributions_list", F.lit(0.0), lambda a, x: a + x["impact"])
    rounded = lambda c: scoring.rounded(c, F.lit(deal))
    rows = explained.withColumn("contributions_list", pairs).withColumn("log_fair", F.col("base") + total)
    # Greatest first; equal ones by name.
    order = lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["factor"] < b["factor"], -1).when(a["factor"] > b["factor"], 1).otherwise(0)
    top = F.slice(F.filter(F.array_sort("contributions_list", order), lambda x: x["size"] > 1e-9), 1, n)
    scale = scoring.log_mean(F.exp("log_fair"), F.exp("base"))
    rows = rows.withColumn("fair_price", rounded(F.expm1("log_fair"))).withColumn("factors_base", rounded(F.expm1("base"))).withColumn("_scale", scale)
    factor = lambda x: F.struct(x["factor"].alias("factor"), x["impact"].alias("impact"), F.bround(F.expm1(x["impact"]) * 100, 1).alias("impact_pct"), rounded(x["impact"] * F.col("_scale")).alias("amount"))
    rows = rows.withColumn("factors", F.transform(top, factor))
    shown = F.aggregate("factors", F.lit(0.0), lambda a, x: a + x["amount"])
    rows = rows.withColumn("factors_other", F.col("fair_price") - F.col("factors_base") - shown)
    return rows.drop("contributions_list", "_scale")
