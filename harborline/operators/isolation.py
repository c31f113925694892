"""Isolation forest: trees grown from small random samples, one Spark group per tree; scoring by partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TREE = "tree int, node int, feature int, split double, left int, right int, path double"


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def grow(df: DataFrame, features: list[str], trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """One row per node of every tree. A tree sees ``sample`` rows at most, which is what the method asks for."""
    total = df.count()
    wanted = trees * sample
    fraction = 1.3 * wanted / max(total, 1)
    # with replacement: a row may serve several trees, also when there are fewer rows than trees need
    drawn = df.select(*features).sample(True, fraction, seed).withColumn("_draw", F.rand(seed))
    # cut to the sample size before grouping: the sort keeps trees * sample rows per task
    drawn = drawn.orderBy("_draw").limit(wanted)
    dealt = drawn.withColumn("tree", F.pmod(F.hash("_draw"), F.lit(trees)).cast("int"))

    def grow_one(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        points = rows[features].to_numpy(dtype="float64")[:sample]
        random = np.random.default_rng(seed * 1000 + tree)
        limit = int(np.ceil(np.log2(max(2, len(points)))))
        nodes: list[list] = []

        def build(inside: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + _mean_path(len(inside))])
            low, high = inside.min(axis=0), inside.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth < limit and len(inside) > 1 and len(usable):
                feature = int(random.choice(usable))
                split = random.uniform(low[feature], high[feature])
                goes_left = inside[:, feature] <= split
                nodes[at][2:4] = [feature, float(split)]
                nodes[at][4] = build(inside[goes_left], depth + 1)
                nodes[at][5] = build(inside[~goes_left], depth + 1)
            return at

        build(points, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "path"])

    return dealt.groupBy("tree").applyInPandas(grow_one, schema=_TREE)


def score(df: DataFrame, features: list[str], forest: pd.DataFrame, sample: int = 256) -> DataFrame:
    """Add ``isolation`` (0..1, higher is more unusual). The forest has at most 2 * sample nodes per tree."""
    grown = [tree.sort_values("node") for _, tree in forest.groupby("tree")]
    trees = [{name: tree[name].to_numpy() for name in ("feature", "split", "left", "right", "path")} for tree in grown]
    norm = _mean_path(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch[features].to_numpy(dtype="float64")
            depth = np.zeros(len(points))
            for tree in trees:
                at = np.zeros(len(points), dtype="int64")
                while True:
                    feature = tree["feature"][at]
                    inner = np.flatnonzero(feature >= 0)
                    if not len(inner):
                        break
                    here = at[inner]
                    left = points[inner, feature[inner]] <= tree["split"][here]
                    at[inner] = np.where(left, tree["left"][here], tree["right"][here])
                depth += tree["path"][at]
            yield batch.assign(isolation=2.0 ** (-(depth / max(1, len(trees))) / norm))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", isolation double"
    return df.mapInPandas(run, schema=schema)
