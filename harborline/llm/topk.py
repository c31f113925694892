"""Exact top-k search by inner product with histograms of all scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from harborline.session import written

EXACT = float(1 << 53)
LIMIT = 1 << 61


def scaled(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(double, lambda x: F.floor(x * scale)))


def matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products as long. Doubles are exact up to 2 ** 53; larger numbers go through Python's integers."""
    most = lambda m: float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0
    if queries.shape[1] * most(queries) * most(rows) < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    if exact.size and max(exact.max(), -exact.min()) > LIMIT:
        raise OverflowError("a score is beyond 2^61, the range that is searched")
    return exact.astype(np.int64)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    bins: int = 256,
    query_block: int = 1024,
    row_block: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "vec",
) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of ``queries``; ties to the smaller id.

    Both tables have an id and an array of long. Queries and rows are dealt to blocks by a hash, and each pair of blocks is
    one group, so a task holds at most about ``query_block`` x ``row_block`` scores however large the tables are.
    Every pass scores everything and counts, per query, the scores in ``bins`` equal steps of the range in which the
    query's k-th score is known to lie; the sums over all groups narrow the range to one step, until it holds one value. A
    group stops counting for a query once it alone has k scores in higher steps. Then rows above the k-th score
    are kept, and of those equal to it the k smallest ids of each group, which bounds ties; a rank ends it. Pass results
    are written to the shared folder; a lost executor costs the groups it held.

    Returns ``query_id``, ``rank`` (from 1), the id and ``score``. A row is never compared with a query of its own id. Null
    vectors and null ids take no part; vectors meet only those of equal length. Of rows that share an id, a query uses the
    smallest vector; repeated candidate rows all count. Fewer than k candidates are all returned. Components are long;
    a score outside +-2 ** 61 is an error. Empty tables give an empty table.
    """
    spark = vectors.sparkSession
    usable = F.col("id").isNotNull() & F.col("v").isNotNull()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(usable & (F.size("v") > 0))
    asked = queries.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(usable & (F.size("v") > 0))
    rows, asked = written(rows, "topk-rows"), written(asked.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    sizes = {name: df.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))).alias("sum"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).first() for name, df in (("rows", rows), ("asked", asked))}
    if not sizes["rows"]["n"] or not sizes["asked"]["n"]:
        return empty
    reach = int(min(float(LIMIT), sizes["asked"]["sum"] * sizes["rows"]["most"])) + 1
    query_blocks, row_blocks = -(-sizes["asked"]["n"] // query_block), -(-sizes["rows"]["n"] // row_block)

    def dealt(df: DataFrame, own: str, parts: int, other: str, times: int) -> DataFrame:
        own_block = F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias(own)
        return df.select("*", F.size("v").alias("dim"), own_block, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other))

    cell = ["dim", "qb", "rb"]
    right = dealt(rows, "rb", row_blocks, "qb", query_blocks).groupBy(*cell)

    def cells(state: DataFrame, work, schema: str) -> DataFrame:
        """``work`` over every pair of blocks; ``state`` has id, v, lo, hi and need of each query."""
        return dealt(state, "qb", query_blocks, "rb", row_blocks).groupBy(*cell).cogroup(right).applyInArrow(work, schema)

    def scored(left: pa.Table, right_: pa.Table):
        """Blocks of a few queries at a time: ids, row ids in order, scores, whether the row may answer, and the state."""
        if not left.num_rows or not right_.num_rows:
            return
        right_ = right_.sort_by("id")
        ids, rows_ = left.column("id").to_numpy(), right_.column("id").to_numpy()
        asked_, listed = matrix(left, "v"), matrix(right_, "v")
        lo, hi, need = (left.column(n).to_numpy() for n in ("lo", "hi", "need"))
        for i in range(0, len(ids), 128):
            j = slice(i, i + 128)
            yield ids[j], rows_, scores(asked_[j], listed), ids[j, None] != rows_[None, :], lo[j, None], hi[j, None], need[j, None]

    def table_of(names: list[str], parts: list[tuple]) -> pa.Table:
        columns = zip(*parts) if parts else [[np.zeros(0, np.int64)]] * len(names)
        return pa.table({name: np.concatenate(column).astype(np.int64) for name, column in zip(names, columns)})

    def count(left: pa.Table, right_: pa.Table) -> pa.Table:
        parts = []
        for ids, _, found, other, lo, hi, need in scored(left, right_):
            step = np.maximum(1, -((lo - hi) // bins))
            inside = other & (found >= lo) & (found < hi)
            slot = (found - lo) // step + bins * np.arange(len(ids))[:, None]
            n = np.bincount(slot[inside], minlength=bins * len(ids)).reshape(len(ids), bins)
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            i, at = np.nonzero((n > 0) & (above < need))
            parts.append((ids[i], at, n[i, at]))
        return table_of(["id", "bin", "n"], parts)

    def best(left: pa.Table, right_: pa.Table) -> pa.Table:
        parts = []
        for ids, rows_, found, other, lo, _, _ in scored(left, right_):
            equal = other & (found == lo)
            equal &= np.cumsum(equal, axis=1) <= k
            i, j = np.nonzero((other & (found > lo)) | equal)
            parts.append((ids[i], rows_[j], found[i, j]))
        return table_of(["query_id", "row", "score"], parts)

    state = asked.select("id", "v", F.lit(-reach).cast("long").alias("lo"), F.lit(reach + 1).cast("long").alias("hi"), F.lit(k).cast("long").alias("need"))
    span = 2 * reach + 1
    while span > 1:
        sums = cells(state, count, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("id").orderBy(F.desc("bin"))
        ranked = sums.select("id", "bin", "n", (F.sum("n").over(down) - F.col("n")).alias("above"))
        # The step that holds the k-th score; with fewer scores than k, the lowest step that has any.
        held = ranked.join(state.select("id", F.col("need").alias("wanted")), "id").where(F.col("above") < F.col("wanted"))
        held = held.groupBy("id").agg(F.min_by(F.struct("bin", "above"), "bin").alias("at"))
        step = F.expr(f"greatest(1L, (hi - lo + {bins - 1}) div {bins})")
        low = F.col("lo") + F.col("at.bin") * step
        state = state.join(held, "id").select("id", "v", low.alias("lo"), F.least("hi", low + step).alias("hi"), (F.col("need") - F.col("at.above")).alias("need"))
        state = written(state, "topk-state")
        span = -(-span // bins)
    found = cells(state, best, "query_id long, row long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("row").alias(id_col), "score")
