"""Whitening of a table of vectors with distributed block matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field, unpacked
from harborline.session import written

ROWS, COLUMNS = 1024, 1024  # entries of a block
MAX_LONG = (1 << 63) - 1
EXACT = 1 << 53  # whole numbers below it are exact as doubles


def on_grid(vector: Column, scale: int = 1024, offset: int = 100000) -> Column:
    """``floor(scale * c) + offset`` of each component; null if the vector is null, empty or has a null or non-finite component.

    A component too large for an exact whole number is an error.
    """
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    large = F.raise_error(F.lit("a vector component is too large for the grid")).cast("long")
    cells = F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) * scale < EXACT, F.floor(c.cast("double") * scale).cast("long") + offset).otherwise(large))
    return F.when(F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False)), cells)


def whiten(vectors: DataFrame, components: int = 8, vector_col: str = "vec", block_rows: int = ROWS) -> DataFrame:
    """Project vectors of whole numbers on their principal components, scaled to unit variance.

    1. The rows with a vector get dense numbers (their place in the written table, from row counts per partition). Sums per
       dimension are exact. Centred rows become a ``BlockMatrix`` of ``block_rows`` rows a block.
    2. Its transpose times itself is the scatter matrix. The long middle dimension is cut into as many parts as there are
       blocks, so partial products are made where two blocks meet and added up; no task sees more than a few blocks.
    3. The scatter (dimensions x dimensions) comes to the driver, where its eigenvectors are found.
    4. The block matrix times the whitening matrix gives the projected rows, which are joined back by number.

    What reaches the driver: one count per partition, the sums, the scatter, and (inside MLlib) the numbers of the blocks.

    Returns the input's columns for each row with a vector, then ``n`` (rows of the fit), ``deviation`` (exact sum of
    (n * x - S)^2 as long, an error beyond its range), ``whitened`` and ``explained`` (one entry per component, by falling eigenvalue) and
    ``identity_error`` (largest absolute entry of the whitened rows' covariance minus the identity).

    Rows with a null vector are left out. Fewer components are returned when the vectors vary in fewer directions (an
    eigenvalue below the rounding of the largest one has no unit variance): equal vectors or a single one give empty lists. Repeated rows
    count as often as they occur. Vectors of several lengths have no common covariance, which is an error. An empty table
    gives an empty table. Input columns with the names of added ones are replaced.
    """
    spark = vectors.sparkSession
    packed = as_row(vectors)
    x = field(vector_col).cast("array<long>")
    placed = packed.where(x.isNotNull() & (F.size(x) > 0)).select("row", x.alias("x"), F.monotonically_increasing_id().alias("at"))
    placed = written(placed, "vectors")  # the place is fixed from here on, whatever is computed again
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).orderBy("part").collect()
    n = sum(r.n for r in counts)
    sizes = {r.low for r in counts} | {r.high for r in counts}
    if len(sizes) > 1:
        raise ValueError(f"vectors of {min(sizes)} and of {max(sizes)} components have no common covariance")
    width = sizes.pop() if sizes else 0
    if not n:
        values, kept = np.zeros(0), np.zeros((0, 0))
        total, projected = 0.0, None
    else:
        cells = placed.select(F.posexplode("x").alias("i", "c")).groupBy("i")
        sums = cells.agg(F.sum("c").alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).orderBy("i").collect()
        most = sum(max(abs(n * r.low - r.s), abs(n * r.high - r.s)) ** 2 for r in sums)
        kind = "long" if most <= MAX_LONG else "decimal(38,0)"  # the faster type where no row can leave it
        starts = {r.part: start for r, start in zip(counts, np.cumsum([0, *(r.n for r in counts)]).tolist())}
        offsets = F.create_map(*(F.lit(v) for pair in starts.items() for v in pair))
        numbered = placed.select("row", (offsets[part] + nth).alias("at"), _differences(F.col("x"), n, sums, kind).alias("apart"))
        blocks = _blocks(numbered, n, width, block_rows)
        covariance = _scatter(blocks, -(-n // block_rows)) / n
        values, directions = np.linalg.eigh(covariance)
        values, directions = values[::-1], directions[:, ::-1]
        total = float(np.trace(covariance))
        count = int((values[: min(components, width)] > values[0] * width * np.finfo(float).eps * 16).sum()) if values[0] > 0 else 0
        values, kept = values[:count], directions[:, :count] / np.sqrt(values[:count])
        projected = blocks.multiply(_small(spark, kept)) if count else None
    if projected is None:
        empty = F.array().cast("array<double>")
        out = placed.select("row", F.lit(n).cast("long").alias("n"), (_deviation(_differences(F.col("x"), n, sums, kind), kind) if n else F.lit(0)).cast("long").alias("deviation"), empty.alias("whitened"), F.lit(0.0).alias("identity_error"))
    else:
        lists = projected.blocks.map(lambda block: (block[0][0], block[1].toArray().tolist())).toDF("block long, rows array<array<double>>")
        rows = lists.select("block", F.posexplode("rows").alias("i", "whitened")).select((F.col("block") * block_rows + F.col("i")).alias("at"), "whitened")
        rows = written(rows, "whitened")
        k = len(values)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        apart = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j)) for i, j in pairs]
        error = float(rows.agg(F.greatest(*apart, F.lit(0.0))).first()[0])
        out = numbered.join(rows, "at").select("row", F.lit(n).cast("long").alias("n"), _deviation(F.col("apart"), kind).alias("deviation"), "whitened", F.lit(error).alias("identity_error"))
    explained = F.array(*(F.lit(float(e) / total) for e in values)).cast("array<double>")
    return unpacked(out, n=F.col("n"), deviation=F.col("deviation"), whitened=F.col("whitened"), explained=explained, identity_error=F.col("identity_error"))


def _differences(x: Column, n: int, sums: list, kind: str) -> Column:
    """n * x - S by dimension, exact."""
    totals = F.array(*(F.lit(r.s).cast(kind) for r in sums))
    return F.zip_with(x, totals, lambda c, s: (c.cast(kind) * F.lit(n).cast(kind) - s).cast(kind))


def _deviation(apart: Column, kind: str) -> Column:
    square = F.aggregate(apart, F.lit(0).cast(kind), lambda a, d: (a + d * d).cast(kind))
    return F.when(square <= F.lit(MAX_LONG).cast(kind), square.cast("long")).otherwise(F.raise_error(F.lit("a deviation leaves the range of long")).cast("long"))


def _blocks(numbered: DataFrame, n: int, width: int, block_rows: int) -> BlockMatrix:
    """Rows (``at``, ``apart`` as n times the centred row) as a block matrix; the blocks are a table of packed numbers."""

    def pack(key, table):
        order = np.argsort(table.column("at").to_numpy())
        rows = table.column("centred").combine_chunks().flatten().to_numpy().reshape(len(order), width)[order]
        cuts = [rows[:, start : start + COLUMNS] for start in range(0, width, COLUMNS)]
        return pa.table({"i": [key[0].as_py()] * len(cuts), "j": list(range(len(cuts))), "height": [len(order)] * len(cuts), "cells": pa.array([c.tobytes(order="F") for c in cuts], pa.binary())})

    centred = F.transform("apart", lambda d: d.cast("double") / float(n)).alias("centred")
    grouped = numbered.select("at", centred).groupBy(F.floor(F.col("at") / block_rows).cast("int").alias("i"))
    table = written(grouped.applyInArrow(pack, "i long, j long, height long, cells binary"), "blocks")
    matrices = table.rdd.map(lambda r: ((r.i, r.j), DenseMatrix(r.height, len(r.cells) // 8 // r.height, np.frombuffer(r.cells))))
    return BlockMatrix(matrices, block_rows, COLUMNS, n, width)


def _scatter(blocks: BlockMatrix, parts: int) -> np.ndarray:
    """The transpose of a tall block matrix times it, with its long dimension cut into ``parts``."""
    tall = blocks._java_matrix_wrapper._java_model
    return BlockMatrix(tall.transpose().multiply(tall, parts), COLUMNS, COLUMNS).toLocalMatrix().toArray()


def _small(spark, matrix: np.ndarray) -> BlockMatrix:
    """A matrix of the driver as a block matrix that fits behind one with COLUMNS columns a block."""
    cuts = [(i, matrix[start : start + COLUMNS]) for i, start in enumerate(range(0, len(matrix), COLUMNS))]
    blocks = [((i, 0), DenseMatrix(*part.shape, part.ravel(order="F"))) for i, part in cuts]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, len(blocks)), COLUMNS, matrix.shape[1], *matrix.shape)
