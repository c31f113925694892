"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field
from harborline.llm.graph import components
from harborline.session import written

TABLES, BITS = 4, 16  # a code has TABLES parts of BITS bits, each the key of one hash table
FITTED, FIT_ROWS = 8, 640  # so many lengths learn a rotation, from so many vectors at least; the others take a random frame


def fit_rotation(sample: np.ndarray, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Origin and projection (dimensions x code bits) whose signs are balanced codes with the least quantisation error.

    The origin stays where it is: taking off the mean would widen the angle between near vectors that share a direction, and
    with it the number of bits in which their codes differ. Principal directions are uncorrelated; the rotation is then refined in turns: best codes for the rotation,
    best rotation (orthogonal Procrustes) for the codes. With fewer dimensions than bits, the directions are repeated
    by a random orthonormal frame.
    """
    _, directions = np.linalg.eigh(sample.T @ sample)
    directions = directions[:, ::-1][:, : TABLES * BITS]
    rng = np.random.default_rng(seed)
    size, bits = directions.shape[1], TABLES * BITS
    projected = sample @ directions
    rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0][:size]
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ codes, full_matrices=False)
        rotation = left @ right
    return np.zeros(sample.shape[1]), directions @ rotation


@lru_cache(maxsize=FITTED)
def random_frame(length: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection that need no sample: random directions through the origin, orthonormal as far as the length allows."""
    rng, bits = np.random.default_rng(seed), TABLES * BITS
    return np.zeros(length), np.linalg.qr(rng.standard_normal((max(length, bits), bits)))[0][:length]


def by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their numbers as a matrix."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)


def coded(vectors: DataFrame, fits: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds ``code``: the parts of the binary code as an array of TABLES ints; ``fits`` has mean and projection by length."""

    @F.arrow_udf("array<int>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = 1 << np.arange(BITS)
        for batch in batches:
            parts = np.zeros((len(batch), TABLES), np.int32)
            for at, data in by_length(batch):
                length = data.shape[1]
                mean, projection = fits[length] if length in fits else random_frame(length)
                signs = ((data - mean) @ projection >= 0).reshape(len(at), TABLES, BITS)
                parts[at] = (signs * weights).sum(axis=2)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * TABLES), pa.array(parts.ravel()))

    return vectors.withColumn("code", code("v"))


def usable(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components, and not the zero vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    probe: int = 1,
    max_distance: int = 24,
    sample_rows: int = 20000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Link vectors of equal label and length whose cosine is at least ``threshold``, and group them.

    Every vector gets a 64-bit code. Each of the FITTED most common lengths learns a rotation on a fixed-size sample (its
    ``sample_rows`` smallest id hashes; the only bounded step); a length with few vectors and every further length is coded
    by random directions, which need no sample. Vectors with equal components and label are one class. Two classes are candidates if one of
    the four 16-bit parts of their codes differs in at most ``probe`` bits: each class enters the tables under its own
    key and looks up all keys within that distance, an equi-join on label, length, table and key. A pair is kept by the first table
    that finds it, so pairs need no de-duplication, then dropped if the whole codes differ in more than ``max_distance`` bits.
    At a cosine of 0.98 a bit differs with probability 0.064, so a pair at the threshold is missed with less than 1 %
    (measured against brute force in the tests). The rest is decided by the cosine of the original vectors in double precision:
    no pair below the threshold is linked. Nothing caps the candidates of a class.

    Returns one row per input row: id and label column, ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable, its own included) and ``kept`` (it is that smallest one).

    Null labels, null vectors, zero vectors and vectors with null or non-finite components link with nothing; so do rows
    without an id (their component is null). Vectors of different lengths are not linked. Repeated rows of one id
    count as links of each other. An empty table gives an empty table. Other columns are not read.
    """
    base = as_row(vectors).select(field(id_col).cast("long").alias("id"), field(label_col).alias("label"), F.transform(field(vector_col), lambda x: x.cast("double")).alias("v"))
    fit = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    lengths = fit.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(FITTED).collect()
    fits = {}
    for n, rows in lengths:
        if rows >= FIT_ROWS:
            sample = fit.where(F.size("v") == n).orderBy(F.xxhash64("id"), "id").select("v").limit(sample_rows).toPandas()["v"]
            data = np.stack(sample.to_numpy()).astype(np.float64)
            data /= np.abs(data).max(axis=1, keepdims=True)  # keeps the squares of tiny and huge numbers
            fits[n] = fit_rotation(data / np.linalg.norm(data, axis=1, keepdims=True))
    classes = fit.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members"))
    largest = F.array_max(F.transform("raw", lambda x: F.abs(x)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    scaled = classes.withColumn("raw", F.col("v")).withColumn("v", F.transform("raw", lambda x: x / largest)).withColumn("v", F.transform("v", lambda x: x / norm))
    classes = written(coded(scaled, fits).select("label", F.col("raw").alias("v"), F.size("raw").alias("length"), "id", "members", "code"), "vector-classes")
    pairs = written(_linked(classes, threshold, probe, max_distance), "vector-links")

    label_key = F.col("label")
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    other = classes.select(F.col("id").alias("other"), "members")
    linked = ends.join(other, "other").groupBy("id").agg(F.sum("members").alias("outside"))
    grouped = components(pairs).withColumnRenamed("component", "lowest")
    info = classes.select("label", "v", "id", "members").join(linked, "id", "left").join(grouped, "id", "left")
    info = info.select(label_key.alias("of_label"), F.col("v").alias("of_v"), F.col("id").alias("first"), (F.col("members") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), F.coalesce("lowest", "id").alias("lowest"))
    rows = base.withColumn("key", F.when(F.col("id").isNotNull() & usable(F.col("v")), F.col("v")))
    joined = rows.join(info, (F.col("label") == F.col("of_label")) & (F.col("key") == F.col("of_v")), "left")
    lowest = F.coalesce("lowest", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("label").alias(label_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        lowest.alias("component_id"),
        F.coalesce(lowest == F.col("id"), F.lit(False)).alias("kept"),
    )


def _linked(classes: DataFrame, threshold: float, probe: int, max_distance: int) -> DataFrame:
    """Pairs (a < b) of classes whose vectors have at least the threshold as cosine."""
    masks = [m for m in range(1 << BITS) if m.bit_count() <= probe]
    tables = F.posexplode("code").alias("table", "part")
    stored = classes.select(F.col("id").alias("b"), "label", "length", F.col("code").alias("code_b"), tables).withColumnRenamed("part", "key")
    asked = classes.select(F.col("id").alias("a"), "label", "length", F.col("code").alias("code_a"), tables)
    asked = asked.select("a", "label", "length", "code_a", "table", F.explode(F.transform(F.array(*(F.lit(m) for m in masks)), lambda m: F.col("part").bitwiseXOR(m))).alias("key"))
    apart = [F.bit_count(F.col("code_a")[i].bitwiseXOR(F.col("code_b")[i])) for i in range(TABLES)]
    earlier = F.lit(False)
    for i in range(TABLES - 1):
        earlier = earlier | ((F.col("table") > i) & (apart[i] <= probe))
    near = asked.join(stored, ["label", "length", "table", "key"]).where((F.col("a") < F.col("b")) & ~earlier & (sum(apart[1:], apart[0]) <= max_distance)).select("a", "b")
    near = near.join(classes.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(classes.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def rerank(batches):
        for batch in batches:
            cosine = np.zeros(len(batch))
            for (at, x), (_, y) in zip(by_length(batch.column("va")), by_length(batch.column("vb"))):  # both ends have one length
                x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))  # keeps the squares of tiny and huge numbers
                cosine[at] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("a", "b")], names=["a", "b"]).filter(pa.array(cosine >= threshold))

    return near.mapInArrow(rerank, "a long, b long")
