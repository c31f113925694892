"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import SPACES, as_row, field, let, lower_ascii, shuffle_partitions, unpacked
from harborline.session import fresh_path, written

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


class LineIndex:
    """Hashes of all lines seen so far, kept as levels of sorted runs.

    A run is a Parquet table bucketed and sorted by the 128-bit hash of a line's key. ``add`` joins the distinct keys of
    a batch with every run, which needs no shuffle of the runs, and writes the keys that no run holds as a new run on
    level 0. Once a level holds ``fanout`` runs they are merged into one run of the next level, so the number of runs
    stays logarithmic in the number of batches and every hash is rewritten once per level. Runs are files in the shared
    folder: a lost executor costs a re-read only.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = 10):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _store(self, keys: DataFrame, *parts: str) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh_path(self.spark, "line-run")
        writer = keys.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY)
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        return name, path

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where(~F.col("earlier")).select(*KEY)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; gives per document (``id``, ``text_key``) the positions of the lines it loses.

        A line is lost if its key is in an earlier batch or in a smaller id of this batch.
        """
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where(F.col("id").isNotNull())
        lines = rows.select("id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= self.min_chars)
        lines = lines.select("id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))

        keys = lines.groupBy(*KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"))
        found = F.lit(False)
        for i, run in enumerate(self.runs):
            keys = keys.join(self._run(run).withColumn(f"in_{i}", F.lit(True)), KEY, "left")
            found = found | F.coalesce(f"in_{i}", F.lit(False))
        kind = dict(keys.dtypes)["first"]
        name, path = self._store(keys.select(*KEY, "first", "last", found.alias("earlier")), "earlier")

        # Read by path, without buckets: both sides are then shuffled and Spark can split a line that is everywhere.
        stored = self.spark.read.schema(f"h1 long, h2 long, first {kind}, last {kind}, earlier boolean").parquet(path)
        repeated = stored.where(F.col("earlier") | (F.col("first") < F.col("last")))
        repeated = repeated.select(*KEY, F.when(~F.col("earlier"), F.col("first")).alias("owner"))
        lost = lines.join(repeated, KEY).where(F.col("owner").isNull() | (F.col("owner") != F.col("id")))
        lost = written(lost.groupBy("id", "text_key").agg(F.collect_set("pos").alias("lost")), "lost-lines")
        self.levels[0].append(name)
        self._compact()
        return lost

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._run(runs[0])
            for run in runs[1:]:
                merged = merged.unionByName(self._run(run))
            merged = merged.repartition(self.buckets, *KEY).withColumn("earlier", F.lit(False))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._store(merged)[0])
            self._forget(runs)
            level += 1

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def close(self) -> None:
        """Take the runs out of the catalog; their files stay in the shared folder."""
        self._forget(self.runs)
        self.levels = [[]]


def dedup_lines(
    docs: DataFrame, batches: int = 4, fanout: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Drop repeated lines: a key found in several documents stays only in the document with the smallest id.

    Lines end at ``\\n``; a key is the line without white space at its ends and with A-Z in lower case. Keys shorter than
    ``min_chars`` code points never lose a line, and neither do repeats of a key inside its own document.

    Documents enter a ``LineIndex`` in ``batches`` ranges of ascending id, so the first run that holds a key belongs to the
    smallest id. The ranges come from approximate percentiles: they decide how much work a batch is, not the result.

    Returns the input's columns with ``text`` rewritten, then ``n_lines`` (before dropping) and ``n_dropped``.

    Null or empty text: one empty line, returned as an empty text. Null id: the row keeps all lines and owns none.
    Rows that share an id are one document. Repeated rows are each returned. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ident = F.col(f"`{id_col}`")
    cuts = docs.agg(F.percentile_approx(ident, [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()["cuts"] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    index, lost = LineIndex(spark, fanout, min_chars), None
    for low, high in zip(bounds, bounds[1:]):
        batch = docs
        if low is not None:
            batch = batch.where(ident > low)
        if high is not None:
            batch = batch.where(ident <= high)
        found = index.add(batch, id_col, text_col)
        lost = found if lost is None else lost.unionByName(found)
    index.close()

    text = F.coalesce(field(text_col), F.lit(""))
    packed = as_row(docs).select("row", field(id_col).alias("id"), F.xxhash64(text).alias("text_key"))
    joined = packed.join(lost, ["id", "text_key"], "left")
    lines = F.split(text, "\n")

    def rest(of: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(of) - 1), "lost")
        return F.array_join(F.transform(stay, lambda i: F.get(of, i)), "\n")

    kept = F.when(F.col("lost").isNull(), text).otherwise(let(lines, rest))
    return unpacked(
        joined,
        **{name: (kept if name == text_col else field(name)) for name in docs.columns if name.lower() not in ("n_lines", "n_dropped")},
        n_lines=F.size(lines).cast("long"),
        n_dropped=F.coalesce(F.size("lost"), F.lit(0)).cast("long"),
    )
