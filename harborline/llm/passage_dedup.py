"""Removal of every repeated byte string of a given length, with sharded suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field, unpacked
from harborline.llm.shingles import groups, mixed
from harborline.llm.suffixes import hashes, repeated_starts, span_hash
from harborline.session import written

GRAM = 16
PIECE = 1 << 22  # bytes of a text handled at once
POSITION_BITS = np.uint64(24)
SHARD_BYTES = 1 << 20

ANCHORS = "k1 long, k2 long, anchor long, seg long, lead int, start long, last long"


def anchors(data: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For the windows of ``size`` bytes of a text: hash, position, first and last window start, and name of each anchor's segment.

    The anchor of a window is its leftmost gram of GRAM bytes with the smallest hash. It depends on the window's bytes
    only, so equal windows have anchors of equal hash at the same place. Every window has exactly one anchor.
    """
    parts = []
    wide = size - GRAM + 1
    for base in range(0, max(0, len(data) - size + 1), PIECE):
        piece = data[base : base + PIECE + size - 1]
        at = np.arange(len(piece) - GRAM + 1)
        sums = hashes(piece)
        gram = mixed((sums[0][GRAM:] - sums[0][:-GRAM]) * sums[1][: len(at)])
        key = (gram >> POSITION_BITS << POSITION_BITS) | at.astype(np.uint64)
        rows = -(-len(key) // wide)
        block = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
        block[: len(key)] = key
        block = block.reshape(rows, wide)
        left = np.minimum.accumulate(block, axis=1).ravel()
        right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(key) - wide + 1
        least = np.minimum(right[:count], left[wide - 1 : wide - 1 + count])
        where = (least & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([first[1:], [count]]) - 1
        lead = where[first] - first
        seg = mixed(span_hash(sums, first, last + size) ^ (lead.astype(np.uint64) << np.uint64(32)) ^ (last - first).astype(np.uint64))
        parts.append((gram[where[first]], seg, lead, first + base, last + base))
    return tuple(np.concatenate(column) for column in zip(*parts))


def text_key() -> list:
    """A document by its id and text: rows that agree in both are the same for all that follows."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.coalesce("id", F.lit(0)), F.col("id").isNull()).alias("k1"), F.xxhash64(text).alias("k2")]


def remove_repeats(docs: DataFrame, size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove all bytes covered by a string of ``size`` bytes that starts anywhere else, in any document.

    Texts count as UTF-8 bytes, no string crosses documents, and repeats are judged on the input.

    1. Each window of ``size`` bytes belongs to the anchor that its bytes choose (see ``anchors``); the windows of one
       anchor are one segment of the text. Equal windows are in segments with equal anchors. Segments whose anchor is
       nowhere else end here, which is most of a clean corpus. Equal segments are counted once, with their number; all
       windows of a segment that is there twice are repeated.
    2. Different segments with the same anchor are divided: windows of one of PARTS ranges of distance from the anchor share a
       core of bytes, and the core's hash joins the key. Equal pieces are counted once again. Pieces that differ but share
       a key are compared by suffix arrays: they are dealt to shards by key, each shard of about SHARD_BYTES is sorted by
       induced sorting, and the common prefixes in text order tell which windows occur twice. A group too large for a
       shard (a passage that many documents embed) is halved by distance again, with a longer core, down to single
       windows, so every group gets small or turns out to be equal strings.
    3. The starts found are carried back to all places of a segment and merged per document.

    Work moves as hashes; text moves for the segments to compare, and once with the starts to its document.

    Returns the input's columns, then ``n_bytes``, ``n_removed``, ``removed`` (start and end of each maximal run, in bytes) and
    ``kept`` (the other bytes, as binary). Null texts are empty. Rows with equal id and text are different documents, so
    what they share is removed from both; a null id is an id like others. An empty table gives an empty table.
    """
    base = as_row(docs).select(field(id_col).cast("long").alias("id"), field(text_col).alias("text"))

    def find(batches):
        for batch in batches:
            k1, k2 = (batch.column(n).to_numpy() for n in ("k1", "k2"))
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            i = 0
            for group in groups(batch.column("text")):
                for text in group:
                    if len(text) >= size:
                        data = np.frombuffer(text, np.uint8)
                        gram, seg, lead, first, last = anchors(data, size)
                        ids = (np.full(len(gram), k[i]) for k in (k1, k2))
                        for column, values in zip(columns, (*ids, gram.view(np.int64), seg.view(np.int64), lead.astype(np.int32), first, last)):
                            column.append(values)
                    i += 1
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["k1", "k2", "anchor", "seg", "lead", "start", "last"])

    places = written(base.select(*text_key(), "text").mapInArrow(find, ANCHORS), "anchors")
    segments = places.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "last", "lead")).alias("at"))
    segments = written(segments.select("anchor", "seg", "n", "at.*"), "segments")
    shared = segments.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("n > 1")
    segments = segments.withColumnRenamed("n", "times").join(shared, "anchor")
    whole = segments.where("times > 1").select("anchor", "seg", F.lit(0).cast("long").alias("low"), (F.col("last") - F.col("start")).alias("high"))
    marks = written(whole, "repeats").unionByName(_compared(base, segments.where("kinds > 1"), size))

    runs = places.join(marks, ["anchor", "seg"]).select("k1", "k2", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high") + size).alias("end"))
    runs = runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))

    cut = F.arrow_udf(without_runs, "struct<n_bytes long, n_removed long, removed array<struct<start long, end long>>, kept binary>")
    packed = as_row(docs).withColumn("id", field(id_col).cast("long")).withColumn("text", field(text_col))
    joined = packed.select("row", *text_key(), "text").join(runs, ["k1", "k2"], "left").select("row", cut("text", "runs").alias("cut"))
    return unpacked(joined, n_bytes=F.col("cut.n_bytes"), n_removed=F.col("cut.n_removed"), removed=F.col("cut.removed"), kept=F.col("cut.kept"))


CUT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def without_runs(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text without the union of the given runs."""
    for text, runs in texts:
        out = []
        for value, spans in zip(text, runs):
            data = value.as_buffer().to_pybytes() if value.is_valid else b""
            merged: list[list[int]] = []
            for span in spans.as_py() or []:
                if merged and span["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span["end"])
                else:
                    merged.append([span["start"], span["end"]])
            ends = [0, *(end for _, end in merged)]
            kept = b"".join(data[a:b] for a, b in zip(ends, [*(start for start, _ in merged), len(data)]))
            out.append({"n_bytes": len(data), "n_removed": len(data) - len(kept), "removed": [{"start": a, "end": b} for a, b in merged], "kept": kept})
        yield pa.array(out, CUT)


def _compared(base: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Runs of window starts (relative to the segment) that occur in another segment of the same anchor."""
    spark = base.sparkSession
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "seg", "lead", "start", "last")).alias("segs"))

    def extract(batches):
        for batch in batches:
            rows = []
            for text, segs in zip(batch.column("text"), batch.column("segs")):
                data = text.as_buffer()
                for s in segs.as_py():
                    rows.append((s["anchor"], s["seg"], s["lead"], data.slice(s["start"], s["last"] - s["start"] + size).to_pybytes()))
                    if len(rows) >= 4096:
                        yield _segments(rows)
                        rows = []
            yield _segments(rows)

    texts = base.select(*text_key(), "text").join(per_text, ["k1", "k2"]).select("text", "segs")
    texts = written(texts.mapInArrow(extract, "anchor long, seg long, lead int, text binary"), "segment-texts").dropDuplicates(["anchor", "seg"])
    marks = []
    # key: what all rows of a group share; low, high: distances from a window's start to the anchor, for the row's windows.
    width = -(-(size - GRAM + 1) // PARTS)
    left = texts.select(F.col("anchor").alias("key"), "anchor", "seg", "lead", (F.col("lead") - F.length("text") + size).alias("low"), F.col("lead").alias("high"), "text")
    while True:
        rows = written(left.mapInArrow(_divided(size, width), f"{ROWS}, same long"), "segment-parts")
        same = rows.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("anchor", "seg", "lead", "low", "high")).alias("one"))
        same = written(same.select("key", "same", "n", "one.*"), "segment-pieces")
        twice = rows.join(same.where("n > 1").select("key", "same"), ["key", "same"])
        marks.append(written(twice.select("anchor", "seg", (F.col("lead") - F.col("high")).cast("long").alias("low"), (F.col("lead") - F.col("low")).cast("long").alias("high")), "repeats"))
        sized = same.groupBy("key").agg(F.sum(F.col("high") - F.col("low") + size).alias("bytes"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        sized = written(same.drop("n", "same").join(sized, "key"), "segment-groups")
        small = sized.where(F.col("bytes") <= SHARD_BYTES)
        total = small.agg(F.sum(F.col("high") - F.col("low") + size)).first()[0] or 0
        if total:
            shard = F.pmod(F.xxhash64("key"), F.lit(-(-total // SHARD_BYTES))).cast("int").alias("shard")
            shards = small.join(texts.select("anchor", "seg", "text"), ["anchor", "seg"]).select("anchor", "seg", "lead", "high", _piece(size).alias("text"), shard)
            marks.append(written(shards.groupBy("shard").applyInArrow(_sorted_shard(size), MARKS), "repeats"))
        large = sized.where(F.col("bytes") > SHARD_BYTES)
        if width == 1 or large.isEmpty():
            break
        width = -(-width // 2)
        large = large.drop("bytes", "kinds").join(texts.select("anchor", "seg", "text"), ["anchor", "seg"])
        left = large.select("key", "anchor", "seg", "lead", "low", "high", _piece(size).alias("text"))
    out = spark.createDataFrame([], MARKS)
    for each in marks:
        out = out.unionByName(each)
    return out


PARTS = 8
MARKS = "anchor long, seg long, low long, high long"
ROWS = "key long, anchor long, seg long, lead int, low int, high int"


def _piece(size: int):
    """The bytes of the windows at distances from low to high, out of the whole segment."""
    return F.expr(f"substring(text, lead - high + 1, high - low + {size})")


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    anchor, seg, lead, text = zip(*rows) if rows else ([],) * 4
    columns = [pa.array(anchor, pa.int64()), pa.array(seg, pa.int64()), pa.array(lead, pa.int32()), pa.array(text, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "lead", "text"])


def _sorted_shard(size: int):
    def work(table: pa.Table) -> pa.Table:
        starts = repeated_starts([t.as_buffer().to_pybytes() for t in table.column("text")], size)
        offset = (table.column("lead").to_numpy() - table.column("high").to_numpy()).tolist()
        out = []
        for i, at in enumerate(starts):
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
                last = np.concatenate([first[1:], [len(at)]]) - 1
                out.extend((i, int(a) + offset[i], int(b) + offset[i]) for a, b in zip(at[first], at[last]))
        rows, low, high = (list(c) for c in zip(*out)) if out else ([], [], [])
        return pa.table({"anchor": table.column("anchor").take(pa.array(rows, pa.int64())), "seg": table.column("seg").take(pa.array(rows, pa.int64())), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return work


def _divided(size: int, width: int):
    """Each row once per range of ``width`` distances that it has windows in, with the core of that range in its key.

    ``same`` names the bytes of the row's own windows in the range.
    """

    def work(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                yield _divided_rows(batch.slice(at, 2048), size, width)

    return work


def _divided_rows(batch: pa.RecordBatch, size: int, width: int) -> pa.RecordBatch:
    texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
    base = np.cumsum([0, *map(len, texts)])[:-1]
    sums = hashes(np.frombuffer(b"".join(texts), np.uint8))
    key, low, high = (batch.column(n).to_numpy() for n in ("key", "low", "high"))
    anchor = base + high  # a window at distance d starts at anchor - d
    parts = []
    for part in range(int(low.min()) // width, int(high.max()) // width + 1) if len(batch) else ():
        first, last = part * width, part * width + width - 1
        i = np.flatnonzero((low <= last) & (high >= first))
        near, far = np.maximum(low[i], first), np.minimum(high[i], last)
        core = span_hash(sums, anchor[i] - first, anchor[i] - last + size)
        piece = span_hash(sums, anchor[i] - far, anchor[i] - near + size)
        name = mixed(mixed(key[i].view(np.uint64) + np.uint64(part)) ^ core)
        same = mixed(piece ^ (near.astype(np.uint64) << np.uint64(32)) ^ far.astype(np.uint64))
        parts.append((i, name.view(np.int64), near.astype(np.int32), far.astype(np.int32), same.view(np.int64)))
    i, name, near, far, same = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
    kept = batch.select(["anchor", "seg", "lead"]).take(pa.array(i.astype(np.int64)))
    columns = [pa.array(name), *kept.columns, pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(same)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "anchor", "seg", "lead", "low", "high", "same"])
