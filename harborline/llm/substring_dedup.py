"""Removal of word passages that an earlier document holds, with fixed reference blocks as anchors."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from harborline.llm.common import as_row, field, shuffle_partitions, unpacked, words
from harborline.llm.shingles import IS_SPACE, mixed, powers
from harborline.session import fresh_path, written

GROUP_BYTES = 1 << 20  # text of one group of documents
PROBE_BYTES = 1 << 24  # text whose probes meet in one task
STORED_BYTES = 1 << 27  # text of one bucket of the stored groups
RUNS = "array<struct<start: bigint, end: bigint>>"
PIECE = 1 << 22  # bytes of a text handled at once
TAG_BITS = 30  # of a probe's hash that travel, beside its bucket


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of non-space bytes) of a text, made from a few MB of it at a time."""
    out = []
    base = 0
    while base < len(text):
        end = min(base + PIECE, len(text))
        while end < len(text) and not IS_SPACE[text[end]]:  # up to the next white space
            end += 1
        data = np.frombuffer(text, np.uint8, end - base, base)
        space = np.concatenate([[True], IS_SPACE[data], [True]])
        change = np.flatnonzero(space[1:] != space[:-1])
        start, stop = change[0::2], change[1::2]
        up, down = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        out.append(mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        base = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def run_sums(words: np.ndarray, salt: int = 0) -> np.ndarray:
    """Sums over a sequence of words from which ``run_hash`` gives the hash of any run of them."""
    if salt:
        words = mixed(words ^ np.uint64(salt))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words) + 1)[0][:-1])])


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


SALT = 0x5851F42D4C957F2D


class Group:
    """The documents of a group that have room for a window, as one sequence of words, and what repeats are found with."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, size: int):
        words, self.rows = [], []
        known = []
        for i, (ident, text) in enumerate(zip(ids, texts)):
            if ident.is_valid and text.is_valid and len(found := word_hashes(text.as_buffer().to_pybytes())) >= size:
                self.rows.append(i)
                known.append(ident.as_py())
                words.append(found)
        self.size, self.block = size, size // 2
        self.ids = np.array(known, np.int64)
        self.starts = np.cumsum([0, *map(len, words)])  # of each document in the sequence
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        self.owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        self.sums, self.other = run_sums(self.words), run_sums(self.words, SALT)

    def places(self, length: int) -> np.ndarray:
        """Where a run of ``length`` words begins that ends in the same document."""
        at = np.arange(len(self.words))
        return at[at + length <= self.starts[self.owner + 1]]

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits that name the words of each run."""
        out = np.empty(len(start), NAME)
        out["h1"], out["h2"] = run_hash(self.sums, start, end), run_hash(self.other, start, end)
        return out

    def probes(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of every rolling block, and its bucket and tag as one number."""
        at = self.places(self.block)
        h = run_hash(self.sums, at, at + self.block)
        return at, ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(TAG_BITS)) | (h & np.uint64((1 << TAG_BITS) - 1))

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 word of what the windows that hold the blocks at these places cover."""
        reach = self.size - self.block
        return np.maximum(at - reach, self.starts[self.owner[at]]), np.minimum(at + self.size, self.starts[self.owner[at] + 1])


NAME = np.dtype([("h1", np.uint64), ("h2", np.uint64)])
NAMED = "h1 long, h2 long, gid long, low long, high long"


def _named(gid: int, names: np.ndarray, ids: np.ndarray, block: np.ndarray | None = None) -> pa.Table:
    """Each distinct name once, with the smallest and the largest id that has it."""
    order = np.lexsort((ids, names["h2"], names["h1"]))
    names, ids = names[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(names)) - 1 if len(names) else first
    columns = {"h1": names["h1"][first].view(np.int64), "h2": names["h2"][first].view(np.int64), "gid": np.full(len(first), gid), "low": ids[first], "high": ids[last]}
    if block is not None:
        columns["block"] = block[order][first].view(np.int64)
    return pa.table(columns)


def _lookup(names: np.ndarray, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``names`` are in ``known`` (columns h1 and h2, distinct), and in which of its rows."""
    keys = np.empty(len(known), NAME)
    for part in ("h1", "h2"):
        keys[part] = known.column(part).to_numpy().view(np.uint64)
    order = np.lexsort((keys["h2"], keys["h1"]))
    keys = keys[order]
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.flatnonzero(keys["h1"][np.searchsorted(keys["h1"], names["h1"]).clip(max=len(keys) - 1)] == names["h1"])
    # Names that share the first half stand side by side; the search goes on by the second half.
    at = np.searchsorted(keys["h1"], names["h1"][near])
    while True:
        ahead = (keys["h1"][at] == names["h1"][near]) & (keys["h2"][at] < names["h2"][near]) & (at + 1 < len(keys))
        if not ahead.any():
            break
        at = at + ahead
    same = keys[at] == names[near]
    return near[same], order[at[same]]


def _probes(size: int, buckets: int):
    def work(key, table):
        group = Group(table.column("id"), table.column("text"), size)
        at, code = group.probes(buckets)
        order = np.argsort(code, kind="stable")  # documents stay in order within a code
        at, code = at[order], code[order]
        if not len(at):
            return pa.table({"bucket": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "tags": pa.array([], pa.binary())})
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        last = np.append(first[1:], len(code)) - 1
        is_block = (at - group.starts[group.owner[at]]) % group.block == 0
        marks = np.logical_or.reduceat(is_block, first) * 2 + (group.owner[at[first]] != group.owner[at[last]])
        code = code[first]
        tags = (code & np.uint64((1 << TAG_BITS) - 1)).astype(np.uint32) << np.uint32(2) | marks.astype(np.uint32)
        bucket = (code >> np.uint64(TAG_BITS)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        parts = [part.tobytes() for part in np.split(tags, cuts[1:])]
        return pa.table({"bucket": bucket[cuts], "gid": np.full(len(cuts), key[0].as_py()), "tags": pa.array(parts, pa.binary())})

    return work


def _met(key, table):
    """Of the tags of a bucket those that are a reference block of one document and are found in another, by group."""
    parts = [np.frombuffer(t.as_buffer(), np.uint32) for t in table.column("tags")]
    tags = np.concatenate(parts)
    order = np.argsort(tags >> np.uint32(2), kind="stable")
    tag = tags[order] >> np.uint32(2)
    first = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
    times = np.diff(np.append(first, len(tag)))  # a group has a tag once
    marks = np.bitwise_or.reduceat(tags[order] & np.uint32(3), first)
    hit = np.empty(len(tags), bool)
    hit[order] = np.repeat((marks & 2 > 0) & ((times > 1) | (marks & 1 > 0)), times)
    ends = np.cumsum([len(p) for p in parts])[:-1]
    out = [(p[h] >> np.uint32(2)).tobytes() for p, h in zip(parts, np.split(hit, ends))]
    found = pa.table({"bucket": table.column("bucket"), "gid": table.column("gid"), "tags": pa.array(out, pa.binary())})
    return found.filter(pa.array([len(o) > 0 for o in out], pa.bool_()))


def _extents(size: int, buckets: int):
    def work(key, texts, hits):
        group = Group(texts.column("id"), texts.column("text"), size)
        codes = [np.frombuffer(t.as_buffer(), np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(TAG_BITS)) for b, t in zip(hits.column("bucket").to_pylist(), hits.column("tags"))]
        at, code = group.probes(buckets)
        at = at[np.isin(code, np.concatenate([np.zeros(0, np.uint64), *codes]))]
        block = run_hash(group.sums, at, at + group.block)
        gid = key[0].as_py()
        return _named(gid, group.names(*group.around(at)), group.ids[group.owner[at]], block)

    return work


def _windows(size: int):
    def work(key, texts, known):
        group = Group(texts.column("id"), texts.column("text"), size)
        at = group.places(group.block)
        start, end = group.around(at)
        near, row = _lookup(group.names(start, end), known)
        mine = group.ids[group.owner[at[near]]] == known.column("first").to_numpy()[row]
        near = near[mine]
        # Marks of first and last window start, summed up, tell which windows lie in an extent.
        opened = np.zeros(len(group.words) + 1, np.int64)
        np.add.at(opened, start[near], 1)
        np.add.at(opened, end[near] - size + 1, -1)
        at = np.flatnonzero(np.cumsum(opened) > 0)
        return _named(key[0].as_py(), group.names(at, at + size), group.ids[group.owner[at]])

    return work


CUT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())]


def _cut(size: int, id_col: str, text_col: str):
    def work(key, rows, known):
        row = rows.column("row").combine_chunks()
        texts, ids = (pc.struct_field(row, name) for name in (text_col, id_col))
        group = Group(ids.cast(pa.int64()), texts.cast(pa.string()), size)
        covered = np.zeros(len(group.words) + 1, np.int64)
        blocks, windows = group.places(group.block), group.places(size)
        for (start, end), whole in ((group.around(blocks), True), ((windows, windows + size), False)):
            part = known.filter(pc.equal(known.column("extent"), whole))
            near, at = _lookup(group.names(start, end), part)
            later = group.ids[group.owner[start[near]]] > part.column("first").to_numpy()[at]
            np.add.at(covered, start[near[later]], 1)
            np.add.at(covered, end[near[later]], -1)
        gone = np.cumsum(covered)[:-1] > 0
        place = {i: k for k, i in enumerate(group.rows)}
        out = []
        for i, text in enumerate(texts):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            runs = []
            if i in place:
                lost = np.concatenate([[False], gone[group.starts[place[i]] : group.starts[place[i] + 1]], [False]])
                edges = np.flatnonzero(lost[1:] != lost[:-1]).tolist()
                runs = list(zip(edges[0::2], edges[1::2]))
            ends = [0, *(b for _, b in runs)]
            kept = [w for a, b in zip(ends, [*(a for a, _ in runs), len(words)]) for w in words[a:b]]
            out.append((len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in runs], b" ".join(kept).decode()))
        columns = zip(*out) if out else [[]] * len(CUT)
        return pa.table({"row": row} | {name: pa.array(list(values), kind) for (name, kind), values in zip(CUT, columns)})

    return work


def remove_passages(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove all words covered by ``size`` consecutive words that also occur in a document with a smaller id.

    Words are runs of characters other than white space, unchanged. Windows are judged on the input.

    1. Index and probe. Each document is cut into non-overlapping reference blocks of size / 2 words; every window holds a whole
       block of its document. Every rolling run of that length, of every document, is looked up among the blocks. For that, documents are dealt
       to groups of about GROUP_BYTES of text by a hash of id and text, and stored in buckets by group. A group sends each
       distinct probe hash once to the bucket of the hash, with two marks (is it a reference block, do two documents of the group
       have it), and gets back the hashes that are a block of one document and occur in another. What is very frequent
       travels once per group.
    2. Extend. A hit is extended on both sides to all words that the windows around it cover. Equal extents (128-bit names)
       are one class: in all but its smallest document the whole extent is removed, which settles the inside of long
       repeats. Where classes share a block but differ further out, the smallest document of each class is extended window by
       window: the smallest document of each window is its owner.
    3. What is in a class or window whose first document is smaller is removed; runs of it are the maximal exact repeats.

    Hits are never paired with each other, so a passage in n documents costs n extents, whatever n is.

    Returns the input's columns, then ``n_words``, ``n_removed``, ``removed`` (first and last + 1 word of each maximal run) and ``kept``
    (the other words, joined by one space). Null and empty texts have no words. Documents without an id lose nothing and
    cause no loss. Rows with the same id count as one document: none of them is smaller. A very long text makes a large group;
    its bytes are read a few MB at a time. An empty table gives an empty table. Input columns with the names of added ones are replaced.
    """
    if size % 2:
        raise ValueError("the window must have an even number of words")
    spark = docs.sparkSession
    ident, text = field(id_col).cast("long"), field(text_col).cast("string")
    packed = as_row(docs)
    # A text of so few bytes cannot hold a window; neither it nor a text without an id needs to meet others.
    apart = ident.isNull() | text.isNull() | (F.octet_length(text) < 2 * size - 1)
    rest = words(text)
    alone = packed.where(apart).select("row", F.size(rest).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(RUNS).alias("removed"), F.array_join(rest, " ").alias("kept"))
    packed = packed.where(~apart)
    total = packed.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_groups, n_probes, n_buckets = (max(1, -(-total // each)) for each in (GROUP_BYTES, PROBE_BYTES, STORED_BYTES))
    n_buckets = max(n_buckets, shuffle_partitions(spark))
    gid = F.pmod(F.xxhash64(ident, text), F.lit(n_groups)).alias("gid")
    name = f"passage_texts_{uuid.uuid4().hex}"
    writer = packed.select(gid, "row").repartition(n_buckets, "gid").write.format("parquet").option("path", fresh_path(spark, "passage-texts"))
    writer.bucketBy(n_buckets, "gid").sortBy("gid").saveAsTable(name)
    stored = spark.table(name)
    texts = stored.select("gid", ident.alias("id"), text.alias("text"))

    probes = texts.groupBy("gid").applyInArrow(_probes(size, n_probes), "bucket long, gid long, tags binary")
    hits = written(probes.groupBy("bucket").applyInArrow(_met, "bucket long, gid long, tags binary"), "block-hits")
    extents = texts.groupBy("gid").cogroup(hits.groupBy("gid")).applyInArrow(_extents(size, n_probes), f"{NAMED}, block long")
    extents = written(extents, "extents")
    classes = extents.groupBy("block", "h1", "h2").agg(F.min("low").alias("first"), F.max("high").alias("final"))
    kinds = classes.groupBy("block").agg((F.count(F.lit(1)) > 1).alias("shared"))
    classes = written(classes.join(kinds, "block"), "extent-classes")
    settled = extents.join(classes.where(F.col("shared") | (F.col("first") < F.col("final"))), ["block", "h1", "h2"])
    settled = written(settled.select("gid", "h1", "h2", "low", "high", "first", "shared"), "extents-settled")

    opened = settled.where(F.col("shared") & (F.col("low") == F.col("first"))).select("gid", "h1", "h2", "first")
    windows = texts.groupBy("gid").cogroup(opened.groupBy("gid")).applyInArrow(_windows(size), NAMED)
    windows = written(windows, "windows")
    owners = windows.groupBy("h1", "h2").agg(F.min("low").alias("first"), F.max("high").alias("final")).where("first < final").drop("final")
    owned = windows.join(owners, ["h1", "h2"]).where("high > first").select("gid", "h1", "h2", "first", F.lit(False).alias("extent"))
    known = owned.unionByName(settled.where("high > first").select("gid", "h1", "h2", "first", F.lit(True).alias("extent")))

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(span)), StructField("kept", StringType())]
    rows = stored.groupBy("gid").cogroup(known.groupBy("gid"))
    out = rows.applyInArrow(_cut(size, id_col, text_col), StructType([stored.schema["row"], *added]))
    out = out.unionByName(alone)
    spark.sql(f"DROP TABLE {name}")  # out of the catalog only: the plan above goes on reading its files
    return unpacked(out, n_words=F.col("n_words"), n_removed=F.col("n_removed"), removed=F.col("removed"), kept=F.col("kept"))
