"""Near-duplicate documents by the Jaccard similarity of their word shingles, exactly."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field
from harborline.llm.graph import components
from harborline.llm.shingles import groups, mixed, shingle_sets
from harborline.session import written

BUCKET_BITS = 21
CHUNK = 1 << 12  # buckets in one row of counts
MOST = (1 << 32) - 1
ORDERS = [np.uint64(0x1F83D9AB), np.uint64(0x5BE0CD19), np.uint64(0x9B05688C)]
HUB_ROUNDS = 1


def prefix_size(n: int, percent: int) -> int:
    """Two sets that reach the threshold share one of these many first tokens of either, under any common order."""
    return n - (percent * n + 99) // 100 + 1


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefix(tokens: np.ndarray, counts: np.ndarray, order: np.uint64, percent: int) -> np.ndarray:
    """First tokens under an order: rare hash buckets first, among equal counts by a hash of the token and the order."""
    key = (counts[bucket(tokens)].astype(np.uint64) << np.uint64(32)) | (mixed(tokens ^ order) >> np.uint64(32))
    return tokens[np.argsort(key, kind="stable")[: prefix_size(len(tokens), percent)]]


def signature(tokens: np.ndarray) -> int:
    """A 63-bit name of the set; documents with the same set are one class."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little") >> 1


def parity(tokens: np.ndarray) -> bytes:
    """One bit per hash slot, set if an odd number of tokens falls into it; about two slots a token, a power of two."""
    slots = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """False only if the sets cannot reach the threshold: slots that differ need a token that only one of them has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):  # the longer one in fewer slots
        long_ = a if len(a) > len(b) else b
        half = long_[: len(long_) // 2] ^ long_[len(long_) // 2 :]
        a, b = (half, b) if long_ is a else (a, half)
    most = (n + m - int(np.bitwise_count(a ^ b).sum())) // 2
    return 100 * most >= percent * (n + m - most)


def _summaries(batches):
    """(id, class, n, parity) of every text, then (chunk, counts) of the shingles of all texts of the task."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    names = ["id", "class", "n", "parity", "chunk", "counts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    for batch in batches:
        sets = [s for group in groups(batch.column(1)) for s in shingle_sets(group)]
        for s in sets:
            np.add.at(counts, bucket(s), 1)
        size = len(sets)
        columns = [batch.column(0), [signature(s) if len(s) else None for s in sets], [len(s) for s in sets], [parity(s) for s in sets], [None] * size, [None] * size]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    parts = counts.reshape(-1, CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    packed = [zlib.compress(parts[i].astype(np.min_scalar_type(parts[i].max())).tobytes(), 1) for i in used]
    columns = [[None] * len(used)] * 4 + [used, packed]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _totals(batches):
    """Sums of the counts of each chunk; a task holds no more than one number per bucket, however many rows come in."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = zlib.decompress(data)
            counts = np.frombuffer(data, f"u{len(data) // CHUNK}")
            total[chunk] = np.minimum(total.get(chunk, 0) + counts.astype(np.int64), MOST)
    packed = [total[chunk].astype(np.uint32).tobytes() for chunk in total]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])


def near_documents(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents that are linked by near-equal sets of five-word shingles.

    Words are runs of characters other than white space, A-Z in lower case. Two documents are linked if
    100 * intersection >= ``percent`` * union of their sets of distinct shingles; groups are the connected components.

    1. Documents with equal sets are one class. One pass names the classes and counts all shingles in 2 ** 21 hash buckets.
    2. Several global token orders put tokens of rare buckets first and differ in the hash that orders a bucket. Two sets
       that reach the threshold share a token of their prefixes under every order. The prefixes under the first order are
       shuffled by token; tokens of one class only end here, which leaves the documents that can have a partner.
    3. The first token two sets share leaves no more common tokens than follow it in either, so a pair is listed at a token
       only if its positions allow the threshold. Then the sizes and a parity bitmap of a few bits per shingle must allow it.
       Then the pair must share prefix tokens under each other order as well before its whole sets are compared.
    4. Pairs inside the classes of a token are not all listed. First each token compares all its classes with one hub, the
       class that has the token first, which is the one with the fewest rare tokens of its own;
       what the hub links is one component. Then pairs of classes that share a token are compared unless they already are
       in one component, where another link changes nothing. So a large group of copies costs a multiple of its size, and no
       link between components is lost.

    Texts of documents that can have a partner are joined once and read from a table in the shared folder; sets are built
    again from them where a pair is compared, since texts are smaller. No list of classes, pairs or links reaches the driver; the
    bucket counts do, 8 MB for any input.

    Returns per input row: id column, ``n_shingles`` and ``component_id`` (the smallest id reachable, its own included).

    Null and empty texts and texts without words have no shingle and are linked with nothing; a text of one to four words has
    its whole sequence as one. Rows without an id are linked with nothing and have no component. Repeated rows fall into
    one class. An empty table gives an empty table. Other columns are not read.
    """
    base = as_row(docs).select(field(id_col).cast("long").alias("id"), field(text_col).alias("text"))
    found = written(base.mapInArrow(_summaries, "id long, class long, n int, parity binary, chunk int, counts binary"), "shingle-sets")
    sets = found.where("chunk IS NULL").select("id", "class", "n", "parity")
    chunks = found.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    counts = np.zeros(((1 << BUCKET_BITS) // CHUNK, CHUNK), np.uint32)
    for row in chunks.mapInArrow(_totals, "chunk int, counts binary").collect():
        counts[row["chunk"]] = np.frombuffer(row["counts"], np.uint32)
    counts = docs.sparkSession.sparkContext.broadcast(counts.ravel())

    def prefixes(batches):
        seen = set()  # classes of this task: a copy has the same prefix
        for batch in batches:
            for group in groups(batch.column(0)):
                tokens, classes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for s in shingle_sets(group):
                    name = signature(s)
                    if len(s) and name not in seen:
                        seen.add(name)
                        tokens.append(prefix(s, counts.value, ORDERS[0], percent))
                        classes.append(np.full(len(tokens[-1]), name))
                        places.append((len(s) << 32) + np.arange(len(tokens[-1])))
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(classes), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "class", "place"])

    known = base.where(F.col("id").isNotNull())
    rows = known.select("text").mapInArrow(prefixes, "token long, class long, place long")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    size, position = F.shiftright("place", 32).cast("int").alias("size"), F.col("place").bitwiseAND(F.lit(MOST)).cast("int").alias("pos")
    members = written(rows.join(shared, "token").distinct().select("token", "class", size, position), "prefix-members")
    sizes = sets.where("id IS NOT NULL AND class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id", "n", "parity")).alias("one")).select("class", "one.*")
    sizes = written(sizes, "shingle-classes")
    links = _links(known, sizes, members, counts, percent)
    grouped = components(links)

    rows = sets.join(grouped.withColumnRenamed("id", "class"), "class", "left").select("id", "n", F.coalesce("component", "class").alias("group"))
    lowest = rows.where("group IS NOT NULL AND id IS NOT NULL").groupBy("group").agg(F.min("id").alias("lowest"))
    joined = rows.join(lowest, "group", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("lowest", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def _links(known: DataFrame, sizes: DataFrame, members: DataFrame, counts, percent: int) -> DataFrame:
    """Links (a, b) between classes that give the same components as all links."""
    wanted = sizes.join(members.select("class").distinct(), "class").select("class", "id")
    texts = written(known.join(wanted, "id").select("class", "text").dropDuplicates(["class"]), "candidate-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs that are linked; most others end before texts are read."""
        n = sizes.select("class", "n", "parity")
        pairs = pairs.join(n.toDF("a", "na", "pa"), "a").join(n.toDF("b", "nb", "pb"), "b").where(near)
        pairs = written(pairs.mapInArrow(possible, "a long, b long"), "possible-pairs")
        sides = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
        sides = sides.join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
        return written(sides.mapInArrow(check, "a long, b long"), "class-links")

    def possible(batches):
        for batch in batches:
            sides = zip(*(batch.column(n).to_pylist() for n in ("pa", "na", "pb", "nb")))
            hits = [may_link(x, n, y, m, percent) for x, n, y, m in sides]
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    def check(batches):
        for batch in batches:
            hits = []
            cache: dict[int, np.ndarray] = {}
            for i in range(len(batch)):
                x, y = (_set_of(batch, i, key, text, cache) for key, text in (("a", "ta"), ("b", "tb")))
                hits.append(_linked(x, y, counts.value, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hits, pa.bool_()))

    near = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    # A common token leaves both sets no more common tokens than follow it there; for the first one that bound must do.
    room = F.least(F.col("size") - F.col("pos"), F.col("other_size") - F.col("other_pos")).cast("long") * (100 + percent)
    allowed = (F.col("group") != F.col("other_group")) & (room >= (F.col("size").cast("long") + F.col("other_size")) * percent)

    def partners(frame: DataFrame) -> DataFrame:
        renamed = {"class": "other", "group": "other_group", "size": "other_size", "pos": "other_pos"}
        return frame.select("token", *(F.col(old).alias(new) for old, new in renamed.items()))

    links = None
    left = members.withColumn("group", F.col("class"))
    for turn in range(HUB_ROUNDS):
        first = F.min(F.struct("pos", F.xxhash64("class", F.lit(turn)).alias("h"), "class", "group", "size")).alias("hub")
        hubs = partners(left.groupBy("token").agg(first).select("token", "hub.*"))
        pairs = left.join(hubs, "token").where(allowed)
        pairs = pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        new = verified(pairs)
        links = new if links is None else links.union(new)
        group = written(components(links), "class-groups").withColumnRenamed("id", "class")
        left = members.join(group, "class", "left").select("token", "class", "size", "pos", F.coalesce("component", "class").alias("group"))
        split = left.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token")
        left = written(left.join(split, "token"), "split-tokens")
    pairs = left.join(partners(left), "token").where((F.col("class") < F.col("other")) & allowed)
    return links.union(verified(pairs.select(F.col("class").alias("a"), F.col("other").alias("b")).distinct()))


def _set_of(batch: pa.RecordBatch, i: int, key: str, text: str, cache: dict[int, np.ndarray]) -> np.ndarray:
    name = batch.column(key)[i].as_py()
    if name not in cache:
        if len(cache) > 256:
            cache.clear()
        cache[name] = shingle_sets([batch.column(text)[i].as_buffer().to_pybytes()])[0]
    return cache[name]


def _linked(x: np.ndarray, y: np.ndarray, counts: np.ndarray, percent: int) -> bool:
    """Whether the sets reach the threshold: first the prefixes under the further orders must meet, then the sets decide."""
    for order in ORDERS[1:]:
        if not len(np.intersect1d(prefix(x, counts, order, percent), prefix(y, counts, order, percent), assume_unique=True)):
            return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)
