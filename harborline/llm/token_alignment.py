"""Alignment of the tokens of two tokenizers over the same texts, and how often each pair of ids is linked."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field, unpacked
from harborline.llm.shingles import groups, mixed

MEMO = 1 << 16  # window alignments of each of the two generations that a task remembers
# Fixed value: how a byte-level BPE cuts a text into the parts that it encodes one by one.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"  # the space mark of the second tokenizer's pieces
LINKS = "array<struct<pair long, times int>>"
Row = tuple[int, int, str, np.ndarray, np.ndarray]
NO_TOKENS: Row = (0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def unescaped() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, take the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """The files of a byte-level BPE (A) and of a piece model (B) as bytes; the tokenizers are made where they are used."""

    json_file: bytes
    model_file: bytes

    @classmethod
    def read(cls, folder: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Tokenizers:
        with open(os.path.join(folder, a), "rb") as first, open(os.path.join(folder, b), "rb") as second:
            return cls(first.read(), second.read())

    def __getstate__(self):
        return {"json_file": self.json_file, "model_file": self.model_file, "by_rank": self.by_rank}

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(self.json_file)
        made.encode_special_tokens = True
        return made

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model_file)

    @cached_property
    def entries(self) -> dict:
        return json.loads(self.json_file)

    @cached_property
    def by_rank(self) -> bool:
        """Whether merging by the id of the merged token gives A's tokens, which is faster than its list of merges.

        True if the i-th merge makes the i-th merged id and every token's own bytes are merged to it: a pair that is not in the list, but
        whose bytes are a token, then never stands side by side, or the token's own bytes would stop at that pair.
        """
        spec, plain = self.entries, len(unescaped())
        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or {k: (spec["pre_tokenizer"] or {}).get(k) for k in split} != split:
            return False
        if any(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) != plain + i for i, m in enumerate(merges)):
            return False
        special = {added["content"] for added in spec.get("added_tokens", [])}
        return all([t.id for t in self.a.model.tokenize(entry)] == [i] for entry, i in vocab.items() if entry not in special)

    @cached_property
    def ranked(self):
        import tiktoken

        special = {added["id"] for added in self.entries.get("added_tokens", [])}
        ranks = {self.bytes_a[i]: i for i in self.entries["model"]["vocab"].values() if i not in special}
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, texts: list[str]) -> list[np.ndarray]:
        if self.by_rank:
            return [np.asarray(self.ranked.encode_to_numpy(text), np.int64) for text in texts]
        return [np.array(found.ids, np.int64) for found in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, np.int64) for ids in self.b.encode_as_numpy(texts, num_threads=1)]

    @cached_property
    def bytes_a(self) -> list[bytes]:
        """The bytes of each id of A; special tokens are their own text."""
        byte, entries = unescaped(), self.entries
        out = [b""] * (max(entries["model"]["vocab"].values(), default=-1) + 1)
        for entry, i in entries["model"]["vocab"].items():
            out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        for added in entries.get("added_tokens", []):
            out += [b""] * (added["id"] + 1 - len(out))
            out[added["id"]] = added["content"].encode()
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        """The bytes of each id of B: pieces with the space mark as space, byte pieces as their byte, control pieces as nothing."""
        model, out = self.b, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            out.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
        return out

    def possible_pairs(self) -> int:
        """How many pairs of ids can ever be linked.

        Linked tokens end together, so the bytes of one are a suffix of the other's. The vocabularies alone bound this number.
        """
        count = 0
        for longer, shorter, proper in ((self.bytes_a, self.bytes_b, False), (self.bytes_b, self.bytes_a, True)):
            times: dict[bytes, int] = {}
            for entry in shorter:
                times[entry] = times.get(entry, 0) + 1
            count += sum(times.get(entry[i:], 0) for entry in longer for i in range(int(proper), len(entry)))
        return count


class Aligner:
    """Tokens of both kinds for whole texts, cut into groups at shared ends; works on all texts that it is given at once."""

    def __init__(self, tokenizers: Tokenizers, memo: int = MEMO):
        self.tok, self.limit = tokenizers, memo
        self.known, self.before = {}, {}  # once the first is full it becomes the second, from which what is still in use comes back
        self.size_a, self.size_b = (np.array([len(t) for t in table], np.int64) for table in (tokenizers.bytes_a, tokenizers.bytes_b))
        self.space_a, self.space_b = (np.array([t[:1] == b" " for t in table], bool) for table in (tokenizers.bytes_a, tokenizers.bytes_b))
        # Each id as text, thrice: before a further token of its kind, before the other kind's and at the end of its group.
        self.first_b = len(self.size_a)
        self.names = [f"{i}{mark}" for count in (self.first_b, len(self.size_b)) for i in range(count) for mark in ",|;"]
        self.width = np.array([len(name) for name in self.names[::3]], np.int64)

    def __call__(self, texts: list[str]) -> list[Row]:
        """Per text its number of tokens of both, groups as text, linked pairs with their number of links."""
        rows = [NO_TOKENS] * len(texts)
        full = [i for i, text in enumerate(texts) if text]
        if not full:
            return rows
        found = zip(full, self.tok.ids_a([f" {texts[i]}" for i in full]), self.tok.ids_b([texts[i] for i in full]))
        found = [(i, a, b) for i, a, b in found if self.joins(b" " + texts[i].encode(), a, b)]
        if not found:
            return rows
        a, b = (np.concatenate(ids) for ids in list(zip(*found))[1:])
        ids, stops, ends = self.windows(a, b)
        first, kinds = distinct(ids, stops)
        packed, stops = ids.tobytes(), 4 * stops
        starts = np.append(0, stops[:-1])[first]
        aligned = self.aligned([packed[i:j] for i, j in zip(starts.tolist(), stops[first].tolist())])
        groups, pairs = [one[0] for one in aligned], [one[1] for one in aligned]
        kinds = kinds.tolist()
        # A text ends where its last token does, and the next one begins with a space, so its end is an anchor.
        last = np.searchsorted(ends, np.cumsum([len(a) for _, a, _ in found])).tolist()
        start = 0
        for (i, a, b), at in zip(found, last):
            of = kinds[start : at + 1]
            of_text, times = np.unique(np.frombuffer(b"".join(map(pairs.__getitem__, of)), np.int64), return_counts=True)
            rows[i] = len(a), len(b), "".join(map(groups.__getitem__, of))[:-1], of_text, times
            start = at + 1
        return rows

    def joins(self, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the tokens of both join to the text's bytes; merging by rank leaves bytes out at most, so that their number tells."""
        whole = int(self.size_a[a].sum()) == len(data) if self.tok.by_rank else b"".join(map(self.tok.bytes_a.__getitem__, a.tolist())) == data
        return whole and b"".join(map(self.tok.bytes_b.__getitem__, b.tolist())) == data

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all windows (of each A's before B's, which are numbered after all of A), how many ids and how many of A's end with each."""
        # Anchors: both tokens end at one byte and both next tokens begin with a space (or the texts end).
        marked_a = np.flatnonzero(np.append(self.space_a[a[1:]], True))
        marked_b = np.flatnonzero(np.append(self.space_b[b[1:]], True))
        in_a, in_b = shared_ends(np.cumsum(self.size_a[a])[marked_a], np.cumsum(self.size_b[b])[marked_b])
        stop_a, stop_b = marked_a[in_a] + 1, marked_b[in_b] + 1
        return dealt(a.astype(np.int32), (b + self.first_b).astype(np.int32), stop_a, stop_b), stop_a + stop_b, stop_a

    def aligned(self, keys: list[bytes]) -> list[tuple[str, bytes]]:
        """The alignment of each of different windows: remembered by its ids, or made now, all new ones at once."""
        known = self.known
        found = list(map(known.get, keys))
        fresh = [key for key, one in zip(keys, found) if one is None]
        if fresh:
            back = {key: self.before[key] for key in fresh if key in self.before}
            new = [key for key in fresh if key not in back]
            known.update(back)
            known.update(zip(new, self.align(new)))
            found = [one or known[key] for key, one in zip(keys, found)]
        if len(known) >= self.limit:
            self.known, self.before = {}, known
        return found

    def align(self, keys: list[bytes]) -> Iterator[tuple[str, bytes]]:
        """Groups of each window as text, every group closed by a semicolon, and the pairs (A id * 2^32 + B id) that end them as bytes."""
        if not keys:
            return iter(())
        ids = np.frombuffer(b"".join(keys), np.int32).astype(np.int64)
        stops = np.cumsum([len(key) // 4 for key in keys])
        of_b = ids >= self.first_b
        a, b = ids[~of_b], ids[of_b]
        # Both kinds of a window have as many bytes, so that offsets may run on from window to window.
        in_a, in_b = shared_ends(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b - self.first_b]))
        name_a, name_b = 3 * a, 3 * b
        name_a[in_a] += 1
        name_b[in_b] += 2
        names = dealt(name_a, name_b, in_a + 1, in_b + 1)
        text = "".join(map(self.names.__getitem__, names.tolist()))
        cuts = np.cumsum(self.width[names // 3])[stops - 1].tolist()
        pairs = ((a[in_a] << 32) + b[in_b] - self.first_b).tobytes()
        links = (8 * np.searchsorted(in_a, np.cumsum(~of_b)[stops - 1])).tolist()
        return zip([text[i:j] for i, j in zip([0, *cuts], cuts)], [pairs[i:j] for i, j in zip([0, *links], links)])


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values that two rising sequences share stand in each; the last value must be one of them."""
    at = np.searchsorted(b, a)
    in_a = np.flatnonzero(b[at] == a)
    return in_a, at[in_a]


def distinct(ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of one window of each kind, and the kind of every window; windows end before the stops, their ids tell kinds apart.

    Windows are told apart by a hash of their ids. Those of equal hash are compared id by id; should they differ, no hash is used.
    """
    starts = np.append(0, stops[:-1])
    sizes = stops - starts
    places = np.arange(len(ids)) - np.repeat(starts, sizes)
    names = np.add.reduceat(mixed((places << 32 | ids).astype(np.uint64) + np.uint64(1)), starts)
    kinds = pa.array(names).dictionary_encode().indices.to_numpy()
    first = np.empty(kinds.max() + 1, np.int64)
    first[kinds] = np.arange(len(kinds))
    like = first[kinds]
    if (sizes == sizes[like]).all() and (ids == ids[places + np.repeat(starts[like], sizes)]).all():
        return first, kinds
    numbers: dict[bytes, int] = {}
    kinds = np.array([numbers.setdefault(ids[i:j].tobytes(), len(numbers)) for i, j in zip(starts.tolist(), stops.tolist())])
    return np.unique(kinds, return_index=True)[1], kinds


def dealt(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> np.ndarray:
    """All values of ``a`` and ``b`` in the order of their parts, of each part a's before b's; parts end before the stops."""
    long_a, long_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    out = np.empty(len(a) + len(b), a.dtype)
    out[np.arange(len(a)) + np.repeat(stop_b - long_b, long_a)] = a
    out[np.arange(len(b)) + np.repeat(stop_a, long_b)] = b
    return out


def _column(rows: list[Row]) -> pa.Array:
    n_a, n_b, texts, pairs, times = zip(*rows) if rows else ([],) * 5
    offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    pairs, times = (np.concatenate([np.zeros(0, np.int64), *arrays]) for arrays in (pairs, times))
    links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pairs), pa.array(times.astype(np.int32))], names=["pair", "times"]))
    return pa.StructArray.from_arrays([pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(texts, pa.string()), links], names=["n_a", "n_b", "groups", "links"])


def align(docs: DataFrame, tokenizers: Tokenizers, text_col: str = "text") -> DataFrame:
    """Tokens of two tokenizers over whole texts, grouped where both end.

    A space and the text are encoded by both, without special tokens (their strings inside a text are plain text). The byte offsets
    where tokens of both end cut the tokens into groups; the last tokens of a group are linked. Whitespace tokens are the
    anchors: shared ends before tokens that begin with a space, found by comparing the offsets of the whole text, cut it into
    windows, mostly single words, whose alignment is remembered by its ids (at most twice MEMO windows and those of 1 MB of text
    a task); equal windows of that text are looked up once, and those that are new are aligned together.

    Returns the input's columns, then ``n_a``, ``n_b`` (tokens), ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of both by group) and ``links``
    (each linked pair, A id * 2^32 + B id, with its number of links in the text).

    Texts that are null or empty, or whose tokens do not join to the text's bytes (which happens where a tokenizer
    rewrites characters), have no tokens: zeros, empty ``groups`` and ``links``. Texts are never cut; a task holds
    the tokens of about 1 MB of text, or of one longer text. Equal texts and repeated rows are aligned one by one. An
    empty table gives an empty table. Input columns with the names of added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    kind = f"struct<n_a long, n_b long, groups string, links {LINKS}>"

    @F.arrow_udf(kind)
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = Aligner(shared.value)
        for batch in batches:
            yield _column([row for group in groups(batch) for row in aligner([t.decode() for t in group])])

    packed = as_row(docs).withColumn("found", aligned(field(text_col).cast("string")))
    return unpacked(packed, n_a=F.col("found.n_a"), n_b=F.col("found.n_b"), groups=F.col("found.groups"), links=F.col("found.links"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """Per linked pair of ids ``a``, ``b`` its links over all documents as ``count``, and whether no pair of ``b`` has more (``best``)."""
    pairs = aligned.select(F.explode("links").alias("l")).groupBy("l.pair").agg(F.sum(F.col("l.times").cast("long")).alias("count"))
    pairs = pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "count")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def score(aligned: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Adds what the counts over all documents say about each one's links; ``aligned`` should be a stored table, it is read twice.

    The columns of ``aligned`` stay, then ``n_links``, ``n_best`` (links whose pair is one of the most frequent of its B id) and ``count_sum``
    (sum of the pairs' counts over the links). Documents without links get zeros. The counts are sent to all tasks:
    there are at most as many as pairs of ids of which one is a suffix of the other, a bound that only the two
    vocabularies set (``possible_pairs``) and that is checked.
    """
    spark = aligned.sparkSession
    counts = link_counts(aligned).toArrow()
    if counts.num_rows > (most := tokenizers.possible_pairs()):
        raise ValueError(f"{counts.num_rows} linked pairs, but the vocabularies allow {most}")
    a, b, count, best = (counts.column(c).to_numpy() for c in ("a", "b", "count", "best"))
    pairs = (a << 32) + b
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], count[order], best[order].astype(np.int64)))

    @F.arrow_udf("struct<n_links long, n_best long, count_sum long>")
    def scored(links: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs, count, best = shared.value
        for batch in links:
            cells = batch.flatten()
            times = cells.field("times").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(pairs, cells.field("pair").to_numpy(zero_copy_only=False))
            ends = np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            sums = []
            for values in (times, times * best[at], times * count[at]):
                upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
                sums.append(pa.array(upto[ends] - upto[np.concatenate([[0], ends[:-1]])]))
            yield pa.StructArray.from_arrays(sums, names=["n_links", "n_best", "count_sum"])

    packed = as_row(aligned).withColumn("found", scored(field("links")))
    return unpacked(packed, n_links=F.col("found.n_links"), n_best=F.col("found.n_best"), count_sum=F.col("found.count_sum"))
