"""Exact top-k search of many queries in a corpus: words by an inverted index, vectors block by block.

Neither queries nor corpus rows pass through the driver; what comes out of a task is at most k rows per query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.session import written

QUERIES_PER_BLOCK = 4096
ROWS_PER_BLOCK = 16384
POSTINGS = 16384  # documents of one block of posting lists, about
QUERIES_PER_SALT = 131072
QUERIES_PER_PRODUCT = 256
DIGITS = 9
WORD = r"[\p{L}\p{N}_]+"


def words(text):
    """Distinct lower-cased word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _block(column: str, rows: int, per_block: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(max(1, -(-rows // per_block)))).cast("int")


def postings(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """Inverted index of the texts (id, text) for the wanted tokens: block, token, ids.

    Lists are made per batch of texts, before any row moves, and by blocks of about POSTINGS documents, so no list is longer than a batch.
    """
    kind = dict(corpus.dtypes)["id"]
    texts = corpus.where(F.col("id").isNotNull()).select("id", _block("id", corpus.count(), POSTINGS).alias("block"), words(F.col("text")).alias("words"))
    return texts.where(F.size("words") > 0).mapInArrow(_lists, f"block int, token string, ids array<{kind}>").join(wanted, "token", "left_semi")


def _lists(batches):
    """The ids that hold a token, by block and token."""
    for batch in batches:
        texts = batch.column("words")
        text, token = pc.list_parent_indices(texts).to_numpy(), texts.flatten().dictionary_encode()
        block, code = batch.column("block").to_numpy()[text], token.indices.to_numpy()
        order = np.lexsort((code, block))
        block, code, text = block[order], code[order], text[order]
        start = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (code[1:] != code[:-1])])) if len(order) else order
        ids = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), batch.column("id").take(pa.array(text)))
        yield pa.RecordBatch.from_arrays([pa.array(block[start], pa.int32()), token.dictionary.take(pa.array(code[start])), ids], ["block", "token", "ids"])


def keyword_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank): share of a query's distinct words that a text contains. Whole texts are read.

    The posting lists of a block of documents meet the words of all queries in cogroups, which count ids in memory; k documents of each
    block stay, and no list moves for the sake of a single query. Queries are dealt to salts of about QUERIES_PER_SALT; only their number
    tells how many copies of the lists move. Documents without a word of the query score 0 and count in
    the order of their ids: the k smallest ids stand for them.
    """
    asked = queries.select("query_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    wanted = asked.select(F.explode("words").alias("token")).distinct()
    index = written(postings(corpus, wanted), "postings")
    asking, rows = queries.count(), corpus.count()
    each = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // size)) - 1)))
    # rows that share a query_id ask together
    whole = asked.groupBy("query_id").agg(F.max(F.size("words")).alias("size"), F.flatten(F.collect_list("words")).alias("words"))
    left = index.withColumn("salt", each(asking, QUERIES_PER_SALT))
    right = whole.select("query_id", "size", "words", _block("query_id", asking, QUERIES_PER_SALT).alias("salt"), each(rows, POSTINGS).alias("block"))
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]
    keys = ["block", "salt"]
    counted = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_most_hits(k), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    found = best(counted, k)

    first = [row.id for row in corpus.select("id").orderBy("id").limit(k).collect()]
    rest = asked.select("query_id", F.explode(F.array(*(F.lit(i) for i in first)) if first else F.array().cast(f"array<{dict(corpus.dtypes)['id']}>")).alias("id"))
    rows = found.select("query_id", "id", "score").unionByName(rest.withColumn("score", F.lit(0.0)))
    return best(rows.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def _most_hits(k: int):
    """For every query the ids of a block that are in most of the lists of its words; equal ones in the order of their ids."""

    def work(key, lists, queries):
        lists = lists.take(pc.sort_indices(lists, [("token", "ascending")]))
        token, found = lists.column("token").combine_chunks().dictionary_encode(), lists.column("ids").combine_chunks()
        size = np.bincount(token.indices.to_numpy(), pc.list_value_length(found).to_numpy(zero_copy_only=False), len(token.dictionary))
        ends = np.concatenate([[0], size.cumsum()]).astype(np.int64)
        ids = found.flatten().dictionary_encode()
        known = ids.dictionary.take(in_order := pc.sort_indices(ids.dictionary))
        place = np.empty(len(known), np.int32)
        place[in_order.to_numpy()] = np.arange(len(known), dtype=np.int32)
        at = place[ids.indices.to_numpy()]

        asked = queries.column("words").combine_chunks()
        code = pc.fill_null(pc.index_in(asked.flatten(), token.dictionary), -1).to_numpy()
        until = np.concatenate([[0], pc.list_value_length(asked).to_numpy(zero_copy_only=False).cumsum()]).astype(np.int64)
        most, hits_of, query = [], [], []
        for i in range(len(queries)):
            mine = [at[ends[c] : ends[c + 1]] for c in code[until[i] : until[i + 1]] if c >= 0]
            if not mine:
                continue
            hits = np.bincount(np.concatenate(mine), minlength=len(known))
            or_more = np.bincount(hits)[:0:-1].cumsum()  # ids of the highest number of hits, of that or one less, ...
            least = max(1, len(or_more) - np.searchsorted(or_more, k))
            above = np.flatnonzero(hits > least)
            above = above[np.argsort(-hits[above], kind="stable")]
            top = np.concatenate([above, np.flatnonzero(hits == least)[: k - len(above)]])
            most.append(top)
            hits_of.append(hits[top])
            query.append(np.full(len(top), i))
        none = np.empty(0, np.int64)
        most, hits_of, query = (np.concatenate([none, *parts]) for parts in (most, hits_of, query))
        score = np.round(hits_of / queries.column("size").to_numpy()[query], DIGITS)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(query)), "id": known.take(pa.array(most)), "score": score})

    return work


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank) from queries (query_id, vector) and corpus (id, vector); a zero vector scores 0.

    Queries and rows are dealt to blocks by hash; every block of queries meets every block of rows in a cogroup, where scores are
    one matrix product and k rows per query stay. Larger blocks mean fewer copies of both sides.
    """
    as_double = F.col("vector").cast("array<double>").alias("vector")
    asked, rows = queries.count(), corpus.count()
    of_query, of_row = _block("query_id", asked, QUERIES_PER_BLOCK), _block("id", rows, ROWS_PER_BLOCK)
    every = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // size)) - 1)))
    left = corpus.select("id", as_double, of_row.alias("row_block"), every(asked, QUERIES_PER_BLOCK).alias("query_block"))
    right = queries.select("query_id", as_double, every(rows, ROWS_PER_BLOCK).alias("row_block"), of_query.alias("query_block"))
    keys = ["row_block", "query_block"]
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_products(k), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return best(found, k)


def _unit(lists: pa.ChunkedArray) -> np.ndarray:
    matrix = np.stack([np.asarray(values, dtype="float64") for values in lists.to_pylist()])
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _products(k: int):
    def work(key, rows, queries):
        parts = []
        if len(rows) and len(queries):
            rows = rows.take(pc.sort_indices(rows, [("id", "ascending")]))  # so that equal scores stay in order of ids
            corpus, asked = _unit(rows.column("vector")), _unit(queries.column("vector"))
            for start in range(0, len(asked), QUERIES_PER_PRODUCT):
                scores = np.round(asked[start : start + QUERIES_PER_PRODUCT] @ corpus.T, DIGITS)
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                query = pa.array(np.repeat(np.arange(start, start + len(at)), at.shape[1]))
                parts.append((queries.column("query_id").take(query), rows.column("id").take(pa.array(at.ravel())), pa.array(np.take_along_axis(scores, at, 1).ravel())))
        columns = [pa.chunked_array([c for part in column for c in (part.chunks if isinstance(part, pa.ChunkedArray) else [part])]) for column in zip(*parts)]
        if not columns:
            columns = [queries.column("query_id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64())]
        return pa.table(dict(zip(("query_id", "id", "score"), columns)))

    return work
