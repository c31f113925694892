import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import queries, substring_dedup, token_alignment, whitening

FILES = queries.TOKENIZERS


def cut_passages(rows, size):
    """(id, words, removed runs, kept) of (id, text) rows, from all windows."""
    texts = [(i, [] if t is None else t.encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[s : s + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        lost = [False] * len(w)
        for s in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[s : s + size])] < i:
                lost[s : s + size] = [True] * size
        edges = [k for k in range(len(w) + 1) if (k > 0 and lost[k - 1]) != (k < len(w) and lost[k])]
        out.append((i, len(w), list(zip(edges[0::2], edges[1::2])), b" ".join(x for x, g in zip(w, lost) if not g).decode()))
    return sorted(out, key=str)


def passage_rows(seed, size):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(["ab", "c", "dé", "A", "long-word"]) + str(rng.randrange(9)) for _ in range(n)]
    shared = [words(rng.randint(size - 2, 3 * size)) for _ in range(6)]
    rows = []
    for i in range(70):
        text = words(rng.randint(0, 2 * size))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(shared)[rng.randint(0, 3) :] + words(rng.randint(0, 5))
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", " \t "]).join(text)))
    copy = rows[5][1]
    near = copy.split()
    near[len(near) // 2] = "changed"
    rows += [(2000 + i, copy) for i in range(12)] + [(3000 + i, " ".join(near)) for i in range(3)] + [(1, copy), (1, copy)]
    same = " ".join(["x"] * 40 * size)
    return rows + [(5000, same), (5001, same + " y"), (5002, "x " * (size - 1)), (5003, None), (5004, ""), (5005, " \n"), (None, copy), (None, None), (5006, "\x0b".join(shared[0])), (5007, " ".join(shared[0]))]


@pytest.mark.parametrize(("size", "group"), [(6, 1 << 21), (6, 300), (10, 2000)])
def test_passages_equal_brute_force(documents, monkeypatch, size, group):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(substring_dedup, "PROBE_BYTES", 4 * group)
    rows = passage_rows(size, size)
    out = substring_dedup.remove_passages(documents(rows), size=size).select("doc_id", "n_words", "n_removed", "removed", "kept").collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.removed], r.kept) for r in out), key=str)
    assert got == cut_passages(rows, size)
    assert all(r.n_removed == sum(b - a for a, b in r.removed) for r in out)


def test_passages_clashing_columns_and_empty_table(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text, 5, 6, "a", 7), (2, text, 5, 6, "b", 8)], "doc_id long, text string, gid int, N_WORDS int, row string, h1 int")
    out = substring_dedup.remove_passages(rows).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "gid", "row", "h1", "n_words", "n_removed", "removed", "kept"]
    assert [(r.gid, r.row, r.h1, r.n_words, r.n_removed, r.kept) for r in out.collect()] == [(5, "a", 7, 60, 0, text), (5, "b", 8, 60, 60, "")]
    assert substring_dedup.remove_passages(documents([])).count() == 0
    assert substring_dedup.remove_passages(documents([(None, None), (1, "a b")])).count() == 2


def test_words_do_not_depend_on_the_piece(monkeypatch):
    text = b" ".join(f"word{i}".encode() for i in range(500)) + b"\n" + b"z" * 3000
    whole = substring_dedup.word_hashes(text)
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    assert len(whole) == 501 and (substring_dedup.word_hashes(text) == whole).all()


TEXTS = [None, "", " ", "one", "Hello  world,\n\nthis is\ta text.", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café – ünï", "a▁b", "日本語 テキスト", "👩‍👩‍👧 emoji 🏳️‍🌈", "\x00 zero", "  lead and trail  ", "\r\nx y z", "aaaa" * 500, "x " * 300, "don't we'll I'VE 12345 3.14 $%&", "Ᲊ \U0001f6d9 ͸ ﷺ é"]


def aligned_by_definition(files, text):
    """Tokens, groups and linked pairs from the definition, with the tokenizers library."""
    if not text:
        return 0, 0, [], []
    a = files.a.encode(" " + text, add_special_tokens=False).ids
    b = files.b.encode(text, num_threads=1)
    if any(b"".join(table[i] for i in ids) != (" " + text).encode() for ids, table in ((a, files.bytes_a), (b, files.bytes_b))):
        return 0, 0, [], []
    end_a, end_b = ([sum(len(table[i]) for i in ids[: k + 1]) for k in range(len(ids))] for ids, table in ((a, files.bytes_a), (b, files.bytes_b)))
    shared = sorted(set(end_a) & set(end_b))
    groups, pairs, low = [], [], 0
    for end in shared:
        in_a, in_b = ([i for i, e in zip(ids, ends) if low < e <= end] for ids, ends in ((a, end_a), (b, end_b)))
        groups.append(",".join(map(str, in_a)) + "|" + ",".join(map(str, in_b)))
        low = end
    pairs = [(x, y) for x, e in zip(a, end_a) for y, f in zip(b, end_b) if e == f]
    return len(a), len(b), groups, pairs


def test_alignment_equals_definition(spark):
    rng = random.Random(4)
    files = token_alignment.Tokenizers.read(FILES)
    assert files.by_rank
    texts = TEXTS + ["".join(rng.choice(" \n.,'eat#é中01sßZ") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "one", "n"), (3, "one", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, LINKS string")
    aligned = token_alignment.align(docs, files).repartition(3).cache()
    out = token_alignment.score(aligned, files).collect()
    want = {t: aligned_by_definition(files, t) for t in texts}
    counts = Counter(p for _, t, _ in rows for p in want[t][3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "n_a", "n_b", "groups", "links", "n_links", "n_best", "count_sum"}
    for r in out:
        n_a, n_b, groups, pairs = want[r.text]
        assert (r.n_a, r.n_b, r.groups) == (n_a, n_b, ";".join(groups))
        assert Counter({(x.pair >> 32, x.pair & 0xFFFFFFFF): x.times for x in r.links}) == Counter(pairs)
        assert (r.n_links, r.n_best, r.count_sum) == (len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs))
    assert want["a▁b"][0] == 0  # the piece model turns its space mark into a space
    assert token_alignment.score(token_alignment.align(docs.limit(0), files), files).count() == 0


def test_alignment_forgets_and_stays_right():
    files = token_alignment.Tokenizers.read(FILES)
    texts = [t for t in TEXTS if t] * 2
    few, many = (list(token_alignment.Aligner(files, memo)(texts)) for memo in (2, 1 << 17))
    assert [r[:3] for r in few] == [r[:3] for r in many]
    aligner = token_alignment.Aligner(files, 2)
    single = [aligner([text])[0] for text in texts]
    assert [r[:3] for r in single] == [r[:3] for r in many]
    assert all((x == y).all() and (n == m).all() for (*_, x, n), (*_, y, m) in zip(single, many))


@pytest.mark.parametrize("clash", [False, True])
def test_equal_windows_are_looked_up_once(monkeypatch, clash):
    files = token_alignment.Tokenizers.read(FILES)
    texts = [t for t in TEXTS if t] + ["the cat the dog the cat", "the dog"]
    want = [aligned_by_definition(files, t) for t in texts]
    if clash:  # windows of one hash are told apart by their ids
        monkeypatch.setattr(token_alignment, "mixed", lambda x: x * x.dtype.type(0))
    aligner, keys = token_alignment.Aligner(files), []
    aligned = aligner.aligned
    monkeypatch.setattr(aligner, "aligned", lambda asked: keys.extend(asked) or aligned(asked))
    rows = aligner(texts)
    assert [(r[0], r[1], r[2]) for r in rows] == [(n_a, n_b, ";".join(groups)) for n_a, n_b, groups, _ in want]
    assert [dict(zip(r[3].tolist(), r[4].tolist())) for r in rows] == [Counter((a << 32) + b for a, b in pairs) for *_, pairs in want]
    assert len(keys) == len(set(keys))


def test_ranks_give_the_tokens_of_the_file_for_every_character():
    files = token_alignment.Tokenizers.read(FILES)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200)) + [0x10FFFF]
    texts = ["".join(f"a{c} {c}1\n{c}" for c in map(chr, points[i : i + 500])) for i in range(0, len(points), 500)]
    assert [a.tolist() for a in files.ids_a(texts)] == [e.ids for e in files.a.encode_batch_fast(texts, add_special_tokens=False)]


def test_alignment_without_ranks():
    files = token_alignment.Tokenizers.read(FILES)
    plain = token_alignment.Tokenizers.read(FILES)
    plain.__dict__["by_rank"] = False
    texts = [t for t in TEXTS if t]
    assert [a.tolist() for a in plain.ids_a(texts)] == [a.tolist() for a in files.ids_a(texts)]


def test_alignment_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files = token_alignment.Tokenizers.read(FILES)
    out = {r.doc_id: r for r in queries.op12_token_alignment(spark, str(tmp_path)).collect()}
    groups = aligned_by_definition(files, "one two")[2]
    assert out[1].groups_sha256 == hashlib.sha256(";".join(groups).encode()).hexdigest() and out[1].n_groups == len(groups)
    assert tuple(out[2])[1:] == (0, 0, 0, "", 0, 0, 0)


def whitened_by_numpy(x, k):
    x = np.array(x, dtype=object)
    n, apart = len(x), len(x) * x - x.sum(axis=0)
    centred = apart.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return (apart**2).sum(axis=1), centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_whitening_equals_numpy(spark, block_rows):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((60, 12)) @ rng.standard_normal((12, 12)) * 500).astype(int) + 100000
    rows = [(i, v.tolist(), 1, "s") for i, v in enumerate(x)] + [(90, None, 1, "s"), (None, x[0].tolist(), 1, "s"), (91, x[1].tolist(), 1, None)]
    table = spark.createDataFrame(rows, "vec_id long, vec array<long>, n int, AT string").repartition(5)
    out = whitening.whiten(table, components=8, block_rows=block_rows).collect()
    kept = [r.vec for r in out]
    deviation, want, explained = whitened_by_numpy(kept, 8)
    got = np.array([r.whitened for r in out])
    assert len(out) == 62 and {r.n for r in out} == {62} and [r.deviation for r in out] == deviation.tolist()
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-9 and np.abs(out[0].explained - explained).max() < 1e-12
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_whitening_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, vec array<long>")
    assert whitening.whiten(make([])).count() == 0
    assert [tuple(r)[2:] for r in whitening.whiten(make([(1, [3, 4])])).collect()] == [(1, 0, [], [], 0.0)]
    flat = whitening.whiten(make([(1, [3, 5]), (2, [5, 5]), (3, [3, 5]), (4, [5, 5])])).collect()  # varies in one direction
    assert [sorted(abs(v) for v in r.whitened) for r in flat] == [[1.0]] * 4 and flat[0].explained == [1.0] and {r.deviation for r in flat} == {16}
    big = 10**12
    assert {r.deviation for r in whitening.whiten(make([(1, [0, 0]), (2, [10**9, 0])])).collect()} == {10**18}
    with pytest.raises(Exception, match="range of long"):
        whitening.whiten(make([(1, [0, 0]), (2, [big, 0])])).collect()
    with pytest.raises(ValueError, match="common covariance"):
        whitening.whiten(make([(1, [0, 0]), (2, [1])]))


def test_grid(spark):
    rows = [(1, [0.5, -0.0001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [])]
    out = spark.createDataFrame(rows, "i int, v array<double>").select("i", whitening.on_grid(F.col("v")).alias("x")).orderBy("i").collect()
    assert [r.x for r in out] == [[100512, 99999]] + [None] * 5
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([([1e300],)], "v array<double>").select(whitening.on_grid(F.col("v"))).collect()
