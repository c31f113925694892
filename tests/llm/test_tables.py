import itertools
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import graph, language, mixing, packing, topk, url_filter, vector_dedup
from harborline.llm.queries import RULES


def judged(spark, urls, rules=RULES, **more):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **more)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://example.com/fr", "http://x.net/es/1", "http://x.net/de/", "http://com", "example.com/en/", None, "", "http://example.com:80/en/", "ftp://notexample.com/en/", "http://x.com//y://z", "http://net/fr/\nx"]
    got = judged(spark, urls)
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.com", "/fr", "com/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4] == ("x.net", "/de/", None, "allow")
    assert got[5] == ("com", "", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("example.com:80", "/en/", None, "allow")
    assert got[10] == ("notexample.com", "/en/", "com/", "allow")
    assert got[11] == ("x.com", "//y://z", "com/", "allow")
    assert got[12] == ("net", "/fr/\nx", "net/fr/", "block")


def test_url_rules_equal_brute_force_and_edges(spark):
    rng = random.Random(6)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    paths = ["/" + "".join(rng.choice("x/y") for _ in range(rng.randint(0, 4))) for _ in range(30)]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(25)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(150)]
    got = judged(spark, urls, rules, default="block")
    for i, url in enumerate(urls):
        host, _, path = url[7:].partition("/")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        best = max(fits, default=(0, 0, None, "block"))
        assert got[i][3] == best[3] and (got[i][2] is None) == (best[2] is None)
        assert got[i][2] is None or len(got[i][2]) == best[0]
    assert judged(spark, ["http://a/"], rules[:0])[0][3] == "allow"
    assert judged(spark, []) == {}
    with pytest.raises(ValueError):
        judged(spark, ["http://a/"], [("a", "/" * 3000, "block")])


def links_of(vectors, threshold):
    ok = {i: np.array(v, float) for i, (_, v, _) in enumerate(vectors) if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)}
    out = []
    for i, j in itertools.combinations(ok, 2):
        if vectors[i][2] is not None and vectors[i][2] == vectors[j][2]:
            if ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold:
                out.append((i, j))
    return out


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    rows = [(10 * i + j, (c + rng.standard_normal(64) * s).tolist(), i % 3) for i, c in enumerate(centres) for j, s in enumerate((0, 0, 0.05, 0.1, 0.14, 0.3))]
    rows += [(1000, rows[0][1], None), (1001, None, 0), (1002, [0.0] * 64, 0), (1003, [float("nan")] * 64, 0), (1004, [None] * 64, 0), (1005, [1.0] * 3, 0), (1006, [float("inf")] * 64, 0)]
    out = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = links_of(rows, 0.98)
    degree, ids = Counter(rows[i][0] for pair in links for i in pair), [r[0] for r in rows]
    found = brute.components(ids, [(rows[i][0], rows[j][0]) for i, j in links])
    assert sum(r.n_links for r in out.values()) >= 0.99 * 2 * len(links)
    assert all(out[i].n_links <= degree[i] for i in ids)
    assert np.mean([out[i].component_id == found[i] for i in ids]) > 0.98
    assert all(out[i].kept == (out[i].component_id == i) for i in ids)
    assert all(out[i].n_links == 0 and out[i].kept for i in range(1000, 1007))


def test_recall_at_the_threshold(spark):
    """Pairs exactly at a cosine of 0.98, the hardest to find: at least 0.9 of them are found."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.9801 * a + np.sqrt(1 - 0.9801**2) * b).tolist(), 1)]
    out = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.agg(F.sum("n_links")).first()[0] >= 0.97 * 800


def test_recall_of_vectors_with_a_common_direction(spark):
    """All vectors lean the same way, as embeddings of one model often do; most pairs at the threshold are found."""
    rng = np.random.default_rng(3)
    common = np.zeros(64)
    common[0] = 1.0
    rows = []
    for i in range(600):
        a = rng.standard_normal(64) / 8 + 2.0 * common
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        rows += [(2 * i, a.tolist(), i), (2 * i + 1, (0.9803 * a + np.sqrt(1 - 0.9803**2) * b / np.linalg.norm(b)).tolist(), i)]
    out = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.agg(F.sum("n_links")).first()[0] >= 0.95 * 1200


def test_tiny_and_huge_vectors(spark):
    base = [1.0, 2.0, 1.0]
    rows = [(i, [x * scale for x in base], 1) for i, scale in enumerate([1.0, 1e-200, 1e-300, 1e200, 1e300])]
    out = vector_dedup.near_vectors(spark.createDataFrame(rows + [(9, [1e-200, -1e-200, 0.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {i: (4, 0) for i in range(5)} | {9: (0, 9)}


def test_near_vectors_of_several_lengths(spark):
    """Every length is compared, whether it learns a rotation, has too few vectors or is beyond the fitted lengths."""
    rng = np.random.default_rng(11)
    rows = []
    for n, groups in ((64, 400), (32, 350), (100, 20), *((200 + i, 2) for i in range(vector_dedup.FITTED)), (1, 1)):
        for _ in range(groups):
            a = rng.standard_normal(n)
            rows += [(len(rows) + j, (a * scale).tolist(), n % 2) for j, scale in enumerate((1, 1, 2))]
    out = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all((r.n_links, r.component_id, r.kept) == (2, r.vec_id // 3 * 3, r.vec_id % 3 == 0) for r in out) and len(out) == len(rows)


def test_near_vectors_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_vectors(empty).count() == 0


def test_top_k_scores_out_of_range_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1 << 40, 5]), (2, [1 << 40, 7])], "vec_id long, vec array<long>")
    with pytest.raises(Exception, match="beyond 2\\^61"):
        topk.top_k(rows, rows, k=1).collect()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, 6).tolist()) for i in range(300)] + [(i, [3] * 6) for i in range(300, 380)] + [(400, None), (None, [1] * 6), (401, [1, 2]), (402, [])]
    table = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    for k, block in ((5, 7), (20, 1024), (500, 64)):
        out = topk.top_k(table, table.where("vec_id % 20 = 0 or vec_id = 401"), k=k, bins=4, query_block=block, row_block=50)
        got = {}
        for r in out.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q, v in rows:
            if q is not None and q % 20 == 0 and v:
                scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i is not None and w and i != q and len(w) == len(v))[:k]
                assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
        assert 401 not in got and 400 not in got


def test_top_k_extremes(spark):
    big = [(0, [1 << 30, 1]), (20, [1 << 30, 2]), (1, [-(1 << 30), 0]), (2, [0, 0])]
    table = spark.createDataFrame(big, "vec_id long, vec array<long>")
    out = topk.top_k(table, table.where("vec_id % 20 = 0"), k=2).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in out} == {(0, 1, 20), (0, 2, 2), (20, 1, 0), (20, 2, 2)}
    assert topk.top_k(table.limit(0), table).count() == 0
    values = spark.createDataFrame([([1.5, -0.01],), ([None, 1.0],), ([float("nan")],), (None,)], "v array<float>")
    assert [r[0] for r in values.select(topk.scaled(F.col("v"))).collect()] == [[96, -1], None, None, None]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 240)] + [(7, 7), (None, 3)]
    links += [(rng.randint(300, 380), rng.randint(300, 380)) for _ in range(60)]
    rng.shuffle(links)
    nodes = {n for pair in links for n in pair if n is not None}
    want = brute.components(nodes, [(a, b) for a, b in links if a is not None])
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[n] == c for n, c in got.items()) and all(want[n] == n for n in nodes - set(got))


def test_bounds_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        histogram = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        lengths = sorted(histogram)
        for buckets in (1, 2, 3, 12):
            bounds = packing.best_bounds(histogram, buckets)
            others = [c for c in itertools.combinations(lengths, min(buckets, len(lengths))) if c[-1] == lengths[-1]]
            assert len(bounds) <= buckets and brute.padding(histogram, bounds) == min(brute.padding(histogram, c) for c in others)


def test_packing_keeps_every_token(documents):
    rng = random.Random(8)
    rows = [(i, " ".join(f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 50)))) for i in range(80)] + [(90, None), (91, ""), (92, " \t"), (None, "a b"), (93, "x"), (93, "x"), (94, "w " * 500)]
    out = packing.pack(documents(rows), buckets=3, max_tokens=16, batch_tokens=64, rows_per_shard=7).collect()
    texts = {}
    for r in sorted(out, key=lambda r: r.segment):
        texts.setdefault(r.doc_id, []).append(r.text)
        assert r.n_tokens == len(r.text.split()) <= r.bound <= 16
    for i, text in rows[:80]:
        assert " ".join(texts.get(i, [])) == text
    assert texts[93] == ["x", "x"] and len(texts[94]) == 32 and 90 not in texts and 92 not in texts
    slots = Counter((r.bucket, r.batch, r.slot) for r in out)
    assert max(slots.values()) == 1
    for bucket in {r.bucket for r in out}:
        places = sorted((r.batch, r.slot) for r in out if r.bucket == bucket)
        room = 64 // next(r.bound for r in out if r.bucket == bucket)
        assert places == [(i // room, i % room) for i in range(len(places))]
    assert packing.pack(documents([])).count() == 0


def test_mixing_meets_rates(documents):
    rows = [(i, "t", None, "big" if i % 10 else "small") for i in range(4000)] + [(5000, None, None, None), (None, "x", None, "big"), (None, None, None, "big")]
    docs = documents(rows)
    out = mixing.mix(docs, weights={"big": 1, "small": 1}, seed=3)
    got = Counter(r.source for r in out.collect())
    assert abs(got["big"] - 2000) < 250 and abs(got["small"] - 2000) < 250 and None not in got
    again = mixing.mix(docs.repartition(3), weights={"big": 1, "small": 1}, seed=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert out.groupBy("doc_id", "source").agg(F.max("copy").alias("m"), F.max("n_copies").alias("n")).where("m > n").count() == 0
    tempered = Counter(r.source for r in mixing.mix(docs, temperature=0.0).collect())
    assert tempered[None] > 800  # one row takes a third of the mix: its rate is far above one piece
    assert mixing.mix(documents([])).count() == 0
    clash = mixing.mix(docs.withColumn("number", F.lit(1)).withColumn("copy", F.lit("c")))
    assert dict(clash.dtypes)["copy"] == "int" and "number" in clash.columns


def test_pipeline_equals_brute_force(spark, documents, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = documents([(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "12 34", "en", "src2", 5), (None, "the of and in this is a text of the first and the last", None, "src1", 30), (9004, "the of and in this is a text of the other", None, None, 9)])
    source.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    folder, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    kept = corpus_pipeline.keep_identified(spark, docs, folder)
    model = language.train(docs.where("crc32(cast(doc_id as string)) % 4 <> 2").select("text", "lang"))
    rows = [tuple(r) for r in docs.collect()]
    labels = [found for group in language.chunks(r[1] for r in rows) for found in language.label_group(model, group, 12.0)]
    want = [(i, t, lang or f["lang"], s, n) for (i, t, lang, s, n), f in zip(rows, labels) if f["lang"] != "und" and f["score"] >= 0.5]
    assert kept.columns == names and Counter(map(tuple, kept.collect())) == Counter(want)
    assert len(want) >= 0.97 * len(rows)

    rows, lines = want, brute.dedup_lines([r[:2] for r in want])
    want = [(i, text, r[2], r[3], len(text)) for r, (i, text, _, dropped) in zip(rows, lines) if not (dropped and not text.strip(brute.SPACES))]
    kept = corpus_pipeline.drop_repeated_lines(spark, kept, folder)
    assert kept.columns == names and Counter(map(tuple, kept.collect())) == Counter(want)

    groups = brute.near_documents([r[:2] for r in want if r[0] is not None])
    want = [r for r in want if r[0] is None or groups[r[0]][1] == r[0]]
    kept = corpus_pipeline.keep_one_of_group(spark, kept, folder)
    assert kept.columns == names and Counter(map(tuple, kept.collect())) == Counter(want)

    mixed = corpus_pipeline.mix_sources(spark, kept, folder)
    assert mixed.columns == names
    copies = Counter(map(tuple, mixed.collect()))
    assert set(copies) <= set(want) and abs(sum(copies.values()) - len(want)) < 6 * len(want) ** 0.5

    packed = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.pack_batches(spark, mixed, folder).where("segment = 0").collect())
    assert packed == Counter({(r[0], min(2048, len(r[1].split()))): n for r, n in copies.items() if r[1].split()})
    assert corpus_pipeline.run(spark, folder).count() >= sum(packed.values())
