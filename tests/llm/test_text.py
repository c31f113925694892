import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import language, line_dedup, ngram_join, passage_dedup, secrets, suffixes

EDGE = [(1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "x"), (6, "A line that is here twice\nshort\nA line that is here twice"), (7, "a LINE that is here twice \nshort\nand more"), (8, "é" * 9 + "\n" + "É" * 12), (9, "é" * 9 + "\n" + "é" * 12), (10, "é" * 12), (None, "a line that is here twice"), (None, None)]


def test_line_dedup_equals_brute_force(documents):
    rng = random.Random(3)
    lines = [f"line number {i} of the pool" for i in range(12)] + ["tiny", "", "  Line Number 3 of the pool\t"]
    rows = EDGE + [(20 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows.append((200, "many lines\n" * 5000))
    want = sorted(brute.dedup_lines(rows), key=str)
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        out = line_dedup.dedup_lines(documents(rows), batches=batches, fanout=fanout)
        got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
        assert sorted(got, key=str) == want


def test_line_dedup_repeated_rows_extra_columns_and_empty_table(spark):
    rows = [(1, "one long line here", "a"), (1, "one long line here", "a"), (2, "one long line here", "b")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, N_LINES string"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in out.collect()) == [(1, "one long line here", 0)] * 2 + [(2, "", 1)]
    taken = spark.createDataFrame([(1, "x", 7, 8, 9)], "doc_id long, text string, row int, h1 int, lost int")
    assert [tuple(r) for r in line_dedup.dedup_lines(taken).collect()] == [(1, "x", 7, 8, 9, 1, 0)]
    assert line_dedup.dedup_lines(taken.limit(0)).count() == 0


def test_line_index_keeps_levels_and_forgets(spark, documents):
    index = line_dedup.LineIndex(spark, fanout=2)
    for i in range(4):
        index.add(documents([(i, f"a line of batch {i}\na line of every batch")]))
    assert [len(level) for level in index.levels] == [0, 0, 1]
    assert spark.table(index.runs[0]).count() == 5
    lost = index.add(documents([(9, "first\nA LINE OF BATCH 2")])).collect()
    assert [(r.id, r.lost) for r in lost] == [(9, [1])]
    index.close()


def test_suffix_array_and_repeats_equal_brute_force():
    rng = random.Random(1)
    for symbols, _ in itertools.product((1, 2, 3, 26), range(40)):
        text = bytes(rng.randrange(97, 97 + symbols) for _ in range(rng.randint(0, 70)))
        numbers = np.array([*text, 0], np.int64)
        assert suffixes.suffix_array(numbers, 258).tolist() == sorted(range(len(text) + 1), key=lambda i: (text + b"\0")[i:])
        texts = [bytes(rng.randrange(97, 97 + symbols) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        size = rng.randint(1, 8)
        seen = [t[i : i + size] for t in texts for i in range(len(t) - size + 1)]
        want = [[i for i in range(len(t) - size + 1) if seen.count(t[i : i + size]) > 1] for t in texts]
        assert [a.tolist() for a in suffixes.repeated_starts(texts, size)] == want
    order = suffixes.suffix_array(np.array([*b"abcabcab", 0], np.int64), 258)
    _, prefix = suffixes.common_prefixes(np.array([*b"abcabcab", 0], np.int64), order, 1, 8)
    assert prefix.tolist() == [5, 4, 3, 2, 1, 0, 0, 0, 0] or sorted(prefix.tolist()) == [0, 0, 0, 0, 1, 2, 3, 4, 5]


def passages(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(3)]
    rows = [(i, text(rng.randint(1, 60)) + rng.choice(shared + [""]) + text(rng.randint(0, 30))) for i in range(40)]
    copy = rows[3][1]
    rows += [(50, copy), (50, copy), (51, copy[:60] + "#" + copy[61:]), (52, "z" * 500), (53, None), (54, ""), (None, shared[0]), (55, shared[1][: size - 1]), (56, shared[1][:size])]
    return rows


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_repeated_passages_equal_brute_force(documents, monkeypatch, shard):
    monkeypatch.setattr(passage_dedup, "SHARD_BYTES", shard)  # the small one forces the halving of groups
    rows = passages(5, 64)
    want = brute.remove_repeats([t for _, t in rows], 64)
    out = passage_dedup.remove_repeats(documents(rows), size=64).select("doc_id", "n_bytes", "n_removed", "removed", "kept").collect()
    got = sorted((str(r.doc_id), bytes(r.kept), [tuple(s) for s in r.removed]) for r in out)
    assert got == sorted((str(i), kept, runs) for (i, _), (kept, runs) in zip(rows, want))
    assert all(r.n_bytes - r.n_removed == len(r.kept) for r in out)


def test_repeated_passages_of_an_empty_table(documents):
    assert passage_dedup.remove_repeats(documents([])).count() == 0


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        for _ in range(4):
            other = base[:]
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((len(rows), " ".join(other).upper() if rng.random() < 0.3 else "  ".join(other)))
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE\ttwo"), (105, "two one"), (106, "a b c d e")]


def test_ngram_join_equals_brute_force(documents):
    for seed in (1, 2):
        rows = near_rows(seed)
        out = ngram_join.near_documents(documents(rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.near_documents(rows)


def test_ngram_join_edges(spark, documents):
    rows = [(None, "the same five words here"), (7, "the same five words here"), (7, "the same five words here"), (8, "the same five words HERE")]
    out = ngram_join.near_documents(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == [("7", "7"), ("7", "7"), ("8", "7"), ("None", "None")]
    assert ngram_join.near_documents(documents([])).count() == 0


def test_every_pair_over_the_threshold_shares_prefixes_in_every_order():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 6, 1 << ngram_join.BUCKET_BITS).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, 2).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (len(x) + len(y) - common):
            for order in ngram_join.ORDERS:
                a, b = (ngram_join.prefix(s, counts, order, 75) for s in (x, y))
                _, i, j = np.intersect1d(a, b, return_indices=True)
                assert len(i)
                # the bound at the first common token must not rule the pair out
                assert 175 * min(len(x) - i.min(), len(y) - j.min()) >= 75 * (len(x) + len(y))


def test_parity_never_rejects_a_linked_pair():
    rng = np.random.default_rng(6)
    rejected = 0
    for _ in range(400):
        x = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 90))).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.2, 0.9, 1.0])], rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64)]))
        if len(y):
            common = len(np.intersect1d(x, y))
            may = ngram_join.may_link(ngram_join.parity(x), len(x), ngram_join.parity(y), len(y), 75)
            assert may or 100 * common < 75 * (len(x) + len(y) - common)
            rejected += not may
    assert rejected > 100


def test_secret_patterns_and_random_strings(documents):
    rng = random.Random(9)
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
    prose = "plain words of ordinary prose follow one another without an end " * 20
    rows = [
        (1, 'x PassWord : "abc/123" y'),
        (2, "secret=short token=abcdef"),
        (3, "AKIA" + "A1" * 8 + " AKIA" + "B" * 15),
        (4, "é " + "0123456789abcdef" * 2),
        (5, f"{prose} {base64} {prose}"),
        (6, f"{prose} section-12-of-the-manual-for-users-version-2 aaaaaaaaaaaaaaaaaaaaa1"),
        (7, None),
        (8, ""),
        (9, "api_key='k' apikey=abcdefg ſecret=abcdefg"),
    ]
    out = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.scan_secrets(documents(rows)).collect()}
    assert out[1] == [(2, "assign", 21)]
    assert out[2] == [(13, "assign", 25)]
    assert out[3] == [(0, "access", 20)]
    assert out[4] == [(2, "hex", 34)]
    assert out[5] == [(len(prose) + 1, "random", len(prose) + 65)]
    assert out[6] == out[7] == out[8] == []
    assert out[9] == [(12, "assign", 26)]
    assert secrets.scan_secrets(documents([])).count() == 0


def test_secrets_in_runs_of_several_alphabets_and_beside_base_spans(documents):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n, more="": "".join(rng.choice(letters + more) for _ in range(n))
    prose = "plain words of ordinary prose follow one another without an end " * 40
    plain, url, other, key = token(40), token(30) + "-" + token(30), token(30) + "/" + token(30), token(40)
    access, hexes = "AKIA" + "A1" * 8, "0123456789abcdef" * 2
    texts = [
        (f"https://example.com/reset-password/{plain} ", plain),
        (f"https://example.com/reset-password/{url} ", url),
        (f"id-{other} ", other),
        (f"{access}/{key} ", key),
        (f"{hexes}-{key}_{hexes} ", key),
        ("one/two-three/four-five/six-seven/eight-9 ", None),
        (f"{access}/{key[:19]} ", None),
    ]
    rows = [(i, prose + text + prose) for i, (text, _) in enumerate(texts)]
    out = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in secrets.scan_secrets(documents(rows)).collect()}
    for (i, row), (_, secret) in zip(rows, texts):
        assert [row[a:b] for a, b in out[i]] == ([secret] if secret else [])


def test_candidates_leave_out_nothing_but_base_spans():
    text = "a1" * 12 + "/" + "b2" * 12
    assert list(secrets.candidates(text, [])) == [(0, 49)]
    assert list(secrets.candidates(text, [(24, 0, 25)])) == [(0, 24), (25, 49)]
    assert list(secrets.candidates(text, [(0, 1, 24), (2, 2, 10)])) == [(25, 49)]
    assert list(secrets.candidates(text, [(0, 1, 49)])) == list(secrets.candidates("a/b-" * 9, [])) == []


def test_randomness_battery_tells_noise_from_order():
    rng = np.random.default_rng(8)
    passed = [secrets.randomness(rng.integers(0, 16, 40), 16) >= 0.001 for _ in range(300)]
    assert np.mean(passed) > 0.97
    assert secrets.randomness(np.arange(40) % 16, 16) < 0.001
    assert secrets.randomness(np.zeros(40, np.int64), 16) < 0.001


def test_viterbi_equals_the_plain_dynamic_program():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 30, 5)
        doc = np.repeat(np.arange(5), sizes)
        scores = -rng.random((len(doc), 3)) * 8
        path = language.best_paths(scores.copy(), doc, 5.0)
        for d in range(5):
            s, p = scores[doc == d], path[doc == d]
            value = s[0]
            for row in s[1:]:
                value = np.maximum(value, value.max() - 5.0) + row
            ours = s[np.arange(len(s)), p].sum() - 5.0 * (p[1:] != p[:-1]).sum()
            assert ours == pytest.approx(value.max())


def test_language_spans_and_edges(spark, documents):
    english = "the quick brown fox jumps over the lazy dog and runs through the wood "
    german = "der schnelle braune fuchs springt über den faulen hund und läuft durch den wald "
    greek = "η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί "
    model = language.train(documents([(1, english * 3, "en"), (2, german * 3, "de"), (3, greek * 3, "el"), (4, None, "xx"), (5, "text", None)]))
    assert model.langs == ["de", "el", "en"]
    rows = [(1, english), (2, german), (3, greek), (4, None), (5, ""), (6, "12 34 !"), (7, english * 2 + german), (8, "Добрый день"), (9, greek.upper()), (10, english * 4000)]
    out = {r.doc_id: r for r in language.identify(documents(rows), model).collect()}
    assert [out[i].lang_pred for i in range(1, 8)] == ["en", "de", "el", "und", "und", "und", "en"]
    assert [s.lang for s in out[7].spans] == ["en", "de"] and abs(out[7].spans[1].start - 2 * len(english)) < 8
    assert out[9].lang_pred == "el" and out[10].score == 1.0 and out[4].score == 0.0
    assert 0 <= out[8].score <= 1
    assert language.identify(documents([]), model).count() == 0
    nothing = language.train(documents([]))
    assert {r.lang_pred for r in language.identify(documents(rows), nothing).collect()} == {"und"}


def test_scripts_without_a_language_count_for_none(spark, documents):
    english, german = "the quick brown fox jumps over the lazy dog ", "der schnelle braune fuchs springt über den hund "
    model = language.train(documents([(1, english * 3, "en"), (2, german * 3, "de")]))
    rows = [(7, "\u0301 \u0302\u0303"), (1, "Добрый день, как дела"), (2, "η γρήγορη αλεπού"), (3, "你好世界"), (4, english + "день " * 3 + english), (5, "the день" * 5), (6, english)]
    out = {r.doc_id: r for r in language.identify(documents(rows), model).collect()}
    assert [(out[i].lang_pred, out[i].score, out[i].spans) for i in (1, 2, 3)] == [("de", 0.0, [])] * 3
    assert out[4].lang_pred == "en" and out[4].score == 70 / 82 and [s.lang for s in out[4].spans] == ["en", "en"]
    assert out[4].spans[0].end == len(english) - 1 and out[4].spans[1].start == len(english) + 15
    assert out[5].score < 0.5 and out[6].score == 1.0
    assert (out[7].lang_pred, out[7].score, out[7].spans) == ("und", 0.0, [])  # marks without a letter


def test_pipeline_language_stage_rejects_foreign_scripts_and_wants_labels(spark, documents):
    english = "the quick brown fox jumps over the lazy dog "
    rows = [(i, english * 2, "en" if i < 20 else None) for i in range(40)] + [(50, "Добрый день, как дела", None), (51, "12", None)]
    kept = corpus_pipeline.keep_identified(spark, documents(rows), "").collect()
    assert sorted((r.doc_id, r.lang) for r in kept) == [(i, "en") for i in range(40)]
    with pytest.raises(ValueError, match="no labelled document"):
        corpus_pipeline.keep_identified(spark, documents([(1, english), (2, "12")]), "")
    for none in ([], [(1, "12"), (2, None)]):
        assert corpus_pipeline.keep_identified(spark, documents(none), "").count() == 0


def test_held_out_accuracy(spark):
    from harborline.llm import queries

    folder = "/root/testdata/sf0.01"
    out = queries.op10_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
