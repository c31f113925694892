"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from harborline.llm.common import UPPER

# White space as the operators know it, for trim() and for regular expressions.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPACE_RUN = r"'[\x20\x09-\x0D]+'"


def lower_ascii(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), {SPACE_RUN}), lambda w: w <> '')"


def unit(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE)"


LINES = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, {lower_ascii(f"trim(line, {SPACES})")} AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS lost FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def rules_values(rules: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)


def urls(rules: list[tuple[str, str, str]], default: str) -> str:
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules_values(rules)}),
parts AS (SELECT page_id,
  {lower_ascii("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM best WHERE n = 1"""


def mixed(temperature: float, seed: int, piece: float) -> str:
    return f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(n)::DOUBLE AS n, sum(pow(n::DOUBLE, {temperature!r})) AS wanted FROM sizes),
rates AS (SELECT source, sums.n * pow(sizes.n::DOUBLE, {temperature!r}) / sums.wanted / sizes.n AS rate FROM sizes, sums),
pieces AS (SELECT *, greatest(1, ceil(rate / {piece!r}))::INT AS pieces FROM rates),
means AS (SELECT *, rate / pieces AS mean FROM pieces),
steps AS (SELECT source, unnest(generate_series(0, ceil(mean + 12 * sqrt(mean) + 20)::INT)) AS k, mean FROM means),
mass AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(-mean + k * ln(mean) - lgamma(k + 1)) END AS p FROM steps),
sums_to AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM mass),
cdfs AS (SELECT source, list(upto ORDER BY k) AS cdf FROM sums_to GROUP BY source),
draws AS (SELECT doc_id, source, text, unnest(generate_series(1, pieces)) AS piece, cdf
  FROM documents JOIN means USING (source) JOIN cdfs USING (source)),
drawn AS (SELECT doc_id, source, text, sum(least(len(cdf), len(list_filter(cdf, lambda c: c <= {unit(f"'{seed}'", "doc_id::VARCHAR", "piece::VARCHAR")})))) AS n
  FROM draws GROUP BY ALL)
SELECT doc_id, source, unnest(generate_series(1, n::BIGINT)) AS copy, n::BIGINT AS n_copies,
  md5(concat_ws(':', '{seed}', 'place', doc_id::VARCHAR, copy::VARCHAR)) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256
FROM drawn WHERE n > 0"""


def packed(buckets: int, max_tokens: int, batch_tokens: int, seed: int) -> str:
    """The dynamic program as one step per bucket over the prefix sums of the histogram."""
    steps = ["cost0 AS (SELECT 0 AS i, 0::HUGEINT AS cost)"]
    for b in range(1, buckets + 1):
        steps.append(
            f"""cost{b} AS (SELECT r.i, min(c.cost + r.n * (r.rows - coalesce(l.rows, 0)) - (r.tokens - coalesce(l.tokens, 0)))::HUGEINT AS cost,
  arg_min(c.i, (c.cost + r.n * (r.rows - coalesce(l.rows, 0)) - (r.tokens - coalesce(l.tokens, 0)), c.i)) AS back
  FROM cost{b - 1} c JOIN sums r ON r.i > c.i LEFT JOIN sums l ON l.i = c.i GROUP BY r.i)"""
        )
    # With fewer lengths than buckets, every length is a bound of its own.
    walk = [f"at{buckets} AS (SELECT max(i) AS i FROM sums)"]
    for b in range(buckets, 1, -1):
        walk.append(f"at{b - 1} AS (SELECT back AS i FROM cost{b} JOIN at{b} USING (i))")
    ends = " UNION ALL ".join(f"SELECT i FROM at{b}" for b in range(1, buckets + 1))
    return f"""
WITH docs AS (SELECT doc_id, {words("text")} AS list FROM documents),
cuts AS (SELECT doc_id, list, unnest(generate_series(0, ((len(list) + {max_tokens - 1}) // {max_tokens}) - 1)) AS segment FROM docs WHERE len(list) > 0),
parts AS (SELECT doc_id, segment, list[segment * {max_tokens} + 1 : segment * {max_tokens} + {max_tokens}] AS part FROM cuts),
pieces AS (SELECT doc_id, segment, len(part) AS n_tokens, array_to_string(part, ' ') AS text,
  {unit(f"'{seed}'", "doc_id::VARCHAR", "segment::VARCHAR")} AS place FROM parts),
histogram AS (SELECT n_tokens AS n, count(*) AS rows FROM pieces GROUP BY n_tokens),
sums AS (SELECT n, row_number() OVER (ORDER BY n) AS i, sum(rows) OVER (ORDER BY n) AS rows, sum(rows * n) OVER (ORDER BY n) AS tokens FROM histogram),
{", ".join(steps)}, {", ".join(walk)},
ends AS (SELECT i FROM sums WHERE (SELECT max(i) FROM sums) <= {buckets} UNION SELECT i FROM ({ends}) WHERE (SELECT max(i) FROM sums) > {buckets}),
bounds AS (SELECT n AS bound, lag(n, 1, 0) OVER (ORDER BY n) AS low, row_number() OVER (ORDER BY n) - 1 AS bucket FROM sums JOIN ends USING (i)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY place, doc_id, segment) - 1 AS pos, {batch_tokens} // bound AS room
  FROM pieces JOIN bounds ON n_tokens > low AND n_tokens <= bound)
SELECT doc_id, segment, n_tokens, bucket, bound, pos // room AS batch, pos % room AS slot, sha256(text) AS text_sha256 FROM numbered"""


VECTORS = """
WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
lowest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN lowest ON id = vec_id LEFT JOIN degree ON a = vec_id"""

TOP = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM usable q JOIN usable r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


NEAR = f"""
WITH RECURSIVE lists AS (SELECT doc_id, {words(lower_ascii("text"))} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM lists),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
lowest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN lowest ON id = doc_id LEFT JOIN sizes USING (doc_id)"""


# Bytes as pairs of hexadecimal digits, so that strings of bytes are strings of text.
REPEATS = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 400)) AS s FROM bytes WHERE length(h) >= 800),
names AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS name FROM starts),
twice AS (SELECT name FROM names GROUP BY name HAVING count(*) > 1),
hits AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM names SEMI JOIN twice USING (name)),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM hits),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS b FROM marked GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS low FROM runs),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(concat(a, ':', b), ',' ORDER BY run) AS removed,
  string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY run) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256, coalesce(removed, '') AS removed FROM bytes LEFT JOIN kept USING (doc_id)"""


PASSAGES = f"""
WITH lists AS (SELECT doc_id, {words("text")} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM lists)),
owners AS (SELECT s, min(doc_id) AS owner FROM windows GROUP BY s),
starts AS (SELECT doc_id, i FROM windows JOIN owners USING (s) WHERE doc_id > owner),
places AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM lists),
judged AS (SELECT p.doc_id, p.i, word, coalesce(max(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) > p.i - 50, false) AS lost
  FROM places p LEFT JOIN starts s ON s.doc_id = p.doc_id AND s.i = p.i),
runs AS (SELECT doc_id, min(i) - 1 AS a, max(i) AS b
  FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM judged WHERE lost) GROUP BY doc_id, run),
spans AS (SELECT doc_id, string_agg(concat(a, ':', b), ',' ORDER BY a) AS removed FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(any_value(removed), '') AS removed, count(word) AS n_words, count(*) FILTER (lost) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id LEFT JOIN spans r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
