"""Secret scanning: fixed patterns, and strings that pass a battery of randomness tests."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field
from harborline.session import written

# The base patterns. Letters of the keywords may have either case, in ASCII only.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ["assign", "access", "hex", "random"]
MIN_VALUE, MIN_ACCESS = 6, 20

# Alphabets, narrowest first: a string belongs to the first that has all its symbols.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
MIN_RANDOM = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
SEPARATORS = "+/_-"
# Ways to split a run that mixes the symbols of two alphabets: its pieces in base64url, in base64 and without separators.
SPLITS = [re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), re.compile(r"[^+/_-]+")]
LENGTHS = [20, 24, 32, 48, 64, 128]
BINS = 400  # of the evidence, 0.05 wide


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, in order."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    return sorted(spans)


def encoding_of(word: str) -> str | None:
    symbols = set(word)
    return next((name for name, alphabet in ALPHABETS.items() if symbols <= set(alphabet)), None)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(values: np.ndarray, symbols: int) -> float:
    """Combined p-value (Fisher) of three tests of the hypothesis that the symbols are uniform and independent.

    Chi-squared on the symbol counts (normal by Wilson and Hilferty), Wald-Wolfowitz runs above and below the middle of the
    alphabet, and serial correlation of neighbours. Small means: not random.
    """
    n = len(values)
    counts = np.bincount(values, minlength=symbols)
    expected, free = n / symbols, symbols - 1
    chi = float(((counts - expected) ** 2).sum() / expected)
    p_chi = normal_tail(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = values >= symbols / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * normal_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)  # all on one side
    centred = values - values.mean()
    power = float((centred**2).sum())
    p_serial = 2 * normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / power) * math.sqrt(n)) if power else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def evidence(values: np.ndarray, logs: np.ndarray, mean: float, spread: float) -> float:
    """How far the string is from ordinary text: standardised log ratio of the uniform to the corpus' symbol distribution."""
    return (float(logs[values].sum()) - len(values) * mean) / (spread * math.sqrt(len(values))) if spread > 0 else 0.0


def symbol_models(docs: DataFrame, text_col: str) -> dict[str, tuple[np.ndarray, float, float]]:
    """Per alphabet the log ratio of each symbol and its mean and deviation in ordinary text, from the bytes of all texts."""

    def count(batches):
        sums = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    sums += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(sums)], names=["byte", "n"])

    rows = as_row(docs).select(field(text_col).alias("text")).mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(256)
    for row in rows:
        counts[row["byte"]] = row["n"]
    models = {}
    for name, alphabet in ALPHABETS.items():
        share = counts[[ord(c) for c in alphabet]] + 1.0
        share /= share.sum()
        logs = -np.log(len(alphabet) * share)
        mean = float((share * logs).sum())
        models[name] = (logs, mean, math.sqrt(max(0.0, float((share * logs * logs).sum()) - mean * mean)))
    return models


def outside(start: int, end: int, text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a run outside the base spans (in order of their starts), without the separators at a cut."""
    low, cut = start, False
    for first, _, last in [*((s, k, e) for s, k, e in taken if s < end and start < e), (end, 0, end)]:
        a, b = low, min(first, end)
        while cut and a < b and text[a] in SEPARATORS:
            a += 1
        while b < end and a < b and text[b - 1] in SEPARATORS:
            b -= 1
        if b - a >= MIN_RANDOM:
            yield a, b
        cut = cut or last > low
        low = max(low, last)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Strings to test: runs outside the base spans; a run that fits no alphabet gives all its pieces that do."""
    for m in CANDIDATE.finditer(text):
        for start, end in outside(m.start(), m.end(), text, taken):
            if encoding_of(text[start:end]) is not None:
                yield start, end
                continue
            pieces = {(p.start(), p.end()) for split in SPLITS for p in split.finditer(text, start, end)}
            yield from sorted((a, b) for a, b in pieces if b - a >= MIN_RANDOM)


def random_spans(text: str, taken: list[tuple[int, int, int]], models: dict, level: float) -> list[dict]:
    """Strings outside the base spans that could be a secret, each with its evidence, if the battery calls them random."""
    out = []
    for start, end in candidates(text, taken):
        word = text[start:end]
        if word.isalpha() or not any(c.isalpha() for c in word) or not any(c.isdigit() for c in word):
            continue
        encoding = encoding_of(word)
        alphabet = ALPHABETS[encoding]
        values = np.array([alphabet.index(c) for c in word])
        passed = randomness(values, len(alphabet)) >= level
        out.append({"start": start, "end": end, "encoding": encoding, "random": passed, "evidence": evidence(values, *models[encoding])})
    return out


FOUND = pa.struct(
    [
        ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
        ("more", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("random", pa.bool_()), ("evidence", pa.float64())]))),
    ]
)


def accepted(histogram: list, rate: float) -> dict[tuple[str, int], int]:
    """Per encoding and length class the smallest bin of evidence that Benjamini and Hochberg's rule accepts at ``rate``.

    The test of a string asks whether it is ordinary text; its p-value is the normal tail of the evidence. Length
    classes are judged on their own, so that the many short candidates do not decide over the few long ones.
    """
    limits, groups = {}, {}
    for row in histogram:
        groups.setdefault((row["encoding"], row["class"]), {})[row["bin"]] = row["n"]
    for key, bins in groups.items():
        total, above = sum(bins.values()), 0
        for bin_ in sorted(bins, reverse=True):
            above += bins[bin_]
            if normal_tail(bin_ * 0.05) <= rate * above / total:
                limits[key] = bin_
    return limits


def scan_secrets(docs: DataFrame, rate: float = 0.01, level: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in all texts: three fixed patterns, and strings that look random.

    A candidate is a run of 20 or more characters of the wide alphabets that has a letter and a digit and lies outside the
    base spans; a run that touches base spans is cut there, and the rest, less the separators (+ / - _) at the cut, is a candidate
    if it still has 20 characters. Its encoding is the narrowest alphabet that has all its symbols. A run that fits no
    alphabet, since it has + or / as well as - or _, is split at + and /, at - and _, and at all four, and every piece of 20 or
    more characters is a candidate; of accepted pieces that overlap, those of most evidence are reported. Other runs are
    tested whole. A candidate is reported if the battery (see
    ``randomness``) does not reject chance at ``level``, and if ordinary text is rejected with a false-discovery rate of
    ``rate`` inside its encoding and length class; what ordinary text is, comes from the bytes of all texts.

    Returns per row the id column and ``spans``: start, kind (assign, access, hex or random) and end, in code points with
    the end exclusive, by start, then kind in that order. Null and empty texts have no spans. Rows may repeat, ids may be
    null. An empty table gives an empty table. Other columns are not read.
    """
    models = symbol_models(docs, text_col)

    @F.arrow_udf("struct<base array<struct<start int, kind int, end int>>, more array<struct<start int, end int, encoding string, random boolean, evidence double>>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                text = value.as_py() or ""
                base = base_spans(text)
                out.append({"base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "more": random_spans(text, base, models, level)})
            yield pa.array(out, FOUND)

    found = as_row(docs).select(field(id_col).alias("id"), scan(field(text_col)).alias("found")).select("id", "found.base", "found.more")
    found = written(found, "secrets")  # spans only: a few bytes for each text

    def class_of(span):
        length = span["end"] - span["start"]
        return sum(((length >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))

    def bin_of(span):
        return F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(span["evidence"] / 0.05))).cast("int")

    each = found.select(F.explode("more").alias("s")).select(F.col("s.encoding").alias("encoding"), class_of(F.col("s")).alias("class"), bin_of(F.col("s")).alias("bin"))
    limits = accepted(each.groupBy("encoding", "class", "bin").agg(F.count(F.lit(1)).alias("n")).collect(), rate)  # a bounded table

    def wanted(span):
        fits = F.lit(False)
        for (encoding, class_), bin_ in limits.items():
            fits = fits | ((span["encoding"] == encoding) & (class_of(span) == class_) & (bin_of(span) >= bin_))
        return span["random"] & fits

    # Pieces of one run may overlap: the best first, each unless it meets a better one that stays.
    best = F.array_sort(F.transform(F.filter("more", wanted), lambda s: F.struct((-s["evidence"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"))))
    apart = F.aggregate(best, F.slice(best, 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s))))
    more = F.transform(apart, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), s["end"].alias("end")))
    spans = F.array_sort(F.concat("base", more))
    names = F.array(*(F.lit(kind) for kind in KINDS))
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), named.alias("spans"))
