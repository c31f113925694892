"""Language identification: script ranges, per-word scores and a Viterbi path over the words of a text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import as_row, field, small_text_batches, unpacked

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
NAMES = ["other", *SCRIPTS]
FEATURES = 1 << 15
CHUNK = 1 << 20
_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """For every code point: can it be in a word (a letter or a mark on one), its script, and is it a letter; built once per worker."""
    if not _tables:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        letter = np.array([kind in "LM" for kind in kinds])
        script = np.zeros(0x110000, np.uint8)
        for number, blocks in enumerate(SCRIPTS.values(), 1):
            for first, last in blocks:
                script[first : last + 1] = number
        _tables.extend([letter, script, np.array([kind == "L" for kind in kinds])])
    return _tables


def folded(text: str | None) -> str:
    """Lower case with the same positions as the text."""
    if not text:
        return ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def chunks(texts: Iterable[str | None], limit: int = CHUNK) -> Iterator[list[str]]:
    """Whole texts in groups of about ``limit`` characters, which bounds the memory of the arrays made from them."""
    group, size = [], 0
    for text in texts:
        group.append(folded(text))
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


@dataclass
class Words:
    """Words (runs of letters) of a group of texts. All positions count code points from the start of the group."""

    offsets: np.ndarray  # of each text
    feature: np.ndarray  # of each letter
    first: np.ndarray  # index among the letters of each word's first letter
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    doc: np.ndarray  # index of the word's text
    lettered: np.ndarray  # of each text: does it have a letter


def find_words(group: list[str]) -> Words:
    letter, script, real = tables()
    codes = np.frombuffer(("\n".join(group) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(text) + 1 for text in group])])
    is_letter = letter[np.minimum(codes, 0x10FFFF)]
    at = np.flatnonzero(is_letter)
    before = np.where((at > 0) & is_letter[at - 1], codes[at - 1], 0).astype(np.uint64)
    after = np.where(is_letter[at + 1], codes[at + 1], 0).astype(np.uint64)  # the last code is a line end
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + codes[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    feature = (mixed >> np.uint64(64 - 15)).astype(np.int64)
    opens = (before == 0) & ~((at > 0) & is_letter[at - 1]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(opens)
    start = at[first]
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(first) else first
    lettered = np.zeros(len(group), bool)
    lettered[np.searchsorted(offsets, at[real[codes[at]]], "right") - 1] = True
    return Words(offsets, feature, first, start, at[last] + 1, script[codes[start]], np.searchsorted(offsets, start, "right") - 1, lettered)


@dataclass
class LanguageModel:
    """Log probabilities of letter trigrams (hashed to FEATURES rows) per language, and which scripts a language uses."""

    langs: list[str]
    logs: np.ndarray
    uses: np.ndarray

    def word_scores(self, found: Words) -> np.ndarray:
        """Log likelihood of every word in every language; languages that do not use its script are out of the race.

        A script that no language uses says nothing, its words score 0 everywhere.
        """
        scores = np.add.reduceat(self.logs[found.feature], found.first, axis=0).astype(np.float64)
        uses = self.uses[found.script]
        known = uses.any(axis=1)
        scores[~uses] -= 1e4
        scores[~known] = 0
        return scores


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_langs: int = 256, min_share: float = 0.01) -> LanguageModel:
    """Count trigrams of all given texts per language. The model has FEATURES x languages numbers, whatever the input.

    Rows without a language or a letter teach nothing; without any row the model knows no language. More than ``max_langs``
    languages are an error. A language uses a script if it makes ``min_share`` of its letters.
    """
    small_text_batches(docs.sparkSession)
    rows = as_row(docs).select(field(lang_col).cast("string").alias("lang"), field(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        size = FEATURES + len(NAMES)
        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for group in chunks(text.as_py() for text in batch.column(1)):
                found = find_words(group)
                of = found.doc[np.searchsorted(found.first, np.arange(len(found.feature)), "right") - 1] if len(found.feature) else found.doc
                ends = np.concatenate([found.first[1:], [len(found.feature)]]) if len(found.first) else found.first
                for lang in set(langs[at : at + len(group)]):
                    mine = np.array([each == lang for each in langs[at : at + len(group)]])
                    have = counts.setdefault(lang, np.zeros(size, np.int64))
                    have[:FEATURES] += np.bincount(found.feature[mine[of]], minlength=FEATURES)
                    chosen = mine[found.doc]
                    have[FEATURES:] += np.bincount(found.script[chosen], weights=(ends - found.first)[chosen], minlength=len(NAMES)).astype(np.int64)
                at += len(group)
        for lang, have in counts.items():
            slots = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots.astype(np.int32)), pa.array(have[slots])], names=["lang", "slot", "n"])

    totals = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # At most (FEATURES + scripts) rows per language.
    names = [row["lang"] for row in rows.select("lang").distinct().limit(max_langs + 1).collect()]
    if len(names) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    table = totals.toPandas()
    langs = sorted(set(table["lang"]))
    counts = np.zeros((FEATURES + len(NAMES), len(langs)))
    counts[table["slot"].to_numpy(), table["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(dtype=np.int64)] = table["n"].to_numpy()
    seen = counts[:FEATURES]
    logs = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * FEATURES)).astype(np.float32)
    letters = counts[FEATURES:]
    uses = letters >= min_share * np.maximum(letters.sum(axis=0), 1)
    return LanguageModel(langs, logs, uses & (letters > 0))


def best_paths(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Per word the language on the best path of its text: the sum of word scores less ``penalty`` for every switch.

    Most texts have one language. If no run of words gains more than half of ``penalty`` by leaving the text's best single
    language, no path of k > 1 runs can pay for its k - 1 or more switches, so that constant path is best. Only the other
    texts go through the dynamic program, all texts of the group in step.
    """
    count = len(doc)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.concatenate([starts, [count]]))
    nth = np.repeat(np.arange(len(starts)), sizes)
    single = np.argmax(np.add.reduceat(scores, starts, axis=0), axis=1)
    path = single[nth]
    gain = scores - np.take_along_axis(scores, path[:, None], axis=1)
    upto = np.cumsum(gain, axis=0)
    before = upto - gain
    step = float(np.abs(upto).max()) * 2 + 1  # lets the running minimum start anew with each text
    low = np.minimum.accumulate(before - nth[:, None] * step, axis=0) + nth[:, None] * step
    most = np.maximum.reduceat(upto - low, starts, axis=0).max(axis=1)
    mixed = np.flatnonzero(most > penalty / 2 - 1e-3)
    if not len(mixed):
        return path
    mixed = mixed[np.argsort(-sizes[mixed], kind="stable")]
    langs = scores.shape[1]
    running = np.searchsorted(-sizes[mixed], -np.arange(sizes[mixed[0]]), "left")  # texts longer than each step
    base = np.concatenate([[0], np.cumsum(running)])  # one slot per word: text i at step t has slot base[t] + i
    stay = np.zeros((base[-1], langs), bool)
    leader = np.zeros(base[-1], np.int32)
    value = scores[starts[mixed]].copy()
    for t, active in enumerate(running.tolist()):
        if t:
            now, slots = value[:active], slice(base[t], base[t + 1])
            top = now.argmax(axis=1)
            best = now[np.arange(active), top][:, None] - penalty
            leader[slots] = top
            stay[slots] = now >= best
            value[:active] = np.maximum(now, best) + scores[starts[mixed[:active]] + t]
    ended = value.argmax(axis=1)
    for i, d in enumerate(mixed):
        lang = ended[i]
        for t in range(sizes[d] - 1, -1, -1):
            path[starts[d] + t] = lang
            if t and not stay[base[t] + i, lang]:
                lang = leader[base[t] + i]
    return path


def label_group(model: LanguageModel, group: list[str], penalty: float) -> list[dict]:
    """Per text its language, the share of its letters in it, and the spans (start, end, lang) in code points."""
    out = [{"lang": "und", "score": 0.0, "spans": []} for _ in group]
    found = find_words(group)
    if not len(found.first) or not model.langs:
        return out
    none = len(model.langs)  # of words without a candidate language
    path = np.where(model.uses[found.script].any(axis=1), best_paths(model.word_scores(found), found.doc, penalty), none)
    sizes = np.diff(np.concatenate([found.first, [len(found.feature)]]))
    letters = np.zeros((len(group), none + 1), np.int64)
    np.add.at(letters, (found.doc, path), sizes)
    opens = np.flatnonzero(np.concatenate([[True], (found.doc[1:] != found.doc[:-1]) | (path[1:] != path[:-1])]))
    closes = np.concatenate([opens[1:], [len(path)]]) - 1
    for a, b in zip(opens.tolist(), closes.tolist()):
        if path[a] == none or not found.lettered[found.doc[a]]:
            continue
        base = found.offsets[found.doc[a]]
        out[found.doc[a]]["spans"].append({"start": int(found.start[a] - base), "end": int(found.end[b] - base), "lang": model.langs[path[a]]})
    sums = letters.sum(axis=1)
    for i in np.flatnonzero(found.lettered).tolist():  # where no known language has a letter, the first with score 0
        top = int(letters[i, :none].argmax())
        out[i]["lang"], out[i]["score"] = model.langs[top], float(letters[i, top] / sums[i])
    return out


RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 12.0, text_col: str = "text") -> DataFrame:
    """Label every text with its main language and with spans of each language.

    The script of a word leaves only languages that use it; the word's score in each is the log likelihood of its letter
    trigrams; the best path over all words of the text pays ``penalty`` nats for a change of language. The main language
    is the one with most letters on the path (ties: the first by name), ``score`` its share of all letters of the text. Words of
    a script that no known language uses belong to no language and no span, but their letters count in that share.

    Returns the input's columns, then ``lang_pred``, ``score`` and ``spans`` (start, end and lang in code points of the text).
    Null and empty texts and texts without a letter (marks alone are none) are ``und`` with score 0 and no spans, as is everything if
    the model knows no language. A text all in scripts that no known language uses gets the first language by name, with score 0
    and no spans. Long texts are handled whole. Repeated rows are each returned; an empty table gives an empty table.
    """
    small_text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers

    @F.arrow_udf("struct<lang string, score double, spans array<struct<start int, end int, lang string>>>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array(label_group(shared.value, group, penalty), RESULT) for group in chunks(text.as_py() for text in batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    labelled = as_row(docs).withColumn("found", label(field(text_col)))
    return unpacked(labelled, lang_pred=F.col("found.lang"), score=F.col("found.score"), spans=F.col("found.spans"))
