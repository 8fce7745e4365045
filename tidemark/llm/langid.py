"""Language identification with spans, for mixed-language text.

The scripts of a word's letters narrow its candidates: only the languages whose scripts cover the most of its
letters can have it, whatever the words around it are. For those a mixture of the language's word frequencies
and its letter trigrams gives the word's log-probability. A Viterbi pass over the words, which pays SWITCH for
each change of language, labels spans; the document's language is the one with the most letters, and its score
is their share.

The model is fitted on about SAMPLE documents of each language at most, and on about SAMPLE_CHARS characters of
them, drawn by a hash of the id over all labelled rows; both are parameters. Every word of the sample counts.
Prediction sees nothing but the text. Words are known by a 64-bit hash (XXH64).

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no span; so is every text
where nothing was labelled; words without letters go with the words around them; of equally likely
languages the first in order of code point wins; scripts that no training text uses narrow nothing;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import text_or_empty
from tidemark.llm.tokens import as_bytes, kept

SAMPLE, SAMPLE_CHARS = 2000, 1 << 23
#: Nats that a change of language costs.
SWITCH = 20.0
#: No word speaks for one language over another by more nats than this.
MOST = 6.0
#: What a word scores in a language that its letters rule out: more than any number of switches costs.
NEVER = -1e6
#: Share of a language's letters from which a script belongs to it.
SCRIPT_SHARE = 0.001
#: Chunks that a worker remembers: some 20 MB.
CACHE = 100_000
#: Signs that often end a word.
SIGNS = b".,;:!?*$%&"
UNKNOWN = "und"

# Unicode ranges of scripts (first and last code point).
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}


NAMES = [*SCRIPTS, "Other"]


def script_number(name: str) -> int:
    return NAMES.index(name)


@cache
def script_of(letter: str) -> str:
    point = ord(letter)
    return next((name for name, ranges in SCRIPTS.items() if any(a <= point <= b for a, b in ranges)), "Other")


def letters_of(chunk: bytes) -> str:
    return "".join(filter(str.isalpha, chunk.decode())).lower()


def trigrams(word: str):
    padded = f"^^{word}$"
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


def in_training(doc_id: Column | None = None) -> Column:
    """The documents that the query learns from: crc32 of the id as text, modulo 4, isn't 2."""
    return ~held_out(doc_id)


def held_out(doc_id: Column | None = None) -> Column:
    text = F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def word_hash(word: str) -> int:
    """A word's XXH64 as a signed integer."""
    h = xxhash.xxh64_intdigest(word.encode())
    return h - (1 << 64) if h >> 63 else h


#: The scripts' ranges in order: first code point, one after the last, and the script's name.
_RANGES = sorted((a, b + 1, name) for name, ranges in SCRIPTS.items() for a, b in ranges)
_EDGES = np.array([x for a, b, _ in _RANGES for x in (a, b)], np.int64)


class Model:
    """Word scores by language.

    ``counts``: arrays lang, kind, feature, n of ``features``; or rows of them with features as text.
    """

    def __init__(self, counts):
        if not isinstance(counts, dict):
            rows = list(counts)
            name = {"w": word_hash, "t": _codes_of, "s": script_number}
            counts = {c: np.array([r[k] if k != 2 else name[r[1]](r[2]) for r in rows], np.int64 if k > 1 else object) for k, c in enumerate(("lang", "kind", "feature", "n"))}
        langs, kinds, features, times = (counts[c] for c in ("lang", "kind", "feature", "n"))
        self.langs = sorted(set(langs[kinds == "s"]))
        place, L = {lang: k for k, lang in enumerate(self.langs)}, len(self.langs)

        def table(kind):
            """Features ascending, and their counts by language."""
            own = np.flatnonzero(kinds == kind)
            own = own[np.isin(langs[own], self.langs)]
            found, at = np.unique(features[own], return_inverse=True)
            rows = np.zeros((len(found), L))
            np.add.at(rows, (at, np.array([place[x] for x in langs[own]], np.int64)), times[own])
            return found, rows

        # The last row of ``gram_rows`` counts for nothing, the one before it stands for unknown trigrams.
        self.gram_codes, n = table("t")
        context, at = np.unique(self.gram_codes >> 21, return_inverse=True)
        seen = np.zeros((len(context), L))
        np.add.at(seen, at, n)
        letters = len(np.unique(self.gram_codes & 0x1FFFFF)) + 1
        rows = np.log((n + 0.1) / (seen[at] + 0.1 * letters))
        self.gram_rows = np.concatenate([rows, np.full((1, L), math.log(0.1 / letters)), np.zeros((1, L))])
        self.word_hashes, n = table("w")
        self.word_rows = (n / np.maximum(n.sum(axis=0), 1)).astype(np.float32)
        self.candidates: dict[str, set[int]] = {}
        scripts, n = table("s")
        for script, row in zip(scripts.tolist(), n >= np.maximum(SCRIPT_SHARE * n.sum(axis=0), 1e-9), strict=True):
            if row.any():
                self.candidates[NAMES[script]] = set(np.flatnonzero(row).tolist())
        #: By place among the ranges' edges, which languages may have a letter there.
        self.allowed = np.ones((len(_EDGES) + 1, L), bool)
        for k in range(len(_EDGES) + 1):
            name = _RANGES[(k - 1) // 2][2] if k % 2 else "Other"
            if fit := self.candidates.get(name):
                self.allowed[k] = [lang in fit for lang in range(L)]

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of words of letters, each less its candidates' best and at least -MOST; NEVER for the others."""
        code = np.frombuffer("".join([f"^^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.int64)
        grams = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
        sizes = np.array([len(w) + 3 for w in words])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        at = np.minimum(np.searchsorted(self.gram_codes, grams), max(0, len(self.gram_codes) - 1))
        met = self.gram_codes[at] == grams if len(self.gram_codes) else np.zeros(len(grams), bool)
        at = np.where(met, at, len(self.gram_codes))
        for k in (2, 1):  # trigrams over the end of a word
            at[(ends - k)[:-1]] = len(self.gram_codes) + 1
        logs = np.add.reduceat(self.gram_rows[at], starts, axis=0)
        hashes = np.array([word_hash(w) for w in words], np.int64)
        place = np.minimum(np.searchsorted(self.word_hashes, hashes), max(0, len(self.word_hashes) - 1))
        known = np.flatnonzero(self.word_hashes[place] == hashes) if len(self.word_hashes) else np.zeros(0, int)
        logs[known] = np.log(0.5 * np.exp(np.maximum(logs[known], -700)) + 0.5 * self.word_rows[place[known]])
        # Signs of the padding lie in no script's range, where every language is allowed: they change no difference.
        fits = np.add.reduceat(self.allowed[np.searchsorted(_EDGES, code, "right")], starts, axis=0, dtype=np.int64)
        fits = fits == fits.max(axis=1, keepdims=True)
        best = np.where(fits, logs, -np.inf).max(axis=1, keepdims=True)
        return np.where(fits, np.maximum(logs - best, -MOST), NEVER)


def _codes_of(gram: str) -> int:
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


class Scorer(dict):
    """Chunk's bytes -> row of ``table`` (scores) and ``letters``; emptied between documents when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.used = model, 0
        self.words: dict[str, int] = {}
        self.new: list[tuple[int, str]] = []
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def __missing__(self, chunk: bytes) -> int:
        core = chunk.rstrip(SIGNS)
        word = core.lower().decode() if core.isalpha() else letters_of(chunk)
        row = self.words.get(word)
        if row is None:
            row = self.words[word] = self.used
            self.used += 1
            if row == len(self.letters):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.table[row], self.letters[row] = 0, len(word)
            if word:
                self.new.append((row, word))
        self[chunk] = row
        return row

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
            self.words.clear()
            self.used = 0
        out = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.new:
            self.table[[row for row, _ in self.new]] = self.model.score([word for _, word in self.new])
            self.new = []
        return out


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of labels, paying ``switch`` for each change; ties go to staying, then to the first."""
    langs = range(scores.shape[1])
    rows = scores.tolist()  # few languages: plain numbers are faster than small arrays
    best, back = rows[0], []
    for row in rows[1:]:
        high = max(best)
        least, top = high - switch, best.index(high)
        back.append([k if best[k] >= least else top for k in langs])
        best = [(b if b >= least else least) + s for b, s in zip(best, row, strict=True)]
    at = best.index(max(best))
    path = [at]
    for moves in reversed(back):
        at = moves[at]
        path.append(at)
    return np.array(path[::-1], np.int64)


def label(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """``viterbi``; without the walk where one language must win throughout.

    Any stretch of other languages gains, on the language that is best overall, at most the sum over it of
    each word's best gain. A stretch costs a switch at least, unless it is one language throughout, which
    gains nothing; so if no stretch's sum exceeds a switch, none pays.
    """
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    others = np.delete(scores, best, axis=1)
    if others.shape[1]:
        gains = np.concatenate([[0.0], np.cumsum(others.max(axis=1).astype(np.float64) - scores[:, best])])
        if (gains - np.minimum.accumulate(gains)).max() > switch:
            return viterbi(scores, switch)
    return np.full(len(scores), best)


def identify_text(text: bytes, scorer: Scorer, switch: float = SWITCH):
    """(language, score, spans): spans are (first word, last word, language)."""
    chunks, langs = text.split(), scorer.model.langs
    if not chunks or not langs:
        return UNKNOWN, 0.0, []
    rows = scorer.rows(chunks)
    letters = scorer.letters[rows]
    total = int(letters.sum())
    if not total:
        return UNKNOWN, 0.0, []
    path = label(scorer.table[rows], switch)
    per = np.bincount(path, weights=letters, minlength=len(langs))
    ends = [*np.flatnonzero(np.diff(path)).tolist(), len(path) - 1]
    spans = [(a, b, langs[path[b]]) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]
    top = int(per.argmax())
    return langs[top], float(per[top]) / total, spans


def features(labelled: DataFrame) -> DataFrame:
    """``lang, kind, feature, n``: counts of words (by hash), letter trigrams (by code) and scripts (by number) of ``labelled(text, lang)``."""

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("feature", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            found: dict[str, tuple[Counter, Counter, Counter]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words, grams, scripts = found.setdefault(lang, (Counter(), Counter(), Counter()))
                own = Counter(filter(None, map(letters_of, text.split())))
                words.update(own)
                for word, n in own.items():
                    for gram in trigrams(word):
                        grams[gram] += n
                    for c in word:
                        scripts[script_of(c)] += n
            for lang, own in found.items():
                for kind, name, counted in zip("wts", (word_hash, _codes_of, script_number), own, strict=True):
                    n = len(counted)
                    columns = [pa.array([lang] * n), pa.array([kind] * n), pa.array(map(name, counted), pa.int64()), pa.array(counted.values(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = labelled.select("lang", "text").mapInArrow(run, "lang STRING, kind STRING, feature LONG, n LONG")
    return counted.groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model of ``docs(doc_id, text, lang)`` from about ``sample`` documents and ``chars`` characters of each language at most."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size"))
    sizes = sizes.select(F.col("lang").alias("own"), F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"), F.coalesce(F.try_divide(F.lit(float(chars)), F.col("size")), F.lit(1.0))).alias("share"))
    drawn = F.pmod(F.xxhash64(F.lit(11), F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    chosen = rows.join(F.broadcast(sizes), F.col("lang") == F.col("own")).filter(drawn)  # one row a language
    counts = features(chosen).toArrow()  # bounded by the sample
    return Model({"lang": _texts(counts["lang"]), "kind": _texts(counts["kind"]), "feature": counts["feature"].to_numpy(), "n": counts["n"].to_numpy()})


def _texts(column: pa.ChunkedArray) -> np.ndarray:
    """A column of few different texts as an array of objects, each text held once."""
    coded = column.combine_chunks().dictionary_encode()
    return np.array([*coded.dictionary.to_pylist(), None], object)[coded.indices.to_numpy()]


def _scorer(shared) -> Scorer:
    """The worker's scorer of a broadcast model."""
    return kept(shared.value, Scorer)


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches):
        scorer = _scorer(shared)
        for batch in batches:
            found = [identify_text(t, scorer, switch) for t in as_bytes(batch.column(1))]
            spans = [[{"first": a, "last": b, "lang": c} for a, b, c in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, pa.list_(span))],
                schema=schema,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id LONG, lang_pred STRING, score DOUBLE, spans ARRAY<STRUCT<first: INT, last: INT, lang: STRING>>")


def identified(docs: DataFrame, model: Model, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` with a language that has at least the share ``least`` of the letters; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scorer = _scorer(shared)
        for batch in batches:
            found = [identify_text(t, scorer, switch) for t in as_bytes(batch.column(at))]
            yield batch.filter(pa.array([lang != UNKNOWN and share >= least for lang, share, _ in found], pa.bool_()))

    # Under plain names meanwhile, as a schema given by names would take dots apart.
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
