"""Which tokens of two tokenizers cover the same bytes of a text, and how often in the corpus.

Both tokenizers encode a space and the text. Bits mark the byte at which each token ends, in packed 64-bit words: A's bits AND
B's bits are the cuts that both share, and the number of bits up to a cut (its rank, from running counts of bits) is the
number of tokens up to it, so cuts map to ranges of tokens. Between two cuts lies a group; each of its A tokens is linked to
each of its B tokens. Some texts, BYTES of them at most, are marked and ranked together, as each ends with a cut.

For encoding a text is cut into chunks at single spaces, and chunks into stretches: at spaces and line ends that follow other
characters, and where a Latin word ends with a sign that no piece of B joins to a letter. Neither vocabulary merges across
these places (``Aligner`` checks that), so the ids of those met lately are kept, each in two generations of CACHE entries.

Pairs of ids are counted by the texts that hold them. The HOT most frequent pairs at most go to the executors, where texts
add up their counts; what is left of rarer pairs is joined with the counts, and there no key is frequent.

Defined cases: null and empty texts, and those that a tokenizer does not give back byte for byte (U+2581 is a space to B), have no
tokens: zeros and ''; rows that repeat are counted and returned as often; other columns can't clash, as only the named ones are read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import discard, materialise
from tidemark.llm.tokens import _byte_letters, as_bytes, kept

#: Chunks, and stretches, in each of the two generations that are kept.
CACHE = 160_000
#: Pairs whose counts go to the executors: 17 bytes each.
HOT = 2_000_000
#: Bytes of texts that a task aligns at once, and links of one group that are written out one by one.
BYTES, GIANT = 1 << 21, 1 << 18
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A stretch begins at a space or line end after another character, whatever white space follows.
_STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+\Z")
#: A word of Latin letters is one piece to A, with the space before it.
_WORD = re.compile(f" ?[{_LATIN}]+")


def rank_groups(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B end up to each cut that both share: bits ANDed, ranks from running counts."""

    def packed(ends):
        marks = np.zeros((size // 64 + 1) * 64, np.uint8)
        marks[ends] = 1
        return np.packbits(marks, bitorder="little").view(np.uint64)

    a, b = packed(a_ends), packed(b_ends)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little"))
    word, upto = cuts >> 6, np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (cuts & 63)).astype(np.uint64)

    def rank(words):
        counts = np.bitwise_count(words).astype(np.int64)
        return (np.cumsum(counts) - counts)[word] + np.bitwise_count(words[word] & upto)

    return rank(a), rank(b)


def expanded(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links of groups (tokens up to each cut), with ``own``, the group's text, in the upper 32 bits; and how often each is."""
    m, k = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    n = np.where(m * k > GIANT, 0, m * k)
    at = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    first, second = a[(a_cuts - m)[at] + nth // k[at]], b[(b_cuts - k)[at] + nth % k[at]]
    codes, times = np.unique(own[at] << 32 | first << 16 | second, return_counts=True)
    more = []
    for g in np.flatnonzero(n == 0):  # tokens that hardly ever end together: by their distinct ids
        (x, p), (y, q) = (np.unique(ids[high - size : high], return_counts=True) for ids, high, size in ((a, a_cuts[g], m[g]), (b, b_cuts[g], k[g])))
        more.append(((own[g] << 32 | (x[:, None] << 16 | y)).ravel(), np.outer(p, q).ravel()))
    if more:
        codes, at = np.unique(np.concatenate([codes, *(x for x, _ in more)]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, *(x for _, x in more)])).astype(np.int64)
    return codes, times


def shown(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups' text as bytes, and the places behind each group; ``last`` marks each text's last group, which has no sign after it."""
    m, k = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(b_cuts - k, m)] = a
    ids[np.arange(len(b)) + np.repeat(a_cuts, k)] = b
    ends = a_cuts + b_cuts
    signs[ends - k - 1], signs[ends - 1] = ord("|"), ord(";")
    table, width = digits()
    wide = width[ids]
    rows = table[ids] | signs.astype(np.uint64) << (wide << np.uint64(3))
    wide = wide.astype(np.int64) + 1
    wide[ends[last] - 1] -= 1
    used = np.tri(9, 8, -1, dtype=np.uint8).view(np.uint64).ravel()[wide].view(bool)
    return rows.view(np.uint8)[used], np.cumsum(wide)[ends - 1]


@cache
def digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all numbers of 16 bits, as eight bytes in one, and how many there are."""
    text = np.arange(1 << 16).astype("S8")
    return text.view(np.uint64), np.char.str_len(text).astype(np.uint64)


class Turning:
    """What was met lately, in two generations; the younger one has all of the texts at hand."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def turned(self, keys: set[str]) -> list[str]:
        """Bring ``keys`` into the younger generation; those that are in neither."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        now, old, new = self.now, self.old, []
        for x in keys:
            if x not in now:
                if x in old:
                    now[x] = old[x]
                else:
                    new.append(x)
        return new


class Aligner:
    """Token ids of stretches as 16-bit integers, and alignments of texts."""

    def __init__(self, a_path: str, b_path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        self.letters, self.gap = letters, letters[32]
        to_byte = {c: k for k, c in letters.items()}
        self.a_bytes = {k: bytes(to_byte[c] for c in piece) for piece, k in self.a.get_vocab(with_added_tokens=False).items() if set(piece) <= to_byte.keys()}
        self.b_bytes, pieces = {}, []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            if self.b.is_byte(k):
                self.b_bytes[k] = bytes([int(piece[1:-1], 16)])
            elif not (self.b.is_control(k) or self.b.is_unknown(k)):
                self.b_bytes[k] = piece.replace("▁", " ").encode()
                pieces.append(piece)
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or max(*self.a_bytes, *self.b_bytes) >= 1 << 16:
            raise ValueError("B's vocabulary has pieces across spaces or line ends, or ids have more than 16 bits")
        self.a_bytes, self.b_bytes = ([t.get(k, b"") for k in range(1 << 16)] for t in (self.a_bytes, self.b_bytes))
        self.a_size, self.b_size = (np.array([*map(len, t)], np.int64) for t in (self.a_bytes, self.b_bytes))
        joined = {m for p in pieces for m in re.findall(f"(?<=[{_LATIN}])[!-/:-@\\[-`{{-~]", p)}
        apart = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        self.cut = re.compile(rf"\s*[{_LATIN}]+(?=[{apart}])|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+\Z" if apart else _STRETCH.pattern)
        self.space, self.chunks, self.stretches = self.b.piece_to_id("▁"), Turning(most), Turning(most)

    def a_ids(self, text: str) -> list[int]:
        word = text[1:]
        if text[0] == " " and word.isascii() and word.isalpha():
            return [t.id for t in self.model.tokenize(self.gap + word)]
        if _WORD.fullmatch(text):
            return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]
        return self.a.encode(text, add_special_tokens=False).ids

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        """The tokenizer puts a space first: the stretch's own, or one that comes off with a line end, which never merges."""
        own = [t[1:] if t[0] == " " else f"\n{t}" for t in texts]
        return [ids if t[0] == " " and len(t) > 1 else ids[2:] if t[0] != " " else [self.space] for t, ids in zip(texts, self.b.encode(own, num_threads=1), strict=True)]

    def learn(self, chunks: set[str]) -> None:
        """Have the ids of all ``chunks`` at hand, which stand behind a space; None for those that a tokenizer changes."""
        cut = {x: self.cut.findall(f" {x}") for x in self.chunks.turned(chunks)}
        new = self.stretches.turned(set().union(*cut.values()))
        for x, b in zip(new, self.b_ids(new) if new else (), strict=True):
            a = self.a_ids(x)
            good = _WORD.fullmatch(x) or b"".join(map(self.a_bytes.__getitem__, a)) == x.encode() == b"".join(map(self.b_bytes.__getitem__, b))
            self.stretches.now[x] = (struct.pack(f"<{len(a)}H", *a), struct.pack(f"<{len(b)}H", *b)) if good else None
        near = self.stretches.now
        for x, own in cut.items():
            ids = [near[y] for y in own]
            self.chunks.now[x] = None if None in ids else ids[0] if len(ids) == 1 else (b"".join([y for y, _ in ids]), b"".join([y for _, y in ids]))

    def texts(self, raws: list[bytes]):
        """Of some texts: four counts each; their groups as bytes; and the distinct links of each (number, codes, times)."""
        cut = []
        for raw in raws:
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = ""
            # A space and another character after it are a border, whatever stands before, if that isn't a space too.
            plain = "  " not in text and text[:1] != " " and text[-1:] != " "
            cut.append([] if not text else text.split(" ") if plain else [text])
        self.learn(set().union(*cut))
        known, a_parts, b_parts = self.chunks.now, [], []
        for own in cut:
            ids = [*map(known.__getitem__, own)]
            a, b = ((), ()) if not ids or None in ids else zip(*ids, strict=True)
            a_parts.append(b"".join(a))
            b_parts.append(b"".join(b))
        n = len(raws)
        counts = np.zeros((n, 4), np.int64)
        counts[:, 0], counts[:, 1] = ([len(x) // 2 for x in parts] for parts in (a_parts, b_parts))
        a, b = (np.frombuffer(b"".join(parts), "<u2").astype(np.int64) for parts in (a_parts, b_parts))
        if not len(a):
            return counts, [b""] * n, np.zeros(n, np.int64), a, a
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_cuts, b_cuts = rank_groups(a_ends, b_ends, int(a_ends[-1]))
        own = np.searchsorted(np.cumsum(counts[:, 0]), a_cuts)  # each text ends with a cut
        last = np.append(own[1:] != own[:-1], True)
        links = np.diff(a_cuts, prepend=0) * np.diff(b_cuts, prepend=0)
        counts[:, 2] = np.bincount(own, minlength=n)
        np.add.at(counts[:, 3], own, links)
        codes, times = expanded(a, b, a_cuts, b_cuts, own)
        text, places = shown(a, b, a_cuts, b_cuts, last)
        ends = np.zeros(n, np.int64)
        ends[own[last]] = places[last]
        ends, text = np.maximum.accumulate(ends), text.tobytes()
        groups = [text[low:high] for low, high in zip([0, *ends[:-1]], ends, strict=True)]
        return counts, groups, np.bincount(codes >> 32, minlength=n), codes & 0xFFFFFFFF, times


def _parts(batch: pa.RecordBatch):
    """Slices of a batch with texts of BYTES at most, or one text."""
    low, size = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for k, n in enumerate(sizes.tolist()):
        if size + n > BYTES and k > low:
            yield batch.slice(low, k - low)
            low, size = k, 0
        size += n
    if low < batch.num_rows:
        yield batch.slice(low)


def aligned(docs: DataFrame, a_path: str, b_path: str, groups: bool = True) -> DataFrame:
    """Of each row of ``docs(doc_id, text)``: counts, SHA-256 of its groups (the groups too, if asked for), distinct pairs and how often it links them."""

    def run(batches):
        aligner = kept(("links", a_path, b_path, CACHE), lambda key: Aligner(*key[1:]))
        gc.disable()  # what is kept has no cycles, and looking for some takes as long as encoding
        for batch in batches:
            for part in _parts(batch):
                counts, text, n, codes, times = aligner.texts(list(as_bytes(part.column(1))))
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                columns = [part.column(0), *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(4))]
                columns.append(pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in text]))
                columns += [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (codes, times)]
                if groups:
                    columns.append(pa.array([x.decode() for x in text]))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        gc.enable()

    kinds = ["doc_id LONG", "n_a LONG", "n_b LONG", "n_groups LONG", "n_links LONG", "groups_sha256 STRING", "pairs ARRAY<LONG>", "times ARRAY<LONG>"]
    kinds += ["groups STRING"] * groups
    names = [x.split()[0] for x in kinds]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(kinds))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many rows each pair is, and whether no pair with its A id is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = materialise(counts.withColumn("a", F.shiftright("pair", 16)), "pair_counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # as many rows as A has ids
    return counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def hot_from(counts: DataFrame) -> int:
    """The least power of two that at most HOT pairs' counts reach."""
    level = F.floor(F.log2("count")).cast("int")
    least, held = 1 << 62, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 63 rows
        held += row["count"]
        if held > HOT:
            break
        least = 1 << row.level
    return least


def scored(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id``, the counts of ``aligned``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row of ``docs``."""
    rows = materialise(aligned(docs, a_path, b_path, groups=False).withColumn("row", F.monotonically_increasing_id()), "links", "zstd")
    counts = pair_counts(rows)
    least = hot_from(counts)
    hot = counts.filter(F.col("count") >= least).toArrow()
    pairs = hot["pair"].to_numpy()
    order = np.argsort(pairs)
    shared = rows.sparkSession.sparkContext.broadcast((pairs[order], hot["count"].to_numpy()[order], hot["best"].to_numpy()[order].astype(np.int8)))
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        keys, values, best = shared.value
        for batch in batches:
            codes, times = (batch.column(len(own) + k).flatten().to_numpy() for k in (0, 1))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(len(own))).to_numpy())])
            at = np.minimum(np.searchsorted(keys, codes), max(0, len(keys) - 1))
            known = keys[at] == codes if len(keys) else np.zeros(len(codes), bool)
            sums = []
            for table in (best, values):
                each = np.zeros(len(codes), np.int64)
                each[known] = times[known] * table[at[known]]
                total = np.concatenate([[0], np.cumsum(each)])
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            lost = np.concatenate([[0], np.cumsum(~known)])[ends].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(lost), pa.array(x[~known])) for x in (codes, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), *sums, *rest], names=[*own, "n_best", "count_sum", "pairs", "times"])

    schema = "row LONG, doc_id LONG, n_a LONG, n_b LONG, n_groups LONG, n_links LONG, groups_sha256 STRING, n_best LONG, count_sum LONG, pairs ARRAY<LONG>, times ARRAY<LONG>"
    found = rows.select(*own, "pairs", "times").mapInArrow(run, schema)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return found.select(*out)
    found = materialise(found, "hot_links", "zstd")
    discard(rows)
    cold = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    cold = cold.join(counts.filter(F.col("count") < least), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum")
    )
    added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    whole = found.join(cold, "row", "left")
    return whole.withColumns({"n_best": added("n_best", "more_best"), "count_sum": added("count_sum", "more_sum")}).select(*out)
