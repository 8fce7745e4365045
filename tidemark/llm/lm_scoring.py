"""Scoring texts by context-tree weighting, beside a unigram base, both learned from the corpus.

Training counts byte contexts and words in one pass, with partial sums in each task and in Spark. The
model's trees are built shard by shard on the executors, and the probability of every byte met after its
longest context is written as a table, whose size follows the corpus. Scoring takes a part of at most PART
entries of it at a time to the executors as a broadcast (its size is known before it is sent): one part if
the table is small, else several passes, each of which scores the bytes whose context lies in its part.
Bytes that training never met after their context are joined with their shard of the trees, and words with
the table of words; only common words are scored in the pass itself.

Words are known by a 64-bit hash (XXH64). Rows are told apart by a number given when they are scored, so
repeated ids and rows don't mix; passes meet on a hash of id and text.

Defined cases: a null text counts as empty, which is one end; ids that are null count as empty text in
the choice of training rows; where nothing was trained every bit has probability one half; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ctw
from tidemark.llm._shared import materialise, partitions, text_or_empty
from tidemark.llm.tokens import as_bytes

SEED, SMOOTH = 42, 0.1
END = b"\n"
#: Entries of the table sent to the executors at once: 12 bytes each, about 100 MB with the hash table's room.
PART = 3_000_000
#: Words are common from this share of the tokens; so at most so many words are common.
COMMON = 200_000
#: Bytes of text whose contexts are sorted at once, and words counted before they are sent on.
CHUNK, WORDS = 1 << 20, 300_000
CACHE = 300_000


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def counts(texts: DataFrame, depth: int = ctw.DEPTH) -> DataFrame:
    """``word, key, n``: how often each word hash (word) and context code (not word) is found in ``texts(text)``."""
    schema = pa.schema([("word", pa.bool_()), ("key", pa.int64()), ("n", pa.int64())])

    def rows(word, keys, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), word)), pa.array(keys), pa.array(n)], schema=schema)

    def run(batches):
        words, held, size = Counter(), [], 0
        grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting = []

        def merge():
            code = np.concatenate(waiting)
            code.sort()
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            keys = np.concatenate([grams, code[first]])
            times = np.concatenate([n, np.diff(np.append(first, len(code)))])
            unique, place = np.unique(keys, return_inverse=True)
            return unique, np.bincount(place, weights=times, minlength=len(unique)).astype(np.int64)

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                own = text.lower().split()
                words.update(own)
                words[END] += 1
                held.append(b" ".join(own) + END)
                size += len(held[-1])
                if size >= CHUNK:
                    waiting.append(ctw.codes(held, depth)[0])
                    held, size = [], 0
                    grams, n = merge()
                    waiting = []
                    if len(grams) > WORDS * 4:
                        yield rows(False, grams, n)
                        grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(words) > WORDS:
                    yield rows(True, _signed([word_hash(w) for w in words]), np.fromiter(words.values(), np.int64))
                    words = Counter()
        if held:
            waiting.append(ctw.codes(held, depth)[0])
            grams, n = merge()
        if len(grams):
            yield rows(False, grams, n)
        if words:
            yield rows(True, _signed([word_hash(w) for w in words]), np.fromiter(words.values(), np.int64))

    return texts.select(text_or_empty().alias("text")).mapInArrow(run, "word BOOLEAN, key LONG, n LONG").groupBy("word", "key").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Tables of a trained model: words (key, n), grams (shard, key, n), symbols (part, key, value), and the top."""

    def __init__(self, docs: DataFrame, depth: int = ctw.DEPTH, part: int = PART):
        spark = docs.sparkSession
        self.depth = depth
        found = materialise(counts(docs, depth), "counts")
        self.words = found.filter("word").select("key", "n")
        self.tokens, self.types = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        grams = found.filter("not word").select("key", "n")
        n_grams = grams.count()
        self.shards = max(partitions(spark), -(-n_grams // (part // 8 + 1)))
        last_two = F.shiftright("key", 8).bitwiseAND(0xFFFF)
        grams = grams.withColumn("shard", self.shard_by(last_two))
        sharded = self.grams = materialise(grams.repartition(self.shards, "shard"), "grams")

        def tops(key, table):
            z = ctw.Shard(table["key"].to_numpy(), table["n"].to_numpy(), depth).top
            return pa.table({"key": z[0] & 0xFFFF, "zeros": z[1], "ones": z[2], "below": z[3]})

        top = (
            sharded.groupBy("shard").applyInArrow(tops, "key LONG, zeros LONG, ones LONG, below DOUBLE")
            .groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).orderBy("key")
        )
        rows = top.collect()  # at most 65,280: a byte and a bit node
        columns = [np.array([r[k] for r in rows], np.float64 if k == 3 else np.int64) for k in range(4)]
        self.top = ctw.Top(*columns)
        self.shared = spark.sparkContext.broadcast(self.top)
        shared = self.shared

        def symbols(key, table):
            shard, levels = _estimates(table, shared.value, depth)
            n = len(shard.grams)
            values = shard.symbols(levels[depth]).astype(np.float32)
            return pa.table({"part": pa.array(np.full(n, key[0].as_py(), np.int32)), "key": shard.grams, "value": values})

        self.entries = materialise(sharded.groupBy("shard").applyInArrow(symbols, "part INT, key LONG, value FLOAT"), "model")
        sizes = self.entries.groupBy("part").count().collect()  # a row a shard
        self.parts, filled = [[]], 0
        for r in sorted(sizes, key=lambda r: r.part):
            if self.parts[-1] and filled + r["count"] > part:
                self.parts.append([])
                filled = 0
            self.parts[-1].append(r.part)
            filled += r["count"]
        # The shard of every pair of last bytes, as Spark hashes it.
        pairs = spark.range(1 << 16).select("id", self.shard_by(F.col("id")).alias("s"))
        self.shard_of = np.zeros(1 << 16, np.int32)
        for r in pairs.collect():
            self.shard_of[r.id] = r.s

    def shard_by(self, pair: Column) -> Column:
        return F.pmod(F.xxhash64(pair), F.lit(self.shards)).cast("int")

    def load(self, k: int) -> tuple[ctw.Symbols, np.ndarray]:
        """Part ``k``, and which pairs of last bytes it holds."""
        own = self.entries.filter(F.col("part").isin(self.parts[k])) if self.parts[k] else self.entries
        table = own.select("key", "value").toArrow()
        holds = np.isin(self.shard_of, self.parts[k])
        if k == 0:  # pairs that training never met go with the first part
            holds |= ~np.isin(self.shard_of, [s for p in self.parts for s in p])
        return ctw.Symbols(table.column("key").to_numpy(), table.column("value").to_numpy()), holds

    def unseen(self, codes: DataFrame) -> DataFrame:
        """``code, log10`` of the distinct ``codes(code)`` that no symbol table has."""
        shared, depth = self.shared, self.depth

        def score(left, right):
            code = right["code"].to_numpy()
            levels = _estimates(left, shared.value, depth)[1] if len(left) else {}
            return pa.table({"code": code, "log10": ctw.unseen(code, levels, shared.value)})

        sharded = codes.withColumn("shard", self.shard_by(F.shiftright("code", 8).bitwiseAND(0xFFFF)))
        return self.grams.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(score, "code LONG, log10 DOUBLE")


def _estimates(table: pa.Table, top: ctw.Top, depth: int):
    """A shard's trees and its estimates by depth, from its grams."""
    order = np.argsort(table["key"].to_numpy())
    shard = ctw.Shard(table["key"].to_numpy()[order], table["n"].to_numpy()[order], depth)
    at = shard.levels[2][0] & 0xFFFF
    return shard, shard.estimates(top.rest[at], top.done[at])


def _lists(owners: np.ndarray, values: np.ndarray, n: int, kind) -> pa.ListArray:
    """Lists of values by owner; owners ascending."""
    offsets = np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _scores(model: LanguageModel, k: int, common):
    """A function over batches of (doc_id, held_out, text, text_key), and its rows' schema: scores by part ``k``.

    With ``common`` (hashes and scores of the common words) the words are scored and listed too.
    """
    shared = model.entries.sparkSession.sparkContext.broadcast((*model.load(k), common))
    depth, whole = model.depth, len(model.parts) == 1
    schema = [("row", pa.int64()), ("text_key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("unseen", pa.list_(pa.int64()))]
    if common is not None:
        schema += [("n_tokens", pa.int64()), ("n_common", pa.int64()), ("common_score", pa.float64()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("n_bytes", pa.int64())]
    schema = pa.schema(schema)

    def run(batches):
        from pyspark import TaskContext

        symbols, holds, words = shared.value
        at = TaskContext.get().partitionId() << 40
        lookup = _Words(*words) if words is not None else None
        for batch in batches:
            ids, held, keys = batch.column(0), batch.column(1), batch.column(3)
            streams, rows, first, size = [], [], 0, 0

            def flush(last):
                n = last - first
                code, sizes = ctw.codes(streams, depth)
                ends = np.cumsum(sizes)
                if whole:
                    bits, new = symbols.log10(code)
                else:
                    own = np.flatnonzero(holds[(code >> 8) & 0xFFFF])
                    bits = np.zeros(len(code))
                    bits[own], new = symbols.log10(code[own])
                    new = own[new]
                sums = np.add.reduceat(bits, np.concatenate([[0], ends[:-1]]))
                lists = _lists(np.searchsorted(ends, new, "right"), code[new], n, pa.int64())
                columns = [np.arange(at + first, at + last), keys[first:last], ids[first:last], held[first:last], sums, lists]
                columns += [*lookup.score(rows), sizes] if lookup is not None else []
                return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

            for i, text in enumerate(as_bytes(batch.column(2))):
                own = text.lower().split()
                streams.append(b" ".join(own) + END)
                size += len(streams[-1])
                if lookup is not None:
                    own.append(END)
                    rows.append(np.fromiter(map(lookup.__getitem__, own), np.int64, len(own)))
                if size >= CHUNK:
                    yield flush(i + 1)
                    streams, rows, first, size = [], [], i + 1, 0
            if streams:
                yield flush(len(ids))
            at += len(ids)

    return run


class _Words(dict):
    """Word -> its place among the words met lately. Places are valid until the next call of ``score``."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        super().__init__()
        self.keys, self.logs, self.new = keys, logs, []
        self.hashes, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.hashes) + len(self.new)
        self.new.append(word_hash(word))
        return place

    def score(self, rows: list[np.ndarray]) -> list:
        """Columns from n_tokens on: scores of common words (NaN: not common), and hashes and times of the others."""
        if self.new:
            hashes = _signed(self.new)
            at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
            scores = np.where(self.keys[at] == hashes, self.logs[at], np.nan) if len(self.keys) else np.full(len(hashes), np.nan)
            self.hashes, self.scores, self.new = np.concatenate([self.hashes, hashes]), np.concatenate([self.scores, scores]), []
        sizes = np.array([len(r) for r in rows], np.int64)
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        scores = self.scores[flat]
        rare = np.isnan(scores)
        pairs, times = np.unique(owner[rare] * len(self.hashes) + flat[rare], return_counts=True)
        owners = pairs // max(1, len(self.hashes))
        n_common = np.bincount(owner[~rare], minlength=len(rows))
        total = np.bincount(owner[~rare], weights=scores[~rare], minlength=len(rows))
        hashes = self.hashes[pairs - owners * len(self.hashes)]
        out = [sizes, n_common, total, _lists(owners, hashes, len(rows), pa.int64()), _lists(owners, times, len(rows), pa.int32())]
        if len(self) > CACHE:
            self.clear()
            self.hashes, self.scores = np.zeros(0, np.int64), np.zeros(0)
        return out


SCORED = "row LONG, text_key LONG, doc_id LONG, held_out BOOLEAN, score DOUBLE, unseen ARRAY<LONG>"


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length)."""
    scale = F.lit(model.tokens + SMOOTH * (model.types + 1))
    log = lambda n: F.log10((n + F.lit(SMOOTH)) / scale)
    often = model.words.filter(F.col("n") > F.lit(model.tokens / COMMON)).select("key", log(F.col("n")).alias("log")).toArrow()
    keys, logs = often.column("key").to_numpy(), often.column("log").to_numpy()
    order = np.argsort(keys)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("doc_id", "text"))
    wide = SCORED + ", n_tokens LONG, n_common LONG, common_score DOUBLE, keys ARRAY<LONG>, times ARRAY<INT>, n_bytes LONG"
    first = materialise(rows.mapInArrow(_scores(model, 0, (keys[order], logs[order])), wide), "scored")
    out = first.drop("keys", "times")
    for k in range(1, len(model.parts)):  # rows alike in id and text have one score
        part = rows.mapInArrow(_scores(model, k, None), SCORED).groupBy("text_key").agg(F.max("score").alias("more"), F.first("unseen").alias("also"))
        joined = out.join(part, "text_key").withColumns({"score": F.col("score") + F.col("more"), "unseen": F.concat("unseen", "also")})
        out = materialise(joined.drop("more", "also"), "scored_part")
    new = materialise(out.select("row", F.explode("unseen").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("n")), "unseen")
    met = materialise(model.unseen(new.select("code").distinct()), "unseen_scores")
    bits = new.join(met, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("log10")).alias("unseen_score"))
    tail = first.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    sums = (
        tail.join(model.words, "key", "left").groupBy("row")
        .agg(F.sum(F.col("times") * log(F.coalesce("n", F.lit(0)))).alias("tail_score"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    )
    total = F.col("score") + F.coalesce("unseen_score", F.lit(0.0))
    return out.join(sums, "row", "left").join(bits, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        (-total * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
