"""Spelling variants: words at edit distance one, by a self-join of the vocabulary's trie with active-node sets.

The trie of all words is cut at a frontier of prefixes: ``frontier`` deepens a prefix, code point by code point, until at
most LIMIT words lie below it, so a hot prefix is many parts. Below the frontier a part's trie is walked level by level. The
active nodes of a node are those whose prefix is at a distance of at most one: itself, and pairs one edit away.
An edit is spent where two children part (replaced) or where a child meets its parent (inserted); from there on a pair
goes down only by equal letters, and is emitted where both end a word. Each level's pairs are a set.

Pairs that part above the frontier have spent their edit there, so what follows is equal: a word gives one key for each
place above its frontier, the word without that letter. Equal keys of one place are a replacement; a key that is a
word is an insertion. Such a group has at most as many members as the alphabet has letters, whatever the words.

Defined cases: null texts have no words; rows that repeat count again; a null ``doc_id`` is written as an empty string; only the named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import LOWER, UPPER, discard, materialise

LEAST_LENGTH, LEAST_COUNT, TYPOS, RATIO = 5, 3, 97, 2
#: Words below a prefix at most, and words that one task's group of prefixes has on average.
LIMIT, GROUP = 2_000, 5_000
_RUN = r"[A-Za-zÀ-ÿ]+"


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: what the runs of letters of ``docs(doc_id, text)`` are, where some are mistyped on purpose by a hash."""
    # Outer, as before an inner one Spark would extract the runs in a filter of its own.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode_outer(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    # Lower-cased by letters only where that differs from lower(): a run has no other characters than Latin-1 ones.
    run = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    low = runs.filter("run IS NOT NULL").select("id", run.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % TYPOS == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return low.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def frontier(words: DataFrame) -> DataFrame:
    """``prefix``: where the trie of ``words(word)`` is cut; no other prefix begins with one of them. Written tables."""
    level, done, depth = words.select("word"), None, 1
    while True:
        below = level.filter(F.char_length("word") >= depth).withColumn("prefix", F.substring("word", 1, depth))
        counts = materialise(below.groupBy("prefix").agg(F.count(F.lit(1)).alias("words")), "prefixes")
        good = counts.filter(F.col("words") <= LIMIT)
        done = good if done is None else done.unionByName(good)
        hot = counts.filter(F.col("words") > LIMIT).select("prefix")
        if not hot.limit(1).count():
            return done
        small = F.broadcast if depth < 3 else lambda table: table  # two letters: at most some thousands
        level, depth = materialise(below.join(small(hot), "prefix", "left_semi").select("word"), "hot_words"), depth + 1


def parted(words: DataFrame) -> DataFrame:
    """``word, depth, prefix`` of ``words(word)``: the frontier's prefix and its length; words that end above it have no prefix."""
    cut = materialise(frontier(words), "frontier")
    depths = sorted(r.depth for r in cut.select(F.char_length("prefix").alias("depth")).distinct().collect())  # as many as the trie is deep
    each = words.select("word", F.explode(F.array(*map(F.lit, depths or [1]))).alias("depth")).filter(F.char_length("word") >= F.col("depth"))
    found = each.withColumn("prefix", F.expr("substring(word, 1, depth)")).join(cut.withColumnRenamed("words", "below"), "prefix")
    return words.select("word").join(found, "word", "left").select("word", F.coalesce("depth", F.char_length("word") + 1).alias("depth"), "prefix", "below")


def above(words: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``words(word, depth)`` that part above the frontier, each once."""
    keys = words.select("word", F.explode(F.sequence(F.lit(0), F.least(F.col("depth"), F.char_length("word")) - 1)).alias("at"))
    keys = keys.withColumn("key", F.expr("concat(substring(word, 1, at), substring(word, at + 2))"))
    same = keys.select("key", "at", F.col("word").alias("a")).join(keys.select("key", "at", F.col("word").alias("b")), ["key", "at"]).filter("a < b")
    longer = keys.select("key", F.col("word").alias("a")).join(words.select(F.col("word").alias("key")), "key").select("a", F.col("key").alias("b"))
    return same.select("a", "b").unionByName(longer.distinct())


def trie(words: list[str], depth: list[int]) -> tuple[np.ndarray, ...]:
    """Nodes below the roots, which are the distinct prefixes of these depths of sorted ``words``.

    Of each node: its parent (-1 at a root), its letter, its level below the root, the word that ends there (-1: none).
    """
    parents, letters, levels, ends, path, last = [], [], [], [], [], None
    for k, (word, d) in enumerate(zip(words, depth, strict=True)):
        if word[:d] != last:
            last, path, old = word[:d], [len(parents)], ""
            parents.append(-1)
            letters.append(0)
            levels.append(0)
            ends.append(-1)
        rest = word[d:]
        same = 0
        for x, y in zip(rest, old, strict=False):
            if x != y:
                break
            same += 1
        del path[same + 1 :]
        for c in rest[same:]:
            parents.append(path[-1])
            letters.append(ord(c))
            levels.append(len(path))
            ends.append(-1)
            path.append(len(parents) - 1)
        ends[path[-1]] = k
        old = rest
    return tuple(np.array(x, np.int64) for x in (parents, letters, levels, ends))


def walk(words: list[str], depth: list[int]) -> np.ndarray:
    """Pairs of places in sorted ``words`` of words at distance one whose prefixes of these depths are equal."""
    parent, letter, level, end = trie(words, depth)
    inner = np.flatnonzero(parent >= 0)
    order = inner[np.argsort(parent[inner] << 16 | letter[inner], kind="stable")]
    keys = parent[order] << 16 | letter[order]  # children by parent and letter
    first = np.searchsorted(keys, np.arange(len(parent)) << 16)
    degree = np.bincount(parent[inner], minlength=len(parent))
    out, pairs = [], np.empty((0, 2), np.int64)

    def spread(nodes):
        """Each node again for each of its children, and those children."""
        n = degree[nodes]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(nodes)), n), order[np.repeat(first[nodes], n) + at]

    for now in range(int(level.max(initial=0)) + 2):
        nodes = np.flatnonzero(level == now)
        at, child = spread(pairs[:, 0])  # equal letters
        other = pairs[at, 1]
        want = other << 16 | letter[child]
        place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        met = keys[place] == want if len(keys) else np.zeros(0, bool)
        grown = [np.stack([child[met], order[place[met]]], 1)]
        at, child = spread(nodes)
        if len(child):
            grown.append(np.stack([child, nodes[at]], 1))  # inserted: the child beside its parent
            left, second = spread(nodes[at])  # replaced: each child beside its later sisters
            both = np.stack([child[left], second], 1)
            grown.append(both[letter[both[:, 0]] < letter[both[:, 1]]])
        pairs = np.concatenate(grown)
        if not len(pairs):
            break
        code = np.unique(pairs[:, 0] * len(parent) + pairs[:, 1])
        pairs = np.stack([code // len(parent), code % len(parent)], 1)
        over = (end[pairs[:, 0]] >= 0) & (end[pairs[:, 1]] >= 0)
        out.append(end[pairs[over]])
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def below(words: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``words(word, depth, prefix, below)`` within one part of the trie, each once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        own = rows["word"].to_numpy()
        found = walk(own.tolist(), rows["depth"].tolist())
        return pd.DataFrame({"a": own[found[:, 0]], "b": own[found[:, 1]]})

    inside = words.filter("prefix IS NOT NULL AND below > 1")
    groups = max(1, -(-inside.count() // GROUP))
    return inside.select("word", "depth", (F.pmod(F.xxhash64("prefix"), F.lit(groups))).alias("part")).groupBy("part").applyInPandas(run, "a STRING, b STRING")


def near(words: DataFrame) -> DataFrame:
    """``a, b``: all pairs of ``words(word)``, distinct words, at edit distance one, each once."""
    own = materialise(parted(words), "parted")
    return materialise(above(own).unionByName(below(own)).distinct(), "near_words")


def variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the vocabulary of ``docs``.

    ``form`` is the most frequent near word, if at least RATIO times as frequent; ``root`` follows forms to the last.
    """
    words = materialise(vocabulary(docs), "vocabulary")
    pairs = near(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = known.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("form"))).alias("best"))
    often = -F.col("best.rank") >= RATIO * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.rank")).alias("form_n"),
    )
    found = materialise(found, "forms")
    discard(pairs)
    # Forms' frequencies at least double, so a chain of k forms takes about log2(k) rounds of doubling.
    roots = materialise(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = materialise(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done = not further.filter("moved").limit(1).count()
        discard(roots)
        roots = further
        if done:
            break
    return found.join(roots.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
