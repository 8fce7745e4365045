"""Benchmark decontamination by a prefix-filtered set join of shingles.

An item's windows (``WINDOW`` consecutive words, or the whole item where it has fewer) are sets of shingles of
``SHINGLE`` words, each with its place. A window is contained in a text only if all its shingles are, so any one of them
is a necessary prefix: with shingles ordered by rarity, the rarest is the cheapest. Rarity is counted in the
texts themselves, in a first pass over the items' shingles alone; a window with a shingle that no text has is out.
The second pass joins the prefix with the texts' shingles. The place of the shingle fixes where the window would begin
(positional bound) and whether the text is long enough (length bound); what is left is compared word by word.

Windows go to the texts in a broadcast up to BROADCAST of them, so that a text's words never leave their row; beyond
it shingles are shuffled to windows, and only texts with a candidate are looked at again.

Defined cases: a null text has no words; a window's words are hit wherever it occurs, overlaps count once; items without
words have no windows; items alike in text are items of their own; a null ``item_id`` is written as an empty string; rows of
``docs`` that repeat give rows that repeat; other columns can't clash, as only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import LOWER, UPPER, discard, materialise

WINDOW, SHINGLE = 10, 5
#: Windows of some 300 bytes each that are sent to all executors.
BROADCAST = 100_000
#: Words of letters, digits and all beyond ASCII; A-Z may still be upper case.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """The words of a text with A-Z lower-cased; none where it is null."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(_WORD), F.lit(0))
    ascii_only = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(found, lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def shingle_hashes(words: str, size: int) -> Column:
    """A hash of the ``size`` words from each place on; fewer at the end."""
    rest = "".join(f", get({words}, i + {k})" for k in range(1, size))
    return F.expr(f"transform({words}, (w, i) -> xxhash64(w{rest}))")


def windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``window, words, n`` of the distinct windows of ``items(item_id, text)``; and ``window, item_id`` (a string)."""
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words("text").alias("words")).filter("size(words) > 0")
    cut = own.select("item_id", F.expr(f"explode_outer(transform(sequence(1, greatest(1, size(words) - {WINDOW - 1})), i -> slice(words, i, {WINDOW})))").alias("words"))
    table = materialise(cut.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("window", F.monotonically_increasing_id()), "windows")
    return table.select("window", "words", F.size("words").alias("n")), table.select("window", F.explode("items").alias("item_id"))


def shingles(rows: DataFrame, *keep: str) -> DataFrame:
    """``h, offset`` of each shingle of windows, shingles being as long as the window allows; hashes as in ``shingle_hashes``."""
    each = F.expr(f"transform(sequence(0, n - least({SHINGLE}, n)), i -> xxhash64(slice(words, i + 1, least({SHINGLE}, n))))")
    return rows.select(*keep, "n", F.posexplode_outer(each).alias("offset", "h"))


def tokens(docs: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """``at, h`` of all shingles of ``docs(words)`` of these sizes, and one row a text with ``at`` -1."""
    # Outer, as before an inner one Spark would test the arrays' sizes, and so make them, in a filter of its own.
    hashes = F.concat(F.array(F.lit(0).cast("long")), *(shingle_hashes("words", k) for k in sizes))
    found = docs.select("*", hashes.alias("hashes")).select(*keep, F.size("words").alias("n_words"), F.posexplode_outer("hashes").alias("place", "h"))
    return found.select(*keep, "n_words", F.when(F.col("place") == 0, -1).otherwise((F.col("place") - 1) % F.col("n_words")).alias("at"), "h")


def prefixes(docs: DataFrame, table: DataFrame, sizes: list[int], small) -> DataFrame:
    """``window, n, h, offset``: the rarest shingle of each window whose shingles all occur in ``docs``."""
    own = materialise(shingles(table, "window"), "shingles")
    met = tokens(docs, sizes).filter("at >= 0").join(small(own.select("h").distinct()), "h", "left_semi")
    counts = materialise(met.groupBy("h").agg(F.count(F.lit(1)).alias("count")), "rarity")
    ranked = own.join(counts, "h", "left").groupBy("window", "n").agg(
        F.min(F.struct("count", "h", "offset")).alias("rarest"), F.bool_and(F.col("count").isNotNull()).alias("possible")
    )
    out = materialise(ranked.filter("possible").select("window", "n", "rarest.h", "rarest.offset"), "prefixes")
    discard(own, counts)
    return out


def occurrences(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``doc_id, mark, n_words, start, n, window``: every occurrence of a window of ``table`` in ``docs(doc_id, mark, words)``.

    And one row with null ``window`` for each row of ``docs``.
    """
    sizes = sorted(r.size for r in table.select(F.least(F.lit(SHINGLE), "n").alias("size")).distinct().collect())  # at most SHINGLE
    few = table.count() <= BROADCAST
    small = F.broadcast if few else lambda rows: rows
    found = prefixes(docs, table, sizes, small)
    begin = F.when(F.col("at") >= 0, F.col("at") - F.col("offset"))
    fits = F.col("window").isNull() | ((begin >= 0) & (begin + F.col("n") <= F.col("n_words")))
    if few:
        none = docs.sparkSession.range(1).selectExpr("CAST(NULL AS LONG) AS window", "NULL AS n", "0L AS h", "NULL AS offset", "CAST(NULL AS ARRAY<STRING>) AS own")
        sent = found.join(table.select("window", F.col("words").alias("own")), "window").select("window", "n", "h", "offset", "own").unionByName(none.select("window", F.col("n").cast("int"), "h", F.col("offset").cast("int"), "own"))
        met = tokens(docs, sizes, "doc_id", "mark", "words").join(F.broadcast(sent), "h").filter((F.col("at") < 0) == F.col("window").isNull())
        same = F.col("window").isNull() | (F.slice("words", begin + 1, F.col("n")) == F.col("own"))
        return met.filter(fits).filter(same).select("doc_id", "mark", "n_words", begin.alias("start"), "n", "window")
    met = tokens(docs, sizes, "doc_id", "mark").filter("at >= 0").join(found, "h").filter(fits)
    cand = materialise(met.select("doc_id", "mark", begin.alias("start"), "n", "window").distinct(), "candidates")
    again = docs.join(cand.select(F.col("doc_id").alias("id"), F.col("mark").alias("own_mark")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own_mark")))
    texts = again.select("id", "own_mark", "words").dropDuplicates(["id", "own_mark"])
    checked = (
        cand.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own_mark")))
        .select("doc_id", "mark", F.size("words").alias("n_words"), "start", "n", "window", F.slice("words", F.col("start") + 1, F.col("n")).alias("here"))
        .join(table.select("window", F.col("words").alias("own")), "window")
        .filter(F.col("here") == F.col("own"))
    )
    base = docs.select("doc_id", "mark", F.size("words").alias("n_words"), *(F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("n", "int"), ("window", "long"))))
    return base.unionByName(checked.select(*base.columns))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` of every row of ``docs(doc_id, text)``; ``items`` is sorted as strings."""
    table, owners = windows(items)
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), words("text").alias("words"))
    met = materialise(occurrences(own, table), "occurrences")
    key = ["doc_id", "mark"]
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0)))
    counted = met.withColumn("new", F.greatest(new, F.lit(0))).groupBy(*key).agg(
        F.first("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"), F.count_if(F.col("window").isNull()).cast("int").alias("rows")
    )
    hit = met.filter("window IS NOT NULL").select(*key, "window").distinct().join(owners, "window").groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = hit.select(F.col("doc_id").alias("id"), F.col("mark").alias("own_mark"), "items")
    whole = counted.join(hit, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own_mark")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        "doc_id", "n_words", "n_hit", F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("copy")
    ).drop("copy")
