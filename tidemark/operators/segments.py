"""Blocks, boards and tokens of chapters.

Input: ``book_id, chapter_num, text``. A chapter is one row, so segmentation needs no shuffle at all;
folds over its sentences carry line counts, never the text wrapped so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X

KEYS = ["book_id", "chapter_num"]


def block_texts(t: Column) -> Column:
    """Paragraphs; those of several lines with dialogue among them are cut into lines."""
    keep = lambda parts: F.filter(F.transform(parts, X.strip), lambda x: x != "")

    def cut(p: Column) -> Column:
        return X.let(keep(F.split(p, "\n")), lambda lines: F.when((F.size(lines) > 1) & F.exists(lines, X.is_dialogue), lines).otherwise(F.array(p)))

    return F.flatten(F.transform(keep(F.split(t, f"\n{X.SPACE}*\n")), cut))


def blocks(chapters: DataFrame, width: int = X.MAX_CHARS) -> DataFrame:
    """book_id, chapter_num, block_idx, text, is_dialogue, estimated_lines, sentences."""
    rows = chapters.select(*KEYS, F.posexplode(block_texts(F.col("text"))).alias("block_idx", "text"))
    return rows.withColumns(
        {"is_dialogue": X.is_dialogue(F.col("text")), "estimated_lines": X.line_count(F.col("text"), width), "sentences": X.sentences(F.col("text"))}
    )


class Lines:
    """Greedy wrapping of words to ``width``: how many lines there are, and how much of the last one is used."""

    def __init__(self, width: int, lines: int = 0, used: int = 0):
        self.width, self.lines, self.used = width, lines, used

    def more(self, text: str, goes_on: bool = False) -> Lines:
        """After ``text`` as well; its first paragraph goes on in the last line if it ``goes_on`` behind a space."""
        lines, used = self.lines, self.used
        for k, paragraph in enumerate(text.split("\n")):
            if k or not goes_on:
                used = 0
            for n in map(len, paragraph.split()):
                if 0 < used and used + 1 + n <= self.width:
                    used += 1 + n
                else:
                    lines, used = lines + 1, n
        return Lines(self.width, lines, used)


def packed_sentences(sentences: list[str], most: int, width: int) -> list[tuple[str, int]]:
    """(text, lines): sentences joined greedily into texts of at most ``most`` lines; a longer sentence stands alone."""
    out, own, state = [], [], Lines(width)
    for s in sentences:
        longer = state.more(s, True)
        if own and longer.lines <= most:
            own.append(s)
            state = longer
            continue
        if own:
            out.append((" ".join(own), state.lines))
        own, state = [s], Lines(width).more(s)
    return [*out, (" ".join(own), state.lines)] if own else out


def boards_of_blocks(blocks, most: int, width: int) -> list[dict]:
    """Boards of a chapter's blocks (text, said, sentences): those that are too long by sentences, short dialogue together."""
    out: list[dict] = []
    for b in blocks:
        lines = Lines(width).more(b["text"]).lines
        if lines > most:
            out += [{"text": t, "lines": n, "dialogue": b["said"], "open": False} for t, n in packed_sentences(list(b["sentences"]), most, width)]
        elif b["said"] and out and out[-1]["open"] and out[-1]["lines"] + lines <= most:
            out[-1] = {**out[-1], "text": out[-1]["text"] + "\n" + b["text"], "lines": out[-1]["lines"] + lines}
        else:
            out.append({"text": b["text"], "lines": lines, "dialogue": b["said"], "open": b["said"]})
    return out


def packed_boards(chapters: DataFrame, most: int = X.MAX_LINES, width: int = X.MAX_CHARS) -> DataFrame:
    """Boards of each chapter's text: the chapter's keys, at (from 0), text, lines, dialogue.

    Cutting into blocks and sentences stays in the JVM; packing is one Python pass over a batch of chapters, as each board
    depends on the one before.
    """
    kind = pa.struct([("text", pa.string()), ("lines", pa.int32()), ("dialogue", pa.bool_()), ("open", pa.bool_())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [boards_of_blocks(blocks, most, width) for blocks in part.column(2).to_pylist()]
                owners = pa.array(np.repeat(np.arange(len(found)), [len(b) for b in found]))
                places = pa.array(np.concatenate([np.arange(len(b)) for b in found]).astype(np.int32))
                flat = pa.array([b for own in found for b in own], kind)
                yield pa.RecordBatch.from_arrays([part.column(0).take(owners), part.column(1).take(owners), places, *flat.flatten()[:3]], names=[*KEYS, "at", "text", "lines", "dialogue"])

    # A block of no more characters than lines fits in any case.
    parts = lambda b: F.when(F.length(b) > most, X.sentences(b)).otherwise(F.array().cast("array<string>"))
    blocks = F.transform(block_texts(F.col("text")), lambda b: F.struct(b.alias("text"), X.is_dialogue(b).alias("said"), parts(b).alias("sentences")))
    rows = chapters.select(*KEYS, blocks.alias("blocks"))
    out = [("at", T.IntegerType()), ("text", T.StringType()), ("lines", T.IntegerType()), ("dialogue", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in KEYS), *(T.StructField(*x) for x in out)]))


def boards(chapters: DataFrame, most: int = X.MAX_LINES, width: int = X.MAX_CHARS) -> DataFrame:
    """The initial boards: book_id, chapter_num, chunk_id, text, chunk_type, lines_count, n_words."""
    rows = packed_boards(chapters, most, width)
    return rows.select(
        *KEYS,
        (F.col("at") + 1).alias("chunk_id"),
        "text",
        F.when(F.col("dialogue"), "dialogue").otherwise("narration").alias("chunk_type"),
        F.col("lines").alias("lines_count"),
        F.size(X.words(F.col("text"))).alias("n_words"),
    )


def tokens(chapters: DataFrame) -> DataFrame:
    """Words with what separates them and their places in the rendered text.

    token_idx, word, sep, block_idx, is_dialogue, char_start, char_end.
    """

    texts = chapters.select(*KEYS, F.posexplode(block_texts(F.col("text"))).alias("block_idx", "b"))
    parts = texts.select(
        *KEYS,
        "block_idx",
        X.is_dialogue(F.col("b")).alias("is_dialogue"),
        F.arrays_zip(F.regexp_extract_all("b", F.lit("(?U)\\S+"), F.lit(0)).alias("word"), F.regexp_extract_all("b", F.lit("(?U)\\s+"), F.lit(0)).alias("gap")).alias("ts"),
    )
    # One row per block finds where its words begin; a word then looks along its own block only.
    order = Window.partitionBy(*KEYS).orderBy("block_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chars = F.aggregate("ts", F.lit(0).cast("long"), lambda n, t: n + F.length(t["word"]) + 1)
    placed = parts.filter(F.size("ts") > 0).withColumns(
        {"words_before": F.coalesce(F.sum(F.size("ts")).over(before), F.lit(0)), "chars_before": F.coalesce(F.sum(chars).over(before), F.lit(0)), "ends": F.lead("block_idx").over(order).isNull()}
    )
    flat = placed.select(*KEYS, "block_idx", "is_dialogue", "words_before", "chars_before", "ends", F.size("ts").alias("n"), F.posexplode("ts").alias("k", "t"))
    sep = F.when(F.col("ends") & (F.col("k") == F.col("n") - 1), "").when(F.coalesce(F.col("t.gap"), F.lit("\n")).contains("\n"), "\n").otherwise(" ")
    inside = Window.partitionBy(*KEYS, "block_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("chars_before") + F.coalesce(F.sum(F.length("t.word") + 1).over(inside), F.lit(0))).cast("int")
    return flat.select(
        *KEYS, (F.col("words_before") + F.col("k")).cast("int").alias("token_idx"), F.col("t.word").alias("word"), sep.alias("sep"), "block_idx", "is_dialogue", start.alias("char_start")
    ).withColumn("char_end", F.col("char_start") + F.length("word"))


def rendered(rows: DataFrame, *keys: str) -> DataFrame:
    """Text of each group of tokens: words with their separators, the last one's left out; and ``all_dialogue``, ``n``."""
    ordered = F.array_sort(F.collect_list(F.struct("token_idx", "word", "sep", "is_dialogue")))
    return rows.groupBy(*keys).agg(ordered.alias("ts")).select(
        *keys,
        F.array_join(F.transform("ts", lambda t, i: F.concat(t["word"], F.when(i == F.size("ts") - 1, "").otherwise(t["sep"]))), "").alias("text"),
        F.forall("ts", lambda t: t["is_dialogue"]).alias("all_dialogue"),
        F.size("ts").alias("n"),
    )


def token_hashes(token_rows: DataFrame) -> DataFrame:
    """Version of a chapter's text: ``text_hash, token_count``."""
    ordered = F.array_sort(F.collect_list(F.struct("token_idx", "word")))
    return token_rows.groupBy(*KEYS).agg(X.words_hash(F.transform(ordered, lambda t: t["word"])).alias("text_hash"), F.count(F.lit(1)).cast("int").alias("token_count"))


def proposed_layout(chapters: DataFrame, most: int = X.MAX_LINES, width: int = X.MAX_CHARS) -> DataFrame:
    """``breaks``: token indexes where boards after the first start; ``token_count``."""
    rows = boards(chapters, most, width)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", F.col("ends").cast("int").alias("ends"))))
    order = Window.partitionBy(*KEYS).orderBy("chunk_id")
    per = rows.withColumn("ends", F.sum("n_words").over(order)).groupBy(*KEYS).agg(F.transform(ordered, lambda x: x["ends"]).alias("ends"))
    ends = F.coalesce("ends", F.array().cast("array<int>"))
    return chapters.select(*KEYS).join(per, KEYS, "left").select(
        *KEYS, F.slice(ends, F.lit(1), F.greatest(F.lit(0), F.size(ends) - 1)).alias("breaks"), F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)).alias("token_count")
    )


def layout_gaps(chapters: DataFrame, layouts: DataFrame) -> DataFrame:
    """Chapters whose proposed layout has another number of words than the chapter has tokens; there should be none."""
    n = tokens(chapters).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("tokens"))
    both = layouts.select(*KEYS, "token_count").join(n, KEYS, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return both.filter(F.col("tokens") != F.col("token_count"))


def legacy_chapters(books: DataFrame) -> DataFrame:
    """``book_id, text`` -> chapters by lines that begin with ``Rozdział`` and a Roman number; bodies up to the next."""
    heading = "(?iu)^\\s*rozdzia[łl]\\s+([ivxlc]+)\\b\\.?\\s*(.*)$"
    lines = books.select("book_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = Window.partitionBy("book_id").orderBy("line_no")
    marked = lines.withColumn("is_heading", F.col("line").rlike(heading)).withColumn("chapter_idx", F.sum(F.col("is_heading").cast("int")).over(order))
    return (
        marked.filter("chapter_idx > 0").groupBy("book_id", F.col("chapter_idx").cast("int").alias("chapter_num"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
        .select(
            "book_id", "chapter_num", X.strip(F.col("ls")[0]["line"]).alias("header"),
            X.strip(F.array_join(F.transform(F.slice("ls", 2, 1 << 30), lambda x: x["line"]), "\n")).alias("text"),
        )
    )


def mapped_chapters(book_text: DataFrame, chapter_map: DataFrame) -> DataFrame:
    """Texts of a chapter map's ranges; an end not after the start means the end of the book."""
    n = F.length("text")
    end = F.when(F.col("text_end") <= F.col("text_start"), n).otherwise(F.col("text_end"))
    return chapter_map.join(book_text, "book_id").select(*KEYS, "header", "title", F.substr("text", F.col("text_start") + 1, end - F.col("text_start")).alias("text"))
