"""Text queries over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}

WORDS_SQL = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
TRIM_SQL = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
MARKERS = ["licensed under", "released under"]


def wrap_sql(t: str, width: int = 45) -> str:
    """Greedy line count of a text in SQL."""
    sizes = f"list_transform({WORDS_SQL.format('p')}, lambda w: {{'n': 0::BIGINT, 'c': 0::BIGINT, 'l': length(w)::BIGINT}})"
    fits = f"a.c > 0 AND a.c + 1 + b.l <= {width}"
    step = f"{{'n': CASE WHEN {fits} THEN a.n ELSE a.n + 1 END, 'c': CASE WHEN {fits} THEN a.c + 1 + b.l ELSE b.l END, 'l': 0::BIGINT}}"
    fold = f"list_reduce(list_prepend({{'n': 0::BIGINT, 'c': 0::BIGINT, 'l': 0::BIGINT}}, {sizes}), lambda a, b: {step}).n"
    return f"coalesce(CAST(list_sum(list_transform(string_split({t}, chr(10)), lambda p: {fold})) AS INTEGER), 0)"


def sentences_sql(t: str) -> str:
    cut = f"regexp_replace({t}, '([.!?…])\\s+([A-ZĄĆĘŁŃÓŚŹŻ—–\\-])', '\\1' || chr(30) || '\\2', 'g')"
    found = f"list_filter(list_transform(string_split({cut}, chr(30)), lambda s: {TRIM_SQL.format('s')}), lambda s: s <> '')"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{TRIM_SQL.format(t)}] END"


def _documents(name: str, sql: str, /, **columns):
    """A query that computes columns of ``documents``; the SQL lists the same columns."""

    def query(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
        return docs.select("doc_id", *(f(F.col("text")).alias(c) for c, f in columns.items()))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT doc_id, {sql} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


_documents("s2_newlines", "replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body", body=lambda t: X.newlines(F.regexp_replace(t, "\n", "\r\n")))
_low = "lower(text)"
_first = "CAST(floor(length(text) * 0.85) AS INTEGER) + 1"
_at = ", ".join(f"CASE WHEN strpos(substr({_low}, {_first}), '{m}') > 0 THEN strpos(substr({_low}, {_first}), '{m}') + {_first} - 1 END" for m in MARKERS)
_body = f"CASE WHEN least({_at}) IS NULL THEN text ELSE regexp_replace(substr(text, 1, CAST(least({_at}) AS INTEGER) - 1), '\\s+$', '') END"
_documents("s3_footer", f"{_body} AS body, CAST(length(text) - length({_body}) AS INTEGER) AS removed", body=lambda t: X.without_footer(t, MARKERS), removed=lambda t: F.length(t) - F.length(X.without_footer(t, MARKERS)))
_documents("s5_text_slice", "substr(text, 101, 1200) AS head, substr(text, 11, 40) AS part", head=lambda t: X.text_slice(t, F.lit(100), F.lit(0)), part=lambda t: X.text_slice(t, F.lit(10), F.lit(50)))
_documents("t1_line_count", f"{wrap_sql('text')} AS lines", lines=X.line_count)
_documents("t2_sentences", f"array_to_string({sentences_sql('text')}, '|') AS sentences, len({sentences_sql('text')}) AS n", sentences=lambda t: F.array_join(X.sentences(t), "|"), n=lambda t: F.size(X.sentences(t)).cast("long"))
_documents("t3_dialogue_lines", "len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(ltrim(l), '^[—–\\-―“„\"]'))) AS n", n=lambda t: F.size(F.filter(F.split(t, "\n"), X.is_dialogue)).cast("long"))
_roman = " || ".join(f"['', {', '.join(repr(x) for x in tens)}][CAST(doc_id % 4000 // {unit} % 10 + 1 AS INTEGER)]" for unit, tens in (
    (1000, ["M", "MM", "MMM"]), (100, "C CC CCC CD D DC DCC DCCC CM".split()), (10, "X XX XXX XL L LX LXX LXXX XC".split()), (1, "I II III IV V VI VII VIII IX".split()),
))
_documents("t7_roman", f"{_roman} AS roman", roman=lambda t: X.roman((F.col("doc_id") % 4000).cast("int")))
_documents("t10_search_form", "ltrim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS form", form=X.search_form)
_documents("t11_normal_words", f"array_to_string(list_transform({WORDS_SQL.format('text')}, lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_]', '', 'g')), ' ') AS words", words=lambda t: F.array_join(F.transform(X.words(t), X.normal_word), " "))
_documents("t12_words", f"len({WORDS_SQL.format('text')}) AS n, array_to_string({WORDS_SQL.format('text')}, ' ') AS words", n=lambda t: F.size(X.words(t)).cast("long"), words=lambda t: F.array_join(X.words(t), " "))
_documents("t15_text_hash", f"substr(sha1(array_to_string({WORDS_SQL.format('text')}, chr(10))), 1, 16) AS hash", hash=lambda t: X.words_hash(X.words(t)))
_mark = "left(text, 40) || ' (brak tekstu x) ' || substr(text, 41)"
_mark_col = lambda t: F.concat(F.substring(t, 1, 40), F.lit(" (brak tekstu x) "), F.substr(t, F.lit(41)))
_documents("t16_without_marker", f"{TRIM_SQL.format(f'regexp_replace({_mark}, chr(92) || ' + chr(39) + '(brak tekstu[^)]*' + chr(39) + f' || chr(92) || {chr(39)}){chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} AS body", body=lambda t: X.without_marker(_mark_col(t)))
_documents("t17_heard_board", "CASE WHEN text = '' THEN '(brak tekstu w pliku txt)' ELSE text || chr(10) || '(brak tekstu w pliku txt)' END AS board", board=X.heard_board)
_clean = "regexp_replace(trim(regexp_replace(translate(text, '\\/:*?\"<>|' || chr(13) || chr(10) || chr(9), ''), '\\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g')"
_devices = ", ".join(f"'{d}'" for d in X.DEVICE_NAMES)
_documents("t18_safe_name", f"CASE WHEN {_clean} = '' THEN 'projekt' WHEN upper(string_split({_clean}, '.')[1]) IN ({_devices}) THEN '_' || {_clean} ELSE {_clean} END AS name", name=X.safe_component)
_spoken = TRIM_SQL.format("regexp_replace(text, '^[—–\\-\"''„“\\s]+', '')")
_five = f"{WORDS_SQL.format(_spoken)}[1:5]"
_kept = f"regexp_replace(regexp_replace(translate(array_to_string({_five}, ' '), '\\/:*?\"<>|', ''), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
_documents("t19_file_name", f"CASE WHEN len({_five}) = 0 THEN 'fragment' WHEN {_kept} = '' THEN 'audio_fragment' ELSE {_kept} END AS name", name=X.file_name)
_documents(
    "t20_srt_time",
    "format('{:02d}:{:02d}:{:02d},{:03d}', (n_ms // 3600000), (n_ms // 60000) % 60, (n_ms // 1000) % 60, n_ms % 1000) AS stamp".replace("n_ms", "(length(text)::BIGINT * 1375)"),
    stamp=lambda t: X.srt_time(F.length(t) * F.lit(1.375)),
)
_documents("t21_srt_text", f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {TRIM_SQL.format('l')}), lambda l: l <> ''), chr(10)) AS cue", cue=X.srt_text)
