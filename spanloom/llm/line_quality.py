"""Line-first cleaning with DataFrame expressions only.

Every line that has a word is judged by its own rules: punctuation (too many marks for its letters, or a mark after nearly
every word), navigation (separators between short items) and boilerplate (fixed phrases of page furniture). Lines that
fail are removed. A document that loses too large a share of its characters is rejected. Repetition inside a document is
measured on sorted three-word windows, so it costs n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document that loses more than this share (percent) of its word characters is rejected.
MAX_LOST_PERCENT = 50
#: Marks for each 100 characters of a line's words, and words of a line, from which the punctuation rule looks.
MAX_MARKS_PERCENT = 30
MIN_LINE_WORDS = 3
#: Separators of a line from which it is navigation, if each has at most so many words.
MIN_SEPARATORS, WORDS_PER_SEPARATOR = 3, 4
# Phrases of page furniture.
BOILERPLATE = (
    "cookie policy,privacy policy,terms of service,terms of use,all rights reserved,javascript is disabled,enable javascript,"
    "click here,sign in,log in,subscribe to our,skip to content,back to top,share on,powered by,copyright ©"
).split(",")
WHITE = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"
MARK = "[^\\p{L}\\p{N} \\t-\\r]"
SYMBOL, SEPARATOR, LOUD = "[#*$%&|<>]", "[|»•·›]", "[!?#*$%&<>]"


def _phrase(text: Column) -> Column:
    """Whether a lower-case text has a phrase of page furniture."""
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | text.contains(phrase)
    return out


def line_figures(line: Column) -> Column:
    """struct(line, words, chars of its words, marks: neither letter nor digit)."""
    chars = F.length(F.regexp_replace(line, WHITE, ""))
    return F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words"), chars.alias("chars"), F.regexp_count(line, F.lit(MARK)).alias("marks"))


def line_rule(x: Column, furniture: Column) -> Column:
    """The rule that a line with line_figures fails, or null. furniture: whether its document has a phrase of page furniture.

    A line without a mark can fail for a phrase only, so most lines are looked at no further.
    """
    separators = F.regexp_count(x["line"], F.lit(SEPARATOR))
    marked = (
        F.when((x["words"] >= MIN_LINE_WORDS) & (x["marks"] * 100 > x["chars"] * MAX_MARKS_PERCENT), "punctuation")
        .when((x["marks"] >= MIN_SEPARATORS) & (separators >= MIN_SEPARATORS) & (x["words"] <= separators * WORDS_PER_SEPARATOR), "navigation")
        .when((x["words"] >= MIN_LINE_WORDS) & (x["marks"] >= x["words"]) & (F.regexp_count(x["line"], F.lit(LOUD)) >= x["words"]), "punctuation")
    )
    return F.when(furniture & _phrase(F.lower(x["line"])), "boilerplate").when(x["marks"] > 0, marked)


def _step(rows: DataFrame, **columns: str) -> DataFrame:
    return rows.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def measured(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """One row for each input row: doc_id, the base counts, base_failed, kept, word characters of removed lines, their
    number, the cleaned text, and the columns of `carry`.

    Null texts have no words, so they fail the base rules, as empty ones do. Lines without a word count for nothing and
    stay in the cleaned text. Each row is judged alone, so repeated rows agree and null ids need no choice. An empty
    table gives an empty one.
    """
    names = [f"c{k}" for k in range(len(carry))]
    carried = [F.col(f"`{x}`").alias(n) for n, x in zip(names, carry, strict=True)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("t"), *carried)
    rows = rows.withColumns(
        {
            "words": F.array_remove(F.split("t", WHITE), ""),
            "lines": F.transform(F.split("t", "\n"), line_figures),
            "furniture": _phrase(F.lower("t")),
            "word_chars": F.length(F.regexp_replace("t", WHITE, "")).cast("long"),
            "n_symbols": F.regexp_count("t", F.lit(SYMBOL)).cast("long"),
        }
    )
    # Every array that a loop reads is a column of the step before, so that it is made once for each row.
    rows = rows.withColumns(
        {
            "verdicts": F.transform("lines", lambda x: F.struct(x["chars"].alias("chars"), line_rule(x, F.col("furniture")).alias("rule"))),
            "real": F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: x["line"]),
            "hashes": F.expr("slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0))"),
        }
    )
    rows = _step(rows, distinct_windows="size(array_distinct(hashes))")
    # Only texts with a repeated window sort theirs.
    rows = _step(rows, ordered="if(size(hashes) = distinct_windows, cast(array() as array<struct<h:bigint,i:int>>), array_sort(transform(hashes, (h, i) -> struct(h, i))))")
    rows = _step(
        rows,
        places="array_sort(transform(filter(ordered, (x, k) -> coalesce(x.h = get(ordered, k - 1).h, false) or coalesce(x.h = get(ordered, k + 1).h, false)), x -> x.i))",
    )
    rows = _step(
        rows,
        n_words="cast(size(words) as bigint)",
        n_dup_lines="cast(size(real) - size(array_distinct(real)) as bigint)",
        n_repeat_words="if(size(places) = 0, 0L, aggregate(sequence(0, size(places) - 1), 0L, (sum, k) -> sum + least(3, coalesce(get(places, k + 1) - get(places, k), 3))))",
        lost_chars="aggregate(verdicts, 0L, (sum, v) -> sum + if(v.rule is null, 0, v.chars))",
        n_failed_lines="cast(size(filter(verdicts, v -> v.rule is not null)) as bigint)",
        clean_text="array_join(transform(filter(arrays_zip(lines, verdicts), z -> z.verdicts.rule is null), z -> z.lines.line), '\n')",
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars"))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(
        F.col("id").alias("doc_id"), *figures, kept.alias("kept"), "lost_chars", "n_failed_lines", "clean_text", *[F.col(n).alias(x) for n, x in zip(names, carry, strict=True)]
    )


def op3(docs: DataFrame) -> DataFrame:
    """Query form: the base counts, base_failed and kept of every document."""
    return measured(docs).drop("clean_text")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS words, string_split(t, chr(10)) AS lines FROM t
), v AS (
  SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^ \t-\r]')) AS real,
    list_transform(lines, lambda x: {
      'raw': x,
      'bare': regexp_replace(x, '[ \t-\r]+', '', 'g'),
      'n': len(list_filter(regexp_split_to_array(x, '[ \t-\r]+'), lambda y: y <> ''))}) AS l
  FROM w
), m AS (
  SELECT *, list_transform(l, lambda x: {
      'chars': length(x.bare),
      'bad': regexp_matches(lower(x.raw), 'PHRASES')
        OR (length(regexp_replace(x.bare, '[^|»•·›]+', '', 'g')) >= 3 AND greatest(x.n, 1) <= 4 * length(regexp_replace(x.bare, '[^|»•·›]+', '', 'g')))
        OR (x.n >= 3 AND 100 * length(regexp_replace(x.bare, '[\p{L}\p{N}]+', '', 'g')) > 30 * length(x.bare))
        OR (x.n >= 3 AND length(regexp_replace(x.bare, '[^!?#*$%&<>]+', '', 'g')) >= x.n)}) AS judged
  FROM v
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id
), f AS (
  SELECT m.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(real) - len(list_distinct(real)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(list_sum(list_transform(judged, lambda x: CASE WHEN x.bad THEN x.chars ELSE 0 END)), 0) AS BIGINT) AS lost_chars,
    CAST(len(list_filter(judged, lambda x: x.bad)) AS BIGINT) AS n_failed_lines
  FROM m LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept, lost_chars, n_failed_lines
FROM b
""".replace("PHRASES", "|".join(BOILERPLATE))
