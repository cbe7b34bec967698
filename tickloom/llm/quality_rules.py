"""Line-first quality rules, in Spark expressions alone.

Every line is judged by itself: navigation (link bars and tables of short cells), boilerplate
(licence, copyright, cookie and sign-up lines) and punctuation (shouting, symbols after the
words). Lines that fail are removed, then a document that lost too much of its text is rejected,
as is one that fails the base counts on the whole text.

Edge cases: a null text counts as empty; an empty text has no words, fails the base and is not
kept; repeated rows and null ids pass through, one result each; other columns are ignored, whatever
their names; an empty table gives an empty result. Texts of any length stay in one row. Equal 8-word windows are found by 64-bit hashes of
word hashes, so two different windows of one text meet with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import GAPS, WORD, let, query, table, texts, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
#: A document is kept if at least this share of its word characters survives the line rules.
MIN_SURVIVING = 0.6
#: A line fails if more than this share of its word characters are symbols or exclamation marks.
MAX_MARKS = 0.12
#: A line fails if more than this share of its words repeat the word before.
MAX_STUTTER = 0.4
#: A line of at least so many cells, split at bars, with at most this many words a cell.
MIN_CELLS, MAX_CELL_WORDS = 4, 3

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!#*$%&<>{}=~\^]"
#: A line of at most MAX_PHRASE_WORDS words fails if it holds one of these phrases, in any case, or
#: starts with one of the openings; in longer ones a phrase is a small part of what is said.
MAX_PHRASE_WORDS = 20
PHRASES = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "we use cookies", "accept cookies", "cookie policy", "subscribe to our", "sign up for our", "click here to",
    "enable javascript", "share this page", "share this article",
)
OPENINGS = ("copyright", "(c)", "\u00a9")


def _lines(text: Column) -> Column:
    """The lines of a text, each with its words."""
    return F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), words(line).alias("words")))


def _all_words(lines: Column) -> Column:
    return F.flatten(F.transform(lines, lambda x: x["words"]))


def _chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, ""))


def _count(text: Column, of: str) -> Column:
    """How many characters of a class the text has; texts without any are only searched."""
    return F.when(text.rlike(of), F.length(text) - F.length(F.regexp_replace(text, of, ""))).otherwise(F.lit(0))


def _repeat_words(ws: Column) -> Column:
    """How many words lie in a window that the text has twice or more."""
    pair = lambda step: lambda h: F.transform(h, lambda x, k: F.xxhash64(x, F.get(h, k + step)))
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words
        hashes = let(hashes, pair(step))
    windows = F.slice(hashes, F.lit(1), F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0)))
    return let(windows, lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(_covered(w)))


def _covered(windows: Column) -> Column:
    """Words under windows with an equal one: sort (hash, place), keep those beside an equal
    hash, sort the places and add up the steps, each at most a window long."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = lambda s: lambda x, k: F.struct(
        x["i"].alias("i"), (F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])).alias("twice")
    )
    places = let(
        placed,
        lambda s: F.array_sort(F.transform(F.filter(F.transform(s, beside(s)), lambda x: x["twice"]), lambda x: x["i"])),
    )
    return let(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))),
            F.lit(0),
            lambda total, step: total + step,
        ),
    )


def line_fails(x: Column) -> Column:
    """True for a (line, words) that one of the rules removes; never for one without words."""
    line, ws = x["line"], x["words"]
    without = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    cells = without("|") + 1
    navigation = line.contains("|") & (cells >= MIN_CELLS) & (without(" ") - without("|") <= MAX_CELL_WORDS * cells)
    marked = line.rlike(MARKS) & (_count(line, MARKS) > MAX_MARKS * _chars(ws))
    said = lambda low: reduce(or_, [low.contains(p) for p in PHRASES] + [F.ltrim(low).startswith(o) for o in OPENINGS])
    stutter = F.size(F.filter(ws, lambda w, k: w.eqNullSafe(F.get(ws, k - 1)))) > MAX_STUTTER * F.size(ws)
    short = F.size(ws) <= MAX_PHRASE_WORDS
    return (F.size(ws) > 0) & (navigation | marked | (short & let(F.lower(line), said)) | stutter)


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, cleaned text (failing lines removed), surviving characters, and the verdict."""
    own = texts(docs).withColumn("lines", _lines(F.col("text")))
    own = own.withColumn("words", _all_words(F.col("lines")))
    worded = F.transform(F.filter("lines", lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
    out = own.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _chars(F.col("words")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(worded, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("left"),
    )
    out = out.withColumn("kept_chars", _chars(_all_words(F.col("left"))).cast("long"))
    out = out.withColumn("cleaned", F.array_join(F.transform("left", lambda x: x["line"]), "\n")).drop("left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= MIN_SURVIVING * F.col("word_chars")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their failing lines removed, as documents' columns."""
    own = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    # One array of the cleaned text, or none: each text is judged once, in one expression.
    out = own.withColumn("__cleaned", F.explode(_cleaned_if_kept(F.col("text"))))
    out = out.withColumn("text", F.col("__cleaned")).drop("__cleaned")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _cleaned_if_kept(text: Column) -> Column:
    """The verdict of ``judge`` in one expression: an array with the cleaned text, or an empty one."""
    none = F.array().cast("array<string>")

    def rest(ws: Column):
        def judged(left: Column) -> Column:
            survives = _chars(_all_words(left)) >= MIN_SURVIVING * _chars(ws)
            return F.when(survives, F.array(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))).otherwise(none)

        return judged

    def verdict(lines: Column) -> Column:
        def by_words(ws: Column) -> Column:
            base = (F.size(ws) >= MIN_WORDS) & (100 * _repeat_words(ws) <= MAX_REPEATED * F.size(ws))
            return F.when(base, let(F.filter(lines, lambda x: ~line_fails(x)), rest(ws))).otherwise(none)

        return let(_all_words(lines), by_words)

    return let(_lines(text), verdict)


_SQL_SAID = " OR ".join([f"contains(lower(x), '{p}')" for p in PHRASES] + [f"starts_with(ltrim(lower(x), ' '), '{o}')" for o in OPENINGS])

ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW})
), twice AS (
  SELECT rid, unnest(list(i)) AS i FROM win GROUP BY rid, g HAVING count(*) > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM twice) GROUP BY rid
), line AS (
  SELECT rid, x, length(regexp_replace(x, '{GAPS}', '', 'g')) AS chars,
         length(regexp_replace(x, '[^|]', '', 'g')) AS bars, length(regexp_replace(x, '[^ ]', '', 'g')) AS gaps,
         length(x) - length(regexp_replace(x, '{MARKS}', '', 'g')) AS marks,
         len(ws) AS n, len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS again
  FROM (SELECT *, regexp_extract_all(x, '{WORD}') AS ws FROM (SELECT rid, unnest(lines) AS x FROM w))
), good AS (
  SELECT rid, sum(chars) AS chars FROM line
  WHERE NOT ((bars + 1 >= {MIN_CELLS} AND gaps - bars <= {MAX_CELL_WORDS} * (bars + 1))
             OR marks > {MAX_MARKS} * chars OR again > {MAX_STUTTER} * n OR (n <= {MAX_PHRASE_WORDS} AND ({_SQL_SAID})))
  GROUP BY rid
), c AS (
  SELECT w.rid, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '{GAPS}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(good.chars, 0) AS BIGINT) AS kept_chars
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN good USING (rid)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars,
       NOT base_failed AND kept_chars >= {MIN_SURVIVING} * word_chars AS kept
FROM f
"""


@query("op5_line_rules", ORACLE)
def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars", "kept"
    )
