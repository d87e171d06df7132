"""Quality rules, with DataFrame functions only.

Base measures count words (runs of other than white space), word characters, symbols, repeated lines and words in
repeated three-word windows.  On top of them stands cross-document line frequency: normalised lines are hashed, the distinct
texts of a host (``source``) that hold a line are counted, lines above the limit are removed, and documents that keep too little of
themselves are rejected.

A line is above the limit if more than ``max_docs`` distinct texts of the host hold it, however large the host is; copies of a text
count once, so a group of copies doesn't reject itself.  A document is depleted if it keeps less than ``min_left`` of its words.

Texts are read once, into a table of measures and line hashes that the rest works on; a line that very many documents hold is added up
before it is dealt.  Windows are equal if their 64-bit hashes are, lines likewise.

Defined results: null text has no words and fails the base rules; a null source is a host of its own; equal rows get the same
verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_DOCS, MIN_LEFT = 20, 0.5
#: Windows of a text up to which hash and place share a number when they are sorted; beyond, pairs are sorted.
PACKED = 1 << 16


def spaced(text: Column) -> Column:
    """text with a space for each other white-space character."""
    for c in common.SPACES.replace(" ", ""):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


#: Places of windows that a text has twice or more, in order: sorting by (hash, place) brings equal ones together.  A number holds
#: as many bits of the hash as the places leave, and whole hashes decide.
_PACKED = "sort_array(transform(hashes, (h, i) -> (h & ~mask) | cast(i as bigint)))"
_PLACE = "cast(get(keyed, {j}) & mask as int)"
_SAME = f"(get(hashes, {_PLACE}) <=> get(hashes, cast(p & mask as int)))"
_TWICE = "filter(keyed, (p, j) -> (j > 0 AND " + _SAME.format(j="j - 1") + ") OR (j < size(keyed) - 1 AND " + _SAME.format(j="j + 1") + "))"
_PAIRS = "sort_array(transform(hashes, (h, i) -> struct(h, cast(i as bigint) as i)))"
_TWICE_PAIRS = "transform(filter(pairs, (p, j) -> (j > 0 AND get(pairs, j - 1).h <=> p.h) OR get(pairs, j + 1).h <=> p.h), p -> p.i)"
_COVERED = "coalesce(aggregate(sort_array({places}), named_struct('n', 0L, 'last', -3L), (s, p) -> named_struct('n', s.n + least(3L, p - s.last), 'last', p)).n, 0L)"


def _repeated(rows: DataFrame, packed: int) -> DataFrame:
    """rows (words, n_words, ...) with ``n_repeat_words``: words in three-word windows that a text has twice or more."""
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    hashes = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), window))
    rows = rows.withColumn("hashes", hashes).withColumn("mask", F.expr("shiftleft(1L, length(bin(n_words))) - 1"))
    short = F.col("n_words") <= packed
    rows = rows.withColumn("keyed", F.when(short, F.expr(_PACKED))).withColumn("pairs", F.when(~short, F.expr(_PAIRS)))
    places = f"transform({_TWICE}, p -> p & mask)"
    covered = F.when(short, F.expr(_COVERED.format(places=places))).otherwise(F.expr(_COVERED.format(places=_TWICE_PAIRS)))
    return rows.withColumn("n_repeat_words", covered).drop("hashes", "mask", "keyed", "pairs")


def measures(docs: DataFrame, packed: int = PACKED) -> DataFrame:
    """docs (doc_id, source, text) with the base measures, ``copy`` (a hash of the text), ``row`` (a number of the row) and ``lines``:
    the hashes of each row's normalised lines, and how many words they have."""
    rows = docs.select("doc_id", "source", common.text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    rows = _repeated(rows, packed).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(common.SPACES)) != ""))
    line = lambda x: F.struct(F.xxhash64(F.lower(F.array_join(words_of(x), " "))).alias("line"), F.size(words_of(x)).alias("n"))
    return rows.select(
        "row", "doc_id", "source", F.xxhash64("text").alias("copy"), "n_words", F.char_length(F.replace(spaced(F.col("text")), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"), F.transform("lines", line).alias("lines"),
    )


def normalised(line: Column) -> Column:
    return F.lower(F.array_join(words_of(line), " "))


def lines_above(measured: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(row, line, n): for each row of measured the hashes of its lines above the limit, and the words it has in them."""
    rows = measured.select("row", "source", "copy", F.explode("lines").alias("x")).select("row", "source", "copy", "x.line", "x.n")
    counts = rows.groupBy("source", "line", "copy").agg(F.lit(1).alias("one")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs"))
    above = common.written(counts.where(F.col("docs") > max_docs).select(F.col("source").alias("host"), common.skew_key("line").alias("same")), "lines-above")
    return rows.join(above, (F.col("line").cast("string") == F.col("same")) & F.col("source").eqNullSafe(F.col("host"))).select("row", "line", "n")


def without_lines(docs: DataFrame, **limits) -> DataFrame:
    """docs with the lines above the limit taken out of ``text``; columns and rows stay as they are."""
    kept = common.written(docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("at")), "quality-docs")
    measured = kept.select(F.col("at").alias("row"), "whole.source", F.xxhash64(F.coalesce("whole.text", F.lit(""))).alias("copy"), F.split(F.coalesce("whole.text", F.lit("")), "\n").alias("lines"))
    shown = F.filter("lines", lambda x: F.btrim(x, F.lit(common.SPACES)) != "")
    measured = measured.withColumn("lines", F.transform(shown, lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.lit(0).alias("n"))))
    gone = lines_above(measured, **limits).groupBy("row").agg(F.collect_set("line").alias("gone"))
    left = F.filter(F.split("whole.text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normalised(x))))
    text = F.when(F.col("gone").isNull(), F.col("whole.text")).otherwise(F.array_join(left, "\n"))
    rows = kept.join(gone, F.col("at") == F.col("row"), "left")
    return rows.select(*[text.alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


def verdicts(docs: DataFrame, min_left: float = MIN_LEFT, packed: int = PACKED, **limits) -> DataFrame:
    """The base measures of every row, base_failed and kept."""
    measured = common.written(measures(docs.select("doc_id", "source", "text"), packed), "quality")
    gone = lines_above(measured, **limits).groupBy(F.col("row").alias("of")).agg(F.sum("n").alias("removed"))
    rows = measured.drop("lines").join(gone, F.col("row") == F.col("of"), "left")
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (F.col("n_words") - removed >= min_left * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), removed.alias("n_removed_words"))
