"""Tables of contents: which pages they are on, what they say, and how printed page numbers map to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .pages import in_range, ordered_text


def runs(flags: DataFrame, limit: int) -> DataFrame:
    """(doc_id, run_no, first_page, last_page) of the runs of "yes" pages in flags (doc_id, page_no, toc_detected).

    A run starts on a page up to ``limit`` and goes on, also beyond it, until a "no"."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    rows = flags.withColumn("island", F.sum((F.col("toc_detected") == "no").cast("int")).over(order)).where("toc_detected = 'yes'")
    found = rows.groupBy("doc_id", "island").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).where(F.col("first_page") <= limit)
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_page")).alias("run_no"), "first_page", "last_page")


def first_run(flags: DataFrame, limit: int) -> DataFrame:
    return runs(flags, limit).where("run_no = 1").drop("run_no")


def content(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs with ``toc_content`` (their pages' text, dot leaders made colons) and ``page_index_given``."""
    rows = in_range(found, pages.select("doc_id", "page_no", "text"), "first_page", "last_page")
    rows = rows.groupBy("doc_id", "run_no", "first_page", "last_page").agg(ordered_text().alias("raw")).withColumn("toc_content", X.dot_leaders(F.col("raw")))
    return rows.withColumn("page_index_given", F.when(F.col("toc_content").rlike(r"(?m)\d\s*$"), "yes").otherwise("no")).drop("raw")


def chosen_run(found: DataFrame) -> DataFrame:
    """The first run that gives page numbers, or else the first run, of each document."""
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy((F.col("page_index_given") != "yes").cast("int"), "run_no"))
    return found.withColumn("best", best).where("best = 1").drop("best")


def title_pairs(printed: DataFrame, physical: DataFrame, start_page: int = 1) -> DataFrame:
    """Pairs of printed items (doc_id, title, page) and located ones (doc_id, title, physical_index) of one title; null titles
    are alike, repeated titles give every pair."""
    a = printed.select("doc_id", "title", "page").alias("a")
    b = physical.select("doc_id", "title", "physical_index").alias("b")
    joined = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & F.col("a.title").eqNullSafe(F.col("b.title")))
    return joined.where(F.col("b.physical_index") >= start_page).select("a.doc_id", "a.title", "a.page", "b.physical_index")


def page_offset(pairs: DataFrame) -> DataFrame:
    """(doc_id, page_offset): the most common difference of physical index and page, the smallest of equally common ones;
    pairs with a missing or negative value don't count."""
    diffs = pairs.where("page >= 0 AND physical_index >= 0").groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("page_offset")).agg(F.count(F.lit(1)).alias("n"))
    best = diffs.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "page_offset")).alias("x"))
    return best.select("doc_id", F.col("x.page_offset").cast("int").alias("page_offset"))


def add_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    """Items whose page and offset are known get physical_index = page + offset and lose their page; others stay."""
    rows = items.join(offsets, "doc_id", "left")
    known = F.col("page").isNotNull() & F.col("page_offset").isNotNull()
    return rows.withColumn("physical_index", F.when(known, F.col("page") + F.col("page_offset")).otherwise(F.col("physical_index"))).withColumn("page", F.when(~known, F.col("page"))).drop("page_offset")


def neighbours(items: DataFrame, wanted: Column, good: Column, before: Column, after: Column) -> DataFrame:
    """The wanted items with ``prev_index`` and ``next_index``: the index of the nearest good item on either side, or the given
    ends."""
    order = Window.partitionBy("doc_id").orderBy("item_no")
    value = F.when(good, F.col("physical_index"))
    prev = F.last(value, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(value, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = items.withColumn("prev_index", F.coalesce(prev, before)).withColumn("next_index", F.coalesce(following, after)).withColumn("wanted", wanted)
    return rows.where("wanted").drop("wanted")


def gap_neighbours(items: DataFrame, page_counts: DataFrame) -> DataFrame:
    rows = items.join(page_counts.select("doc_id", "n_pages"), "doc_id")
    none = F.col("physical_index").isNull()
    return neighbours(rows, none, ~none, F.lit(0), F.col("n_pages")).drop("n_pages")


def located(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, item_no, found_index): the first page between prev_index and next_index that has the title on it."""
    title = X.squeezed(F.col("title"))
    rows = in_range(asked.select("doc_id", "item_no", "prev_index", "next_index", title.alias("sought")), pages.select("doc_id", "page_no", "text"), "prev_index", "next_index")
    rows = rows.where(X.squeezed(F.col("text")).contains(F.col("sought")))
    return rows.groupBy("doc_id", "item_no").agg(F.min("page_no").alias("found_index"))


def fill_gaps(items: DataFrame, pages: DataFrame, page_counts: DataFrame, locate=located) -> DataFrame:
    """Items without an index get the page that ``locate`` finds between their neighbours."""
    found = locate(gap_neighbours(items, page_counts), pages)
    return items.join(found, ["doc_id", "item_no"], "left").withColumn("physical_index", F.coalesce("physical_index", "found_index")).drop("found_index")


def in_pages(items: DataFrame, first: int, last: int) -> DataFrame:
    """The items that are said to start on the pages from first to last."""
    return items.where(F.col("physical_index").between(first, last))


def gap_pages(items: DataFrame, pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc_id, item_no, n, tagged): how many pages an item without an index may start on, and their tagged text."""
    gaps = gap_neighbours(items, page_counts).select("doc_id", "item_no", "prev_index", "next_index")
    rows = in_range(gaps, pages.select("doc_id", "page_no", "text"), "prev_index", "next_index")
    rows = rows.withColumn("text", X.tagged(F.col("page_no"), F.col("text")))
    return rows.groupBy("doc_id", "item_no").agg(F.count(F.lit(1)).alias("n"), ordered_text().alias("tagged"))


def parse_lines(contents: DataFrame) -> DataFrame:
    """Items of ``toc_content`` (doc_id, toc_content): a line is an optional code, a title, and an optional printed page."""
    lines = contents.select("doc_id", F.posexplode(F.split("toc_content", "\n")).alias("pos", "line"))
    pattern = r"^\s*(\d+(?:\.\d+)*)?\.?\s*(.*?)[:.\s]*(\d+)?\s*$"
    got = lambda k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    rows = lines.select("doc_id", "pos", got(1).alias("structure"), got(2).alias("title"), got(3).try_cast("int").alias("page")).where("title IS NOT NULL AND lower(title) NOT IN ('contents', 'table of contents')")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("item_no"), "structure", "title", "page")
