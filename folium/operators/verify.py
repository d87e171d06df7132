"""Checking where sections are said to start, repairing what is wrong, and deciding what to try next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import cut
from . import toc

THRESHOLD = 0.4


def truncated(items: DataFrame, page_counts: DataFrame, start: int = 1, check_low: bool = False) -> DataFrame:
    """Items whose index is beyond the last page (of a slice from ``start``) lose it; those before it too if check_low."""
    rows = items.join(page_counts.select("doc_id", "n_pages"), "doc_id")
    good = F.col("physical_index") <= F.col("n_pages") + (start - 1)
    if check_low:
        good = good & (F.col("physical_index") >= start)
    return rows.withColumn("physical_index", F.when(good, F.col("physical_index"))).drop("n_pages")


def with_index(items: DataFrame) -> DataFrame:
    return items.where("physical_index IS NOT NULL")


def checked(items: DataFrame, pages: DataFrame, at_start: bool = False) -> DataFrame:
    """Items with ``answer``: whether the title is on its page (or begins it).  Items without an index or beyond the pages are
    "no" and meet no page, which is how a costly check is kept from them."""
    at = pages.select("doc_id", F.col("page_no").alias("physical_index"), F.col("text").alias("page_text"))
    rows = items.join(at, ["doc_id", "physical_index"], "left")
    page, title = X.squeezed(F.col("page_text")), X.squeezed(F.col("title"))
    hit = page.startswith(title) if at_start else page.contains(title)
    return rows.withColumn("answer", F.when(F.coalesce(hit, F.lit(False)), "yes").otherwise("no")).drop("page_text").select(*items.columns, "answer")


def accuracy(answers: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(doc_id, checked, correct, accuracy): the share of "yes" among items with an index; 0 if the last of them is in the first
    half of the pages."""
    known = with_index(answers).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("checked"), F.sum((F.col("answer") == "yes").cast("int")).alias("correct"), F.max_by("physical_index", "item_no").alias("last"))
    rows = page_counts.select("doc_id", "n_pages").join(known, "doc_id", "inner")
    far = F.col("last") >= F.col("n_pages") / 2.0
    share = F.when(far, F.col("correct") / F.col("checked")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "checked", "correct", F.round(share, 6).alias("accuracy"))


def incorrect(answers: DataFrame) -> DataFrame:
    return with_index(answers).where("answer <> 'yes'")


def repair_ranges(answers: DataFrame, page_counts: DataFrame, start: int = 1) -> DataFrame:
    """The incorrect items with the indices of the nearest correct ones; the ends are the pages before and last."""
    rows = with_index(answers).join(page_counts.select("doc_id", "n_pages"), "doc_id")
    wrong = F.col("answer") != "yes"
    return toc.neighbours(rows, wrong, ~wrong, F.lit(start - 1), F.col("n_pages") + (start - 1)).drop("n_pages")


def fixes(answers: DataFrame, pages: DataFrame, page_counts: DataFrame, located=toc.located) -> DataFrame:
    """(doc_id, item_no, found_index) for the incorrect items whose title is on a page between correct neighbours."""
    return located(repair_ranges(answers, page_counts), pages)


def apply_fixes(items: DataFrame, found: DataFrame) -> DataFrame:
    return items.join(found, ["doc_id", "item_no"], "left").withColumn("physical_index", F.coalesce("found_index", "physical_index")).drop("found_index")


def decisions(accuracies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """What follows a check: accept, fix, or fall back to a weaker mode."""
    wrong = F.col("checked") > F.col("correct")
    what = F.when((F.col("accuracy") == 1.0) & ~wrong, "accept").when((F.col("accuracy") > threshold) & wrong, "fix").otherwise("fall back")
    return accuracies.withColumn("decision", what)


def repaired(items: DataFrame, pages: DataFrame, page_counts: DataFrame, rounds: int = 3, checked=checked, located=toc.located) -> DataFrame:
    """Items after up to ``rounds`` repairs; a round that finds nothing ends it."""
    for _ in range(rounds):
        answers = checked(items, pages)
        found = cut(fixes(answers, pages, page_counts, located), "fixes")
        changed = found.join(items, ["doc_id", "item_no"]).where("NOT (found_index <=> physical_index)")
        if changed.isEmpty():
            break
        items = cut(apply_fixes(items, found), "items")
    return items


def sampled(items: DataFrame, n: int | None, seed: int = 7) -> DataFrame:
    """n items of each document for a check, in the order of a seeded MD5; all of them if n is null."""
    if n is None:
        return items
    order = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("item_no").cast("string"))))
    return items.withColumn("drawn", F.row_number().over(order)).where(F.col("drawn") <= n).drop("drawn")
