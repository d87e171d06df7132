"""Trees as flat rows: parents by structure code, paths, pre-order, end pages, outlines and nested JSON.

Items are rows (doc_id, item_no, structure, title, ...) in the order of item_no.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import cut
from .pages import ordered_text


def code_parents(items: DataFrame) -> DataFrame:
    """Items with ``parent_item``: the latest earlier item whose code is what stands before the last dot; null for roots.

    Items stand by the code that they look for and once more by the code that they have, and each looks back; nothing is paired."""
    child = items.withColumn("code", X.parent_code(F.col("structure"))).withColumn("candidate", F.lit(None).cast(items.schema["item_no"].dataType))
    has = {"code": F.col("structure"), "doc_id": F.col("doc_id"), "item_no": F.col("item_no"), "candidate": F.col("item_no")}
    parent = items.where("structure IS NOT NULL").select(*[has.get(c, F.lit(None).cast(child.schema[c].dataType)).alias(c) for c in child.columns])
    rows = parent.withColumn("looks", F.lit(False)).unionByName(child.withColumn("looks", F.lit(True)))
    before = Window.partitionBy("doc_id", "code").orderBy("item_no", F.col("looks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("parent_item", F.when(F.col("code").isNotNull(), F.last("candidate", True).over(before)))
    return found.where("looks").drop("looks", "code", "candidate")


def paths(items: DataFrame) -> DataFrame:
    """Items with parent_item plus ``path`` (item_no of all ancestors and itself) and ``depth``.

    A round doubles the length of all paths, over all documents at once, and works on the items whose path has no root yet, so
    there are as many rounds as the depth of the deepest tree has binary digits."""
    rows = cut(items.withColumn("path", F.array("item_no")).withColumn("up", F.col("parent_item")), "paths")
    while not rows.where("up IS NOT NULL").isEmpty():
        above = rows.select("doc_id", F.col("item_no").alias("up"), F.col("path").alias("above"), F.col("up").alias("next_up"))
        open_ = rows.where("up IS NOT NULL").join(above, ["doc_id", "up"]).withColumn("path", F.concat("above", "path")).withColumn("up", F.col("next_up"))
        rows = cut(rows.where("up IS NULL").unionByName(open_.select(*rows.columns)), "paths")
    return rows.select(*items.columns, "path", (F.size("path") - 1).alias("depth"))


def preorder(rows: DataFrame) -> DataFrame:
    """Rows of ``paths`` with ``seq`` (depth first, from 0) and ``node_id`` (at least four digits)."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return rows.withColumn("seq", seq).withColumn("node_id", X.node_id(F.col("seq")))


def subtree_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, item_no, below): the number of nodes below each node of ``paths``."""
    each = rows.select("doc_id", F.explode("path").alias("item_no")).groupBy("doc_id", "item_no").agg(F.count(F.lit(1)).alias("n"))
    return each.select("doc_id", "item_no", (F.col("n") - 1).alias("below"))


def leaves(rows: DataFrame) -> DataFrame:
    """Rows of ``preorder`` that have nothing below them."""
    following = F.lead("depth").over(Window.partitionBy("doc_id").orderBy("seq"))
    return rows.withColumn("next_depth", following).where("next_depth IS NULL OR next_depth <= depth").drop("next_depth")


def with_preface(items: DataFrame) -> DataFrame:
    """Items with a row "Preface" (structure "0", page 1, item_no 0) where a document's first item is beyond page 1."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "item_no").alias("at")).where("at > 1")
    row = {"item_no": F.lit(0), "structure": F.lit("0"), "title": F.lit("Preface"), "physical_index": F.lit(1)}
    kinds = dict(items.dtypes)
    preface = first.select(*[F.col("doc_id") if c == "doc_id" else row.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in items.columns])
    return items.unionByName(preface)


def end_pages(items: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Items (physical_index, appear_start) with ``start_index`` and ``end_index``: the page before the next item's if that one
    begins its page, else that page; the last item, and one before an item without a page, ends with the document."""
    order = Window.partitionBy("doc_id").orderBy("item_no")
    following, starts = F.lead("physical_index").over(order), F.lead("appear_start").over(order)
    last = F.lead(F.lit(1)).over(order).isNull()
    following = F.coalesce(following, F.col("n_pages"))
    end = F.when(last, F.col("n_pages")).when(starts == "yes", following - 1).otherwise(following)
    rows = items.join(page_counts.select("doc_id", "n_pages"), "doc_id")
    return rows.withColumn("start_index", F.col("physical_index")).withColumn("end_index", end.cast("int")).drop("n_pages")


def outline(rows: DataFrame) -> DataFrame:
    """(doc_id, outline): the lines of all nodes of ``preorder``, indented by depth."""
    missing = F.lit(None).cast("int")
    start = F.col("start_index") if "start_index" in rows.columns else missing
    end = F.col("end_index") if "end_index" in rows.columns else missing
    lines = rows.withColumn("text", X.outline_line(F.col("depth"), F.col("title"), start, end))
    return lines.groupBy("doc_id").agg(ordered_text("seq").alias("outline"))


def nested_json(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, structure_json): the nodes of ``preorder`` as nested JSON.  Levels are folded from the deepest up, each by one
    aggregation over all documents; nodes without children have no ``nodes``."""
    parts = cut(rows.select("doc_id", "item_no", "parent_item", "depth", "seq", F.to_json(F.struct(*fields)).alias("json")), "nodes")
    deepest = parts.agg(F.max("depth")).head()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        level = parts.where(F.col("depth") == depth)
        if below is not None:
            level = level.join(below, ["doc_id", "item_no"], "left")
            inside = F.concat(F.expr("left(json, length(json) - 1)"), F.when(F.length("json") > 2, F.lit(",")).otherwise(F.lit("")), F.lit('"nodes":['), F.col("kids"), F.lit("]}"))
            level = level.withColumn("json", F.when(F.col("kids").isNotNull(), inside).otherwise(F.col("json")))
        if depth == 0:
            return level.groupBy("doc_id").agg(F.concat(F.lit("["), ordered_text("seq", "json", ","), F.lit("]")).alias("structure_json"))
        below = level.groupBy("doc_id", F.col("parent_item").alias("item_no")).agg(ordered_text("seq", "json", ",").alias("kids"))
    raise AssertionError("a level 0 always ends the loop")


def without_text(rows: DataFrame) -> DataFrame:
    return rows.drop("text")


def without_repeated_head(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Items without a document's first one where it has the title (stripped) that titles (doc_id, title) give the document."""
    first = items.groupBy("doc_id").agg(F.min("item_no").alias("first"))
    rows = items.join(first, "doc_id").join(titles.select("doc_id", X.strip(F.col("title")).alias("parent_title")), "doc_id", "left")
    repeated = (F.col("item_no") == F.col("first")) & (X.strip(F.col("title")) == F.col("parent_title"))
    return rows.where(~F.coalesce(repeated, F.lit(False))).select(*items.columns)
