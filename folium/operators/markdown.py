"""Markdown lines to section nodes.

Lines are rows (doc_id, line_no from 1, line).  Nodes are rows (doc_id, seq from 1, line_no, level, title) in the order of their
lines.  The tree over them needs no stack: the parent of a node is the nearest earlier one of a smaller level, which is the
greatest of five running maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .pages import ordered_text

DEEPEST = 6


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """Lines of files (doc_id, text), empty last ones included."""
    rows = files.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def marked(rows: DataFrame) -> DataFrame:
    """Lines with ``level`` and ``title`` where they are headings outside of code fences."""
    fence = X.strip(F.col("line")).startswith("```")
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(upto))
    title, level = X.heading_title(F.col("line")), X.heading_level(F.col("line"))
    heading = ~F.col("fence") & (F.col("fences") % 2 == 0) & title.isNotNull() & (level > 0)
    return rows.select("doc_id", "line_no", "line", F.when(heading, level).alias("level"), F.when(heading, title).alias("title"))


def headings(rows: DataFrame) -> DataFrame:
    found = marked(rows).where("level IS NOT NULL")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("seq"), "line_no", "level", "title")


def sections(rows: DataFrame) -> DataFrame:
    """Nodes with ``text``: the lines from a heading to the one before the next, stripped.  Lines before the first heading
    belong to none."""
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    found = marked(rows).withColumn("seq", F.count("level").over(upto)).where("seq > 0")
    found = found.groupBy("doc_id", F.col("seq").cast("int").alias("seq")).agg(F.min("line_no").alias("line_no"), F.max("level").alias("level"), F.max("title").alias("title"), ordered_text("line_no", "line", "\n").alias("text"))
    return found.withColumn("text", X.strip(F.col("text")))


def _last(k: int):
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.max(F.when(F.col("level") == k, F.col("seq"))).over(before)


def tree(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_seq`` (null for roots) and ``depth``."""
    rows = nodes.withColumns({f"last_{k}": _last(k) for k in range(1, DEEPEST)})
    smaller = [F.when(F.col("level") > k, F.col(f"last_{k}")) for k in range(1, DEEPEST)]
    # A node of level k is an ancestor if no later one before this has a level below k.
    above = [F.when((F.col("level") > k) & F.col(f"last_{k}").isNotNull() & (F.col(f"last_{k}") > F.coalesce(F.greatest(*[F.col(f"last_{j}") for j in range(1, k)], F.lit(0)) if k > 1 else F.lit(0), F.lit(0))), 1).otherwise(0) for k in range(1, DEEPEST)]
    depth = above[0]
    for one in above[1:]:
        depth = depth + one
    return rows.select(*nodes.columns, F.greatest(*smaller).alias("parent_seq"), depth.alias("depth"))


def subtree_end(nodes: DataFrame) -> DataFrame:
    """Nodes with ``subtree_end``: the last node below each, or itself."""
    after = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("seq"))).over(after)) for k in range(1, DEEPEST + 1)]
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return nodes.withColumn("subtree_end", F.coalesce(F.least(*nexts) - 1, n).cast("int"))


def subtree_tokens(nodes: DataFrame) -> DataFrame:
    """Nodes (with text) with ``subtree_end`` and ``text_token_count`` over a node and all below it."""
    rows = subtree_end(nodes).withColumn("own", X.token_count(F.col("text")))
    upto = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumn("upto", F.sum("own").over(upto))
    ends = rows.select("doc_id", F.col("seq").alias("subtree_end"), F.col("upto").alias("at_end"))
    rows = rows.join(ends, ["doc_id", "subtree_end"])
    return rows.select(*nodes.columns, "subtree_end", (F.col("at_end") - F.col("upto") + F.col("own")).cast("long").alias("text_token_count"))


def thinned(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes of subtree_tokens without those below a node of fewer than ``least`` tokens, whose text takes theirs in."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    small = F.max(F.when(F.col("text_token_count") < least, F.col("subtree_end"))).over(before)
    rows = nodes.withColumn("gone", F.coalesce(small >= F.col("seq"), F.lit(False)))
    rows = rows.withColumn("top", F.max(F.when(~F.col("gone"), F.col("seq"))).over(order))
    kept = [c for c in nodes.columns if c not in ("doc_id", "seq", "text", "text_token_count")]
    first = [F.min_by(c, "seq").alias(c) for c in kept]
    texts = F.array_sort(F.collect_list(F.when(F.length(X.strip(F.col("text"))) > 0, F.struct("seq", "text"))))
    merged = rows.groupBy("doc_id", F.col("top").alias("seq")).agg(*first, F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("merged"), F.min_by("text_token_count", "seq").alias("before"))
    count = F.when(F.col("before") < least, X.token_count(F.col("text")).cast("long")).otherwise(F.col("before"))
    return merged.select("doc_id", "seq", *kept, "text", count.alias("text_token_count"))


def summary_keys(nodes: DataFrame, threshold: int) -> DataFrame:
    """Nodes with ``is_leaf``, and ``summary`` (leaves) or ``prefix_summary`` (others) where the text is short enough to be its
    own summary; ``ask`` marks those for the reasoner."""
    following = F.lead("level").over(Window.partitionBy("doc_id").orderBy("seq"))
    rows = nodes.withColumn("is_leaf", F.coalesce(following <= F.col("level"), F.lit(True)))
    short = X.token_count(F.col("text")) < threshold
    return rows.select(*nodes.columns, "is_leaf", F.when(short & F.col("is_leaf"), F.col("text")).alias("summary"), F.when(short & ~F.col("is_leaf"), F.col("text")).alias("prefix_summary"), (~short).alias("ask"))
