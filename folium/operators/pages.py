"""Pages: scans of lines, counts, texts of ranges, prefix sums and token-budget packing.

Pages are rows (doc_id, page_no from 1, text, token_count); every window stays within a doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def from_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """Each line of a document is a page."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "text"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("int").alias("page_no"), "text", X.token_count(F.col("text")).alias("token_count"))


def with_token_counts(pages: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """pages with ``token_count`` by a byte-level BPE: a file of ranks (a token in base 64 and its rank a line, on a path that all executors
    have) and the pattern that splits texts.  Null text has no tokens; special tokens are ordinary text."""
    from collections.abc import Iterator

    import pyarrow as pa

    kept = pages.drop("token_count")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        for batch in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], names=[*batch.schema.names, "token_count"])

    from pyspark.sql import types as T

    return kept.mapInArrow(count, T.StructType([*kept.schema.fields, T.StructField("token_count", T.IntegerType())]))


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))


def token_total(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.sum("token_count").alias("tokens"))


def ordered_text(by: str = "page_no", text: str = "text", separator: str = "") -> Column:
    """Texts of a group in order, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, text))), lambda x: x[text]), separator)


def in_range(rows: DataFrame, pages: DataFrame, first: str, last: str, block: int = 32) -> DataFrame:
    """rows joined with the pages of their document from the page in column ``first`` to that in ``last``.

    Rows and pages meet by blocks of pages, so a row meets only pages near its range and a long document is no single key."""
    a, b, n = F.col(first), F.col(last), F.lit(block)
    blocks = F.when(a <= b, F.sequence(F.floor(a / n), F.floor(b / n)))
    left = rows.withColumn("page_block", F.explode(blocks))
    right = pages.withColumn("page_block", F.floor(F.col("page_no") / n))
    return left.join(right, ["doc_id", "page_block"]).where(F.col("page_no").between(a, b)).drop("page_block")


def range_text(pages: DataFrame, first: int, last: int, tag: bool = False) -> DataFrame:
    text = X.tagged(F.col("page_no"), F.col("text")) if tag else F.col("text")
    kept = pages.where(F.col("page_no").between(first, last)).withColumn("text", text)
    return kept.groupBy("doc_id").agg(ordered_text().alias("text"))


def tagged_pages(pages: DataFrame, trailing: int = 2) -> DataFrame:
    return pages.select("doc_id", "page_no", X.tagged(F.col("page_no"), F.col("text"), trailing).alias("tagged"))


def running_tokens(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, upto): tokens of the pages up to each page."""
    upto = Window.partitionBy("doc_id").orderBy("page_no")
    return pages.select("doc_id", "page_no", F.sum("token_count").over(upto).alias("upto"))


def section_tokens(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """sections (doc_id, start_index, end_index, ...) with ``tokens`` of their pages: the difference of two running sums, so
    the work doesn't grow with the pages of a section.  Inverted ranges have none."""
    sums = running_tokens(pages)
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    rows = sections.join(last, "doc_id", "left")
    rows = rows.withColumn("to_page", F.least("end_index", "last_page")).withColumn("from_page", F.greatest(F.col("start_index"), F.lit(1)) - 1)
    high = sums.select("doc_id", F.col("page_no").alias("to_page"), F.col("upto").alias("high"))
    low = sums.select("doc_id", F.col("page_no").alias("from_page"), F.col("upto").alias("low"))
    rows = rows.join(high, ["doc_id", "to_page"], "left").join(low, ["doc_id", "from_page"], "left")
    tokens = F.when(F.col("to_page") > F.col("from_page"), F.coalesce("high", F.lit(0)) - F.coalesce("low", F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn("tokens", tokens.cast("long")).select(*sections.columns, "tokens")


def section_text(sections: DataFrame, pages: DataFrame, key: str = "item_no") -> DataFrame:
    """(doc_id, key, text): the texts of each section's pages, in order; sections without pages have none."""
    joined = in_range(sections.select("doc_id", key, "start_index", "end_index"), pages.select("doc_id", "page_no", "text"), "start_index", "end_index")
    return joined.groupBy("doc_id", key).agg(ordered_text().alias("text"))


def groups(pages: DataFrame, budget: int, drop_empty: bool = True) -> DataFrame:
    """(doc_id, group_no, first_page, last_page): pages packed to a token budget, each group starting with the last page of
    the one before.

    Up to the budget in all there is one group.  Beyond it, with p = ceil(total / budget), a group is closed before the page
    that would take it over ceil((total / p + budget) / 2).  If the first page does so alone, an empty group comes first
    (dropped unless asked for, its number staying free)."""
    per_doc = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "token_count"))).alias("pages"), F.sum("token_count").alias("total"))
    parts = F.ceil(F.col("total") / budget)
    limit = F.when(F.col("total") <= budget, F.col("total")).otherwise(F.ceil((F.col("total") / parts + budget) / 2))
    rows = per_doc.withColumn("limit", limit.cast("long"))
    # The state: tokens of the open group, those and the number of the page before, and the first pages of later groups.
    fold = """aggregate(pages,
        named_struct('sum', 0L, 'last', cast(null as int), 'page', cast(null as int), 'starts', cast(array() as array<int>)),
        (s, p) -> if(s.sum + p.token_count > limit,
            named_struct('sum', cast(coalesce(s.last, 0) + p.token_count as bigint), 'last', p.token_count, 'page', p.page_no, 'starts', concat(s.starts, array(coalesce(s.page, p.page_no)))),
            named_struct('sum', s.sum + p.token_count, 'last', p.token_count, 'page', p.page_no, 'starts', s.starts)),
        s -> s.starts)"""
    rows = rows.withColumn("starts", F.expr(fold)).withColumn("first", F.element_at("pages", 1))
    placed = rows.select("doc_id", "starts", F.element_at("pages", -1)["page_no"].alias("n"), (F.col("first.token_count") > F.col("limit")).alias("hollow"),
                         F.posexplode(F.concat(F.array("first.page_no"), "starts")).alias("group_no", "first_page"))
    empty = F.col("hollow") & (F.col("group_no") == 0)
    placed = placed.withColumn("last_page", F.coalesce(F.get("starts", F.col("group_no")), F.col("n")))
    if drop_empty:
        return placed.where(~empty).select("doc_id", "group_no", "first_page", "last_page")
    return placed.select("doc_id", "group_no", *[F.when(~empty, F.col(c)).alias(c) for c in ("first_page", "last_page")])
