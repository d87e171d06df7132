"""From pages to a section index, over all documents at once.

What has to be decided about texts is up to ``rules``: columns by default, a model if given one.  What depends on a check's outcome is
a bounded loop over the documents that are still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pages as P
from ..operators import toc, tree, verify
from .lineage import cut
from .rules import Rules

RULES = Rules()
ITEM = ("doc_id", "item_no", "structure", "title", "physical_index")


def started(items: DataFrame, pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Items with ``appear_start``: whether the title begins its page."""
    return rules.checked(items, pages, at_start=True).withColumnRenamed("answer", "appear_start")


def sections(items: DataFrame, pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The section tree of items (doc_id, item_no, structure, title, physical_index): validated, with a preface, start and end
    pages, parents, depths and ids in pre-order."""
    counts = P.page_count(pages)
    rows = verify.with_index(verify.truncated(items.select(*ITEM), counts))
    rows = tree.with_preface(rows)
    rows = tree.end_pages(started(rows, pages, rules), counts)
    return tree.preorder(tree.paths(tree.code_parents(rows)))


def whole_documents(pages: DataFrame, terms: int | None = 12) -> DataFrame:
    """One item for each document, titled by the first ``terms`` terms (null: all) of its first page that has text."""
    first = pages.where(F.length(X.strip(F.col("text"))) > 0).groupBy("doc_id").agg(F.min_by("text", "page_no").alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    words = words if terms is None else F.slice(words, 1, terms)
    return first.select("doc_id", F.lit(1).alias("item_no"), F.lit("1").alias("structure"), F.array_join(words, " ").alias("title"), F.lit(1).alias("physical_index"))


def detected(pages: DataFrame, limit: int, rules: Rules = RULES) -> DataFrame:
    """(doc_id, page_no, toc_detected) of the pages up to limit and, of documents in which a run is open there, of as many more (twice
    as many each time) as it takes until none is open: a run has no longest length."""
    flags = rules.contents_flags
    found = cut(flags(pages.where(F.col("page_no") <= limit)), "flags")
    last, ask = limit, limit
    while True:
        running = found.where((F.col("page_no") == last) & (F.col("toc_detected") == "yes")).select("doc_id")
        more = pages.where((F.col("page_no") > last) & (F.col("page_no") <= last + ask)).join(running, "doc_id", "left_semi")
        more = cut(flags(more), "flags")
        if more.isEmpty():
            return found
        found, last, ask = found.unionByName(more), last + ask, 2 * ask


def contents_items(pages: DataFrame, limit: int = 20, rules: Rules = RULES) -> DataFrame:
    """Items by printed page numbers, for documents whose contents give them: the table is parsed, titles are sought on the pages
    behind it, the most common offset places the rest, and what is left is sought between its neighbours."""
    runs = rules.page_numbers_given(toc.content(toc.runs(detected(pages, limit, rules), limit), pages))
    chosen = cut(toc.chosen_run(runs).where("page_index_given = 'yes'"), "contents")
    items = cut(rules.items(chosen.select("doc_id", "toc_content")), "items")
    after = chosen.select("doc_id", (F.col("last_page") + 1).alias("prev_index"), (F.col("last_page") + limit).alias("next_index"))
    found = rules.located(items.join(after, "doc_id"), pages)
    physical = items.join(found, ["doc_id", "item_no"]).withColumnRenamed("found_index", "physical_index")
    offsets = toc.page_offset(toc.title_pairs(items, physical))
    placed = toc.add_offset(items.withColumn("physical_index", F.lit(None).cast("int")), offsets)
    return toc.fill_gaps(placed, pages, P.page_count(pages), rules.located).select(*ITEM)


def contents_without_pages(pages: DataFrame, limit: int = 20, rules: Rules = RULES) -> DataFrame:
    """Items of a table of contents, each sought on all pages behind it."""
    chosen = cut(toc.chosen_run(rules.page_numbers_given(toc.content(toc.runs(detected(pages, limit, rules), limit), pages))), "contents")
    items = cut(rules.items(chosen.select("doc_id", "toc_content")), "items")
    behind = chosen.join(P.page_count(pages), "doc_id").select("doc_id", (F.col("last_page") + 1).alias("prev_index"), F.col("n_pages").alias("next_index"))
    found = rules.located(items.join(behind, "doc_id"), pages)
    return items.join(found, ["doc_id", "item_no"], "left").select("doc_id", "item_no", "structure", "title", F.col("found_index").alias("physical_index"))


def settled(pages: DataFrame, limit: int = 20, threshold: float = verify.THRESHOLD, rules: Rules = RULES) -> DataFrame:
    """The items of each document by the strongest way that passes its check: printed pages, contents, headings.

    Ways are tried in turn on the documents still open; those between the threshold and all correct are repaired.  The last
    way's result is taken as it is."""
    counts = cut(P.page_count(pages), "counts")
    done, open_pages = None, pages
    for way in (contents_items, contents_without_pages, None):
        if way is None:
            items = cut(rules.headings(open_pages), "headings")
            items = items.unionByName(whole_documents(open_pages.join(items.select("doc_id").distinct(), "doc_id", "left_anti")))
            return items if done is None else done.unionByName(items)
        items = cut(verify.with_index(verify.truncated(way(open_pages, limit, rules), counts)), "items")
        found = verify.decisions(verify.accuracy(rules.checked(items, open_pages), counts), threshold).where("decision <> 'fall back'")
        found = cut(found, "settled")
        kept = items.join(found.select("doc_id"), "doc_id", "left_semi")
        kept = cut(verify.repaired(kept, open_pages, counts, checked=rules.checked, located=rules.located), "items")
        done = kept if done is None else done.unionByName(kept)
        open_pages = open_pages.join(found.select("doc_id"), "doc_id", "left_anti")


def large(rows: DataFrame, pages: DataFrame, max_pages: int = 10, max_tokens: int = 20_000) -> DataFrame:
    """Sections that span more than max_pages and have max_tokens or more."""
    counted = P.section_tokens(rows, pages)
    return counted.where((F.col("end_index") - F.col("start_index") > max_pages) & (F.col("tokens") >= max_tokens))


def split_items(rows: DataFrame, pages: DataFrame, max_pages: int, max_tokens: int, rules: Rules = RULES) -> DataFrame:
    """(doc_id, item_no, sub_no, title, physical_index): the sections that each large leaf falls into, by headings of its pages; a
    first one of the same title as the leaf is left out."""
    big = large(tree.leaves(rows), pages, max_pages, max_tokens).select("doc_id", F.col("item_no").alias("of"), F.col("title").alias("of_title"), "start_index", "end_index")
    inside = P.in_range(big.select("doc_id", "start_index", "end_index"), pages, "start_index", "end_index").select(*pages.columns).distinct()
    heads = rules.headings(cut(inside, "large")).select("doc_id", "title", "physical_index")
    found = P.in_range(big, heads.withColumnRenamed("physical_index", "page_no"), "start_index", "end_index").withColumnRenamed("page_no", "physical_index")
    sub = F.row_number().over(Window.partitionBy("doc_id", "of").orderBy("physical_index"))
    found = found.withColumn("sub_no", sub)
    same = (F.col("sub_no") == 1) & (X.strip(F.col("title")) == X.strip(F.col("of_title")))
    return found.where(~same).select("doc_id", F.col("of").alias("item_no"), "sub_no", "title", "physical_index")


def split_large(items: DataFrame, pages: DataFrame, max_pages: int = 10, max_tokens: int = 20_000, max_depth: int = 5, rules: Rules = RULES) -> DataFrame:
    """Items with those of large leaves put in, level by level, until none is large, none splits, or max_depth is reached."""
    for _ in range(max_depth):
        rows = cut(sections(items, pages, rules), "sections")
        more = cut(split_items(rows, pages, max_pages, max_tokens, rules), "split")
        if more.isEmpty():
            break
        codes = items.select("doc_id", "item_no", "structure")
        more = more.join(codes, ["doc_id", "item_no"]).select("doc_id", "item_no", "sub_no", F.concat_ws(".", "structure", F.col("sub_no").cast("string")).alias("structure"), "title", "physical_index")
        both = items.select("doc_id", "item_no", F.lit(0).alias("sub_no"), "structure", "title", "physical_index").unionByName(more)
        order = Window.partitionBy("doc_id").orderBy("item_no", "sub_no")
        items = cut(both.withColumn("item_no", F.row_number().over(order)).select(*ITEM), "items")
    return items


def summaries(texts: DataFrame, words: int | None = 30) -> DataFrame:
    """Texts (.., text) with ``summary``: the first sentence, at most ``words`` terms of it (null: all); null for blank text."""
    return RULES.summaries(texts, words)


def descriptions(rows: DataFrame) -> DataFrame:
    """(doc_id, doc_description): the titles of the roots."""
    return RULES.descriptions(rows)


def build_index(pages: DataFrame, max_pages: int = 10, max_tokens: int = 20_000, with_text: bool = False, with_summary: bool = True, with_description: bool = False,
                with_id: bool = True, check_pages: int = 20, rules: Rules = RULES) -> DataFrame:
    """(doc_id, doc_description, structure_json) of every document of pages."""
    pages = cut(pages, "pages")
    items = split_large(cut(settled(pages, check_pages, rules=rules), "items"), pages, max_pages, max_tokens, rules=rules)
    rows = cut(sections(items, pages, rules), "sections")
    fields = ["title", "start_index", "end_index", *["node_id"] * with_id]
    if with_text or with_summary:
        texts = P.section_text(rows, pages)
        rows = cut(rows.join(rules.summaries(texts) if with_summary else texts, ["doc_id", "item_no"], "left"), "sections")
        fields += ["summary"] * with_summary + ["text"] * with_text
    found = tree.nested_json(rows, fields)
    if with_summary and with_description:
        return found.join(rules.descriptions(rows), "doc_id", "left")
    return found.withColumn("doc_description", F.lit(None).cast("string"))


def build_markdown_index(files: DataFrame, thinning: int | None = None, with_text: bool = False, with_id: bool = True, with_summary: bool = False, short: int = 200,
                         with_description: bool = False, rules: Rules = RULES) -> DataFrame:
    """(doc_id, structure_json) of Markdown files (doc_id, text), and doc_description if asked for.  Nodes of fewer than ``short``
    tokens are their own summary; a leaf has ``summary``, another node ``prefix_summary``."""
    from ..operators import markdown as M

    nodes = M.sections(M.lines(files))
    if thinning is not None:
        nodes = M.thinned(M.subtree_tokens(nodes), thinning)
        order = Window.partitionBy("doc_id").orderBy("line_no")
        nodes = nodes.withColumn("seq", F.row_number().over(order))
    nodes = cut(nodes, "nodes")
    rows = M.tree(nodes).select("doc_id", F.col("seq").alias("item_no"), F.col("parent_seq").alias("parent_item"), "depth", (F.col("seq") - 1).alias("seq"), "title", F.col("line_no").alias("line_num"), "text")
    rows = cut(rows.withColumn("node_id", X.node_id(F.col("seq"))), "nodes")
    fields = ["title", *["node_id"] * with_id, "line_num"]
    if with_summary:
        keys = M.summary_keys(nodes, short).select("doc_id", F.col("seq").alias("item_no"), "is_leaf", "ask", F.coalesce("summary", "prefix_summary").alias("own"))
        asked = rules.summaries(rows.join(keys.where("ask"), ["doc_id", "item_no"], "left_semi").select("doc_id", "item_no", "text")).drop("text")
        rows = rows.join(keys, ["doc_id", "item_no"], "left").join(asked, ["doc_id", "item_no"], "left")
        said = F.when(F.col("ask"), F.col("summary")).otherwise(F.col("own"))
        rows = rows.withColumns({"summary": F.when(F.col("is_leaf"), said), "prefix_summary": F.when(~F.col("is_leaf"), said)})
        rows = cut(rows, "nodes")
        fields += ["summary", "prefix_summary"]
    found = tree.nested_json(rows, [*fields, *["text"] * with_text])
    return found.join(rules.descriptions(rows), "doc_id", "left") if with_description else found
