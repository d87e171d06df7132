"""Queries of the engine's own operators over the given tables; ``oracle`` has the DuckDB SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import text as X
from .operators import markdown as M
from .operators import pages as P
from .operators import retrieval as R
from .operators import toc, tree, verify
from .plans import fixtures as FX
from .plans import index as I
from .plans import lineage
from .sources import catalog, store
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries; the budgets suit the short pages of the given tables.
LIMIT, BUDGET, THIN, SHORT, LOCATED = 20, 120, 40, 30, 20

_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return M.sections(FX.md_lines(s, d))


def _answers(s: SparkSession, d: str) -> DataFrame:
    return verify.checked(FX.toc_items(s, d), FX.doc_pages(s, d))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return P.page_count(FX.doc_pages(s, d))


def _codes(s: SparkSession, d: str) -> DataFrame:
    return tree.preorder(tree.paths(tree.code_parents(FX.toc_codes(s, d))))


def _sections(s: SparkSession, d: str) -> DataFrame:
    return I.sections(FX.toc_items(s, d), FX.doc_pages(s, d))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    items = FX.toc_items(s, d)
    return toc.title_pairs(items, items.where(F.col("true_page") <= LOCATED))


# Pages

@query
def page_scan(s, d):
    return FX.doc_pages(s, d)


@query
def page_count(s, d):
    return _counts(s, d)


@query
def page_encoded_tokens(s, d):
    import public_tokenizers

    counted = P.with_token_counts(FX.doc_pages(s, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "page_no", "token_count")


@query
def doc_token_total(s, d):
    return P.token_total(FX.doc_pages(s, d))


@query
def page_range_text(s, d):
    return P.range_text(FX.doc_pages(s, d), 2, 4)


@query
def tagged_pages(s, d):
    return P.tagged_pages(FX.doc_pages(s, d))


@query
def page_groups(s, d):
    return P.groups(FX.doc_pages(s, d), BUDGET)


@query
def page_group_text_stats(s, d):
    pages = FX.doc_pages(s, d)
    rows = P.in_range(P.groups(pages, BUDGET), pages, "first_page", "last_page")
    return rows.groupBy("doc_id", "group_no").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.sum(F.length("text")).alias("chars"))


@query
def line_classes(s, d):
    rows = FX.doc_pages(s, d)
    return rows.select("doc_id", "page_no", X.log_class(F.col("text")).alias("class"), X.shortened(F.col("text"), 20).alias("short"))


# Markdown

@query
def md_headings(s, d):
    return M.headings(FX.md_lines(s, d))


@query
def md_section_slices(s, d):
    return _nodes(s, d)


@query
def md_section_tree(s, d):
    return M.tree(M.headings(FX.md_lines(s, d))).withColumn("node_id", X.node_id(F.col("seq") - 1))


@query
def md_parent_lookup(s, d):
    return M.tree(M.headings(FX.md_lines(s, d))).select("doc_id", "seq", "parent_seq")


@query
def md_subtree_interval(s, d):
    return M.subtree_end(M.headings(FX.md_lines(s, d))).select("doc_id", "seq", "level", "subtree_end")


@query
def md_subtree_tokens(s, d):
    return M.subtree_tokens(_nodes(s, d)).select("doc_id", "seq", "level", "subtree_end", "text_token_count")


@query
def md_thinning(s, d):
    rows = M.subtree_tokens(_nodes(s, d))
    kept = M.thinned(rows, THIN).select("doc_id", "seq", "level", "title", "text")
    return kept.join(rows.select("doc_id", "seq", "text_token_count"), ["doc_id", "seq"])


@query
def md_leaf_summary_key(s, d):
    return M.summary_keys(_nodes(s, d), SHORT).select("doc_id", "seq", "is_leaf", "summary", "prefix_summary", "ask")


# Trees by code

@query
def code_parent_join(s, d):
    return tree.code_parents(FX.toc_codes(s, d)).select("doc_id", "item_no", "structure", "parent_item")


@query
def code_tree(s, d):
    return _codes(s, d).select("doc_id", "item_no", "structure", "title", "parent_item", "depth", "path")


@query
def code_tree_depths(s, d):
    return _codes(s, d).groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@query
def code_preorder_ids(s, d):
    return _codes(s, d).select("doc_id", "item_no", "seq", "node_id")


@query
def code_subtree_counts(s, d):
    return tree.subtree_counts(_codes(s, d))


@query
def code_leaves(s, d):
    return tree.leaves(_codes(s, d)).select("doc_id", "item_no")


@query
def code_outline(s, d):
    return tree.outline(_codes(s, d))


@query
def nested_json(s, d):
    return tree.nested_json(_codes(s, d), ["title", "node_id"])


# Tables of contents

@query
def toc_first_run(s, d):
    return toc.first_run(FX.toc_flags(s, d), LIMIT)


@query
def toc_run_choice(s, d):
    return toc.chosen_run(toc.content(toc.runs(FX.toc_flags(s, d), LIMIT), FX.doc_pages(s, d))).select("doc_id", "first_page", "last_page", "page_index_given")


@query
def title_pairs(s, d):
    return _pairs(s, d)


@query
def page_offset(s, d):
    return toc.page_offset(_pairs(s, d))


@query
def add_offset(s, d):
    return toc.add_offset(FX.toc_items(s, d), toc.page_offset(_pairs(s, d))).select("doc_id", "item_no", "title", "page", "physical_index")


@query
def gap_neighbours(s, d):
    return toc.gap_neighbours(FX.toc_items(s, d), _counts(s, d)).select("doc_id", "item_no", "prev_index", "next_index")


@query
def gap_pages(s, d):
    return toc.gap_pages(FX.toc_items(s, d), FX.doc_pages(s, d), _counts(s, d))


@query
def filled_gaps(s, d):
    return toc.fill_gaps(FX.toc_items(s, d), FX.doc_pages(s, d), _counts(s, d)).select("doc_id", "item_no", "title", "physical_index")


@query
def items_in_pages(s, d):
    return toc.in_pages(FX.toc_items(s, d), 2, 9).select("doc_id", "item_no", "title", "physical_index")


# Checks and repairs

@query
def sampled_items(s, d):
    return verify.sampled(FX.toc_items(s, d), 2).select("doc_id", "item_no", "title")


@query
def repaired_items(s, d):
    items = verify.with_index(verify.truncated(FX.toc_items(s, d), _counts(s, d)))
    return verify.repaired(items, FX.doc_pages(s, d), _counts(s, d), 1).select("doc_id", "item_no", "title", "physical_index")


@query
def validate_truncate(s, d):
    return verify.truncated(FX.toc_items(s, d), _counts(s, d)).select("doc_id", "item_no", "title", "physical_index")


@query
def drop_null_index(s, d):
    return verify.with_index(FX.toc_items(s, d)).select("doc_id", "item_no", "title", "physical_index")


@query
def title_check(s, d):
    return _answers(s, d).select("doc_id", "item_no", "answer")


@query
def title_start_check(s, d):
    return I.started(FX.toc_items(s, d), FX.doc_pages(s, d)).select("doc_id", "item_no", "appear_start")


@query
def verify_accuracy(s, d):
    return verify.accuracy(_answers(s, d), _counts(s, d))


@query
def incorrect_items(s, d):
    return verify.incorrect(_answers(s, d)).select("doc_id", "item_no", "title", "physical_index")


@query
def correct_neighbours(s, d):
    return verify.repair_ranges(_answers(s, d), _counts(s, d)).select("doc_id", "item_no", "prev_index", "next_index")


@query
def fix_incorrect(s, d):
    return verify.fixes(_answers(s, d), FX.doc_pages(s, d), _counts(s, d))


@query
def fix_apply(s, d):
    return verify.apply_fixes(FX.toc_items(s, d), fix_incorrect(s, d)).select("doc_id", "item_no", "title", "physical_index")


@query
def mode_decision(s, d):
    return verify.decisions(verify_accuracy(s, d))


# The section index

@query
def preface_row(s, d):
    items = FX.toc_items(s, d).select(*I.ITEM)
    return tree.with_preface(verify.with_index(verify.truncated(items, _counts(s, d))))


@query
def end_index(s, d):
    return _sections(s, d).select("doc_id", "item_no", "start_index", "end_index")


@query
def section_index(s, d):
    return _sections(s, d).select("doc_id", "item_no", "structure", "title", "start_index", "end_index", "parent_item", "depth", "seq", "node_id")


@query
def section_text(s, d):
    return P.section_text(_sections(s, d), FX.doc_pages(s, d))


@query
def text_removed(s, d):
    rows = _sections(s, d).select("doc_id", "item_no", "title", "node_id")
    return tree.without_text(rows.join(P.section_text(_sections(s, d), FX.doc_pages(s, d)), ["doc_id", "item_no"], "left"))


@query
def section_tokens(s, d):
    return P.section_tokens(_sections(s, d), FX.doc_pages(s, d)).select("doc_id", "item_no", "start_index", "end_index", "tokens")


@query
def large_nodes(s, d):
    return I.large(_sections(s, d), FX.doc_pages(s, d), 1, 60).select("doc_id", "item_no", "tokens")


@query
def head_removal(s, d):
    items = FX.toc_items(s, d).select("doc_id", "item_no", "title")
    titles = FX.doc_pages(s, d).where("page_no = 1").select("doc_id", F.substring("text", 1, 40).alias("title"))
    return tree.without_repeated_head(items, titles)


@query
def outline_text(s, d):
    return tree.outline(_sections(s, d))


@query
def doc_description(s, d):
    return I.descriptions(_sections(s, d))


@query
def first_sentence_summary(s, d):
    return I.summaries(FX.doc_pages(s, d)).select("doc_id", "page_no", "summary")


@query
def document_index(s, d):
    return I.build_index(FX.doc_pages(s, d), with_summary=True, with_description=True)


@query
def markdown_index(s, d):
    files = FX.md_lines(s, d).groupBy("doc_id").agg(P.ordered_text("line_no", "line", "\n").alias("text"))
    return I.build_markdown_index(files, THIN)


@query
def html_outline(s, d):
    pages = FX.table(s, d, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"), (F.size(F.split("html", "<p>")) - 1).alias("n_p"))


# Questions

@query
def select_sections(s, d):
    return R.select_sections(FX.questions(s, d), _sections(s, d))


@query
def rag_context(s, d):
    questions, sections = FX.questions(s, d), lineage.cut(_sections(s, d), "sections")
    matched = R.match_sections(R.select_sections(questions, sections), sections)
    return R.contexts(matched, FX.doc_pages(s, d), questions, sections)


@query
def rag_answer(s, d):
    return R.answers(rag_context(s, d), FX.questions(s, d))


# Scalars

@query
def strip_fence(s, d):
    return FX.replies(s, d).select("item_id", X.strip_fence(F.col("reply")).alias("reply"))


@query
def json_default(s, d):
    return FX.replies(s, d).select("item_id", X.json_field(X.extract_json(F.col("reply")), "answer", "no").alias("answer"))


@query
def json_array_rows(s, d):
    item = "array<struct<structure:string,title:string,physical_index:string>>"
    # Spark reads an object as an array of one row, so what is no array goes first.
    rows = FX.replies(s, d).where(F.ltrim(X.strip_fence(F.col("reply"))).startswith("[")).select("item_id", F.explode(F.from_json(X.strip_fence(F.col("reply")), item)).alias("x"))
    return rows.select("item_id", "x.structure", "x.title", X.parse_physical_index(F.col("x.physical_index")).alias("physical_index"))


def _literals(s: SparkSession, d: str, values: list[str | None]) -> DataFrame:
    rows = s.createDataFrame([(v,) for v in values], "v string")
    return FX.table(s, d, "region").select("r_regionkey").crossJoin(F.broadcast(rows))


@query
def parse_physical_index(s, d):
    return _literals(s, d, ["<physical_index_5>", "physical_index_10", "physical_index_0", " 7 ", "invalid_format", None]).withColumn("n", X.parse_physical_index(F.col("v")))


@query
def to_int_default(s, d):
    return _literals(s, d, ["12", " 3 ", "x", "", None]).withColumn("n", X.to_int(F.col("v"), -1))


@query
def page_to_int(s, d):
    return _literals(s, d, ["12", " 3 ", "x", "", None]).withColumn("n", X.page_to_int(F.col("v")))


@query
def extract_json(s, d):
    parsed = X.extract_json(F.col("reply"))
    return FX.replies(s, d).select("item_id", X.json_field(parsed, "thinking", "-").alias("thinking"), F.try_variant_get(parsed, "$[0].title", "string").alias("title"), F.to_json(parsed).alias("json"))


@query
def string_arrays(s, d):
    reply = F.concat(F.lit('```json ["'), F.col("n_name"), F.lit('", "x"] ```'))
    return FX.table(s, d, "nation").select("n_nationkey", X.string_array(F.when(F.col("n_nationkey") % 2 == 0, reply).otherwise("n_name")).alias("titles"))


@query
def dot_leader(s, d):
    line = F.concat("p_name", F.lit(" ........ "), F.col("p_size").cast("string"), F.lit(". . . . . . 7"))
    return FX.table(s, d, "part").select("p_partkey", X.dot_leaders(line).alias("line"))


@query
def doc_key(s, d):
    suffix = F.expr("CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.markdown' ELSE '.PDF' END")
    return FX.table(s, d, "pages").select("page_id", X.doc_key(F.concat("url", suffix)).alias("doc_key"))


@query
def sanitize_ip(s, d):
    header = F.expr("concat('10.0.', user_id % 7, '.', user_id % 250, ', 192.168.0.1')")
    return FX.table(s, d, "events").select("event_id", X.client_of(header, F.lit("0.0.0.0")).alias("client"))


# Stores

def _indexed(s: SparkSession, d: str) -> DataFrame:
    return FX.table(s, d, "documents").selectExpr("doc_id", "source AS filename", "n_chars AS page_count")


@query
def index_upsert(s, d):
    rows = _indexed(s, d)
    old = rows.where("doc_id % 2 = 0").withColumn("version", F.lit("old"))
    return store.upserted(old, rows.where("doc_id % 3 = 0").withColumn("version", F.lit("new")), "doc_id")


@query
def index_lookup(s, d):
    return store.lookup(FX.table(s, d, "documents").select("doc_id", "source"), "source", "src3")


@query
def cache_anti_join(s, d):
    rows = FX.table(s, d, "documents").select("doc_id", "source")
    return store.not_indexed(rows, rows.where("doc_id % 2 = 0"), "doc_id")


@query
def index_listing(s, d):
    rows = FX.table(s, d, "documents").selectExpr("cast(doc_id AS string) AS doc_key", "CASE WHEN doc_id % 3 <> 0 THEN source END AS filename", "CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS page_count", "doc_id AS indexed_at")
    return store.listing(rows)


@query
def page_store(s, d):
    rows = store.stored_pages(store.page_store(FX.doc_pages(s, d)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def model_lookup(s, d):
    asked = catalog.models(s).select(F.col("id").alias("model")).unionByName(s.createDataFrame([("unknown",)], "model string"))
    requests = FX.table(s, d, "region").select("r_regionkey").crossJoin(F.broadcast(asked))  # a row a model of the catalogue
    return catalog.with_api_id(catalog.with_url(requests)).select("r_regionkey", "model", "api_id", "url")


@query
def audit_append(s, d):
    path = lineage.new_path(s, "audit")
    for run, messages in (("r1", ["started", "done"]), ("r2", ["started"]), ("r1", ["again"])):
        store.audit(s, path, run, messages)
    return s.read.parquet(path).select("run_id", F.col("seq").cast("int").alias("seq"), "message")


# Jobs and usage

def _uses(s: SparkSession, d: str) -> DataFrame:
    return FX.table(s, d, "events").select(F.col("user_id").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query
def usage_ttl(s, d):
    return jobs.usage(_uses(s, d)).select("client", "event_id", "uses")


@query
def usage_remaining(s, d):
    return jobs.remaining(jobs.usage(_uses(s, d)))


@query
def job_latest_status(s, d):
    return jobs.latest_status(FX.job_events(s, d))


@query
def job_event_order(s, d):
    return jobs.ordered_events(FX.job_events(s, d))


@query
def job_sessions(s, d):
    return jobs.sessions(FX.job_events(s, d), "1 hour").select("job_id", F.unix_micros("started").alias("started"), F.unix_micros("last").alias("last"), "events")


@query
def stream_progress(s, d):
    stream = FX.as_job_events(jobs.read_stream(s, f"{d}/events.parquet"))
    return jobs.run_to_end(jobs.progress_stream(stream), lineage.new_path(s, "progress"), "complete")


@query
def stream_usage(s, d):
    stream = jobs.read_stream(s, f"{d}/events.parquet").select(F.col("user_id").alias("client"), "event_id", "ts")
    return jobs.run_to_end(jobs.usage_stream(stream), lineage.new_path(s, "usage"), "append")


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
