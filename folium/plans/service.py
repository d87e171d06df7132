"""Jobs over an inbox: limits, cache, indexing, storing; and questions over what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import retrieval as R
from ..sources import store
from . import index as I
from .lineage import cut
from .rules import Rules


def index_jobs(uploads: DataFrame, pages: DataFrame, kept: store.IndexStore, free_pages: int | None = 50, rules: Rules = I.RULES) -> DataFrame:
    """(doc_key, status, error) of uploads (doc_key, doc_id): documents over the page limit fail, those in the store are taken from it,
    the rest are indexed all together and stored with their pages."""
    counts = P.page_count(pages)
    rows = uploads.join(counts, "doc_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    rows = cut(rows, "uploads")
    over = F.lit(False) if free_pages is None else F.col("n_pages") > free_pages
    known = kept.read()
    new = rows.where(~over)
    if known is not None:
        new = store.not_indexed(new, known)
    new = cut(new, "new")
    if not new.isEmpty():
        own = pages.join(new.select("doc_id"), "doc_id", "left_semi")
        found = I.build_index(own, rules=rules)
        made = new.join(found, "doc_id", "left").join(store.page_store(own), "doc_id", "left")
        kept.upsert(cut(made.select("doc_key", F.col("doc_key").alias("filename"), "doc_id", "structure_json", "pages_json", F.col("n_pages").alias("page_count"), F.current_timestamp().alias("indexed_at")), "indexed"))
    limit = F.concat(F.lit("more pages than the limit of "), F.lit(str(free_pages)))
    return rows.select("doc_key", F.when(over, "ERROR").otherwise("DONE").alias("status"), F.when(over, limit).alias("error"))


def sections_of(index: DataFrame) -> DataFrame:
    """The sections of stored indices as rows, in pre-order, from their nested JSON."""
    node = "struct<title:string,start_index:int,end_index:int,node_id:string,nodes:array<string>>"
    rows = index.select("doc_id", F.posexplode(F.from_json("structure_json", f"array<{node}>")).alias("pos", "n")).select("doc_id", F.array("pos").alias("path"), "n")
    found = rows
    while True:
        rows = cut(rows.where("n.nodes IS NOT NULL").select("doc_id", "path", F.posexplode("n.nodes").alias("pos", "text")).select("doc_id", F.concat("path", F.array("pos")).alias("path"), F.from_json("text", node).alias("n")), "level")
        if rows.isEmpty():
            break
        found = found.unionByName(rows)
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return found.select("doc_id", seq.alias("seq"), (F.size("path") - 1).alias("depth"), "n.title", "n.start_index", "n.end_index", "n.node_id")


def answer(questions: DataFrame, index: DataFrame, rules: Rules = I.RULES) -> DataFrame:
    """(question_id, answer, sources) of questions (question_id, doc_id, question) over stored indices."""
    sections, pages = cut(sections_of(index), "sections"), store.stored_pages(index)
    matched = R.match_sections(rules.select_sections(questions, sections), sections)
    return rules.answers(R.contexts(matched, pages, questions, sections), questions)
