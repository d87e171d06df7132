"""Questions over section indices: choosing sections, gathering their pages, answering.

Sections are rows (doc_id, seq, depth, title, start_index, end_index); questions rows (question_id, doc_id, question).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tree
from .pages import in_range, ordered_text


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def select_sections(questions: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, doc_id, rank, title): the k sections whose titles share most terms with the question, at least one; of
    equals the earlier."""
    asked = questions.select("question_id", "doc_id", F.explode(terms(F.col("question"))).alias("term"))
    named = sections.select("doc_id", "seq", "title", F.explode(terms(F.col("title"))).alias("term"))
    rows = asked.join(named, ["doc_id", "term"]).groupBy("question_id", "doc_id", "seq", "title").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("shared"), "seq"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "doc_id", "rank", "title")


def match_sections(selected: DataFrame, sections: DataFrame) -> DataFrame:
    """For each selected title the first section of its document with that title in any case, or that contains it."""
    s = sections.select("doc_id", "seq", F.col("title").alias("node_title"), "start_index", "end_index")
    rows = selected.join(s, "doc_id").where((F.lower("node_title") == F.lower("title")) | F.col("node_title").contains(F.col("title")))
    rows = rows.groupBy("question_id", "doc_id", "rank").agg(F.min_by(F.struct("seq", "node_title", "start_index", "end_index"), "seq").alias("x"))
    return rows.select("question_id", "doc_id", "rank", "x.*")


def contexts(matched: DataFrame, pages: DataFrame, questions: DataFrame, sections: DataFrame, extra_page: bool = False) -> DataFrame:
    """(question_id, context, sources): the pages of the matched sections under their titles; the outline where there is none.
    extra_page: also the page behind each section."""
    last = F.col("end_index") + (1 if extra_page else 0)
    m = matched.withColumn("start", F.coalesce("start_index", F.lit(0))).withColumn("end_index", F.coalesce("end_index", "start_index", F.lit(0)))
    m = m.withColumn("last", last)
    found = in_range(m.select("question_id", "rank", "doc_id", "start", "last"), pages.select("doc_id", "page_no", "text"), "start", "last").select("question_id", "rank", "page_no", "text")
    rows = m.select("question_id", "rank", "node_title").join(found, ["question_id", "rank"], "left")
    part = (
        rows.withColumn("line", F.when(F.col("page_no").isNotNull(), F.concat(F.col("text"), F.lit("\n"))))
        .groupBy("question_id", "rank", "node_title").agg(ordered_text("page_no", "line").alias("body"))
        .withColumn("part", F.concat(F.lit("=== "), F.col("node_title"), F.lit(" ===\n"), F.col("body"), F.lit("\n")))
    )
    found = part.groupBy("question_id").agg(ordered_text("rank", "part").alias("context"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_title"))), lambda x: x["node_title"]).alias("sources"))
    rest = questions.join(found.select("question_id"), "question_id", "left_anti").join(tree.outline(sections), "doc_id", "left")
    none = F.array().cast("array<string>")
    return found.unionByName(rest.select("question_id", F.coalesce("outline", F.lit("")).alias("context"), none.alias("sources")))


def answers(context: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, answer, sources): the first context line that shares most terms with its question."""
    lines = context.join(questions.select("question_id", "question"), "question_id").select("question_id", "question", "sources", F.posexplode(F.split("context", "\n")).alias("pos", "line"))
    lines = lines.where("line NOT LIKE '=== % ==='").withColumn("shared", F.size(F.array_intersect(terms(F.col("question")), terms(F.col("line")))))
    best = lines.groupBy("question_id").agg(F.min(F.struct((-F.col("shared")).alias("n"), "pos", "line", "sources")).alias("x"))
    return best.select("question_id", F.col("x.line").alias("answer"), F.col("x.sources").alias("sources"))
