"""What a plan has to decide about texts: by rules that are columns, or by a model.

``Rules`` answers with columns.  ``Model`` asks a backend of ``reasoner`` instead: a prompt is an instruction and a JSON payload,
equal prompts are asked once, and a reply that can't be read, or that failed, counts as the operation's default.  Both give the same
tables, so every plan takes either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pages as P
from ..operators import retrieval, toc, verify
from . import reasoner
from .lineage import cut

ITEMS = "array<struct<structure:string,title:string,page:int,physical_index:string>>"


def contents_flag(text: Column) -> Column:
    """"yes" for a page of which three lines or more end in a number behind a title, or one says "contents"."""
    lines = F.split(text, "\n")
    entries = F.size(F.filter(lines, lambda x: x.rlike(r"\S(?:\.{3,}|\s)\s*\d+\s*$")))
    named = F.exists(lines, lambda x: F.lower(X.strip(x)).isin("contents", "table of contents"))
    return F.when((entries >= 3) | named, "yes").otherwise("no")


def first_sentence(text: Column, words: int | None = 30) -> Column:
    """The first sentence of a text, at most ``words`` terms of it (null: all); null for blank text."""
    first = F.regexp_extract(text, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1)
    terms = F.filter(F.split(F.when(first == "", text).otherwise(first), r"\s+"), lambda w: w != "")
    return F.when(F.length(X.strip(text)) > 0, F.array_join(terms if words is None else F.slice(terms, 1, words), " "))


class Rules:
    """Decisions as columns and joins."""

    def contents_flags(self, pages: DataFrame) -> DataFrame:
        """(doc_id, page_no, toc_detected): whether a page is one of a table of contents."""
        return pages.select("doc_id", "page_no", contents_flag(F.col("text")).alias("toc_detected"))

    def page_numbers_given(self, found: DataFrame) -> DataFrame:
        """found (.., toc_content) with page_index_given as toc.content has it."""
        return found

    def items(self, contents: DataFrame) -> DataFrame:
        """(doc_id, item_no, structure, title, page) of tables of contents (doc_id, toc_content)."""
        return toc.parse_lines(contents)

    def headings(self, pages: DataFrame) -> DataFrame:
        """(doc_id, item_no, structure, title, physical_index) of pages without a table of contents: a page that begins with a
        heading-like line (2 to 12 terms, at most 80 code points, no final stop) starts a section."""
        title = X.strip(F.get(F.split("text", "\n"), F.lit(0)))
        rows = pages.select("doc_id", "page_no", title.alias("title")).where((F.length("title") <= 80) & X.token_count(F.col("title")).between(2, 12) & ~F.col("title").rlike(r"[.!?;,]$"))
        order = Window.partitionBy("doc_id").orderBy("page_no")
        return rows.select("doc_id", F.row_number().over(order).alias("item_no"), F.row_number().over(order).cast("string").alias("structure"), "title", F.col("page_no").alias("physical_index"))

    def checked(self, items: DataFrame, pages: DataFrame, at_start: bool = False) -> DataFrame:
        """items with ``answer``: whether the title is on its page, or begins it."""
        return verify.checked(items, pages, at_start)

    def located(self, asked: DataFrame, pages: DataFrame) -> DataFrame:
        """(doc_id, item_no, found_index) of titles sought on the pages from prev_index to next_index."""
        return toc.located(asked, pages)

    def summaries(self, texts: DataFrame, words: int | None = 30) -> DataFrame:
        """texts (.., text) with ``summary``."""
        return texts.withColumn("summary", first_sentence(F.col("text"), words))

    def descriptions(self, rows: DataFrame) -> DataFrame:
        """(doc_id, doc_description) of section rows: the titles of the roots."""
        return rows.where("depth = 0").groupBy("doc_id").agg(P.ordered_text("seq", "title", "; ").alias("doc_description"))

    def select_sections(self, questions: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
        """(question_id, doc_id, rank, title) of the sections to read for a question."""
        return retrieval.select_sections(questions, sections, k)

    def answers(self, contexts: DataFrame, questions: DataFrame) -> DataFrame:
        """(question_id, answer, sources)."""
        return retrieval.answers(contexts, questions)


class Model(Rules):
    """Decisions by a model.  ``budget`` is the number of tokens of a group of pages that one prompt holds, ``rounds`` how often a
    reply that was cut is asked to go on."""

    def __init__(self, backend: reasoner.Backend, cache: DataFrame | None = None, tasks: int = 8, budget: int = 20_000, rounds: int = 5):
        self.backend, self.cache, self.tasks, self.budget, self.rounds = backend, cache, tasks, budget, rounds

    def ask(self, rows: DataFrame, op: str, instruction: str, **payload: Column) -> DataFrame:
        """rows with ``reply``, null where there is none.  A reply that was cut at its length goes on from its last whole object, and
        what follows is put behind it; rows that still aren't whole after ``rounds`` keep what they have."""
        names = rows.columns
        body = F.concat(F.lit(instruction + "\n"), F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()])))
        rows = cut(rows.withColumn("op", F.lit(op)).withColumn("prompt", body).withColumn("row", F.monotonically_increasing_id()), "prompts")
        found = reasoner.complete(rows.select("row", "op", "prompt"), self.backend, self.cache, self.tasks)
        found = cut(found.select("row", "prompt", F.col("content").alias("reply"), "finish_reason"), "replies")
        for _ in range(self.rounds):
            open_ = found.where("finish_reason = 'max_output_reached'")
            if open_.isEmpty():
                break
            kept = X.continued(F.col("reply"))
            kept = F.when(kept == "", F.col("reply")).otherwise(kept)
            more = open_.select("row", F.col("prompt").alias("first"), kept.alias("kept"), F.lit(op).alias("op"), F.concat("prompt", F.lit("\nGo on from here, without repeating it:\n"), kept).alias("prompt"))
            more = reasoner.complete(more, self.backend, self.cache, self.tasks)
            more = more.select("row", F.col("first").alias("prompt"), F.concat("kept", F.coalesce("content", F.lit(""))).alias("reply"), F.coalesce("finish_reason", F.lit("error")).alias("finish_reason"))
            found = cut(found.where("NOT (finish_reason <=> 'max_output_reached')").unionByName(more), "replies")
        return rows.join(found.select("row", "reply"), "row", "left").select(*names, "reply")

    def _yes(self, rows: DataFrame, op: str, instruction: str, column: str, **payload: Column) -> DataFrame:
        found = self.ask(rows, op, instruction + ' Reply with {"answer": "yes"} or {"answer": "no"}.', **payload)
        said = F.lower(X.json_field(X.extract_json(F.col("reply")), "answer", "no"))
        return found.withColumn(column, F.when(said == "yes", "yes").otherwise("no")).drop("reply")

    def contents_flags(self, pages: DataFrame) -> DataFrame:
        rows = pages.select("doc_id", "page_no", "text")
        return self._yes(rows, "contents_page", "Is this page part of a table of contents? Abstracts, lists of figures and of symbols are none.", "toc_detected", text=F.col("text")).drop("text")

    def page_numbers_given(self, found: DataFrame) -> DataFrame:
        return self._yes(found.drop("page_index_given"), "page_numbers", "Does this table of contents give page numbers?", "page_index_given", contents=F.col("toc_content"))

    def _rows(self, found: DataFrame, *more: str) -> DataFrame:
        """The items of replies that are JSON arrays, in order; other replies have none."""
        rows = found.withColumn("array", X.strip_fence(F.col("reply"))).where(F.ltrim("array").startswith("["))
        return rows.select("doc_id", *more, F.posexplode(F.from_json("array", ITEMS)).alias("pos", "x")).where("x.title IS NOT NULL")

    def items(self, contents: DataFrame) -> DataFrame:
        instruction = "Give the entries of this table of contents, in order, as a JSON array of objects with structure (such as 1.2, or null), title and page (or null)."
        found = self.ask(contents.select("doc_id", "toc_content"), "items", instruction, contents=F.col("toc_content"))
        # A table that isn't whole is asked for once more, with what there is.
        listed = found.where("reply IS NOT NULL").withColumnRenamed("reply", "entries")
        missing = self._yes(listed, "items_whole", "Are all entries of the table of contents in the list?", "whole", contents=F.col("toc_content"), entries=F.col("entries")).where("whole = 'no'")
        more = self.ask(missing, "items_more", instruction + " Give only those that the list doesn't have.", contents=F.col("toc_content"), entries=F.col("entries"))
        rows = self._rows(found).withColumn("part", F.lit(0)).unionByName(self._rows(more).withColumn("part", F.lit(1)))
        order = Window.partitionBy("doc_id").orderBy("part", "pos")
        return rows.select("doc_id", F.row_number().over(order).alias("item_no"), "x.structure", "x.title", "x.page")

    def headings(self, pages: DataFrame) -> DataFrame:
        """Sections found group of pages by group, each prompt with the sections found before it; a round a group, over all documents."""
        groups = P.groups(pages, self.budget)
        texts = P.in_range(groups, pages.select("doc_id", "page_no", X.tagged(F.col("page_no"), F.col("text")).alias("text")), "first_page", "last_page")
        texts = cut(texts.groupBy("doc_id", "group_no").agg(P.ordered_text().alias("text")), "groups")
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no")) - 1
        texts = cut(texts.withColumn("turn", order), "groups")
        instruction = "Give the sections that start on these pages, in order, as a JSON array of objects with structure (such as 1.2), title (as it stands on the page) and physical_index (the tag of its page). Go on from the sections before."
        found, turn = None, 0
        while not (own := texts.where(F.col("turn") == turn)).isEmpty():
            before = F.lit(None).cast("string")
            if found is not None:
                known = found.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "pos", "structure", "title")))).alias("before"))
                own, before = own.join(known, "doc_id", "left"), F.col("before")
            replies = self.ask(own, "sections", instruction, pages=F.col("text"), before=before)
            new = self._rows(replies).select("doc_id", F.lit(turn).alias("turn"), "pos", "x.structure", "x.title", X.parse_physical_index(F.col("x.physical_index")).alias("physical_index"))
            found = cut(new if found is None else found.unionByName(new), "sections")
            turn += 1
        if found is None:
            return Rules.headings(self, pages.limit(0))
        # The page that two groups share may give a section twice.
        once = found.groupBy("doc_id", "title", "physical_index").agg(F.min(F.struct("turn", "pos", "structure")).alias("x")).where("physical_index IS NOT NULL")
        order = Window.partitionBy("doc_id").orderBy("x.turn", "x.pos")
        return once.select("doc_id", F.row_number().over(order).alias("item_no"), "x.structure", "title", "physical_index")

    def checked(self, items: DataFrame, pages: DataFrame, at_start: bool = False) -> DataFrame:
        at = pages.select("doc_id", F.col("page_no").alias("physical_index"), F.col("text").alias("page_text"))
        rows = items.join(at, ["doc_id", "physical_index"], "left").select(*items.columns, "page_text")
        known = cut(rows, "titles")
        where = "begin this page" if at_start else "start on this page or stand on it"
        asked = self._yes(known.where("page_text IS NOT NULL"), "title_begins" if at_start else "title_on_page", f"Does a section of this title {where}? White space may differ.", "answer", title=F.col("title"), page=F.col("page_text"))
        return asked.unionByName(known.where("page_text IS NULL").withColumn("answer", F.lit("no"))).select(*items.columns, "answer")

    def located(self, asked: DataFrame, pages: DataFrame) -> DataFrame:
        texts = pages.select("doc_id", "page_no", X.tagged(F.col("page_no"), F.col("text")).alias("text"))
        rows = P.in_range(asked.select("doc_id", "item_no", "title", "prev_index", "next_index"), texts, "prev_index", "next_index")
        rows = rows.groupBy("doc_id", "item_no", "title").agg(P.ordered_text().alias("text"))
        found = self.ask(rows, "find_title", 'On which page does the section of this title start? Reply with {"physical_index": its tag} or {"physical_index": null}.', title=F.col("title"), pages=F.col("text"))
        index = X.parse_physical_index(F.try_variant_get(X.extract_json(F.col("reply")), "$.physical_index", "string"))
        return found.select("doc_id", "item_no", index.alias("found_index")).where("found_index IS NOT NULL")

    def summaries(self, texts: DataFrame, words: int | None = 30) -> DataFrame:
        named = texts.withColumn("asked_text", F.nullif(X.strip(F.col("text")), F.lit("")))
        found = self.ask(named.where("asked_text IS NOT NULL"), "summary", "Say in a few sentences what this part of a document is about. Reply with the summary alone.", text=F.col("text"))
        rest = named.where("asked_text IS NULL").withColumn("summary", F.lit(None).cast("string"))
        return found.withColumnRenamed("reply", "summary").unionByName(rest).drop("asked_text")

    def descriptions(self, rows: DataFrame) -> DataFrame:
        node = F.struct("seq", "title", *[c for c in ("summary",) if c in rows.columns])
        found = rows.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(node))).alias("sections"))
        found = self.ask(found, "description", "Describe this document in one sentence, so that it can be told from others. Reply with the sentence alone.", sections=F.col("sections"))
        return found.select("doc_id", F.col("reply").alias("doc_description"))

    def select_sections(self, questions: DataFrame, sections: DataFrame, k: int = 3) -> DataFrame:
        from ..operators import tree

        rows = questions.join(tree.outline(sections), "doc_id")
        found = self.ask(rows, "select", f"Which sections of this outline answer the question? Reply with a JSON array of at most {k} titles, the best first.", question=F.col("question"), outline=F.col("outline"))
        titles = found.select("question_id", "doc_id", F.posexplode(X.string_array(F.col("reply"))).alias("pos", "title"))
        return titles.where(F.col("pos") < k).select("question_id", "doc_id", (F.col("pos") + 1).alias("rank"), "title")

    def answers(self, contexts: DataFrame, questions: DataFrame) -> DataFrame:
        rows = contexts.join(questions.select("question_id", "question"), "question_id")
        found = self.ask(rows, "answer", "Answer the question from this context alone, and say so if it doesn't hold the answer.", question=F.col("question"), context=F.col("context"))
        return found.select("question_id", F.col("reply").alias("answer"), "sources")
