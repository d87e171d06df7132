"""Inputs that the queries derive from the given tables: pages, Markdown lines, codes, contents items, flags, replies, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_lines(table(spark, sf_dir, "documents"))


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).selectExpr("doc_id", "page_no AS line_no", """
        CASE WHEN length(text) > 0 AND length(text) < 60 THEN repeat('#', cast(1 + length(text) % 4 AS int)) || ' ' || text
             WHEN length(text) >= 60 AND length(text) % 17 = 0 THEN '```' ELSE text END AS line""")  # fmt: skip


TOC_CODES = """
WITH n AS (SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) nr FROM nation),
y AS (
  SELECT r_regionkey doc_id, 0 n1, 0 n2, cast(r_regionkey + 1 AS varchar(20)) structure, r_name title FROM region
  UNION ALL
  SELECT n_regionkey, nr, 0, cast(n_regionkey + 1 AS varchar(20)) || '.' || cast(nr AS varchar(20)), n_name FROM n WHERE n_nationkey % 7 <> 0
  UNION ALL
  SELECT n_regionkey, nr, sr, cast(n_regionkey + 1 AS varchar(20)) || '.' || cast(nr AS varchar(20)) || '.' || cast(sr AS varchar(20)), s_name
  FROM (SELECT n.n_regionkey, n.nr, s_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) sr FROM supplier JOIN n ON s_nationkey = n_nationkey) z)
SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY n1, n2) AS int) item_no, structure, title FROM y
"""


def toc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {f"{{{t}}}": table(spark, sf_dir, t) for t in ("region", "nation", "supplier")}
    sql = TOC_CODES
    for t in ("nation", "region", "supplier"):
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(sql, **{k[1:-1]: v for k, v in views.items()})


def toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on odd pages of documents of six pages or more, with printed pages shifted and some indices missing or wrong."""
    pages = doc_pages(spark, sf_dir)
    large = P.page_count(pages).where("n_pages >= 6").select("doc_id")
    rows = pages.join(large, "doc_id").where("page_no % 2 = 1 AND token_count >= 5")
    rows = rows.selectExpr("doc_id", "row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS item_no", "substring(text, 1, 40) AS title", "page_no")
    return rows.selectExpr(
        "doc_id", "item_no",
        "concat(cast(cast(floor((item_no + 2) / 3) AS int) AS string), CASE item_no % 3 WHEN 1 THEN '' WHEN 2 THEN '.1' ELSE '.2' END) AS structure",
        "title", "page_no AS true_page", "page_no - cast(doc_id % 5 AS int) AS page",
        "CASE WHEN (doc_id + page_no) % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 OR (doc_id + page_no) % 7 = 0 THEN page_no + 1 ELSE page_no END AS physical_index",
    )


def toc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).selectExpr("doc_id", "page_no", "CASE WHEN token_count % 5 < 2 THEN 'yes' ELSE 'no' END AS toc_detected")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id", r"""CASE item_id % 5
        WHEN 0 THEN '```json {"thinking": "x", "answer": "yes"} ```'
        WHEN 1 THEN '{"thinking": "x", "answer": "no",}'
        WHEN 2 THEN '{"answer": "yes", "page": None}'
        WHEN 3 THEN '[{"structure": "1", "title": "A", "physical_index": "<physical_index_3>"}]'
        ELSE 'Error' END AS reply""")  # fmt: skip


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).where("page_no = 3").selectExpr("doc_id AS question_id", "doc_id", "substring(text, 1, 60) AS question")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    status = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'ERROR' ELSE 'RUNNING' END AS status"
    return events.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(status))
