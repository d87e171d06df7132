"""Stores and sinks as Parquet and JSON: indexed documents, pages, audit logs, nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def upserted(old: DataFrame, new: DataFrame, key: str = "doc_key") -> DataFrame:
    """new rows, and the old rows of other keys."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def lookup(index: DataFrame, key: str, value) -> DataFrame:
    return index.where(F.col(key) == F.lit(value))


def not_indexed(documents: DataFrame, index: DataFrame, key: str = "doc_key") -> DataFrame:
    return documents.join(index.select(key).distinct(), key, "left_anti")


def listing(index: DataFrame) -> DataFrame:
    """All indexed documents, the newest first, with defaults for what is missing."""
    return index.select("doc_key", F.coalesce("filename", "doc_key").alias("filename"), F.coalesce("page_count", F.lit(0)).alias("page_count"), "indexed_at").orderBy(F.desc("indexed_at"), "doc_key")


def page_store(pages: DataFrame) -> DataFrame:
    """(doc_id, pages_json): pages as a JSON list of index (from 0) and text."""
    page = F.struct((F.col("page_no") - 1).alias("index"), F.col("text"))
    return pages.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(page))).alias("pages_json"))


def stored_pages(store: DataFrame) -> DataFrame:
    """The pages of a page store as rows."""
    rows = store.select("doc_id", F.explode(F.from_json("pages_json", "array<struct<index:int,text:string>>")).alias("p"))
    return rows.select("doc_id", (F.col("p.index") + 1).alias("page_no"), F.col("p.text").alias("text"))


class IndexStore:
    """Indexed documents under a path; each version is a folder of its own, named by a marker written last, so readers see a
    whole version whatever fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _version(self) -> int | None:
        try:
            return self.spark.read.text(f"{self.path}/current").agg(F.max(F.col("value").cast("int"))).head()[0]
        except AnalysisException:
            return None

    def read(self) -> DataFrame | None:
        version = self._version()
        return None if version is None else self.spark.read.parquet(f"{self.path}/v{version}")

    def upsert(self, rows: DataFrame, key: str = "doc_key") -> None:
        old, version = self.read(), self._version()
        both = rows if old is None else upserted(old, rows, key)
        following = (version or 0) + 1
        both.write.mode("overwrite").parquet(f"{self.path}/v{following}")
        self.spark.createDataFrame([(str(following),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/current")


def audit(spark: SparkSession, path: str, run_id: str, messages: list[str]) -> None:
    """Appends messages to the log of a run."""
    rows = spark.createDataFrame([(run_id, k, m) for k, m in enumerate(messages)], "run_id string, seq int, message string")
    rows.withColumn("ts", F.current_timestamp()).write.mode("append").partitionBy("run_id").parquet(path)


def run_id(name: str, now=None) -> str:
    from datetime import datetime

    return f"{name}_{(now or datetime.now()):%Y%m%d_%H%M%S}"


def write_results(index: DataFrame, path: str) -> None:
    """A JSON object for each document: doc_name, doc_description if there is one, structure."""
    parts = [F.concat(F.lit('"doc_name":'), F.to_json(F.array("doc_name")).substr(F.lit(2), F.length(F.to_json(F.array("doc_name"))) - 2))]
    if "doc_description" in index.columns:
        d = F.to_json(F.array("doc_description"))
        parts.append(F.when(F.col("doc_description").isNotNull(), F.concat(F.lit('"doc_description":'), d.substr(F.lit(2), F.length(d) - 2))))
    parts.append(F.concat(F.lit('"structure":'), F.col("structure_json")))
    index.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).write.mode("overwrite").text(path)
