"""Job events and usage counters: batch forms, and Structured Streaming forms that give the same results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, FREE_PAGES, DAY = 2, 50, 86_400


def ordered_events(events: DataFrame) -> DataFrame:
    """Events (job_id, event_id, ts, status) with their ``place`` in their job."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    return events.select("job_id", "event_id", F.row_number().over(order).alias("place"), "status")


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("events"))


def usage(events: DataFrame) -> DataFrame:
    """(client, event_id, ts, uses): a counter that starts with a first use and starts anew with the first use after a day.

    After a day without events the counter starts anew whatever came before, so a client's events fall into runs that are told
    apart by a window and counted each on its own; a run is folded once, and its work grows with its events alone."""
    order = Window.partitionBy("client").orderBy(F.col("ts").asc_nulls_first(), "event_id")
    pause = F.col("ts") > F.lag("ts").over(order) + F.expr("interval 1 day")
    runs = events.select("client", "event_id", "ts", F.coalesce(pause, F.lit(True)).cast("int").alias("begins"))
    runs = runs.withColumn("run", F.sum("begins").over(order))
    rows = runs.groupBy("client", "run").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("events"))
    # The state: places where the counter starts; between two of them it counts up from 1.
    starts = """aggregate(events, named_struct('until', cast(null as timestamp), 'at', 0, 'starts', cast(array() as array<int>)),
        (s, e) -> if(s.until is null or e.ts > s.until, named_struct('until', e.ts + interval 1 day, 'at', s.at + 1, 'starts', concat(s.starts, array(s.at))),
                     named_struct('until', s.until, 'at', s.at + 1, 'starts', s.starts)), s -> s.starts)"""
    uses = "flatten(transform(starts, (a, k) -> sequence(1, coalesce(get(starts, k + 1), size(events)) - a)))"
    rows = rows.withColumn("starts", F.expr(starts)).select("client", F.explode(F.arrays_zip("events", F.expr(uses).alias("uses"))).alias("x"))
    return rows.select("client", "x.events.event_id", "x.events.ts", F.col("x.uses").alias("uses"))


def remaining(used: DataFrame, limit: int = LIMIT) -> DataFrame:
    return used.select("client", "event_id", F.greatest(F.lit(0), F.lit(limit) - F.col("uses")).alias("remaining"), (F.col("uses") <= limit).alias("allowed"))


def sessions(events: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """(job_id, started, last, events): runs of a job's events without a pause as long as the gap; what a listener that gives up
    after the gap would see in one go."""
    window = F.session_window("ts", gap)
    rows = events.groupBy("job_id", window.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("last"))
    return rows.select("job_id", "started", "last", "events")


def ingest(spark: SparkSession, inbox: str, kept, checkpoint: str, free_pages: int | None = 50) -> DataFrame:
    """Indexes the PDF files of an inbox as they come: each micro-batch is a set of jobs, and what is in the store stays as it is.
    Works through what is there now and gives (doc_key, status, error) of all batches."""
    from ..functions import text as X
    from ..plans import service
    from ..sources import files

    schema = spark.read.format("binaryFile").load(inbox).schema
    stream = spark.readStream.format("binaryFile").schema(schema).load(inbox)
    out = f"{checkpoint}/statuses"

    def batch(rows: DataFrame, number: int) -> None:
        pages = files.pages_of(rows)
        uploads = rows.select(X.doc_key(F.element_at(F.split("path", "/"), -1)).alias("doc_key"), F.xxhash64("path").alias("doc_id"))
        service.index_jobs(uploads, pages.drop("doc_name"), kept, free_pages).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a table's files, be it a folder or one file; time stamps get the session's time zone, as watermarks ask for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        rows = stream.parquet(path)
    else:
        rows = stream.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Works through what a stream has now and gives what the sink has then: all rows in append mode, the last state in complete
    mode.  Batches are Parquet tables below folder; one that is repeated after a failure replaces itself."""
    spark, out = stream.sparkSession, f"{folder}/batches"
    batches: list[int] = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    kept = batches if mode == "append" else [max(batches)]
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={k}" for k in sorted(set(kept))])


def progress_stream(events: DataFrame) -> DataFrame:
    """Latest status and number of events of each job, in complete mode."""
    return events.groupBy("job_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def usage_stream(events: DataFrame) -> DataFrame:
    """The usage counter of events (client, event_id, ts) as a stateful operator: a client's state is its count and its end.

    Uses of one batch are taken in their order of time; across batches they are expected in that order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, 0)
        rows = pd.concat(frames).sort_values(["ts", "event_id"], kind="stable")
        uses = []
        for ts in rows["ts"].astype("datetime64[us]").astype("int64"):
            if not count or ts > until:
                count, until = 0, ts + DAY * 1_000_000
            count += 1
            uses.append(count)
        state.update((count, until))
        yield pd.DataFrame({"client": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "uses": uses})

    return events.groupBy("client").applyInPandasWithState(step, "client long, event_id long, uses int", "count int, until long", "append", GroupStateTimeout.NoTimeout)
