"""Incremental ingest with Structured Streaming (file sources, ``availableNow`` trigger).

The daily pull of the batch flows, run as a stream: every new landed file is
processed exactly once (the source remembers processed files in the
checkpoint, the Parquet sink commits through its metadata log), and a
restarted or failed run resumes where it stopped.

``ingest_job_pages``  landed job pages -> bronze Parquet partitioned by load date
``ingest_feedback``   landed feedback JSON -> append-only feedback Parquet with server time
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.dates import as_of_date, as_of_timestamp, load_date_text
from ..operators.shape import flatten_jobs, skills_text
from ..schemas import FEEDBACK, JOB_PAGE
from ..sinks.tables import content_key


def ingest_job_pages(spark: SparkSession, landing: str, bronze: str, checkpoint: str,
                     as_of: str | None = None, bracketed_skills: bool = False,
                     max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start (and return) an ``availableNow`` stream landing -> bronze.

    Same flattening as the batch flow; ``load_date`` is the processing date
    (pinned by ``as_of`` in tests). Caller waits with ``awaitTermination()``."""
    reader = spark.readStream.schema(JOB_PAGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = reader.json(landing)
    rows = flatten_jobs(pages.select(F.explode("results").alias("r")))
    rows = (rows.withColumn("skills", skills_text("skills", bracketed_skills))
                .withColumn("load_date", load_date_text(as_of_date(as_of))))
    return (rows.writeStream.format("parquet").partitionBy("load_date")
                .option("path", bronze).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())


def ingest_feedback(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                    as_of: str | None = None, once_within: str | None = None) -> StreamingQuery:
    """Start an ``availableNow`` stream of landed feedback rows into the feedback table.

    ``once_within`` (such as "1 day"): a submission with the content of one that arrived at most that long ago is a
    retry and dropped. The state holds the keys of that span only; the checkpoint keeps it between runs."""
    src_schema = StructType([f for f in FEEDBACK.fields if f.name != "Timestamp"])
    rows = spark.readStream.schema(src_schema).json(landing)
    rows = rows.withColumn("Timestamp", as_of_timestamp(as_of))
    if once_within:
        rows = rows.withColumn("key", content_key(src_schema.names)).withWatermark("Timestamp", once_within) \
            .dropDuplicatesWithinWatermark(["key"]).drop("key")
    return (rows.writeStream.format("parquet").option("path", sink)
                .option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
