"""What is written: frame facts, cut lists, segment manifests. All of them partition by a hash of the video, so that many videos give few folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import frame_seconds
from ..operators.islands import CHUNK, joined_runs
from ..schema import FRAME, VIDEO

BUCKETS = 32
#: Frames of a video that one task writes.
STRETCH = 1 << 20
COLOCATED = "spark.sql.requireAllClusterKeysForCoPartition"


def cut_list(ranges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Kept ranges in frames and in seconds to nine decimals."""
    rows = ranges.join(catalog.select(VIDEO, "fps"), VIDEO)
    time = lambda c: F.format_string("%.9f", frame_seconds(F.col(c), F.col("fps")))
    return rows.select(VIDEO, "range_idx", "start_frame", "end_frame", time("start_frame").alias("start_sec"), time("end_frame").alias("end_sec"))


def write_frame_facts(facts: DataFrame, path: str, buckets: int = BUCKETS, stretch: int = STRETCH) -> None:
    """Facts sorted by video and frame inside each file, so that scans for few videos or frames skip files and row groups.

    Rows are dealt by bucket and stretch of the video: a long video is written by as many tasks as it has stretches, into one folder.
    """
    dealt = facts.withColumn("bucket", F.pmod(F.xxhash64(VIDEO), F.lit(buckets)).cast("int")).repartition("bucket", F.floor(F.col(FRAME) / stretch))
    dealt.sortWithinPartitions("bucket", VIDEO, FRAME).write.partitionBy("bucket").parquet(path)


def read_frame_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def store_colocated(frames: DataFrame, table: str, path: str, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """A table of frame rows in buckets of (video_id, chunk), sorted inside: tables that are stored alike are joined by these columns, and counted or cut into runs, without an exchange.

    A join that also matches frames keeps that where the session has COLOCATED set to false: the tables' buckets then serve although the join has one key more.
    """
    dealt = frames.withColumn("chunk", F.floor(F.col(FRAME) / chunk)).repartition(buckets, VIDEO, "chunk")
    dealt.write.option("path", path).bucketBy(buckets, VIDEO, "chunk").sortBy(VIDEO, "chunk", FRAME).mode("overwrite").saveAsTable(table)
    return frames.sparkSession.table(table)


def colocated_runs(stored: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The runs of states of a table of store_colocated: video_id, state, start, end. Frames stay where they are; runs of the stretches are joined over borders."""
    w = Window.partitionBy(VIDEO, "chunk").orderBy(FRAME)
    fresh = F.when((F.lag(FRAME).over(w) == F.col(FRAME) - 1) & F.lag("state").over(w).eqNullSafe(F.col("state")), 0).otherwise(1)
    grouped = stored.select(VIDEO, "chunk", FRAME, "state").withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    return joined_runs(grouped.groupBy(VIDEO, "chunk", "_run").agg(F.first("state").alias("state"), F.min(FRAME).alias("start"), F.max(FRAME).alias("end")))


def write_rows(rows: DataFrame, path: str, fmt: str = "parquet", buckets: int = BUCKETS) -> None:
    """Cut lists or manifests as Parquet, CSV or JSON, by bucket of the video."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(VIDEO), F.lit(buckets)).cast("int")).repartition("bucket")
    writer = dealt.write.partitionBy("bucket").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
