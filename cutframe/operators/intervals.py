"""Algebra on intervals of frames: union, complement, difference and overlap, without a row for a frame.

Intervals are rows (video_id, start, end), ends inclusive. Whatever needs an order works on stretches of `CHUNK` frames of the axis, each by
itself; what goes on over a border is then joined, and only the intervals that touch borders meet for that. So a long video is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import VIDEO
from .islands import BUCKET, CHUNK

START, END = "start", "end"


def _cut(intervals: DataFrame, chunk: int) -> DataFrame:
    """Intervals cut at the borders of stretches: video_id, _chunk, start, end."""
    dealt = intervals.where(F.col(START) <= F.col(END)).select(VIDEO, START, END, F.explode(F.sequence(F.floor(F.col(START) / chunk), F.floor(F.col(END) / chunk))).alias("_chunk"))
    return dealt.select(VIDEO, "_chunk", F.greatest(START, F.col("_chunk") * chunk).alias(START), F.least(END, (F.col("_chunk") + 1) * chunk - 1).alias(END))


def _groups(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of one key that overlap or lie side by side, as one."""
    w = Window.partitionBy(*keys).orderBy(START, END)
    reach = F.max(END).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_apart", F.when(F.col(START) <= reach + 1, 0).otherwise(1))
    return marked.withColumn("_group", F.sum("_apart").over(w)).groupBy(*keys, "_group").agg(F.min(START).alias(START), F.max(END).alias(END)).drop("_group")


def _healed(pieces: DataFrame, chunk: int) -> DataFrame:
    """Disjoint pieces of stretches (video_id, _chunk, start, end), joined over the borders: those that touch one meet by video, all others stay with their stretch."""
    touches = ((F.col(START) == F.col("_chunk") * chunk) & (F.col("_chunk") > 0)) | (F.col(END) == (F.col("_chunk") + 1) * chunk - 1)
    homes = pieces.select(VIDEO, F.when(~touches, F.col("_chunk")).alias("_home"), START, END)
    return _groups(homes, [VIDEO, "_home"]).select(VIDEO, START, END)


def union(intervals: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The union of intervals, overlapping or side by side, as the fewest intervals."""
    return _healed(_groups(_cut(intervals, chunk), [VIDEO, "_chunk"]), chunk)


def complement(intervals: DataFrame, catalog: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What no interval holds of frames 0 .. total - 1, as the fewest intervals. What lies outside of these frames does not count."""
    ends = catalog.where("total > 0").select(VIDEO, "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / chunk))).alias("_chunk"))
    marks = ends.select(VIDEO, "_chunk", F.least("total", (F.col("_chunk") + 1) * chunk).alias(START), F.col("total").alias("_total")).withColumn(END, F.col(START))  # stands behind a stretch
    rows = _cut(intervals, chunk).withColumn("_total", F.lit(None).cast("long")).unionByName(marks)
    w = Window.partitionBy(VIDEO, "_chunk").orderBy(START, F.col("_total").asc_nulls_first())
    before = F.coalesce(F.max(END).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.col("_chunk") * chunk)
    limit = F.max("_total").over(Window.partitionBy(VIDEO, "_chunk"))
    gaps = rows.select(VIDEO, "_chunk", before.alias("_from"), F.least(F.col(START) - 1, limit - 1).alias(END), limit.alias("_limit"))
    return _healed(gaps.where(f"_limit IS NOT NULL AND _from <= {END}").select(VIDEO, "_chunk", F.col("_from").alias(START), END), chunk)


def difference(one: DataFrame, other: DataFrame, catalog: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What intervals of `one` hold and those of `other` do not, inside the video."""
    return complement(complement(one, catalog, chunk).unionByName(other.select(VIDEO, START, END)), catalog, chunk)


def overlaps(one: DataFrame, other: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of intervals of one video that overlap, with the columns of both and the common part (start, end).

    An equi-join on buckets of the axis; a pair that shares several buckets is reported in the first of them. Columns of `other` must differ from those of `one`.
    """

    def dealt(rows: DataFrame, prefix: str) -> DataFrame:
        buckets = F.explode(F.sequence(F.floor(F.col(START) / bucket), F.floor(F.col(END) / bucket))).alias(f"{prefix}_bucket")
        rest = [c for c in rows.columns if c not in (VIDEO, START, END)]
        return rows.where(F.col(START) <= F.col(END)).select(F.col(VIDEO).alias(f"{prefix}_video"), F.col(START).alias(f"{prefix}_start"), F.col(END).alias(f"{prefix}_end"), *rest, buckets)

    a, b = dealt(one, "_a"), dealt(other, "_b")
    first = F.greatest("_a_start", "_b_start")
    met = a.join(b, (F.col("_a_video") == F.col("_b_video")) & (F.col("_a_bucket") == F.col("_b_bucket")) & (F.col("_a_start") <= F.col("_b_end")) & (F.col("_b_start") <= F.col("_a_end")) & (F.floor(first / bucket) == F.col("_a_bucket")))
    rest = [c for c in (*one.columns, *other.columns) if c not in (VIDEO, START, END)]
    return met.select(F.col("_a_video").alias(VIDEO), first.alias(START), F.least("_a_end", "_b_end").alias(END), *rest)
