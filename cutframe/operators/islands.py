"""Runs of equal values in ordered series, and joins of points to the runs that hold them.

Both work on chunks of a series, so that one very long series is no single task: only the ends of runs meet
in a window over a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRAME, VIDEO

CHUNK = 65_536
BUCKET = 1_024


def run_bounds(rows: DataFrame, by: list[str], keys: tuple[str, ...] = (VIDEO,), order: str = FRAME, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of consecutive `order` values with equal `by`: keys, by, start, end (inclusive).

    Repeated rows count once. Where one `order` value has rows of several `by`, each of these is a run of its own there or ends one.
    """
    at = F.col(order)
    number = F.floor(at / chunk).cast("long")
    # the last row of a chunk also stands before the next chunk, and the first one after the one before
    homes = F.filter(F.array(number, F.when(at % chunk == chunk - 1, number + 1), F.when((at % chunk == 0) & (at > 0), number - 1)), lambda c: c.isNotNull())
    dealt = rows.select(*keys, order, *by, F.explode(homes).alias("_chunk"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order, *by)

    def breaks(shift, step: int) -> Column:
        out = shift(at).over(w).isNull() | ~shift(at).over(w).isin(at, at + step)
        for c in by:
            out = out | ~shift(F.col(c)).over(w).eqNullSafe(F.col(c))
        return out

    marked = dealt.withColumns({"_first": breaks(F.lag, -1), "_last": breaks(F.lead, 1)}).where((F.floor(at / chunk) == F.col("_chunk")) & (F.col("_first") | F.col("_last")))
    ends = marked.select(*keys, *by, F.explode(F.filter(F.array(F.when(F.col("_first"), F.struct(at.alias("at"), F.lit(0).alias("side"))), F.when(F.col("_last"), F.struct(at.alias("at"), F.lit(1).alias("side")))), lambda x: x.isNotNull())).alias("x")).select(*keys, *by, "x.at", "x.side")
    w = Window.partitionBy(*keys).orderBy("at", "side")
    return ends.withColumn("end", F.lead("at").over(w)).where("side = 0").select(*keys, *by, F.col("at").alias("start"), "end")


def joined_runs(pieces: DataFrame, by: str = "state") -> DataFrame:
    """video_id, `by`, start, end: disjoint pieces of runs, joined where one goes on in the next.

    Pieces with a column `chunk` are whole runs within their stretch: there only a stretch's first and last piece meet those of the others, by video.
    """
    keys = [VIDEO]
    if "chunk" in pieces.columns:
        stretch = Window.partitionBy(VIDEO, "chunk")
        inner = (F.col("start") > F.min("start").over(stretch)) & (F.col("start") < F.max("start").over(stretch))
        pieces, keys = pieces.withColumn("_home", F.when(inner, F.col("chunk"))), [VIDEO, "_home"]
    w = Window.partitionBy(*keys).orderBy("start")
    goes_on = F.lag(by).over(w).eqNullSafe(F.col(by)) & (F.col("start") == F.lag("end").over(w) + 1)
    numbered = pieces.withColumn("_joined", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    return numbered.groupBy(*keys, "_joined", by).agg(F.min("start").alias("start"), F.max("end").alias("end")).select(VIDEO, by, "start", "end")


def spread(intervals: DataFrame, start: str = "start", end: str = "end", out: str = FRAME) -> DataFrame:
    """One row for every frame of inclusive intervals; empty ones give none."""
    return intervals.where(F.col(start) <= F.col(end)).withColumn(out, F.explode(F.sequence(F.col(start), F.col(end))))


def first_wins(intervals: DataFrame, key: str = VIDEO, start: str = "start", end: str = "end") -> DataFrame:
    """Inclusive intervals without overlaps: where several hold a point, it stays with the one that starts first (of equals, that ends first).

    Earlier intervals reach into a later one from its start, so each keeps what lies beyond their furthest end.
    """
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn(start, F.greatest(F.col(start), F.coalesce(before + 1, F.col(start)))).where(F.col(start) <= F.col(end))


def interval_join(points: DataFrame, intervals: DataFrame, how: str = "inner", at: str = FRAME, key: str = VIDEO, start: str = "start", end: str = "end", bucket: int = BUCKET) -> DataFrame:
    """Points with the intervals (inclusive) of their key that hold them, one row for each (see first_wins): an equi-join on buckets of the axis, then a filter."""
    cut = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)))).withColumnRenamed(key, "_key")
    dealt = points.withColumn("_at_bucket", F.floor(F.col(at) / bucket))
    inside = (F.col(key) == F.col("_key")) & (F.col("_at_bucket") == F.col("_bucket")) & F.col(at).between(F.col(start), F.col(end))
    return dealt.join(cut, inside, how).drop("_bucket", "_at_bucket", "_key")
