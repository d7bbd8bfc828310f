"""Frame tables, the video catalogue, template images and parameters."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import catalog_fps
from ..schema import CLASSES, FRAME, VIDEO, Params

#: Image types of template folders.
IMAGE_TYPES = ("png", "jpg", "bmp", "jpeg")
#: Folders of classes that have other names than their class.
FOLDERS = {"1x": "speed_1x", "2x": "speed_2x", "play": "speed_0_2x"}


def frame_table(spark: SparkSession, path: str, columns: tuple[str, ...] = (VIDEO, FRAME, "state", "diff")) -> DataFrame:
    """Frames kept as Parquet; only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def image_frames(spark: SparkSession, path: str) -> DataFrame:
    """Stills laid out as <video_id>/<frame_idx>.<type>: video_id, frame_idx, w, h, channels, px. Unreadable ones are left out."""
    rows = _images(spark, path)
    parts = F.split("origin", "/")
    return rows.select(F.element_at(parts, -2).cast("long").alias(VIDEO), F.regexp_extract("origin", r"(\d+)\.[^./]+$", 1).cast("long").alias(FRAME), "w", "h", "channels", "px")


def video_catalog(frames: DataFrame, declared: DataFrame) -> DataFrame:
    """video_id, total, fps: frames counted from the table, rates declared (0 reads as the default)."""
    sizes = frames.groupBy(VIDEO).agg((F.max(FRAME) + 1).alias("total"))
    return sizes.join(declared.select(VIDEO, "fps"), VIDEO, "left").withColumn("fps", catalog_fps(F.coalesce("fps", F.lit(0.0))))


def _images(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    typed = rows.where(F.lower("image.origin").rlike(r"\.(" + "|".join(IMAGE_TYPES) + r")$"))
    return typed.select(F.col("image.origin").alias("origin"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("px"))


def _class(folder: Column) -> Column:
    out = folder
    for name, kind in FOLDERS.items():
        out = F.when(folder == name, kind).otherwise(out)
    return out


def template_images(spark: SparkSession, root: str) -> DataFrame:
    """Images in <root>/templates_<class> and <root>/source_images_<class>, or with the folders' names in place of the class: class, role (template or source), origin, w, h, channels, px.

    Of several sources of a class the first by name is used.
    """
    found = r"/(templates|source_images)_([^/]+)/[^/]+$"
    rows = _images(spark, root).select(_class(F.regexp_extract("origin", found, 2)).alias("class"), F.when(F.regexp_extract("origin", found, 1) == "templates", "template").otherwise("source").alias("role"), "origin", "w", "h", "channels", "px").where(F.col("class").isin(*CLASSES))
    sources = rows.where("role = 'source'").groupBy("class").agg(F.min("origin").alias("origin"))
    return rows.where("role = 'template'").unionByName(rows.where("role = 'source'").join(sources, ["class", "origin"], "left_semi"))


def params_array(*settings: Params) -> Column:
    """Sets of parameters as an array of structs, to explode beside the rows of a sweep."""
    rows = [asdict(p) for p in settings or (Params(),)]
    return F.array(*(F.struct(F.lit(n).alias("params_id"), *(F.lit(v).alias(k) for k, v in row.items())) for n, row in enumerate(rows)))


def params_table(spark: SparkSession, *settings: Params) -> DataFrame:
    """One row for each set of parameters."""
    return spark.range(1).select(F.explode(params_array(*settings)).alias("p")).select("p.*")
