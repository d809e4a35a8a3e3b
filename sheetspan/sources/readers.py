"""Readers of annotation, detection, text and training files; schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

C = F.col
LABELME = "version string, flags string, imagePath string, imageWidth double, imageHeight double, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
_PAIR = "struct<x:double,y:double>"
_BOX = "struct<x:double,y:double,width:double,height:double>"
REGIONS = f"id string, type string, label string, confidence double, polygonPx array<{_PAIR}>, polygon array<array<double>>, bboxPx {_BOX}, bbox array<double>"


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: g.point(p[0], p[1]))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """LabelMe files, one row per shape.  A rectangle's two corners become four points; polygons,
    line strips and masks need three points."""
    docs = spark.read.schema(LABELME).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    rows = docs.select("file", "imageWidth", "imageHeight", F.posexplode("shapes").alias("ord", "s"))
    p = _points(C("s.points"))
    corners = g.rect_points(F.least(p[0]["x"], p[1]["x"]), F.least(p[0]["y"], p[1]["y"]), F.abs(p[1]["x"] - p[0]["x"]), F.abs(p[1]["y"] - p[0]["y"]))
    points = F.when((C("s.shape_type") == "rectangle") & (F.size(p) == 2), corners).when(F.size(p) >= 3, p)
    out = rows.select(F.regexp_extract("file", r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"), "imageWidth", "imageHeight", "ord", C("s.label").alias("label"), C("s.shape_type").alias("shape_type"), points.alias("points"))
    return out.where("points IS NOT NULL")


def read_yolo_labels(spark: SparkSession, path: str, sizes: DataFrame) -> DataFrame:
    """Label lines with pixel boxes; sizes has image_id (file stem), width, height.  Lines under five
    tokens, with words for numbers, or without extent are dropped."""
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("image_id"), F.split(F.trim("value"), r"\s+").alias("t"))
    rows = lines.where(F.size("t") >= 5).select("image_id", F.expr("try_cast(t[0] as int)").alias("class_id"), F.expr("transform(slice(t, 2, size(t) - 1), v -> try_cast(v as double))").alias("c"))
    rows = rows.where(C("class_id").isNotNull() & ~F.exists("c", lambda v: v.isNull())).join(sizes, "image_id")
    xs, ys = F.filter("c", lambda v, i: i % 2 == 0), F.filter("c", lambda v, i: i % 2 == 1)
    poly = g.box(F.array_min(xs) * C("width"), F.array_min(ys) * C("height"), (F.array_max(xs) - F.array_min(xs)) * C("width"), (F.array_max(ys) - F.array_min(ys)) * C("height"))
    box = F.when(F.size("c") == 4, g.from_unit(C("c"), C("width"), C("height"))).otherwise(poly)
    return rows.select("image_id", "class_id", C("c").alias("coords"), box.alias("bbox")).where((C("bbox.width") > 0) & (C("bbox.height") > 0))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """S3: detector JSON lines in two spellings: the box comes from the polygon if absent, a
    rectangle from the box under three points; rows with neither are dropped."""
    df = spark.read.schema(REGIONS).json(path)
    points = F.coalesce("polygonPx", _points(C("polygon")))
    own = F.coalesce("bboxPx", F.when(F.size("bbox") == 4, g.box(C("bbox")[0], C("bbox")[1], C("bbox")[2], C("bbox")[3])))
    ring = F.size(F.coalesce(points, F.array())) >= 3
    box = F.coalesce(own, F.when(ring, g.bbox_of(points)))
    out = df.select("id", "type", "label", "confidence", F.when(ring, points).otherwise(g.rect_points(box["x"], box["y"], box["width"], box["height"])).alias("points"), box.alias("bbox"))
    return out.where("bbox IS NOT NULL")


def explode_ocr(pages: DataFrame) -> DataFrame:
    """Pages (page_id, lines array<struct<text,confidence>>, confidence, text_hint) to trimmed,
    non-blank lines; confidence falls back to the page's and to 0.85; without lines the hint is split."""
    hint = F.transform(F.split("text_hint", "\n"), lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("confidence")))
    rows = F.when(F.size(F.coalesce("lines", F.array())) > 0, C("lines")).otherwise(hint)
    out = pages.select("page_id", C("confidence").alias("_page"), F.posexplode(rows).alias("ord", "l"))
    return out.select("page_id", "ord", F.trim("l.text").alias("text"), F.coalesce("l.confidence", "_page", F.lit(0.85)).alias("confidence")).where("text <> ''")


def read_training_results(spark: SparkSession, path: str) -> DataFrame:
    """Results files with open headers as long rows: epoch, metric, value; kept are names with
    map, precision, recall, box, mask or loss."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    keep = [c for c in df.columns if any(k in c.lower() for k in ("map", "precision", "recall", "box", "mask", "loss"))]
    values = df.select(F.trim("epoch").cast("int").alias("epoch"), *(F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in keep))
    return values.unpivot("epoch", keep, "metric", "value")


def latest_jobs(events: DataFrame) -> DataFrame:
    """Each job's last readable event, ties to the larger event id."""
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events.where("job_id IS NOT NULL AND kind IS NOT NULL").withColumn("_n", F.row_number().over(w))
    return rows.where("_n = 1").drop("_n")
