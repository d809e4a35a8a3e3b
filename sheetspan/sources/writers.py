"""Report shapes and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

C = F.col


def compliance_report(compliance: DataFrame, version: str) -> DataFrame:
    """The nine columns of the compliance file, as text; nulls stay empty."""
    shown = lambda c: C(c).cast("string").alias(c)
    return compliance.select(
        C("unit_id").alias("unit"), "rule_code", "result", shown("measured"), shown("required"), F.when(C("required").isNotNull(), "m2").alias("unit_measure"), shown("confidence"),
        F.when(C("result") == "pass", "Requirement met.").when(C("result") == "fail", "Requirement not met.").otherwise("Evidence missing.").alias("explanation"), F.lit(version).alias("policy_version"),
    )


def hierarchy_report(floors: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms of units first, then shared ones, by floor, with a yes/no flag."""
    shared = F.when(C("is_common"), "yes").otherwise("no")
    out = floors.join(rooms, "page_id").select("page_id", "level", C("unit_label").alias("unit"), C("label").alias("room"), shared.alias("shared"), "ord", "is_common")
    return out.orderBy("page_id", "is_common", "ord").drop("is_common")


def eval_report(scores: DataFrame) -> DataFrame:
    """Evaluation columns with four decimals."""
    four = lambda c: F.format_string("%.4f", C(c)).alias(c)
    return scores.select("sheet_id", "tp", "fp", "fn", four("sq"), four("rq"), four("pq"), four("precision"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def analysis_document(pages: DataFrame, entities: DataFrame, compliance: DataFrame) -> DataFrame:
    """One JSON text per page: its regions in order and its rule results."""
    e = entities.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "entity_id", "type", "label", "confidence", "bbox"))).alias("entities"))
    r = compliance.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rule_code", "unit_id", "result"))).alias("compliance"))
    all_ = pages.join(e, "page_id", "left").join(r, "page_id", "left")
    return all_.select("page_id", F.to_json(F.struct("page_id", "width_px", "height_px", "ppm", "entities", "compliance")).alias("document"))


def yolo_lines(labels: DataFrame) -> DataFrame:
    """``class c1 c2 ...`` with six decimals, one row per label in order: split, image_id, value."""
    text = F.array_join(F.transform("coords", lambda c: F.format_string("%.6f", c)), " ")
    return labels.select("split", "image_id", "ord", F.concat_ws(" ", C("class_id").cast("string"), text).alias("value"))


def write_yolo(labels: DataFrame, path: str) -> None:
    lines = yolo_lines(labels).repartition("split", "image_id").sortWithinPartitions("split", "image_id", "ord")
    lines.select("split", "image_id", "value").write.mode("overwrite").partitionBy("split", "image_id").text(path)


def labelme_documents(entities: DataFrame) -> DataFrame:
    """A LabelMe document of each page that has regions; rectangles as two corners."""
    pairs = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    rect = C("shape_type") == "rectangle"
    b = g.bbox_of(C("points"))
    points = F.when(rect, F.array(F.array(b["x"], b["y"]), F.array(g.right(b), g.bottom(b)))).otherwise(pairs)
    kind = F.when(rect, "rectangle").when(C("shape_type") == "polyline", "linestrip").otherwise("polygon")
    shape = F.struct("ord", F.struct(C("label"), points.alias("points"), kind.alias("shape_type")).alias("s"))
    per = entities.groupBy("page_id").agg(F.array_sort(F.collect_list(shape)).alias("rows"))
    return per.select("page_id", F.to_json(F.struct(F.lit("5.0").alias("version"), F.transform("rows", lambda r: r["s"]).alias("shapes"))).alias("document"))


def upsert(target: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The target with updates merged by key, the largest version of a key wins, updates on ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def insert_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """W7, insert only: rows whose key the target lacks are added."""
    return target.unionByName(rows.join(target.select(key), key, "left_anti"))
