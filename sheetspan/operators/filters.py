"""Filters over regions, lines, tiles and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

C = F.col
#: Detection tasks and the region types they keep.
TASKS = {
    "rooms": ("room", "unit_boundary"), "openings": ("door", "window"), "structural": ("wall", "door", "window", "stair", "unit_boundary"),
    "objects": ("fixture", "stair"), "walls": ("wall",), "north": ("north_arrow",),
}


def live(entities: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """regions that nobody rejected; ``overrides`` (entity_id, status) goes before a region's own
    status, and no status counts as predicted."""
    own = entities.withColumn("status", F.coalesce("status", F.lit("predicted")))
    if overrides is not None:
        new = overrides.select("entity_id", C("status").alias("_new"))
        own = own.join(new, "entity_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return own.where("status <> 'rejected'")


def for_task(entities: DataFrame, task: str) -> DataFrame:
    """the types of a detection task; walls and openings by label as well; unknown tasks keep all."""
    if task not in TASKS:
        return entities
    keep = C("type").isin(*TASKS[task])
    label = t.normalise_label(F.coalesce("label", F.lit("")))
    if task == "walls":
        keep = keep | label.rlike(r"\bwall\b")
    if task == "openings":
        keep = keep | label.rlike(r"\b(door|window)\b")
    return entities.where(keep)


def split_text(lines: DataFrame, title: DataFrame, drawing: DataFrame) -> DataFrame:
    """lines in the title crop, and lines in the drawing crop (without one, those not in the title);
    crops are (page_id, crop); a line can be in both."""
    own = lines.join(title.select("page_id", C("crop").alias("tc")), "page_id", "left").join(drawing.select("page_id", C("crop").alias("dc")), "page_id", "left")
    cx, cy = C("x") + C("w") / 2, C("y") + C("h") / 2
    in_title = F.coalesce(g.in_box(cx, cy, C("tc")), F.lit(False))
    in_drawing = F.when(C("dc").isNotNull(), g.in_box(cx, cy, C("dc"))).otherwise(~in_title)
    parts = F.array_compact(F.array(F.when(in_title, "title"), F.when(in_drawing, "drawing")))
    return own.withColumn("part", F.explode(parts)).drop("tc", "dc")


def drop_padding(regions: DataFrame, width: str = "tile_w", height: str = "tile_h") -> DataFrame:
    """tile regions that start inside the real tile and keep more than a pixel of it."""
    w, h = F.least(C("x") + C("w"), C(width)) - C("x"), F.least(C("y") + C("h"), C(height)) - C("y")
    return regions.where((C("x") < C(width)) & (C("y") < C(height)) & (w > 1) & (h > 1))


def active_rules(rules: DataFrame, guidelines: DataFrame) -> DataFrame:
    """all rules if there are no guidelines, else those of accepted ones, by rule id or, without
    one, by mapped kind."""
    if guidelines.isEmpty():
        return rules
    accepted = guidelines.where("status = 'accepted'")
    ids = accepted.where("rule_id IS NOT NULL").select(C("rule_id").alias("code"))
    kinds = accepted.where("rule_id IS NULL").select(C("mapped_kind").alias("kind")).distinct()
    return rules.join(ids, "code", "left_semi").select(rules.columns).unionByName(rules.join(ids, "code", "left_anti").join(kinds, "kind", "left_semi").select(rules.columns))


def structural_pool(entities: DataFrame) -> DataFrame:
    """walls and doors of a page: those of the structural source if it has any there, else all."""
    pool = entities.where(C("type").isin("wall", "door"))
    head = (C("source") == "structural").cast("int")
    return pool.withColumn("_head", F.max(head).over(Window.partitionBy("page_id"))).where((C("_head") == 0) | (head == 1)).drop("_head")
