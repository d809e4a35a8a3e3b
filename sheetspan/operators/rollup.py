"""Aggregations, windows, top-k and set operators over plan tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

C = F.col


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group; ``order`` must not tie."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def unit_summary(units: DataFrame, contained: DataFrame, areas: DataFrame) -> DataFrame:
    """A1: rooms, bedrooms, bathrooms, area and private open space of every unit; sums of 0 are null."""
    kind = t.room_kind(C("room_label"))
    rooms = contained.join(areas, "room_id")
    per = rooms.groupBy("unit_id").agg(
        F.count("*").alias("rooms"), F.count(F.when(kind == "bedroom", 1)).alias("bedrooms"), F.count(F.when(kind == "bathroom", 1)).alias("bathrooms"),
        F.nullif(F.sum("area_m2"), F.lit(0.0)).alias("area_m2"), F.sum(F.when(kind.isin("balcony", "courtyard"), C("area_m2"))).alias("open_m2"),
    )
    return units.join(per, "unit_id", "left").fillna(0, ["rooms", "bedrooms", "bathrooms"])


def unit_records(units: DataFrame, contained: DataFrame, areas: DataFrame) -> DataFrame:
    """A2: every unit with its room ids in order, the sum of their areas (0 is null) and whether it
    still needs review (only predicted)."""
    per = contained.join(areas, "room_id").groupBy("unit_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("room_ord", "room_id"))), lambda r: r["room_id"]).alias("room_ids"), F.sum("area_m2").alias("m2")
    )
    return units.join(per, "unit_id", "left").select(
        "page_id", "unit_id", "label", F.coalesce("room_ids", F.array().cast("array<long>")).alias("room_ids"), F.nullif(C("m2"), F.lit(0.0)).alias("area_m2"), (C("status") == "predicted").alias("review")
    )


def floor_properties(pages: DataFrame, units: DataFrame, rooms: DataFrame, contained: DataFrame) -> DataFrame:
    """A3: units, rooms, shared rooms, gross and shared area (0 is null) and unassigned rooms of a page."""
    held = contained.select("room_id", F.lit(True).alias("held")).distinct()
    per = rooms.join(held, "room_id", "left").groupBy("page_id").agg(
        F.count("*").alias("rooms"), F.count(F.when(C("is_common"), 1)).alias("shared_rooms"), F.nullif(F.sum("area_m2"), F.lit(0.0)).alias("gross_m2"),
        F.nullif(F.sum(F.when(C("is_common"), C("area_m2"))), F.lit(0.0)).alias("shared_m2"), F.count(F.when(C("held").isNull() & ~C("is_common"), 1)).alias("unassigned"),
    )
    n = units.groupBy("page_id").agg(F.count("*").alias("units"))
    return pages.select("page_id").join(per, "page_id", "left").join(n, "page_id", "left").fillna(0, ["rooms", "shared_rooms", "unassigned", "units"])


def metric_layer(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Long table of measurements in pixels and metres; ``estimated`` where the page has no scale;
    values must be positive."""
    p = C("points")
    is_ = lambda *types: C("type").isin(*types)
    rows = F.array_compact(
        F.array(
            *(
                F.when(cond, F.struct(F.lit(kind).alias("kind"), value.alias("px"), F.lit(power).alias("power")))
                for kind, cond, value, power in (
                    ("area", is_("room", "unit_boundary"), g.poly_area(p), 2), ("perimeter", is_("room", "unit_boundary"), g.perimeter(p), 1),
                    ("min_width", is_("room", "unit_boundary"), g.min_width(p), 1), ("wall_length", is_("wall"), g.perimeter(p) / 2, 1),
                    ("wall_thickness", is_("wall"), g.wall_thickness(p), 1), ("opening_width", is_("door"), g.opening_span(p), 1), ("long_edge", is_("window"), g.long_edge(p)["length"], 1),
                )
            )
        )
    )
    long = entities.join(pages.select("page_id", "ppm"), "page_id").select("page_id", "entity_id", "ppm", F.explode(rows).alias("m"))
    scaled = C("ppm") > 0
    metres = F.when(scaled, F.when(C("m.power") == 2, C("m.px") / (C("ppm") * C("ppm"))).otherwise(C("m.px") / C("ppm")))
    return long.where("m.px > 0").select("page_id", "entity_id", "m.kind", F.round("m.px", 6).alias("px"), F.round(metres, 6).alias("metres"), (~F.coalesce(scaled, F.lit(False))).alias("estimated"))


def wall_classes(walls: DataFrame, pages: DataFrame, least_mm: float = 2000.0, least_px: float = 40.0) -> DataFrame:
    """External and internal walls of a page; external by label or by thickness, in mm where scaled."""
    thick = g.wall_thickness(C("points"))
    wide = F.when(C("ppm") > 0, thick / C("ppm") * 1000 >= least_mm).otherwise(thick >= least_px)
    external = F.lower("label").contains("external") | wide
    return walls.join(pages.select("page_id", "ppm"), "page_id").groupBy("page_id").agg(F.count(F.when(external, 1)).alias("external"), F.count(F.when(~external, 1)).alias("internal"))


def region_vote(cells: DataFrame, generic: tuple[str, ...] = ("Room",)) -> DataFrame:
    """Each region's label with the most cells, a generic one only if there is no other; ties by label."""
    per = cells.groupBy("region_id", "label").agg(F.count("*").alias("cells"))
    return first_by(per, ["region_id"], C("label").isin(*generic).cast("int"), F.desc("cells"), "label").select("region_id", "label", "cells")


def sheet_meta(lines: DataFrame, most: int = 4000) -> DataFrame:
    """A10: sheet type, level, scale, paper, unit ids, mean confidence (0.4 to 0.95), lines and a text
    hint of each page, lines in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    per = lines.groupBy("page_id").agg(rows.alias("rows"), F.avg("confidence").alias("mean"), F.count("*").alias("lines"))
    per = per.withColumn("text", F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))
    first = lambda f: F.try_element_at(F.filter(F.transform("rows", lambda r: f(r["text"])), lambda v: v.isNotNull()), F.lit(1))
    return per.select(
        "page_id", t.sheet_type(C("text")).alias("sheet"), first(t.parse_level).alias("level"), first(t.parse_scale).alias("ratio"), first(t.parse_paper).alias("paper"),
        F.array_join(t.parse_unit_ids(C("text")), ",").alias("unit_ids"), F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.95), C("mean"))), 7).alias("confidence"), "lines",
        F.char_length(F.substring("text", 1, most)).cast("long").alias("hint_chars"),
    )


def validation_report(shapes: DataFrame, known: list[str], buildings: dict[str, str], test: set[str], least: float = 2.0) -> DataFrame:
    """Issues of annotation shapes by code, with counts."""
    stem = F.split_part(C("stem"), F.lit("_"), F.lit(1))
    issues = F.array_compact(
        F.array(
            F.when(F.trim("label") == "", "EMPTY_LABEL"), F.when((F.trim("label") != "") & ~C("label").isin(*known), "UNKNOWN_LABEL"),
            F.when((C("w") < least) | (C("h") < least), "TINY_SHAPE"), F.when(~stem.isin(*buildings), "UNKNOWN_BUILDING"),
        )
    )
    flat = shapes.select("page_id", F.explode(issues).alias("code"))
    return flat.groupBy("code").agg(F.count("*").alias("issues"), F.countDistinct("page_id").alias("pages"))


def validation_issues(pages: DataFrame, shapes: DataFrame, known: list[str], buildings: dict[str, str], fold: tuple[set[str], set[str]], least_points: int = 3, least_area: float = 4.0) -> DataFrame:
    """A11 over points: counts of issues of pages (page_id, stem) and their shapes (page_id, label,
    shape_type, points as arrays of numbers) by code, with the pages they are on, and ``ok``, whether
    no code is an error (all are but EMPTY_SHAPES and TINY_SHAPE).  ``fold`` holds the buildings of the train and
    test sides; FOLD_LEAKAGE is one issue of the whole folder, so it has no pages.  As in the survey's source, a shape
    without label is judged no further, and without two points or with points that are no pairs only up to there."""
    train, test = fold
    building = F.coalesce(*(F.when(F.split_part(C("stem"), F.lit("_"), F.lit(1)) == k, v) for k, v in buildings.items()), F.lit(None).cast("string"))
    placed = pages.select("page_id", building.alias("building"))
    empty = placed.join(shapes.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit("EMPTY_SHAPES").alias("code"))
    of_page = F.array_compact(F.array(F.when(C("building").isNull(), "UNKNOWN_BUILDING"), F.when(~C("building").isin(*train, *test), "BUILDING_NOT_IN_FOLD")))
    sides = placed.agg(F.max(C("building").isin(*train)).alias("a"), F.max(C("building").isin(*test)).alias("b")).where("a AND b")
    label, n = F.trim(F.coalesce("label", F.lit(""))), F.coalesce(F.size("points"), F.lit(0))
    pairs = F.forall("points", lambda p: F.coalesce((F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False)))
    corner = lambda i, k: F.try_element_at(F.try_element_at("points", F.lit(i)), F.lit(k))
    ring = F.transform("points", lambda p: g.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    area = F.when(n >= 3, g.poly_area(ring)).otherwise(F.abs((corner(2, 1) - corner(1, 1)) * (corner(2, 2) - corner(1, 2))))
    named, drawn = label != "", (label != "") & (n >= 2)
    polygon = F.lower(F.coalesce("shape_type", F.lit("polygon"))) == "polygon"
    of_shape = F.array_compact(
        F.array(
            F.when(~named, "EMPTY_LABEL"), F.when(named & ~C("label").isin(*known), "UNKNOWN_LABEL"), F.when(named & (n < 2), "BAD_GEOMETRY"),
            F.when(drawn & polygon & (n < least_points), "OPEN_POLYGON"), F.when(drawn & ~pairs, "BAD_POINTS"), F.when(drawn & pairs & (area < least_area), "TINY_SHAPE"),
        )
    )
    flat = empty.unionByName(placed.select("page_id", F.explode(of_page).alias("code"))).unionByName(shapes.select("page_id", F.explode(of_shape).alias("code")))
    flat = flat.unionByName(sides.select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit("FOLD_LEAKAGE").alias("code")))
    counts = flat.groupBy("code").agg(F.count("*").alias("issues"), F.countDistinct("page_id").alias("pages"))
    errors = counts.agg((F.count(F.when(~C("code").isin("EMPTY_SHAPES", "TINY_SHAPE"), 1)) == 0).alias("ok"))
    return counts.crossJoin(F.broadcast(errors))


def dense_classes(labels: DataFrame) -> DataFrame:
    """Class ids in use, numbered from 0 in order.  The classes are few, so one window over them is small."""
    used = labels.select("label").distinct()
    return used.withColumn("class_id", F.row_number().over(Window.orderBy("label")).cast("long") - 1)


def convert_stats(shapes: DataFrame, known: list[str], splits: DataFrame) -> DataFrame:
    """Images, instances and skipped shapes by split."""
    ok = C("label").isin(*known)
    return shapes.join(splits, "page_id").groupBy("split").agg(F.countDistinct("page_id").alias("images"), F.count(F.when(ok, 1)).alias("instances"), F.count(F.when(~ok, 1)).alias("skipped"))


def pq(matches: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Tp, fp, fn, SQ, RQ, PQ and precision of each sheet; precision is 1 where both are empty."""
    n = lambda df, name: df.groupBy("sheet_id").agg(F.count("*").alias(name))
    hit = matches.groupBy("sheet_id").agg(F.count("*").alias("tp"), F.avg("iou").alias("sq"))
    both = n(gold, "g").join(n(pred, "p"), "sheet_id", "full").join(hit, "sheet_id", "left").fillna(0, ["g", "p", "tp"])
    fp, fn = C("p") - C("tp"), C("g") - C("tp")
    rq = F.when(C("tp") + fp + fn == 0, 0.0).otherwise(C("tp") / (C("tp") + fp / 2 + fn / 2))
    sq = F.coalesce("sq", F.lit(0.0))
    precision = F.when((C("g") == 0) & (C("p") == 0), 1.0).when(C("p") == 0, 0.0).otherwise(C("tp") / C("p"))
    return both.select("sheet_id", "tp", fp.alias("fp"), fn.alias("fn"), F.round(sq, 6).alias("sq"), F.round(rq, 6).alias("rq"), F.round(sq * rq, 6).alias("pq"), F.round(precision, 6).alias("precision"))


def match_boxes(gold: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Gold boxes of a sheet in order each take the best unused prediction by IoU, if that is at
    least ``threshold``: an ordered fold over the sheet's overlapping pairs, a group of one page's boxes."""
    a = gold.select(C("sheet_id").alias("page_id"), "gold_id", C("ord").alias("gold_ord"), g.box(C("x"), C("y"), C("w"), C("h")).alias("gbox"))
    b = pred.select(C("sheet_id").alias("page_id"), "pred_id", C("ord").alias("pred_ord"), g.box(C("x"), C("y"), C("w"), C("h")).alias("pbox"))
    from .spatial import box_pairs

    pairs = box_pairs(a, b, "gbox", "pbox").withColumn("iou", g.iou(C("gbox"), C("pbox"))).where("iou > 0")
    per_gold = pairs.groupBy("page_id", "gold_id", "gold_ord").agg(F.array_sort(F.collect_list(F.struct((-C("iou")).alias("m"), "pred_ord", "pred_id"))).alias("best"))
    rows = per_gold.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("gold_ord", "gold_id", "best"))).alias("rows"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("used"), F.expr("cast(array() as array<struct<gold_id:bigint,pred_id:bigint,iou:double>>)").alias("out"))

    def step(acc, row):
        top = F.try_element_at(F.filter(row["best"], lambda p: ~F.array_contains(acc["used"], p["pred_id"])), F.lit(1))
        ok = F.coalesce(-top["m"] >= threshold, F.lit(False))
        return F.struct(
            F.when(ok, F.concat(acc["used"], F.array(top["pred_id"]))).otherwise(acc["used"]).alias("used"),
            F.when(ok, F.concat(acc["out"], F.array(F.struct(row["gold_id"].alias("gold_id"), top["pred_id"].alias("pred_id"), (-top["m"]).alias("iou"))))).otherwise(acc["out"]).alias("out"),
        )

    return rows.select(C("page_id").alias("sheet_id"), F.inline(F.aggregate("rows", start, step)["out"]))


def relative_error(gold: Column, pred: Column) -> Column:
    """1 without a prediction; against 0 it is 0 or 1."""
    return F.when(pred.isNull(), 1.0).when(gold == 0, F.when(pred == 0, 0.0).otherwise(1.0)).otherwise(F.abs(pred - gold) / F.abs(gold))


def number_units(inferred: DataFrame) -> DataFrame:
    """Labels "Unit i" from left to right."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("x", "ord"))
    return inferred.withColumn("label", F.concat(F.lit("Unit "), n.cast("string")))


def best_line(lines: DataFrame) -> DataFrame:
    """The line of each page that best names its level: confidence, and 0.4 more for a level."""
    score = C("confidence") + F.when(t.parse_level(C("text")).isNotNull(), 0.4).otherwise(0.0)
    return first_by(lines.withColumn("score", F.round(score, 6)), ["page_id"], F.desc("score"), "ord").select("page_id", "ord", "text", "score")


def page_levels(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The level that a page's text names (the best line first), else "Floor n"; with its index."""
    named = lines.withColumn("level", t.parse_level(C("text"))).where("level IS NOT NULL")
    best = first_by(named, ["page_id"], F.desc("confidence"), "ord").select("page_id", "level")
    level = F.coalesce("level", F.concat(F.lit("Floor "), (C("page_id") + 1).cast("string")))
    return pages.join(best, "page_id", "left").select("page_id", level.alias("level"), F.coalesce(t.level_index(level), C("level_index")).cast("long").alias("level_index"))


def text_budget(lines: DataFrame, most: int = 48_000) -> DataFrame:
    """Lines of a document while their length with line ends fits."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.char_length("text") + 1).over(w)).where(C("used") <= most).drop("used")


def sections(lines: DataFrame) -> DataFrame:
    """Each line with the last heading above it and its paragraph's number; a heading or a list
    item starts a paragraph, and so does the line after a sentence's end."""
    from ..functions.policy_text import LIST_ITEM, is_heading

    w = Window.partitionBy("doc_id").orderBy("line_no")
    head = F.when(is_heading(C("text")), F.trim("text"))
    new = head.isNotNull() | F.trim("text").rlike(LIST_ITEM) | F.coalesce(F.lag("text").over(w).rlike(r"[.!?]\s*$"), F.lit(True))
    marked = lines.withColumn("_new", new.cast("int"))
    return marked.select("doc_id", "line_no", F.last(head, ignorenulls=True).over(w).alias("heading"), F.sum("_new").over(w).alias("paragraph"))


def door_width_split(doors: DataFrame) -> DataFrame:
    """The span that parts a page's doors into wide and narrow (page_id, split), from doors of a span above 0.

    It is the middle of the largest gap between sorted spans (the first of equal ones), if that gap is at least max(2, 12 % of the smallest
    span); else, where the largest span is over 1.12 times the smallest, 35 % of the way between them; else null, as for one door."""
    real = F.when(C("span") > 0, C("span"))
    w = Window.partitionBy("page_id").orderBy("span", "ord")
    gaps = doors.withColumn("span", real).withColumn("gap", F.lead("span").over(w) - C("span"))
    per = gaps.groupBy("page_id").agg(F.min("span").alias("low"), F.max("span").alias("high"), F.max("gap").alias("gap"), F.max_by("span", F.struct("gap", -C("span"))).alias("at"))
    by_gap, by_ratio = C("gap") >= F.greatest(F.lit(2.0), C("low") * 0.12), C("high") > C("low") * 1.12
    return per.select("page_id", F.when(by_gap, C("at") + C("gap") / 2).when(by_ratio, C("low") + (C("high") - C("low")) * 0.35).alias("split"))


def wide_doors(doors: DataFrame, mode: str = "auto", least: float = 29.0) -> DataFrame:
    """The doors (page_id, ord, label, span and more) with ``wide``: whether a door passes for an entrance by its width.

    Doors labelled main door do, whatever their width; with mode "auto" a page's only door and those from the page's split
    on; with "threshold" those from ``least`` px on.  Doors of no span never do."""
    if mode not in ("auto", "threshold"):
        raise ValueError(f"no such mode: {mode}")
    real = F.coalesce(C("span") > 0, F.lit(False))
    if mode == "threshold":
        return doors.withColumn("wide", real & (t.is_main_door(C("label")) | F.coalesce(C("span") >= least, F.lit(False))))
    split = door_width_split(doors.select("page_id", "ord", "span"))
    only = F.count_if(real).over(Window.partitionBy("page_id")) == 1
    return doors.join(split, "page_id", "left").withColumn("wide", real & (t.is_main_door(C("label")) | only | F.coalesce(C("span") >= C("split"), F.lit(False)))).drop("split")


def overfit_hints(metrics: DataFrame, back: int = 3, rise: float = 1.08) -> DataFrame:
    """Epochs whose loss is over ``rise`` times that of ``back`` epochs before."""
    w = Window.partitionBy("job_id").orderBy("epoch")
    return metrics.withColumn("before", F.lag("loss", back).over(w)).where((C("before") > 0) & (C("loss") > C("before") * rise)).select("job_id", "epoch", "loss", "before")


def vision_pages(pages: DataFrame, most: int = 16) -> DataFrame:
    """K2: up to ``most`` pages of a document by score (image 10, under 400 characters 5, under 80 also 4), in page order."""
    score = F.when(C("has_image"), 10).otherwise(0) + F.when(C("chars") < 400, 5).otherwise(0) + F.when(C("chars") < 80, 4).otherwise(0)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(score.desc(), "page_number"))
    return pages.withColumn("_n", n).where(C("_n") <= most).drop("_n")


def drawing_area(entities: DataFrame) -> DataFrame:
    """K3: the region of each page with the largest area times confidence."""
    score = g.box_area(C("bbox")) * C("confidence")
    best = entities.groupBy("page_id").agg(F.max_by(C("entity_id"), F.struct(score, -C("ord"))).alias("entity_id"))
    return best


def nms(regions: DataFrame, threshold: float = 0.45) -> DataFrame:
    """K5: of each page, type and label, boxes by confidence, dropping those that overlap a kept one by at
    least ``threshold``: an ordered fold over one page's boxes of a label."""
    row = F.struct((-C("confidence")).alias("m"), C("region_id"), g.box(C("x"), C("y"), C("w"), C("h")).alias("b"))
    groups = regions.groupBy("page_id", "type", "label").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.expr("cast(array() as array<struct<m:double,region_id:bigint,b:struct<x:double,y:double,width:double,height:double>>>)")
    kept = F.aggregate("rows", empty, lambda acc, r: F.when(F.exists(acc, lambda k: g.iou(k["b"], r["b"]) >= threshold), acc).otherwise(F.concat(acc, F.array(r))))
    return groups.select("page_id", F.explode(kept).alias("k")).select("page_id", "k.region_id")


def dedupe_regions(regions: DataFrame) -> DataFrame:
    """The first row of every id; blank ids all stay."""
    blank = F.coalesce(F.trim(C("id")) == "", F.lit(True))
    return first_by(regions.where(~blank), ["id"], "ord").unionByName(regions.where(blank))


def page_unit_ids(lines: DataFrame) -> DataFrame:
    """Distinct unit ids of a page in reading order."""
    own = lines.select("page_id", "ord", F.posexplode(t.parse_unit_ids(C("text"))).alias("k", "unit"))
    return own.groupBy("page_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "k", "unit"))), lambda r: r["unit"])), ",").alias("unit_ids"))


def fold_split(shapes: DataFrame, buildings: dict[str, str], test: set[str]) -> DataFrame:
    """U4: pages with their building (by the stem's first part) and split: test buildings are val."""
    spark = shapes.sparkSession
    table = F.broadcast(spark.createDataFrame(list(buildings.items()), "prefix string, building string"))
    pages = shapes.select("page_id", F.split_part(C("stem"), F.lit("_"), F.lit(1)).alias("prefix")).distinct().join(table, "prefix", "left")
    return pages.select("page_id", "building", F.when(C("building").isin(*test), "val").otherwise("train").alias("split"))


def fold_leakage(splits: DataFrame) -> DataFrame:
    """Buildings with pages on both sides."""
    both = splits.where("building IS NOT NULL").groupBy("building").agg(F.countDistinct("split").alias("sides"), F.count("*").alias("pages"))
    return both.where("sides > 1").select("building", "pages")


def random_split(pages: DataFrame, frac: float = 0.2, seed: int = 7) -> DataFrame:
    """max(1, round(n * frac)) pages of each data set to val by the hash of their key, none if it
    has one page."""
    w = Window.partitionBy("dataset_id")
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id"))
    val = (n >= 2) & (rank <= F.greatest(F.lit(1), F.floor(n * frac + 0.5)))
    return pages.withColumn("split", F.when(val, "val").otherwise("train"))


def tile_grid(pages: DataFrame, size: int = 640, overlap: float = 0.2, least: int = 1280) -> DataFrame:
    """Tiles of pages whose longer side is over max(least, size), the last of a row or column
    pulled back to the border; else one tile."""
    stride = max(1, round(size * (1 - overlap)))
    w, h = C("width_px").cast("int"), C("height_px").cast("int")
    gated = F.greatest(w, h) > max(least, size)
    axis = lambda side: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((side - size) / stride).cast("int"), F.lit(0))), lambda i: F.least(i * stride, F.greatest(side - size, F.lit(0)))))
    grid = pages.withColumn("x", F.explode(F.when(gated, axis(w)).otherwise(F.array(F.lit(0))))).withColumn("y", F.explode(F.when(gated, axis(h)).otherwise(F.array(F.lit(0)))))
    return grid.select("page_id", "x", "y", F.when(gated, F.least(F.lit(size), w)).otherwise(w).alias("w"), F.when(gated, F.least(F.lit(size), h)).otherwise(h).alias("h"))


def clip_labels(boxes: DataFrame, tiles: DataFrame, least: float = 2.0) -> DataFrame:
    """U8: boxes cut at each tile of their page (at least ``least`` pixels left), in tile coordinates."""
    t_ = tiles.select("page_id", C("x").cast("double").alias("tx"), C("y").cast("double").alias("ty"), C("w").cast("double").alias("tw"), C("h").cast("double").alias("th"))
    x0, y0 = F.greatest("x", "tx"), F.greatest("y", "ty")
    x1, y1 = F.least(C("x") + C("w"), C("tx") + C("tw")), F.least(C("y") + C("h"), C("ty") + C("th"))
    cut = boxes.join(t_, "page_id").where((x1 - x0 >= least) & (y1 - y0 >= least))
    return cut.select("page_id", "entity_id", "tx", "ty", (x0 - C("tx")).alias("x"), (y0 - C("ty")).alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def training_pages(pages: DataFrame) -> DataFrame:
    """Labelled train pages; of data sets with tile pages only those."""
    own = pages.where("split = 'train' AND shapes > 0")
    return own.withColumn("_tiles", F.max(C("is_tile").cast("int")).over(Window.partitionBy("dataset_id"))).where((C("_tiles") == 0) | C("is_tile")).drop("_tiles")


def active_model(models: DataFrame) -> DataFrame:
    """The latest activated model of each owner is active, the others are not."""
    newest = F.max(F.struct("activated_at", "model_id")).over(Window.partitionBy("owner_id"))
    return models.withColumn("is_active", C("activated_at").isNotNull() & (C("model_id") == newest["model_id"]))
