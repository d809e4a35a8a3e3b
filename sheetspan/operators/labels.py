"""Label resolution, assignment of texts and sizes to rooms, and rule tables from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..workspace import stage
from .graph import both_ways

C = F.col
#: The trained classes, in the order of their ids.
CLASS_NAMES = (
    "Unit", "Open Living", "Bedroom", "Bathroom", "Ensuite", "Laundry", "Closet", "Store", "Balcony", "Lobby", "Communal Space", "Wall", "External Wall", "Single Door",
    "Sliding Door", "Main Door", "Window", "Stair", "Lift",
)
#: Other spellings of classes.
ALIASES = {"Living": "Open Living", "Toilet": "Bathroom", "Double Door": "Single Door", "Home Office": "Bedroom"}
#: Normalised labels of each entity type; any other label is "other".
ENTITY_LABELS = {
    "unit_boundary": "unit",
    "room": "open living, bedroom, bathroom, ensuite, laundry, closet, store, balcony, lobby, communal space, gas stove, refrigerator, washing machine, sofa, bed, bedside cupboard, "
    "tv cabinet, wardrobe, sink, bath, bath tub, squat toilet, urinal, toilet, floor, room, rooms, company area, conference, reception, rest room, restroom, waiting",
    "wall": "wall, external wall, walls, partition, interior wall, internal wall",
    "door": "single door, sliding door, main door, double door, opening symbol, door, doors",
    "window": "window, bay window, blind window, windows",
    "stair": "stair",
    "fixture": "chair, table, half height cabinet, high cabinet",
    "main_floorplan": "drawing area",
    "legend": "legend block, legend",
    "title_block": "title block",
    "north_arrow": "north arrow, compass, north",
}
#: Normalised labels of room types that the label itself does not spell.
ROOM_LABELS = {
    "living": "open living, sofa, chair, table, tv cabinet", "bedroom": "bed, bedside cupboard", "bathroom": "ensuite, sink, bath, bath tub, squat toilet, urinal, toilet, rest room, restroom",
    "common_corridor": "communal space", "legend": "legend block", "north_arrow": "compass, north", "kitchen": "gas stove, refrigerator", "laundry": "washing machine",
    "closet": "wardrobe", "office": "company area", "lobby": "reception",
}
GENERIC = ("room", "space", "area", "unknown", "")


def _lookup(table: dict[str, str], key) -> Column:
    """The name under whose comma-separated labels a normalised label is, or null."""
    out = F.lit(None).cast("string")
    for name, labels in table.items():
        out = F.when(key.isin(labels.split(", ")), name).otherwise(out)
    return out


def resolve_labels(entities: DataFrame) -> DataFrame:
    """Canonical (the class of a label or of its alias, spelled exactly, else null), entity_type and room_type (of
    the normalised label, else "other" and the label itself with underscores)."""
    norm, trimmed = t.normalise_label(C("label")), F.trim("label")
    named = trimmed
    for alias, name in ALIASES.items():
        named = F.when(trimmed == alias, name).otherwise(named)
    return entities.select(
        "*", F.when(named.isin(*CLASS_NAMES), named).alias("canonical"), F.coalesce(_lookup(ENTITY_LABELS, norm), F.lit("other")).alias("entity_type"),
        F.coalesce(_lookup(ROOM_LABELS, norm), F.replace(norm, F.lit(" "), F.lit("_"))).alias("room_type"),
    )


def label_rooms_from_detections(rooms: DataFrame, detected: DataFrame) -> DataFrame:
    """Rooms of generic labels take the label of the best detected room of their page: mutual
    centroids score the smaller area, one centroid inside 10000 - d, else 5000 - d (if positive)."""
    r = rooms.select("page_id", "room_id", C("label").alias("own"), C("points").alias("rp"), g.centroid(C("points")).alias("rc"), g.poly_area(C("points")).alias("ra"))
    d = detected.select("page_id", C("label").alias("other"), C("ord").alias("d_ord"), C("points").alias("dp"), g.centroid(C("points")).alias("dc"), g.poly_area(C("points")).alias("da")).where(~t.normalise_label(C("label")).isin(*GENERIC))
    a, b = g.point_in_poly(C("rc.x"), C("rc.y"), C("dp")), g.point_in_poly(C("dc.x"), C("dc.y"), C("rp"))
    far = F.hypot(C("rc.x") - C("dc.x"), C("rc.y") - C("dc.y"))
    score = F.round(F.when(a & b, 10_000 + F.least("ra", "da")).when(a | b, 10_000 - far).otherwise(5_000 - far), 6)
    pairs = r.where(t.normalise_label(C("own")).isin(*GENERIC)).join(d, "page_id").withColumn("score", score).where("score > 0")
    best = pairs.groupBy("page_id", "room_id").agg(F.max_by("other", F.struct("score", -C("d_ord"))).alias("label"))
    return best


def type_to_unit(units: DataFrame, hits: DataFrame) -> DataFrame:
    """Each unit (page_id, unit_id, label) with the type hit (page_id, unit_key, bedrooms, ord) of
    its key; a page's only unit takes the first hit."""
    exact = hits.where("unit_key IS NOT NULL").groupBy("page_id", "unit_key").agg(F.min_by("bedrooms", "ord").alias("exact"))
    first = hits.groupBy("page_id").agg(F.min_by("bedrooms", "ord").alias("first"))
    own = units.withColumn("unit_key", t.unit_key(C("label"))).withColumn("n", F.count("*").over(Window.partitionBy("page_id")))
    out = own.join(exact, ["page_id", "unit_key"], "left").join(first, "page_id", "left")
    return out.select("page_id", "unit_id", F.coalesce("exact", F.when(C("n") == 1, C("first"))).alias("bedrooms"))


def invented_numbers(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Metric tokens of narratives (page_id, text) that match no known value of the page, raw, with
    one decimal, or rounded."""
    tokens = texts.select("page_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)\s*(?:m2|m²|mm|m)\b"), 1)).alias("token"))
    value = C("value").cast("double")
    keys = known.select("page_id", F.explode(F.array(F.regexp_replace(F.format_string("%.3f", value), r"\.?0+$", ""), F.format_string("%.1f", value), F.format_string("%.0f", F.floor(value + 0.5).cast("double")))).alias("token")).distinct()
    return tokens.distinct().join(keys, ["page_id", "token"], "left_anti")


def space_records(rooms: DataFrame, contained: DataFrame, pages: DataFrame) -> DataFrame:
    """Rooms with at least three points, their area in square metres, their last containing unit
    (none for shared rooms) and a review flag while only predicted."""
    unit = contained.groupBy("room_id").agg(F.max_by("unit_id", "unit_ord").alias("unit_id"))
    own = rooms.where(F.size("points") >= 3).join(pages.select("page_id", "ppm"), "page_id").join(unit, C("entity_id") == C("room_id"), "left")
    return own.select("page_id", "entity_id", "label", "unit_id", F.round(g.area_m2(g.poly_area(C("points")), C("ppm")), 6).alias("area_m2"), (C("status") == "predicted").alias("review"))


def opening_records(openings: DataFrame, access: DataFrame) -> DataFrame:
    """Openings with the room that gives access, null without one."""
    room = access.select(C("to_id").alias("entity_id"), C("from_id").alias("room_id"))
    return openings.join(room, "entity_id", "left").select("page_id", "entity_id", t.opening_type(C("type"), C("label")).alias("opening"), "room_id")


def evidence_ids(compliance: DataFrame) -> DataFrame:
    """Entity ids of the evidence, one row each, over the five spellings of its keys."""
    many = [F.coalesce(C("evidence")[k], F.array()) for k in ("entityIds", "evidenceIds", "roomIds")]
    one = [F.when(C("evidence")[k].isNotNull(), C("evidence")[k]).otherwise(F.array()) for k in ("entityId", "roomId")]
    return compliance.select("page_id", "rule_code", F.explode(F.array_distinct(F.concat(*many, *one))).alias("entity_id"))


def unit_wall_counts(rooms: DataFrame, touches: DataFrame) -> DataFrame:
    """Rooms of every unit, those at external walls, and the internal count, which is the number
    of rooms."""
    own = rooms.join(touches.select(C("entity_id").alias("room_id"), F.lit(1).alias("ext")), "room_id", "left")
    unit = F.coalesce("unit_id", "unit_label", F.lit("unassigned"))
    return own.groupBy("page_id", unit.alias("unit")).agg(F.count("*").alias("internal"), F.count("ext").alias("external"))


def room_properties(rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Each room's neighbours' labels (of its own unit first, then by label) and openings by kind."""
    both = both_ways(walls)
    side = rooms.select(C("room_id").alias("other"), C("label").alias("other_label"), C("unit_id").alias("other_unit"))
    near = both.join(rooms.select("room_id", "unit_id"), "room_id").join(side, "other")
    key = F.struct((~C("unit_id").eqNullSafe(C("other_unit"))).alias("apart"), C("other_label"), C("other"))
    n = near.groupBy("room_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["other_label"]), ", ").alias("neighbours"))
    o = openings.groupBy(C("from_id").alias("room_id")).agg(F.count(F.when(C("kind") == "exterior_window", 1)).alias("windows"), F.count(F.when(C("kind") != "exterior_window", 1)).alias("doors"))
    out = rooms.select("page_id", "room_id", "label").join(n, "room_id", "left").join(o, "room_id", "left")
    return out.fillna(0, ["windows", "doors"]).fillna("", ["neighbours"])


def dedupe_room_kinds(seeds: DataFrame) -> DataFrame:
    """Of the living and kitchen seeds of a unit the one nearest to its centre; others all stay.
    seeds: page_id, seed_id, ord, label, unit_id, x, y, cx, cy."""
    cat = t.room_category(C("label"))
    d = F.hypot(C("x") - C("cx"), C("y") - C("cy"))
    w = Window.partitionBy("page_id", "unit_id", "category").orderBy(F.round(d, 6), "ord")
    rows = seeds.withColumn("category", cat).withColumn("_n", F.row_number().over(w))
    return rows.where((C("_n") == 1) | ~C("category").isin("living", "kitchen")).drop("_n")


def resolve_scale(pages: DataFrame, lines: DataFrame, manual: DataFrame) -> DataFrame:
    """One scale for each page: a manual one, else the ratio of a line with paper (0.95), else the
    first ratio (0.7) on the page's paper or A3."""
    from ..functions import scale

    w, h = C("width_px"), C("height_px")
    read = lines.select("page_id", "ord", t.read_scale(C("text")).alias("s")).select("page_id", "ord", "s.ratio", "s.paper")
    read = stage(read.where("ratio IS NOT NULL OR paper IS NOT NULL"), "scales")
    page_paper = read.where("paper IS NOT NULL").groupBy("page_id").agg(F.min_by("paper", "ord").alias("page_paper"))
    hits = read.where("ratio IS NOT NULL").join(page_paper, "page_id", "left").join(pages, "page_id")
    texts = hits.select(
        "page_id", F.when(C("paper").isNotNull(), 2).otherwise(3).alias("priority"), "ord", scale.ppm_from_scale(C("ratio"), F.coalesce("paper", "page_paper", F.lit("A3")), w, h).alias("ppm"),
        F.when(C("paper").isNotNull(), "text_with_paper").otherwise("text_ratio").alias("method"), F.when(C("paper").isNotNull(), 0.95).otherwise(0.7).alias("confidence"),
    )
    own = manual.select("page_id", F.lit(1).alias("priority"), F.lit(0).cast("long").alias("ord"), "ppm", F.lit("manual").alias("method"), F.lit(1.0).alias("confidence"))
    best = texts.unionByName(own).groupBy("page_id").agg(F.min(F.struct("priority", "ord", "ppm", "method", "confidence")).alias("b"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.round("b.ppm", 6).alias("ppm"), "b.method", "b.confidence")


def merge_text_units(units: DataFrame, text_units: DataFrame) -> DataFrame:
    """Detected units and those of the text whose key is new on the page."""
    seen = units.select("page_id", t.unit_key(C("label")).alias("key")).distinct()
    new = text_units.select("page_id", C("unit").alias("key")).distinct().join(seen, ["page_id", "key"], "left_anti")
    return units.select("page_id", t.unit_key(C("label")).alias("key"), F.lit("detected").alias("source")).distinct().unionByName(new.withColumn("source", F.lit("text")))


_AREA = r"(\d+(?:\.\d+)?)\s*(?:m²|m2|sqm)"
_LENGTH = r"(\d+(?:\.\d+)?)\s*m"
#: The rules that a policy text may name: code, kind, bedrooms, pattern (its group is the number), and the number where the text has none.
TEXT_RULES = (
    ("RDS-APT-SIZE", "apartment_min_internal", 0, rf"studio[^.]{{0,80}}?{_LENGTH}", 35.0), ("RDS-APT-SIZE", "apartment_min_internal", 1, rf"1[-\s]?bed(?:room)?[^.]{{0,80}}?{_LENGTH}", 50.0),
    ("RDS-APT-SIZE", "apartment_min_internal", 2, rf"2[-\s]?bed(?:room)?[^.]{{0,80}}?{_LENGTH}", 70.0), ("RDS-APT-SIZE", "apartment_min_internal", 3, rf"3[-\s]?bed(?:room)?[^.]{{0,80}}?{_LENGTH}", 90.0),
    ("RDS-BED-MIN", "apartment_min_bedroom", None, rf"bedroom[^.]{{0,60}}?{_AREA}", 9.0), ("RDS-LIVING-MIN", "apartment_min_living", None, rf"living[^.]{{0,60}}?{_AREA}", 12.0),
    *(("RDS-POS-MIN", "apartment_min_pos", n, rf"(?:private open space|balcony)[^.]{{0,80}}?{_AREA}", 8.0) for n in range(4)),
    ("RDS-ASPECT-DUAL", "apartment_dual_aspect", None, r"dual aspect|windows on two sides|natural ventilation()", None),
    ("RDS-HAB-WINDOW", "habitable_has_window", None, r"habitable.{0,50}window|bedroom.{0,40}window|each room.{0,30}window()", None),
    ("RDS-STORAGE", "apartment_min_storage", None, r"storage|wardrobe|robe()", 1.0),
    ("RDS-COMMUNAL", "communal_open_space", None, rf"communal[^.]{{0,80}}?{_AREA}.{{0,40}}(?:dwelling|apartment)", 2.5),
)


def threshold_rules_from_text(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text) the rules that its text names: code, kind, bedrooms, minimum.  A rule
    by bedrooms has all its rows once one is named, with the usual numbers for the others."""
    flat = F.regexp_replace("text", r"\s+", " ")

    def row(code, kind, bedrooms, pattern, default):
        number = F.regexp_extract(flat, "(?i)" + pattern, 1)
        return F.struct(
            F.lit(code).alias("code"), F.lit(kind).alias("kind"), F.lit(bedrooms).cast("int").alias("bedrooms"), flat.rlike("(?i)" + pattern).alias("named"),
            F.coalesce(F.when(number != "", number).cast("double"), F.lit(default).cast("double")).alias("minimum"),
        )

    rows = docs.select("doc_id", F.array(*(row(*r) for r in TEXT_RULES)).alias("rows"))
    rows = rows.withColumn("codes", F.transform(F.filter("rows", lambda r: r["named"]), lambda r: r["code"]))
    return rows.select("doc_id", F.explode(F.filter("rows", lambda r: F.array_contains("codes", r["code"]))).alias("r")).select("doc_id", "r.code", "r.kind", "r.bedrooms", "r.minimum")


def bridge_rules(rules: DataFrame, guidelines: DataFrame) -> DataFrame:
    """The rules, and a rule for each mapped guideline (clause, title, mapped_kind) without one of
    its kind; a scale is needed except by aspect and window kinds."""
    have = rules.select(C("kind").alias("mapped_kind")).distinct()
    new = guidelines.where("mapped_kind IS NOT NULL").join(F.broadcast(have), "mapped_kind", "left_anti")
    made = new.select(C("clause").alias("code"), C("mapped_kind").alias("kind"), (~C("mapped_kind").isin("apartment_dual_aspect", "habitable_has_window")).alias("requires_scale"))
    return rules.select("code", "kind", "requires_scale").unionByName(made)


def class_legend(datasets: DataFrame, stock: DataFrame, defaults: list[str]) -> DataFrame:
    """The training legend of each data set (dataset_id, purpose, class_name, ord): its classes
    without the stock names (purpose, class_name) of other purposes; a north-arrow data set has one
    class; without any the defaults stand."""
    foreign = F.broadcast(stock.select(C("purpose").alias("_p"), C("class_name").alias("_c")))
    own = datasets.join(foreign, (C("class_name") == C("_c")) & (C("purpose") != C("_p")), "left_anti")
    kept = own.groupBy("dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "class_name"))), lambda r: r["class_name"]).alias("classes"))
    ids = datasets.select("dataset_id", "purpose").distinct()
    legend = F.when(C("purpose") == "north", F.array(F.lit("north_arrow"))).otherwise(F.coalesce("classes", F.array(*(F.lit(d) for d in defaults))))
    return ids.join(kept, "dataset_id", "left").select("dataset_id", "purpose", F.array_join(legend, ",").alias("legend"))


def crop_purpose(crops: DataFrame, catalog: DataFrame) -> DataFrame:
    """The first category (category, legend, ord) whose legend holds all labels of a crop
    (crop_id, labels, source), else the source's category."""
    fits = crops.join(F.broadcast(catalog), F.size(F.array_except("labels", "legend")) == 0)
    best = fits.groupBy("crop_id").agg(F.min_by("category", "ord").alias("category"))
    return crops.join(best, "crop_id", "left").select("crop_id", F.coalesce("category", "source").alias("category"))
