"""Design-policy rules as set-based plans over all pages at once.

Results have page_id, unit_id ("building" for the page), rule_code, result (pass, fail, uncertain,
not_applicable), measured, required, confidence.  Missing evidence never passes.  Rules are few
(a policy pack), so they are broadcast; rooms and units stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from . import spatial

C = F.col
OUT = ("page_id", "unit_id", "rule_code", "result", "measured", "required", "confidence")
#: The catalogue's default thresholds.
DEFAULTS = {"living": 12.0, "pos": 8.0, "bedroom": 9.0, "bathrooms": 1.0, "storage": 1.0}


def label_match(label: Column, needle: Column) -> Column:
    """Either holds the other, in lower case; an empty label matches everything."""
    a, b = F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lower(F.trim(needle))
    return a.contains(b) | b.contains(a)


def _rows(df: DataFrame, unit: Column, result: Column, measured: Column | None = None, required: Column | None = None, confidence: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(
        "page_id", unit.cast("string").alias("unit_id"), C("code").alias("rule_code"), result.alias("result"),
        (none if measured is None else measured.cast("double")).alias("measured"), (none if required is None else required.cast("double")).alias("required"),
        (F.lit(0.8) if confidence is None else confidence).alias("confidence"),
    )



def _building() -> Column:
    return F.lit("building")


def unscaled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One uncertain row for each rule that needs a scale on each page without one."""
    return _rows(pages.where("ppm IS NULL OR ppm <= 0").crossJoin(F.broadcast(rules.where("requires_scale"))), _building(), F.lit("uncertain"), confidence=F.lit(0.4))


def _ready(pages: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """Pages with the rules of a kind that can be judged there."""
    own = F.broadcast(rules.where(C("kind") == kind))
    return pages.join(own, ~C("requires_scale") | F.coalesce(C("ppm") > 0, F.lit(False)))


def required_labels(rules: DataFrame, pages: DataFrame, rooms: DataFrame) -> DataFrame:
    """A page fails a rule whose needed label matches no room of it."""
    ready = _ready(pages, rules, "required_labels")
    found = rooms.select("page_id", "label").distinct().join(F.broadcast(rules.where("kind = 'required_labels'").select("code", "needle")), label_match(C("label"), C("needle")))
    met = found.select("page_id", "code", F.lit(True).alias("met")).distinct()
    return _rows(ready.join(met, ["page_id", "code"], "left"), _building(), F.when(C("met"), "pass").otherwise("fail"))


def min_wall_count(rules: DataFrame, pages: DataFrame, walls: DataFrame) -> DataFrame:
    """Enough walls on the page, else uncertain."""
    n = walls.groupBy("page_id").agg(F.count("*").alias("n"))
    ready = _ready(pages, rules, "min_wall_count").join(n, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _rows(ready, _building(), F.when(C("n") >= C("min_area"), "pass").otherwise("uncertain"), C("n"), C("min_area"))


def room_min_area(rules: DataFrame, pages: DataFrame, rooms: DataFrame) -> DataFrame:
    """A row for each matching room; without one the page fails, or the rule does not apply if
    it is optional."""
    own = rules.where("kind = 'room_min_area'")
    area = F.round(g.area_m2(C("area_px"), C("ppm")), 6)
    hits = rooms.join(pages.select("page_id", "ppm"), "page_id").join(F.broadcast(own), label_match(C("label"), C("needle")) & (~C("requires_scale") | F.coalesce(C("ppm") > 0, F.lit(False))))
    result = F.when(area.isNull(), "uncertain").when(area >= C("min_area"), "pass").otherwise("fail")
    judged = _rows(hits, C("room_id"), result, area, C("min_area"), F.when(area.isNull(), 0.5).otherwise(C("confidence")))
    none = _ready(pages, rules, "room_min_area").join(hits.select("page_id", "code").distinct(), ["page_id", "code"], "left_anti")
    return judged.unionByName(_rows(none, _building(), F.when(C("optional"), "not_applicable").otherwise("fail")))


def communal_open_space(rules: DataFrame, communal: DataFrame) -> DataFrame:
    """The page's shared outdoor area against a fixed need or one per dwelling."""
    df = communal.crossJoin(F.broadcast(rules.where("kind = 'communal_open_space'")))
    need = F.coalesce(C("min_area"), C("per_dwelling") * F.greatest(C("dwellings"), F.lit(1)))
    missing = ~C("present") | C("communal_m2").isNull()
    result = F.when(missing & need.isNull(), "not_applicable").when(missing, "fail").when(need.isNull() | (C("communal_m2") >= need), "pass").otherwise("fail")
    return _rows(df, _building(), result, F.when(~missing, C("communal_m2")), need)


def _band(rule: str = "by_bedrooms") -> Column:
    """The threshold of a unit's bedroom band: 0, 1, 2, or 3 and more."""
    return F.try_element_at(C(rule), F.least(C("bedrooms"), F.lit(3)).cast("string"))


def per_unit(rules: DataFrame, units: DataFrame, kind: str, judge: Callable[[], tuple[Column, Column | None, Column | None]], keep: Column | None = None) -> DataFrame:
    df = units.crossJoin(F.broadcast(rules.where(C("kind") == kind)))
    df = df.where(~C("requires_scale") | F.coalesce(C("ppm") > 0, F.lit(False)))
    result, measured, required = judge()
    df = df if keep is None else df.where(keep)
    return _rows(df, C("unit_id"), result, measured, required)


def _at_least(measured: Column, required: Column) -> Column:
    return F.when(measured.isNull() | required.isNull(), "uncertain").when(measured >= required, "pass").otherwise("fail")


def min_internal(rules, units):
    """P5: internal area by bedroom band; a missing measure or band is uncertain."""
    return per_unit(rules, units, "apartment_min_internal", lambda: (_at_least(C("internal_m2"), _band()), C("internal_m2"), _band()))


def min_living(rules, units):
    """Living area by band or fixed; no threshold gives no row, no living room is uncertain."""
    need = F.coalesce(_band(), C("min_area"))
    return per_unit(rules, units, "apartment_min_living", lambda: (_at_least(C("living_m2"), need), C("living_m2"), need), need.isNotNull())


def min_pos(rules, units):
    """Private open space (balcony and courtyard) by band, fixed, or 8; none fails."""
    need, own = F.coalesce(_band(), C("min_area"), F.lit(DEFAULTS["pos"])), F.coalesce(C("open_m2"), F.lit(0.0))
    return per_unit(rules, units, "apartment_min_pos", lambda: (F.when((C("open_rooms") > 0) & (own >= need), "pass").otherwise("fail"), own, need))


def min_bedroom(rules, bedrooms, units):
    """Each bedroom's area and, where known, shorter side; a studio is not judged."""
    b = bedrooms.crossJoin(F.broadcast(rules.where("kind = 'apartment_min_bedroom'"))).where(~C("requires_scale") | F.coalesce(C("ppm") > 0, F.lit(False)))
    ok = (C("area_m2") >= F.coalesce(C("min_area"), F.lit(DEFAULTS["bedroom"]))) & F.coalesce(C("side_m") >= C("min_side"), F.lit(True))
    rooms = _rows(b, C("room_id"), F.when(C("area_m2").isNull(), "uncertain").when(ok, "pass").otherwise("fail"), C("area_m2"), F.coalesce(C("min_area"), F.lit(DEFAULTS["bedroom"])))
    none = per_unit(rules, units.where("bedrooms = 0"), "apartment_min_bedroom", lambda: (F.lit("not_applicable"), None, None))
    return rooms.unionByName(none)


def min_bathrooms(rules, units):
    """Bathrooms, one if the rule names no number."""
    need = F.coalesce(C("min_area"), F.lit(DEFAULTS["bathrooms"]))
    return per_unit(rules, units, "apartment_min_bathrooms", lambda: (_at_least(C("bathrooms"), need), C("bathrooms"), need))


def min_storage(rules, units):
    """P10: storage rooms."""
    need = F.coalesce(C("min_area"), F.lit(DEFAULTS["storage"]))
    return per_unit(rules, units, "apartment_min_storage", lambda: (_at_least(C("stores"), need), C("stores"), need))


def dual_aspect(rules, units):
    """Windows on two sides pass, on one side fail, none known is uncertain."""
    two = F.when(C("sides").isNull() | (C("sides") == 0), "uncertain").when(C("sides") >= 2, "pass").otherwise("fail")
    return per_unit(rules, units, "apartment_dual_aspect", lambda: (two, C("sides"), F.lit(2)))


def habitable_has_window(rules, habitable):
    """A page's habitable rooms without a window fail it; no habitable room is uncertain."""
    df = habitable.crossJoin(F.broadcast(rules.where("kind = 'habitable_has_window'")))
    result = F.when(C("habitable") == 0, "uncertain").when(C("missing") == 0, "pass").otherwise("fail")
    return _rows(df, _building(), result, C("missing"))


def rooms_of(entities: DataFrame) -> DataFrame:
    """Rooms with their area in pixels."""
    return spatial.of_type(entities, "room").select("page_id", C("entity_id").alias("room_id"), "ord", "label", "confidence", "points", "bbox", g.poly_area(C("points")).alias("area_px"))


def unit_measures(entities: DataFrame, contained: DataFrame, pages: DataFrame) -> DataFrame:
    """Apartment columns of every unit: rooms by kind, areas in square metres (null without any or
    without scale), distinct sides that windows face (by box quadrant of the unit)."""
    rooms = contained.join(rooms_of(entities).select("room_id", "area_px"), "room_id").join(pages.select("page_id", "ppm"), "page_id")
    rooms = rooms.withColumn("kind", t.room_kind(C("room_label"))).withColumn("m2", g.area_m2(C("area_px"), C("ppm")))
    living, store = t.normalise_label(C("room_label")).rlike(r"\b(living|lounge|family|dining)\b"), t.normalise_label(C("room_label")).rlike(r"\b(store|storage|robe|wardrobe|linen)\b")
    of = lambda cond: F.round(F.sum(F.when(cond, C("m2"))), 6)
    n = lambda cond: F.count(F.when(cond, 1))
    k = C("kind")
    per = rooms.groupBy("page_id", "unit_id").agg(
        n(k == "bedroom").alias("bedrooms"), n(k == "bathroom").alias("bathrooms"), n(k == "toilet").alias("toilets"), n(store).alias("stores"),
        of(k.isin("bedroom", "bathroom", "toilet", "internal")).alias("internal_m2"), of(living).alias("living_m2"), of(k.isin("balcony", "courtyard")).alias("open_m2"),
        n(k.isin("balcony", "courtyard")).alias("open_rooms"),
    )
    zero = ["bedrooms", "bathrooms", "toilets", "stores", "open_rooms"]
    units = spatial.of_type(entities, "unit_boundary").select("page_id", C("entity_id").alias("unit_id"), "label").join(pages.select("page_id", "ppm"), "page_id")
    return units.join(per, ["page_id", "unit_id"], "left").fillna(0, zero)


def evaluate(rules: DataFrame, pages: DataFrame, entities: DataFrame) -> DataFrame:
    """The page rules P1 to P3 and the rules that wait for a scale, in one table."""
    rooms, walls = rooms_of(entities), spatial.of_type(entities, "wall")
    parts = [unscaled(pages, rules), required_labels(rules, pages, rooms), min_wall_count(rules, pages, walls), room_min_area(rules, pages, rooms)]
    return reduce(DataFrame.unionByName, parts)


def needs_review(compliance: DataFrame) -> DataFrame:
    """Rows to look at and the status of each page."""
    open_ = F.count(F.when(C("result").isin("fail", "uncertain"), 1))
    unscaled_ = F.max((C("confidence") == 0.4).cast("int")) == 1
    return compliance.groupBy("page_id").agg(open_.alias("open"), F.when((open_ > 0) | unscaled_, "review_required").otherwise("completed").alias("status"))
