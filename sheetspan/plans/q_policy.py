"""Queries of the policy rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import filters, policy, spatial
from ..workspace import stage
from .fixtures import entities, kept_entities, views
from .q_spatial import CENTRED, ROOMS, UNIT_ROOMS, room_graph
from .registry import query

C = F.col
APT = "code string, kind string, min_area double, min_side double, per_dwelling double, requires_scale boolean, by_bedrooms map<string,double>"
#: Apartment rules with the default bands.
APT_RULES = [
    ("INT", "apartment_min_internal", None, None, None, True, {"0": 35.0, "1": 50.0, "2": 70.0, "3": 90.0}), ("LIV", "apartment_min_living", 12.0, None, None, True, {}),
    ("POS", "apartment_min_pos", None, None, None, True, {}), ("BED", "apartment_min_bedroom", 9.0, 2.5, None, True, {}), ("BATH", "apartment_min_bathrooms", None, None, None, False, {}),
    ("STO", "apartment_min_storage", None, None, None, False, {}), ("DUAL", "apartment_dual_aspect", None, None, None, False, {}), ("WIN", "habitable_has_window", None, None, None, False, {}),
    ("COM", "communal_open_space", None, None, 2.5, True, {}),
]


def _apt(spark):
    return spark.createDataFrame(APT_RULES, APT)


def _live(spark, sf_dir):
    return filters.live(entities(spark, sf_dir))


LIVE = "l_entities AS (SELECT e.*, w * h * 9 / 8 AS area_px FROM d_entities e WHERE status <> 'rejected')"
MATCH = "(contains(lower(e.label), r.needle) OR contains(r.needle, lower(e.label)))"
SCALED = "(NOT r.requires_scale OR coalesce(p.ppm > 0, false))"
PAGE_RULES = f"""{LIVE}, rooms AS (SELECT * FROM l_entities WHERE type = 'room'),
hits AS (SELECT e.page_id, e.entity_id, e.confidence, r.code, r.min_area, round(e.area_px / (p.ppm * p.ppm), 6) AS m2 FROM rooms e JOIN d_pages p USING (page_id) JOIN d_rules r ON r.kind = 'room_min_area' AND {MATCH} AND {SCALED}),
results AS (
 SELECT p.page_id, 'building' AS unit_id, r.code AS rule_code, 'uncertain' AS result, NULL::DOUBLE AS measured, NULL::DOUBLE AS required, 0.4::DOUBLE AS confidence FROM d_pages p, d_rules r WHERE r.requires_scale AND p.ppm IS NULL
 UNION ALL SELECT p.page_id, 'building', r.code, CASE WHEN EXISTS (SELECT 1 FROM rooms e WHERE e.page_id = p.page_id AND {MATCH}) THEN 'pass' ELSE 'fail' END, NULL, NULL, 0.8 FROM d_pages p, d_rules r WHERE r.kind = 'required_labels'
 UNION ALL SELECT p.page_id, 'building', r.code, CASE WHEN coalesce(n, 0) >= r.min_area THEN 'pass' ELSE 'uncertain' END, coalesce(n, 0)::DOUBLE, r.min_area, 0.8 FROM d_pages p JOIN d_rules r ON r.kind = 'min_wall_count'
   LEFT JOIN (SELECT page_id, count(*) AS n FROM l_entities WHERE type = 'wall' GROUP BY 1) w ON w.page_id = p.page_id
 UNION ALL SELECT page_id, CAST(entity_id AS VARCHAR), code, CASE WHEN m2 >= min_area THEN 'pass' ELSE 'fail' END, m2, min_area, confidence FROM hits
 UNION ALL SELECT p.page_id, 'building', r.code, CASE WHEN r.optional THEN 'not_applicable' ELSE 'fail' END, NULL, NULL, 0.8 FROM d_pages p JOIN d_rules r ON r.kind = 'room_min_area' AND {SCALED}
   WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.page_id = p.page_id AND h.code = r.code))"""


def page_rules(spark, sf_dir):
    return policy.evaluate(views(spark, sf_dir, "d_rules"), views(spark, sf_dir, "d_pages"), _live(spark, sf_dir))


@query(f"WITH {PAGE_RULES} SELECT * FROM results")
def p1_p2_p3_page_rules(spark, sf_dir):
    return page_rules(spark, sf_dir)


@query(f"""WITH {PAGE_RULES} SELECT building_id, rule_code, count(*) AS failed, count(DISTINCT page_id) AS pages FROM results JOIN d_pages USING (page_id) WHERE result = 'fail' GROUP BY 1, 2""")
def flagship_failed_rules_by_building(spark, sf_dir):
    pages = views(spark, sf_dir, "d_pages").select("page_id", "building_id")
    failed = page_rules(spark, sf_dir).where("result = 'fail'").join(pages, "page_id")
    return failed.groupBy("building_id", "rule_code").agg(F.count("*").alias("failed"), F.countDistinct("page_id").alias("pages"))


@query(f"""WITH {PAGE_RULES} SELECT page_id, count(*) FILTER (result IN ('fail', 'uncertain')) AS open, CASE WHEN count(*) FILTER (result IN ('fail', 'uncertain')) > 0 OR max((confidence = 0.4)::INT) = 1 THEN 'review_required' ELSE 'completed' END AS status FROM results GROUP BY 1""")
def a18_needs_review(spark, sf_dir):
    return policy.needs_review(page_rules(spark, sf_dir))


KINDED = """CASE WHEN room_label IN ('Bathroom', 'Ensuite') THEN 'bathroom' WHEN room_label IN ('Bedroom', 'master_bedroom') THEN 'bedroom' WHEN room_label = 'Balcony' THEN 'balcony' ELSE 'internal' END"""
UNITS = f"""c_entities AS {CENTRED}, {UNIT_ROOMS}, measured AS (SELECT r.*, {KINDED} AS kind, p.ppm, e.w, e.h, e.w * e.h * 9 / 8 / (p.ppm * p.ppm) AS m2 FROM u_rooms r JOIN d_entities e ON e.entity_id = r.room_id JOIN d_pages p ON p.page_id = r.page_id),
per AS (SELECT page_id, unit_id, count(*) FILTER (kind = 'bedroom') AS bedrooms, count(*) FILTER (kind = 'bathroom') AS bathrooms, 0::BIGINT AS toilets, count(*) FILTER (room_label = 'Store') AS stores, round(sum(m2) FILTER (kind IN ('bedroom', 'bathroom', 'internal')), 6) AS internal_m2,
  round(sum(m2) FILTER (room_label = 'Open Living'), 6) AS living_m2, round(sum(m2) FILTER (kind = 'balcony'), 6) AS open_m2, count(*) FILTER (kind = 'balcony') AS open_rooms FROM measured GROUP BY 1, 2),
units AS (SELECT e.page_id, e.entity_id AS unit_id, e.label, p.ppm, coalesce(bedrooms, 0) AS bedrooms, coalesce(bathrooms, 0) AS bathrooms, coalesce(toilets, 0) AS toilets, coalesce(stores, 0) AS stores, internal_m2, living_m2, open_m2, coalesce(open_rooms, 0) AS open_rooms
  FROM d_entities e JOIN d_pages p USING (page_id) LEFT JOIN per ON per.unit_id = e.entity_id WHERE e.type = 'unit_boundary')"""


def units(spark, sf_dir):
    df = kept_entities(spark, sf_dir)
    return policy.unit_measures(df, spatial.unit_rooms(df), views(spark, sf_dir, "d_pages"))


@query(f"WITH {UNITS} SELECT * FROM units")
def a4_apartment_columns(spark, sf_dir):
    return units(spark, sf_dir)


_SHAPE = "page_id, CAST(unit_id AS VARCHAR) AS unit_id, '{0}' AS rule_code, {1} AS result, CAST({2} AS DOUBLE) AS measured, CAST({3} AS DOUBLE) AS required, 0.8::DOUBLE AS confidence FROM units"
_LEAST = "CASE WHEN {0} IS NULL THEN 'uncertain' WHEN {0} >= {1} THEN 'pass' ELSE 'fail' END"
_NEED = "[35, 50, 70, 90][least(bedrooms, 3) + 1]"


@query(f"WITH {UNITS} SELECT {_SHAPE.format('INT', _LEAST.format('internal_m2', _NEED), 'internal_m2', _NEED)} WHERE ppm > 0")
def p5_min_internal(spark, sf_dir):
    return policy.min_internal(_apt(spark), units(spark, sf_dir))


@query(f"WITH {UNITS} SELECT {_SHAPE.format('LIV', _LEAST.format('living_m2', 12), 'living_m2', 12)} WHERE ppm > 0")
def p6_min_living(spark, sf_dir):
    return policy.min_living(_apt(spark), units(spark, sf_dir))


@query(f"""WITH {UNITS} SELECT {_SHAPE.format("POS", "CASE WHEN open_rooms > 0 AND open_m2 >= 8 THEN 'pass' ELSE 'fail' END", "coalesce(open_m2, 0)", 8)} WHERE ppm > 0""")
def p7_min_open_space(spark, sf_dir):
    return policy.min_pos(_apt(spark), units(spark, sf_dir))


@query(f"""WITH {UNITS}, beds AS (SELECT DISTINCT page_id, room_id, round(m2, 6) AS m2, round(least(w, h * 1.25) / ppm, 6) AS side FROM measured WHERE kind = 'bedroom' AND ppm > 0)
SELECT page_id, CAST(room_id AS VARCHAR) AS unit_id, 'BED' AS rule_code, CASE WHEN m2 >= 9 AND side >= 2.5 THEN 'pass' ELSE 'fail' END AS result, m2 AS measured, 9::DOUBLE AS required, 0.8::DOUBLE AS confidence FROM beds
UNION ALL SELECT {_SHAPE.format("BED", "'not_applicable'", "NULL", "NULL")} WHERE ppm > 0 AND bedrooms = 0""")
def p8_min_bedroom(spark, sf_dir):
    df, pages = kept_entities(spark, sf_dir), stage(views(spark, sf_dir, "d_pages").select("page_id", "ppm"), "pages")
    contained = stage(spatial.unit_rooms(df).select("page_id", "unit_id", "room_id", "room_label"), "contained")
    rooms = policy.rooms_of(df).join(contained.select("room_id").distinct(), "room_id").where(t.room_kind(C("label")) == "bedroom").join(pages.select("page_id", "ppm"), "page_id")
    beds = rooms.select("page_id", "room_id", "ppm", F.round(g.area_m2(C("area_px"), C("ppm")), 6).alias("area_m2"), F.round(g.len_m(g.min_width(C("points")), C("ppm")), 6).alias("side_m"))
    return policy.min_bedroom(_apt(spark), beds, policy.unit_measures(df, contained, pages))


@query(f"WITH {UNITS} SELECT {_SHAPE.format('BATH', _LEAST.format('bathrooms', 1), 'bathrooms', 1)}")
def p9_min_bathrooms(spark, sf_dir):
    return policy.min_bathrooms(_apt(spark), units(spark, sf_dir))


@query(f"WITH {UNITS} SELECT {_SHAPE.format('STO', _LEAST.format('stores', 1), 'stores', 1)}")
def p10_min_storage(spark, sf_dir):
    return policy.min_storage(_apt(spark), units(spark, sf_dir))


SIDES = """(SELECT u.entity_id AS unit_id, count(DISTINCT CASE WHEN v.w >= v.h THEN CASE WHEN v.y < u.y + u.h / 2 THEN 'N' ELSE 'S' END ELSE CASE WHEN v.x + v.w > u.x + u.w / 2 THEN 'E' ELSE 'W' END END) AS sides
  FROM d_entities u JOIN d_entities v ON u.page_id = v.page_id AND v.type = 'window' AND v.x + v.w / 2 BETWEEN u.x AND u.x + u.w AND v.y + v.h / 2 BETWEEN u.y AND u.y + u.h WHERE u.type = 'unit_boundary' GROUP BY 1)"""


@query(f"""SELECT e.page_id, CAST(e.entity_id AS VARCHAR) AS unit_id, 'DUAL' AS rule_code, CASE WHEN coalesce(sides, 0) = 0 THEN 'uncertain' WHEN sides >= 2 THEN 'pass' ELSE 'fail' END AS result, CAST(sides AS DOUBLE) AS measured, 2::DOUBLE AS required, 0.8::DOUBLE AS confidence
FROM d_entities e LEFT JOIN {SIDES} s ON s.unit_id = e.entity_id WHERE e.type = 'unit_boundary'""")
def p11_dual_aspect(spark, sf_dir):
    df = entities(spark, sf_dir)
    u = spatial.of_type(df, "unit_boundary").select("page_id", C("entity_id").alias("unit_id"), C("bbox").alias("ubox"))
    v = spatial.of_type(df, "window").withColumn("vbox", g.box(C("x") + C("w") / 2, C("y") + C("h") / 2, F.lit(0), F.lit(0))).select("page_id", "vbox", "x", "y", "w", "h")
    ub = C("ubox")
    side = F.when(C("w") >= C("h"), F.when(C("y") < ub["y"] + ub["height"] / 2, "N").otherwise("S")).otherwise(F.when(C("x") + C("w") > ub["x"] + ub["width"] / 2, "E").otherwise("W"))
    sides = spatial.box_pairs(v, u, "vbox", "ubox").groupBy("unit_id").agg(F.countDistinct(side).alias("sides"))
    return policy.dual_aspect(_apt(spark), u.join(sides, "unit_id", "left").withColumn("ppm", F.lit(None).cast("double")))


@query(f"""WITH {ROOMS}, h AS (SELECT r.page_id, count(*) AS habitable FROM g_rooms r WHERE label IN ('Bedroom', 'master_bedroom', 'Open Living') GROUP BY 1)
SELECT p.page_id, 'building' AS unit_id, 'WIN' AS rule_code, CASE WHEN habitable IS NULL THEN 'uncertain' WHEN m.missing IS NULL THEN 'pass' ELSE 'fail' END AS result, coalesce(m.missing, 0)::DOUBLE AS measured, NULL::DOUBLE AS required, 0.8::DOUBLE AS confidence
FROM d_pages p LEFT JOIN h USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS missing FROM g_rooms r WHERE label IN ('Bedroom', 'master_bedroom', 'Open Living')
  AND NOT EXISTS (SELECT 1 FROM d_entities v WHERE v.page_id = r.page_id AND v.type = 'window' AND v.x + v.w / 2 BETWEEN r.x AND r.x + r.w AND v.y + v.h / 2 BETWEEN r.y AND r.y + r.h) GROUP BY 1) m USING (page_id)""")
def p12_habitable_windows(spark, sf_dir):
    df, pages = entities(spark, sf_dir), views(spark, sf_dir, "d_pages").select("page_id")
    rooms = spatial.of_type(df, "room").where(t.is_habitable(C("label")) & ~t.is_common(C("label"))).select("page_id", C("entity_id").alias("room_id"), C("bbox").alias("rbox"))
    v = spatial.of_type(df, "window").select("page_id", g.box(C("x") + C("w") / 2, C("y") + C("h") / 2, F.lit(0), F.lit(0)).alias("vbox"))
    lit = spatial.box_pairs(v, rooms, "vbox", "rbox").select("room_id", F.lit(1).alias("lit")).distinct()
    per = rooms.join(lit, "room_id", "left").groupBy("page_id").agg(F.count("*").alias("habitable"), F.count(F.when(C("lit").isNull(), 1)).alias("missing"))
    return policy.habitable_has_window(_apt(spark), pages.join(per, "page_id", "left").fillna(0, ["habitable", "missing"]))


COMMUNAL = """communal AS (SELECT p.page_id, p.ppm, count(e.entity_id) AS n, round(sum(e.w * e.h * 9 / 8) / (p.ppm * p.ppm), 6) AS communal_m2, coalesce(u.n, 0) AS dwellings
  FROM d_pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM d_entities WHERE type = 'unit_boundary' GROUP BY 1) u ON u.page_id = p.page_id
  LEFT JOIN d_entities e ON e.page_id = p.page_id AND e.type = 'room' AND e.label = 'Communal Outdoor Garden' GROUP BY p.page_id, p.ppm, u.n)"""


def communal(spark, sf_dir):
    df, pages = entities(spark, sf_dir), views(spark, sf_dir, "d_pages").select("page_id", "ppm")
    outdoor = policy.rooms_of(df).where(t.room_kind(C("label")) == "communal_outdoor").groupBy("page_id").agg(F.sum("area_px").alias("px"))
    n = spatial.of_type(df, "unit_boundary").groupBy("page_id").agg(F.count("*").alias("dwellings"))
    out = pages.join(outdoor, "page_id", "left").join(n, "page_id", "left").fillna(0, ["dwellings"])
    return out.select("page_id", "ppm", C("px").isNotNull().alias("present"), F.round(g.area_m2(C("px"), C("ppm")), 6).alias("communal_m2"), "dwellings")


@query(f"WITH {COMMUNAL} SELECT page_id, ppm, n > 0 AS present, CASE WHEN n > 0 THEN communal_m2 END AS communal_m2, dwellings FROM communal")
def a5_communal_summary(spark, sf_dir):
    return communal(spark, sf_dir)


@query(f"""WITH {COMMUNAL} SELECT page_id, 'building' AS unit_id, 'COM' AS rule_code, CASE WHEN n = 0 OR communal_m2 IS NULL THEN 'fail' WHEN communal_m2 >= 2.5 * greatest(dwellings, 1) THEN 'pass' ELSE 'fail' END AS result,
CASE WHEN n > 0 THEN communal_m2 END AS measured, 2.5::DOUBLE * greatest(dwellings, 1) AS required, 0.8::DOUBLE AS confidence FROM communal""")
def p4_communal_open_space(spark, sf_dir):
    return policy.communal_open_space(_apt(spark), communal(spark, sf_dir))
