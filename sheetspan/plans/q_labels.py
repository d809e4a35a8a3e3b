"""Queries of label resolution, assignments and rule tables."""

from __future__ import annotations

import ast

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import labels, rollup, spatial
from ..workspace import table
from .fixtures import entities, kept_entities, views
from .q_columns import AREA
from .q_spatial import CENTRED, OPENINGS, ROOMS, UNIT_ROOMS, WALLS, _vertex_to_box, inside, rects, room_graph
from .q_text import policy_lines
from .registry import query

C = F.col
_SPELLED = "['Living', 'Toilet', 'Double Door', 'Home Office', 'Compass', 'squat toilet', 'Rest-room', 'half_height cabinet', 'Company  Area', 'waiting', 'North arrow', 'elevator', 'Communal Space', 'TV_cabinet']"


@query(f"""WITH l AS (SELECT CASE WHEN entity_id % 4 = 1 THEN {_SPELLED}[entity_id % 14 + 1] WHEN entity_id % 3 = 0 THEN upper(label) ELSE label END AS label FROM d_entities),
n AS (SELECT label, trim(regexp_replace(lower(label), '[_\\-\\s]+', ' ', 'g')) AS k, count(*) AS regions FROM l GROUP BY 1)
SELECT label, regions, CASE WHEN label = 'Living' THEN 'Open Living' WHEN label = 'Toilet' THEN 'Bathroom' WHEN label = 'Double Door' THEN 'Single Door' WHEN label = 'Home Office' THEN 'Bedroom'
    WHEN label IN ('Bedroom', 'Bathroom', 'Ensuite', 'Open Living', 'Lobby', 'Balcony', 'Store', 'Communal Space', 'Wall', 'External Wall', 'Single Door', 'Sliding Door', 'Main Door', 'Window', 'Stair', 'Lift') THEN label END AS canonical,
  CASE WHEN k IN ('bedroom', 'bathroom', 'ensuite', 'open living', 'lobby', 'balcony', 'store', 'room', 'communal space', 'toilet', 'squat toilet', 'rest room', 'company area', 'waiting', 'sink', 'tv cabinet') THEN 'room' WHEN k IN ('wall', 'external wall') THEN 'wall'
    WHEN k IN ('single door', 'main door', 'double door') THEN 'door' WHEN k = 'window' THEN 'window' WHEN k IN ('compass', 'north arrow') THEN 'north_arrow' WHEN k = 'half height cabinet' THEN 'fixture' ELSE 'other' END AS entity_type,
  CASE WHEN k IN ('open living', 'tv cabinet') THEN 'living' WHEN k IN ('ensuite', 'toilet', 'squat toilet', 'rest room', 'sink') THEN 'bathroom' WHEN k = 'compass' THEN 'north_arrow' WHEN k = 'company area' THEN 'office'
    WHEN k = 'communal space' THEN 'common_corridor' ELSE replace(k, ' ', '_') END AS room_type FROM n""")
def x2_resolved_labels(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ast.literal_eval(_SPELLED)))
    spelled = F.when(C("entity_id") % 4 == 1, F.element_at(names, (C("entity_id") % 14 + 1).cast("int"))).when(C("entity_id") % 3 == 0, F.upper("label")).otherwise(C("label"))
    return labels.resolve_labels(entities(spark, sf_dir).groupBy(spelled.alias("label")).agg(F.count("*").alias("regions")))


_FAR = "sqrt((r.cx - d.cx) * (r.cx - d.cx) + (r.cy - d.cy) * (r.cy - d.cy))"


@query(f"""WITH e AS (SELECT *, {AREA} AS area FROM {CENTRED}), p AS (SELECT r.page_id, r.entity_id AS room_id, d.label, d.ord, round(CASE WHEN {inside("r.cx", "r.cy", "d")} AND {inside("d.cx", "d.cy", "r")} THEN 10000 + least(r.area, d.area) WHEN {inside("r.cx", "r.cy", "d")} OR {inside("d.cx", "d.cy", "r")} THEN 10000 - {_FAR} ELSE 5000 - {_FAR} END, 6) AS score
  FROM e r JOIN e d ON r.page_id = d.page_id AND d.type = 'room' AND d.label <> 'Room' WHERE r.type = 'room' AND r.label = 'Room'), k AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY score DESC, ord) AS n FROM p WHERE score > 0) SELECT page_id, room_id, label FROM k WHERE n = 1""")
def j14_labels_from_detections(spark, sf_dir):
    rooms = spatial.of_type(entities(spark, sf_dir), "room")
    return labels.label_rooms_from_detections(rooms.withColumn("room_id", C("entity_id")), rooms)


@query("""WITH u AS (SELECT page_id, entity_id AS unit_id, label[6:] AS key, count(*) OVER (PARTITION BY page_id) AS n FROM d_entities WHERE type = 'unit_boundary'), h AS (SELECT page_id, ord, CASE WHEN ord % 2 = 0 THEN CAST(ord % 40 AS VARCHAR) END AS unit_key, ord % 4 AS bedrooms FROM d_ocr_lines WHERE ord % 13 IN (10, 11)),
x AS (SELECT page_id, unit_key, arg_min(bedrooms, ord) AS b FROM h WHERE unit_key IS NOT NULL GROUP BY 1, 2), f AS (SELECT page_id, arg_min(bedrooms, ord) AS b FROM h GROUP BY 1) SELECT u.page_id, u.unit_id, coalesce(x.b, CASE WHEN n = 1 THEN f.b END) AS bedrooms FROM u LEFT JOIN x ON x.page_id = u.page_id AND x.unit_key = u.key LEFT JOIN f ON f.page_id = u.page_id""")
def j19_types_of_units(spark, sf_dir):
    lines = views(spark, sf_dir, "d_ocr_lines").where("text IN ('Type 2B', 'LIFT LOBBY')")
    hits = lines.select("page_id", "ord", F.when(C("ord") % 2 == 0, (C("ord") % 40).cast("string")).alias("unit_key"), (C("ord") % 4).alias("bedrooms"))
    return labels.type_to_unit(spatial.of_type(entities(spark, sf_dir), "unit_boundary").select("page_id", C("entity_id").alias("unit_id"), "label"), hits)


@query("""WITH k AS (SELECT page_id, w AS v FROM d_entities WHERE type = 'wall'), t AS (SELECT DISTINCT page_id, CAST(CAST(h AS INT) AS VARCHAR) AS token FROM d_entities WHERE type = 'door') SELECT page_id, token FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page_id = t.page_id AND CAST(CAST(k.v AS INT) AS VARCHAR) = t.token)""")
def j24_invented_numbers(spark, sf_dir):
    df = entities(spark, sf_dir)
    texts = spatial.of_type(df, "door").select("page_id", F.concat(F.lit("a door of "), C("h").cast("int").cast("string"), F.lit(" mm in the plan")).alias("text"))
    return labels.invented_numbers(texts, spatial.of_type(df, "wall").select("page_id", C("w").alias("value")))


@query(f"""WITH c_entities AS {CENTRED}, {UNIT_ROOMS}, u AS (SELECT room_id, arg_max(unit_id, unit_ord) AS unit_id FROM u_rooms GROUP BY 1)
SELECT e.page_id, e.entity_id, e.label, u.unit_id, round({AREA} / (ppm * ppm), 6) AS area_m2, status = 'predicted' AS review FROM d_entities e JOIN d_pages USING (page_id) LEFT JOIN u ON u.room_id = e.entity_id WHERE e.type = 'room'""")
def j29_space_records(spark, sf_dir):
    df = kept_entities(spark, sf_dir)
    return labels.space_records(spatial.of_type(df, "room"), spatial.unit_rooms(df).select("room_id", "unit_id", "unit_ord"), views(spark, sf_dir, "d_pages"))


@query(f"""WITH e AS {CENTRED}, p AS (SELECT o.entity_id, r.entity_id AS room_id, row_number() OVER (PARTITION BY o.entity_id ORDER BY greatest(1, r.w * r.h), r.ord) AS n FROM e o JOIN e r ON r.page_id = o.page_id AND r.type = 'room' AND o.cx BETWEEN r.x - 24 AND r.x + r.w + 24 AND o.cy BETWEEN r.y - 24 AND r.y + r.h + 24 WHERE o.type IN ('door', 'window'))
SELECT o.page_id, o.entity_id, CASE WHEN o.type = 'window' THEN 'window' WHEN o.label = 'Main Door' THEN 'unit_entrance' ELSE 'internal_room_door' END AS opening, p.room_id FROM d_entities o LEFT JOIN p ON p.entity_id = o.entity_id AND p.n = 1 WHERE o.type IN ('door', 'window')""")
def j29_opening_records(spark, sf_dir):
    df = kept_entities(spark, sf_dir)
    return labels.opening_records(spatial.of_type(df, "door", "window"), spatial.opening_room(df))


@query("SELECT page_id, type AS rule_code, unnest(list_distinct([entity_id, entity_id + 1, entity_id])) AS entity_id FROM d_entities WHERE type = 'fixture'")
def a19_evidence_ids(spark, sf_dir):
    ev = F.create_map(F.lit("entityIds"), F.array("entity_id", C("entity_id") + 1), F.lit("roomIds"), F.array("entity_id"))
    one = spatial.of_type(entities(spark, sf_dir), "fixture").select("page_id", C("type").alias("rule_code"), F.struct(ev["entityIds"].alias("entityIds"), F.lit(None).cast("array<long>").alias("evidenceIds"), ev["roomIds"].alias("roomIds"), F.lit(None).cast("array<long>").alias("entityId"), F.lit(None).cast("array<long>").alias("roomId")).alias("evidence"))
    return labels.evidence_ids(one)


@query(f"""WITH {ROOMS}, ext AS (SELECT DISTINCT r.entity_id FROM d_entities r JOIN d_entities s ON s.page_id = r.page_id AND s.label = 'External Wall' WHERE r.type = 'room' AND {_vertex_to_box("(r.x + r.w / 2)", "(r.y + r.h / 2)", "s")} <= 24)
SELECT r.page_id, coalesce(CAST(unit_id AS VARCHAR), unit_label, 'unassigned') AS unit, count(*) AS internal, count(ext.entity_id) AS external FROM g_rooms r LEFT JOIN ext ON ext.entity_id = r.room_id GROUP BY 1, 2""")
def a20_unit_wall_counts(spark, sf_dir):
    own = kept_entities(spark, sf_dir)
    df = rects(own)
    touches = spatial.touches_external(spatial.of_type(df, "room"), spatial.of_type(df, "wall"))
    return labels.unit_wall_counts(room_graph(spark, sf_dir, own)[0], touches)


@query(f"""WITH {ROOMS}, {WALLS}, {OPENINGS}, b AS (SELECT from_id AS a, to_id AS b FROM walls UNION ALL SELECT to_id, from_id FROM walls), n AS (SELECT b.a AS room_id, string_agg(o.label, ', ' ORDER BY coalesce(r.unit_id, -1) <> coalesce(o.unit_id, -1), o.label, o.room_id) AS neighbours FROM b JOIN g_rooms r ON r.room_id = b.a JOIN g_rooms o ON o.room_id = b.b GROUP BY 1),
o AS (SELECT from_id AS room_id, count(*) FILTER (kind = 'exterior_window') AS windows, count(*) FILTER (kind <> 'exterior_window') AS doors FROM o_edges GROUP BY 1) SELECT r.page_id, r.room_id, r.label, coalesce(neighbours, '') AS neighbours, coalesce(windows, 0) AS windows, coalesce(doors, 0) AS doors FROM g_rooms r LEFT JOIN n USING (room_id) LEFT JOIN o USING (room_id)""")
def a7_room_properties(spark, sf_dir):
    return labels.room_properties(*room_graph(spark, sf_dir))


@query("""WITH s AS (SELECT page_id, entity_id AS seed_id, ord, label, supp, round(sqrt((x - 500) * (x - 500) + (y - 400) * (y - 400)), 6) AS d FROM (SELECT *, entity_id % 3 AS supp FROM d_entities) z WHERE type = 'room'), r AS (SELECT *, CASE WHEN label = 'Open Living' THEN row_number() OVER (PARTITION BY page_id, supp, label ORDER BY d, ord) ELSE 1 END AS n FROM s) SELECT page_id, seed_id FROM r WHERE n = 1""")
def n13_deduped_room_kinds(spark, sf_dir):
    seeds = spatial.of_type(entities(spark, sf_dir), "room").select("page_id", C("entity_id").alias("seed_id"), "ord", "label", (C("entity_id") % 3).alias("unit_id"), "x", "y", F.lit(500.0).alias("cx"), F.lit(400.0).alias("cy"))
    return labels.dedupe_room_kinds(seeds).select("page_id", "seed_id")


@query("""WITH l AS (SELECT page_id, ord, CASE WHEN text LIKE 'SCALE 1:100%' THEN 100 WHEN text = '1:200' THEN 200 END AS ratio, CASE WHEN text LIKE '%@ A1' THEN 'A1' WHEN text = '@ A3' THEN 'A3' END AS paper FROM d_ocr_lines), pp AS (SELECT page_id, arg_min(paper, ord) AS page_paper FROM l WHERE paper IS NOT NULL GROUP BY 1),
c AS (SELECT l.page_id, CASE WHEN paper IS NOT NULL THEN 2 ELSE 3 END AS priority, ord, 1300 / (CASE coalesce(paper, page_paper, 'A3') WHEN 'A1' THEN 841 ELSE 420 END / 1000.0 * ratio) AS ppm FROM l LEFT JOIN pp USING (page_id) WHERE ratio IS NOT NULL UNION ALL SELECT page_id, 1, 0, ppm FROM d_pages WHERE page_id % 5 = 0 AND ppm IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority, ord) AS n FROM c) SELECT p.page_id, round(k.ppm, 6) AS ppm, CASE k.priority WHEN 1 THEN 'manual' WHEN 2 THEN 'text_with_paper' WHEN 3 THEN 'text_ratio' END AS method, CASE k.priority WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.7 END::DOUBLE AS confidence FROM d_pages p LEFT JOIN k ON k.page_id = p.page_id AND n = 1""")
def n14_resolved_scales(spark, sf_dir):
    pages = views(spark, sf_dir, "d_pages")
    return labels.resolve_scale(pages.select("page_id", "width_px", "height_px"), views(spark, sf_dir, "d_ocr_lines"), pages.where("page_id % 5 = 0 AND ppm IS NOT NULL").select("page_id", "ppm"))


@query("""WITH u AS (SELECT DISTINCT page_id, label[6:] AS key FROM d_entities WHERE type = 'unit_boundary'), x AS (SELECT DISTINCT page_id, text[6:] AS key FROM d_ocr_lines WHERE text LIKE 'UNIT %') SELECT page_id, key, 'detected' AS source FROM u UNION ALL SELECT page_id, key, 'text' FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.page_id = x.page_id AND u.key = x.key)""")
def u3_merged_text_units(spark, sf_dir):
    found = views(spark, sf_dir, "d_ocr_lines").select("page_id", F.explode(t.parse_unit_ids(C("text"))).alias("unit"))
    return labels.merge_text_units(spatial.of_type(entities(spark, sf_dir), "unit_boundary"), found)


_SAYS = "[' Studio homes have 37 m of it.', ' A 2-bed home needs 68.5 m2. Three 3 bedroom flats.', ' Each bedroom is 9.5 sqm. The living room has 14 m2 or more.', ' A balcony of 8.25 m2; dual aspect. Communal gardens of 3 sqm for a dwelling. A wardrobe.', ' Every habitable room has a window.']"
_NUM = r"(\d+(?:\.\d+)?)\s*"


@query(rf"""WITH f AS (SELECT doc_id, regexp_replace(concat(text, {_SAYS}[doc_id % 5 + 1], {_SAYS}[doc_id % 3 + 1]), '\s+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
p(code, kind, bedrooms, pattern, usual) AS (VALUES ('RDS-APT-SIZE', 'apartment_min_internal', 0, '(?i)studio[^.]{{0,80}}?{_NUM}m', 35.0), ('RDS-APT-SIZE', 'apartment_min_internal', 1, '(?i)1[-\s]?bed(?:room)?[^.]{{0,80}}?{_NUM}m', 50.0),
  ('RDS-APT-SIZE', 'apartment_min_internal', 2, '(?i)2[-\s]?bed(?:room)?[^.]{{0,80}}?{_NUM}m', 70.0), ('RDS-APT-SIZE', 'apartment_min_internal', 3, '(?i)3[-\s]?bed(?:room)?[^.]{{0,80}}?{_NUM}m', 90.0),
  ('RDS-BED-MIN', 'apartment_min_bedroom', NULL, '(?i)bedroom[^.]{{0,60}}?{_NUM}(?:m²|m2|sqm)', 9.0), ('RDS-LIVING-MIN', 'apartment_min_living', NULL, '(?i)living[^.]{{0,60}}?{_NUM}(?:m²|m2|sqm)', 12.0),
  ('RDS-ASPECT-DUAL', 'apartment_dual_aspect', NULL, '(?i)dual aspect|windows on two sides|natural ventilation()', NULL), ('RDS-STORAGE', 'apartment_min_storage', NULL, '(?i)storage|wardrobe|robe()', 1.0),
  ('RDS-HAB-WINDOW', 'habitable_has_window', NULL, '(?i)habitable.{{0,50}}window|bedroom.{{0,40}}window|each room.{{0,30}}window()', NULL),
  ('RDS-COMMUNAL', 'communal_open_space', NULL, '(?i)communal[^.]{{0,80}}?{_NUM}(?:m²|m2|sqm).{{0,40}}(?:dwelling|apartment)', 2.5),
  ('RDS-POS-MIN', 'apartment_min_pos', 0, '(?i)(?:private open space|balcony)[^.]{{0,80}}?{_NUM}(?:m²|m2|sqm)', 8.0), ('RDS-POS-MIN', 'apartment_min_pos', 1, '(?i)(?:private open space|balcony)[^.]{{0,80}}?{_NUM}(?:m²|m2|sqm)', 8.0),
  ('RDS-POS-MIN', 'apartment_min_pos', 2, '(?i)(?:private open space|balcony)[^.]{{0,80}}?{_NUM}(?:m²|m2|sqm)', 8.0), ('RDS-POS-MIN', 'apartment_min_pos', 3, '(?i)(?:private open space|balcony)[^.]{{0,80}}?{_NUM}(?:m²|m2|sqm)', 8.0)),
r AS (SELECT doc_id, code, kind, bedrooms, usual, regexp_matches(t, pattern) AS named, nullif(regexp_extract(t, pattern, 1), '') AS number FROM f, p)
SELECT doc_id, code, kind, bedrooms, coalesce(CAST(number AS DOUBLE), usual::DOUBLE) AS minimum FROM (SELECT *, bool_or(named) OVER (PARTITION BY doc_id, code) AS have FROM r) w WHERE have""")
def x19_rules_from_text(spark, sf_dir):
    says = F.array(*(F.lit(x) for x in ast.literal_eval(_SAYS)))
    said = F.concat("text", *(F.element_at(says, (C("doc_id") % n + 1).cast("int")) for n in (5, 3)))
    return labels.threshold_rules_from_text(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", said.alias("text")))


@query("SELECT code, kind, requires_scale FROM d_rules UNION ALL SELECT concat('R', p_partkey), CASE p_partkey % 3 WHEN 0 THEN 'apartment_dual_aspect' ELSE 'apartment_min_pos' END, p_partkey % 3 <> 0 FROM part WHERE p_partkey % 3 <> 2 AND p_size < 10")
def u14_bridged_rules(spark, sf_dir):
    kind = F.when(C("p_partkey") % 3 == 0, "apartment_dual_aspect").when(C("p_partkey") % 3 == 1, "apartment_min_pos").otherwise("room_min_area")
    guidelines = table(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("R"), C("p_partkey").cast("string")).alias("clause"), kind.alias("mapped_kind"))
    return labels.bridge_rules(views(spark, sf_dir, "d_rules"), guidelines)


@query()
def n7_sections(spark, sf_dir):
    return rollup.sections(policy_lines(spark, sf_dir))


@query("SELECT e.entity_id, round(100 + x * 2, 6) AS px, round(50 + y * 0.5, 6) AS py, p.page_id % 2 = 0 AS in_page FROM d_entities e JOIN d_pages p USING (page_id) WHERE p.page_id % 2 = 1 UNION ALL SELECT entity_id, x, y, true FROM d_entities WHERE page_id % 2 = 0")
def c18_mapped_ocr_quads(spark, sf_dir):
    frame = F.when(C("page_id") % 2 == 1, F.struct(g.box(F.lit(100), F.lit(50), F.lit(800), F.lit(300)).alias("crop"), F.lit(400.0).alias("raster_w"), F.lit(600.0).alias("raster_h")))
    df = entities(spark, sf_dir).withColumn("q", g.map_ocr_quad(C("points"), frame))
    return df.select("entity_id", F.round(C("q")[0]["x"], 6).alias("px"), F.round(C("q")[0]["y"], 6).alias("py"), (C("page_id") % 2 == 0).alias("in_page"))


_H = "CASE entity_id % 4 WHEN 0 THEN CAST(entity_id % 360 AS DOUBLE) WHEN 1 THEN 90.0 WHEN 2 THEN 180.0 ELSE CASE WHEN w >= h THEN 0.0 ELSE 90.0 END END"


@query(f"SELECT entity_id, round({_H}, 6) AS heading FROM d_entities WHERE type = 'window'")
def c22_headings(spark, sf_dir):
    k = C("entity_id") % 4
    stored, vector = F.when(k == 0, (C("entity_id") % 360).cast("double")), F.when(k == 1, g.point(F.lit(0), F.lit(5)))
    base, tip = F.when(k == 2, g.point(F.lit(9), F.lit(1))), F.when(k == 2, g.point(F.lit(3), F.lit(1)))
    df = spatial.of_type(rects(entities(spark, sf_dir)), "window")
    return df.select("entity_id", F.round(g.heading_of(stored, vector, base, tip, C("points")), 6).alias("heading"))


_STOCK = [("rooms", "Bedroom"), ("rooms", "Bathroom"), ("openings", "Window"), ("openings", "Main Door"), ("walls", "Wall")]
_PURPOSE = "['rooms', 'openings', 'north'][page_id % 3 + 1]"


@query(f"""WITH d AS (SELECT page_id AS dataset_id, {_PURPOSE} AS purpose, label, min(ord) AS o FROM d_entities GROUP BY 1, 2, 3), s(p, c) AS (VALUES {", ".join(f"('{p}', '{c}')" for p, c in _STOCK)}),
k AS (SELECT dataset_id, string_agg(label, ',' ORDER BY o) AS legend FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.c = d.label AND s.p <> d.purpose) GROUP BY 1)
SELECT DISTINCT d.dataset_id, d.purpose, CASE WHEN d.purpose = 'north' THEN 'north_arrow' ELSE coalesce(k.legend, 'Room') END AS legend FROM d LEFT JOIN k USING (dataset_id)""")
def a14_class_legends(spark, sf_dir):
    purpose = F.element_at(F.array(F.lit("rooms"), F.lit("openings"), F.lit("north")), (C("page_id") % 3 + 1).cast("int"))
    data = entities(spark, sf_dir).groupBy(C("page_id").alias("dataset_id"), purpose.alias("purpose"), C("label").alias("class_name")).agg(F.min("ord").alias("ord"))
    return labels.class_legend(data, spark.createDataFrame(_STOCK, "purpose string, class_name string"), ["Room"])


@query("""WITH c AS (SELECT page_id AS crop_id, bool_and(type IN ('door', 'window')) AS a, bool_and(type IN ('door', 'window', 'wall', 'fixture')) AS b FROM d_entities GROUP BY 1) SELECT crop_id, CASE WHEN a THEN 'openings' WHEN b THEN 'structure' ELSE 'full' END AS category FROM c""")
def a15_crop_purposes(spark, sf_dir):
    crops = entities(spark, sf_dir).groupBy(C("page_id").alias("crop_id")).agg(F.collect_set("type").alias("labels")).withColumn("source", F.lit("full"))
    catalog = spark.createDataFrame([("openings", ["door", "window"], 1), ("structure", ["door", "window", "wall", "fixture"], 2)], "category string, legend array<string>, ord int")
    return labels.crop_purpose(crops, catalog)


CROP = 256


@query(f"""WITH k AS (SELECT concat(page_id, '_', CAST(floor((x + w / 2) / {CROP}) AS BIGINT), '_', CAST(floor((y + h / 2) / {CROP}) AS BIGINT)) AS crop_id, type FROM d_entities),
c AS (SELECT crop_id, count(*) AS regions, bool_and(type IN ('door', 'window')) AS a, bool_and(type IN ('door', 'window', 'wall', 'fixture')) AS b FROM k GROUP BY 1) SELECT crop_id, regions, CASE WHEN a THEN 'openings' WHEN b THEN 'structure' ELSE 'full' END AS category FROM c""")
def a15_cell_crop_purposes(spark, sf_dir):
    cell = lambda at, size: F.floor((C(at) + C(size) / 2) / CROP).cast("string")
    df = entities(spark, sf_dir).withColumn("crop_id", F.concat_ws("_", C("page_id").cast("string"), cell("x", "w"), cell("y", "h")))
    per = df.groupBy("crop_id").agg(F.collect_set("type").alias("labels"), F.count("*").alias("regions")).withColumn("source", F.lit("full"))
    catalog = spark.createDataFrame([("openings", ["door", "window"], 1), ("structure", ["door", "window", "wall", "fixture"], 2)], "category string, legend array<string>, ord int")
    return labels.crop_purpose(per, catalog).join(per.select("crop_id", "regions"), "crop_id")


@query(f"WITH {ROOMS} SELECT r.page_id, p.level_index AS level, unit_label AS unit, label AS room, CASE WHEN is_common THEN 'yes' ELSE 'no' END AS shared, ord FROM g_rooms r JOIN d_pages p USING (page_id)")
def w2_hierarchy_report(spark, sf_dir):
    from ..sources import writers

    floors = views(spark, sf_dir, "d_pages").select("page_id", C("level_index").alias("level"))
    return writers.hierarchy_report(floors, room_graph(spark, sf_dir)[0])
