"""Queries of the aggregations, windows, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import rollup, spatial
from .fixtures import entities, views
from .q_columns import AREA, EDGE
from .q_spatial import CENTRED, COMMON, UNIT_ROOMS
from .q_text import _LINES, _NOISE, policy_lines
from .registry import query

C = F.col
AREAS = "areas AS (SELECT e.entity_id AS room_id, round(w * h * 9 / 8 / (ppm * ppm), 6) AS area_m2 FROM d_entities e JOIN d_pages p USING (page_id) WHERE type = 'room')"
KIND = "CASE WHEN room_label IN ('Bathroom', 'Ensuite') THEN 'bathroom' WHEN room_label IN ('Bedroom', 'master_bedroom') THEN 'bedroom' WHEN room_label = 'Balcony' THEN 'balcony' END"


def _areas(spark, sf_dir, df):
    m2 = F.round(g.area_m2(g.poly_area(C("points")), C("ppm")), 6)
    return spatial.of_type(df, "room").join(views(spark, sf_dir, "d_pages").select("page_id", "ppm"), "page_id").select(C("entity_id").alias("room_id"), m2.alias("area_m2"))


def _units(df):
    return spatial.of_type(df, "unit_boundary").select("page_id", C("entity_id").alias("unit_id"), "label", "status")


@query(f"""WITH c_entities AS {CENTRED}, {UNIT_ROOMS}, {AREAS} SELECT u.page_id, u.entity_id AS unit_id, count(r.room_id) AS rooms, count(*) FILTER ({KIND} = 'bedroom') AS bedrooms, count(*) FILTER ({KIND} = 'bathroom') AS bathrooms,
  round(nullif(sum(area_m2), 0), 4) AS area_m2, round(sum(area_m2) FILTER ({KIND} = 'balcony'), 4) AS open_m2 FROM d_entities u LEFT JOIN (SELECT * FROM u_rooms JOIN areas USING (room_id)) r ON r.unit_id = u.entity_id WHERE u.type = 'unit_boundary' GROUP BY 1, 2""")
def a1_unit_summary(spark, sf_dir):
    df = entities(spark, sf_dir)
    out = rollup.unit_summary(_units(df), spatial.unit_rooms(df).drop("page_id"), _areas(spark, sf_dir, df))
    return out.select("page_id", "unit_id", "rooms", "bedrooms", "bathrooms", F.round("area_m2", 4).alias("area_m2"), F.round("open_m2", 4).alias("open_m2"))


@query(f"""WITH c_entities AS {CENTRED}, {UNIT_ROOMS}, {AREAS} SELECT u.page_id, u.entity_id AS unit_id, u.label, coalesce(string_agg(r.room_id, ',' ORDER BY r.room_ord), '') AS room_ids, round(nullif(sum(area_m2), 0), 4) AS area_m2, u.status = 'predicted' AS review
  FROM d_entities u LEFT JOIN (SELECT * FROM u_rooms JOIN areas USING (room_id)) r ON r.unit_id = u.entity_id WHERE u.type = 'unit_boundary' GROUP BY u.page_id, u.entity_id, u.label, u.status""")
def a2_unit_records(spark, sf_dir):
    df = entities(spark, sf_dir)
    out = rollup.unit_records(_units(df), spatial.unit_rooms(df).drop("page_id"), _areas(spark, sf_dir, df))
    return out.withColumn("room_ids", F.array_join(C("room_ids").cast("array<string>"), ",")).withColumn("area_m2", F.round("area_m2", 4))


@query(f"""WITH c_entities AS {CENTRED}, {UNIT_ROOMS}, {AREAS}, r AS (SELECT e.page_id, e.{COMMON} AS is_common, a.area_m2, EXISTS (SELECT 1 FROM u_rooms u WHERE u.room_id = e.entity_id) AS held FROM d_entities e JOIN areas a ON a.room_id = e.entity_id)
SELECT p.page_id, count(r.page_id) AS rooms, count(*) FILTER (is_common) AS shared_rooms, round(nullif(sum(area_m2), 0), 2) AS gross_m2, round(nullif(sum(area_m2) FILTER (is_common), 0), 2) AS shared_m2, count(*) FILTER (NOT held AND NOT is_common) AS unassigned,
  coalesce(any_value(u.n), 0) AS units FROM d_pages p LEFT JOIN r ON r.page_id = p.page_id LEFT JOIN (SELECT page_id, count(*) AS n FROM d_entities WHERE type = 'unit_boundary' GROUP BY 1) u ON u.page_id = p.page_id GROUP BY 1""")
def a3_floor_properties(spark, sf_dir):
    df = entities(spark, sf_dir)
    rooms = spatial.of_type(df, "room").select("page_id", C("entity_id").alias("room_id"), t.is_common(C("label")).alias("is_common")).join(_areas(spark, sf_dir, df), "room_id")
    out = rollup.floor_properties(views(spark, sf_dir, "d_pages"), _units(df), rooms, spatial.unit_rooms(df))
    return out.withColumn("gross_m2", F.round("gross_m2", 2)).withColumn("shared_m2", F.round("shared_m2", 2))


_P = f"(w + 2 * h + 2 * {EDGE})"


@query(f"""WITH m AS (SELECT page_id, entity_id, unnest([CASE WHEN type IN ('room', 'unit_boundary') THEN {{'kind': 'area', 'px': {AREA}, 'power': 2}} END, CASE WHEN type IN ('room', 'unit_boundary') THEN {{'kind': 'perimeter', 'px': {_P}, 'power': 1}} END,
  CASE WHEN type IN ('room', 'unit_boundary') THEN {{'kind': 'min_width', 'px': least(w, h * 1.25), 'power': 1}} END, CASE WHEN type = 'wall' THEN {{'kind': 'wall_length', 'px': {_P} / 2, 'power': 1}} END,
  CASE WHEN type = 'wall' THEN {{'kind': 'wall_thickness', 'px': {AREA} / greatest(w, h, {EDGE}), 'power': 1}} END, CASE WHEN type = 'door' THEN {{'kind': 'opening_width', 'px': least(w, h * 1.25), 'power': 1}} END,
  CASE WHEN type = 'window' THEN {{'kind': 'long_edge', 'px': greatest(w, h, {EDGE}), 'power': 1}} END]) AS m FROM d_entities)
SELECT page_id, entity_id, m.kind AS kind, round(m.px, 6) AS px, round(m.px / CASE WHEN m.power = 2 THEN ppm * ppm ELSE ppm END, 6) AS metres, ppm IS NULL AS estimated FROM m JOIN d_pages USING (page_id) WHERE m IS NOT NULL""")
def a6_metric_layer(spark, sf_dir):
    return rollup.metric_layer(entities(spark, sf_dir), views(spark, sf_dir, "d_pages"))


@query(f"""WITH w AS (SELECT page_id, label = 'External Wall' OR CASE WHEN ppm > 0 THEN {AREA} / greatest(w, h, {EDGE}) / ppm * 1000 >= 5000 ELSE {AREA} / greatest(w, h, {EDGE}) >= 40 END AS ext FROM d_entities JOIN d_pages USING (page_id) WHERE type = 'wall')
SELECT page_id, count(*) FILTER (ext) AS external, count(*) FILTER (NOT ext) AS internal FROM w GROUP BY 1""")
def a8_wall_classes(spark, sf_dir):
    return rollup.wall_classes(spatial.of_type(entities(spark, sf_dir), "wall"), views(spark, sf_dir, "d_pages"), 5000.0)


@query("""WITH c AS (SELECT page_id AS region_id, label, count(*) AS cells FROM d_entities WHERE type = 'room' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY (label = 'Room')::INT, cells DESC, label) AS n FROM c)
SELECT region_id, label, cells FROM r WHERE n = 1""")
def a9_region_vote(spark, sf_dir):
    return rollup.region_vote(spatial.of_type(entities(spark, sf_dir), "room").select(C("page_id").alias("region_id"), "label"))


@query("""WITH l AS (SELECT *, CASE WHEN text = 'FIRST FLOOR PLAN' THEN 'First Floor Plan' WHEN text LIKE 'LEVEL %' THEN concat('Level ', text[7:]) END AS lv, CASE WHEN text LIKE 'SCALE 1:100%' THEN 100 WHEN text = '1:200' THEN 200 END AS ra,
  CASE WHEN text LIKE '%@ A1' THEN 'A1' WHEN text = '@ A3' THEN 'A3' END AS pa FROM d_ocr_lines), u AS (SELECT page_id, string_agg(uid, ',' ORDER BY o) AS unit_ids FROM (SELECT * FROM (SELECT page_id, uid, o, row_number() OVER (PARTITION BY page_id ORDER BY o) AS k FROM (SELECT page_id, text[6:] AS uid, min(ord) AS o FROM d_ocr_lines WHERE text LIKE 'UNIT %' GROUP BY 1, 2) a) b WHERE k <= 20) z GROUP BY 1)
SELECT l.page_id, CASE WHEN bool_or(text IN ('FIRST FLOOR PLAN', 'General Arrangement') OR text LIKE 'LEVEL %') THEN 'ga' ELSE 'unknown' END AS sheet, arg_min(lv, ord) FILTER (lv IS NOT NULL) AS level, arg_min(ra, ord) FILTER (ra IS NOT NULL) AS ratio, arg_min(pa, ord) FILTER (pa IS NOT NULL) AS paper,
  coalesce(any_value(u.unit_ids), '') AS unit_ids, round(greatest(0.4, least(0.95, avg(confidence))), 7) AS confidence, count(*) AS lines, least(4000, sum(length(text) + 1) - 1)::BIGINT AS hint_chars FROM l LEFT JOIN u ON u.page_id = l.page_id GROUP BY 1""")
def a10_sheet_meta(spark, sf_dir):
    return rollup.sheet_meta(views(spark, sf_dir, "d_ocr_lines"))


KNOWN = ["Main Door", "Single Door", "Window", "External Wall", "Wall", "Sink", "Bedroom", "master_bedroom", "Bathroom", "Ensuite", "Open Living", "Balcony", "Lobby", "Store", "Communal Outdoor Garden", "Room", *(f"Unit {i}" for i in range(40))]
BUILDINGS = {"20": "b20", "21": "b21", "82": "b82", "98": "b98", "118": "b118"}
TEST = {"b20", "b82"}
_K = ", ".join(f"'{k}'" for k in KNOWN)


@query(f"""WITH i AS (SELECT page_id, unnest([CASE WHEN trim(label) = '' THEN 'EMPTY_LABEL' END, CASE WHEN trim(label) <> '' AND label NOT IN ({_K}) THEN 'UNKNOWN_LABEL' END, CASE WHEN w < 2 OR h < 2 THEN 'TINY_SHAPE' END, CASE WHEN split_part(stem, '_', 1) = '77' THEN 'UNKNOWN_BUILDING' END]) AS code FROM d_shapes)
SELECT code, count(*) AS issues, count(DISTINCT page_id) AS pages FROM i WHERE code IS NOT NULL GROUP BY 1""")
def a11_validation_report(spark, sf_dir):
    return rollup.validation_report(views(spark, sf_dir, "d_shapes"), KNOWN, BUILDINGS, TEST)


FOLD = ({"b21"}, TEST)


@query(f"""WITH p AS (SELECT DISTINCT page_id, split_part(stem, '_', 1) AS pre FROM d_shapes), s AS (SELECT *, trim(label) <> '' AS named, ord % 61 = 0 AS bad, CASE WHEN ord % 53 = 0 THEN 1 WHEN ord % 59 = 0 OR shape_type = 'rectangle' THEN 2 ELSE 4 END AS n FROM d_shapes WHERE page_id % 13 <> 0),
i AS (SELECT page_id, 'EMPTY_SHAPES' AS code FROM p WHERE page_id % 13 = 0 UNION ALL SELECT page_id, CASE WHEN pre = '77' THEN 'UNKNOWN_BUILDING' ELSE 'BUILDING_NOT_IN_FOLD' END FROM p WHERE pre NOT IN ('20', '21', '82')
  UNION ALL SELECT page_id, unnest([CASE WHEN NOT named THEN 'EMPTY_LABEL' END, CASE WHEN named AND label NOT IN ({_K}) THEN 'UNKNOWN_LABEL' END, CASE WHEN named AND n < 2 THEN 'BAD_GEOMETRY' END, CASE WHEN named AND n = 2 AND shape_type = 'polygon' THEN 'OPEN_POLYGON' END,
    CASE WHEN named AND n > 1 AND bad THEN 'BAD_POINTS' END, CASE WHEN named AND n > 1 AND NOT bad AND w * h < 4 THEN 'TINY_SHAPE' END]) FROM s
  UNION ALL SELECT NULL, 'FOLD_LEAKAGE' FROM p HAVING bool_or(pre = '21') AND bool_or(pre IN ('20', '82'))),
c AS (SELECT code, count(*) AS issues, count(DISTINCT page_id) AS pages FROM i WHERE code IS NOT NULL GROUP BY 1) SELECT *, (SELECT count(*) FROM c WHERE code NOT IN ('EMPTY_SHAPES', 'TINY_SHAPE')) = 0 AS ok FROM c""")
def a11_validation_issues(spark, sf_dir):
    df = views(spark, sf_dir, "d_shapes")
    pair = lambda x, y: F.array(x, y)
    x, y, x1, y1 = C("x"), C("y"), C("x") + C("w"), C("y") + C("h")
    first = pair(x, F.when(C("ord") % 61 != 0, y))
    two = (C("ord") % 59 == 0) | (C("shape_type") == "rectangle")
    points = F.when(C("ord") % 53 == 0, F.array(first)).when(two, F.array(first, pair(x1, y1))).otherwise(F.array(first, pair(x1, y), pair(x1, y1), pair(x, y1)))
    shapes = df.where("page_id % 13 <> 0").withColumn("points", points)
    return rollup.validation_issues(df.select("page_id", "stem").distinct(), shapes, KNOWN, BUILDINGS, FOLD)


@query(f"SELECT CASE WHEN split_part(stem, '_', 1) IN ('20', '82') THEN 'val' ELSE 'train' END AS split, count(DISTINCT page_id) AS images, count(*) FILTER (label IN ({_K})) AS instances, count(*) FILTER (label NOT IN ({_K})) AS skipped FROM d_shapes GROUP BY 1")
def a12_convert_stats(spark, sf_dir):
    shapes = views(spark, sf_dir, "d_shapes")
    return rollup.convert_stats(shapes, KNOWN, rollup.fold_split(shapes, BUILDINGS, TEST).select("page_id", "split"))


@query("SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_id FROM (SELECT DISTINCT label FROM d_entities) z")
def a13_dense_classes(spark, sf_dir):
    return rollup.dense_classes(entities(spark, sf_dir))


@query()
def j27_a16_matches_and_pq(spark, sf_dir):
    gold, pred = views(spark, sf_dir, "d_gold"), views(spark, sf_dir, "d_pred")
    return rollup.pq(rollup.match_boxes(gold, pred), gold, pred)


@query("""SELECT sheet_id, round(avg(CASE WHEN p.pred_id IS NULL THEN 1 ELSE abs(p.x - g.x) / CASE WHEN g.x = 0 THEN NULL ELSE g.x END END), 6) AS error FROM d_gold g LEFT JOIN d_pred p ON p.pred_id = g.gold_id AND g.sheet_id = p.sheet_id WHERE g.x > 0 GROUP BY 1""".replace("SELECT sheet_id,", "SELECT g.sheet_id AS sheet_id,"))
def a17_relative_errors(spark, sf_dir):
    gold, pred = views(spark, sf_dir, "d_gold").where("x > 0"), views(spark, sf_dir, "d_pred").select(C("pred_id").alias("gold_id"), C("x").alias("px"))
    return gold.join(pred, "gold_id", "left").groupBy("sheet_id").agg(F.round(F.avg(rollup.relative_error(C("x"), C("px"))), 6).alias("error"))


@query("""WITH l AS (SELECT *, round(confidence + CASE WHEN text = 'FIRST FLOOR PLAN' OR text LIKE 'LEVEL %' THEN 0.4 ELSE 0 END, 6) AS score FROM d_ocr_lines), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS n FROM l) SELECT page_id, ord, text, score FROM r WHERE n = 1""")
def n1_best_line(spark, sf_dir):
    return rollup.best_line(views(spark, sf_dir, "d_ocr_lines"))


@query("""WITH l AS (SELECT page_id, confidence, ord, CASE WHEN text = 'FIRST FLOOR PLAN' THEN 'First Floor Plan' ELSE concat('Level ', text[7:]) END AS level FROM d_ocr_lines WHERE text = 'FIRST FLOOR PLAN' OR text LIKE 'LEVEL %'), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, ord) AS n FROM l)
SELECT p.page_id, coalesce(r.level, concat('Floor ', p.page_id + 1)) AS level, coalesce(CASE WHEN r.level = 'First Floor Plan' THEN 1 WHEN r.level IS NOT NULL THEN greatest(CAST(r.level[7:] AS BIGINT) - 1, 0) END, p.level_index) AS level_index FROM d_pages p LEFT JOIN r ON r.page_id = p.page_id AND r.n = 1""")
def n2_page_levels(spark, sf_dir):
    return rollup.page_levels(views(spark, sf_dir, "d_pages"), views(spark, sf_dir, "d_ocr_lines"))


@query("SELECT page_id, entity_id, concat('Unit ', row_number() OVER (PARTITION BY page_id ORDER BY x, ord)) AS label FROM d_entities WHERE type = 'unit_boundary'")
def n3_numbered_units(spark, sf_dir):
    return rollup.number_units(spatial.of_type(entities(spark, sf_dir), "unit_boundary")).select("page_id", "entity_id", "label")


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM (SELECT doc_id, line_no, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS used FROM {_LINES} l) z WHERE used <= 2000")
def n8_text_budget(spark, sf_dir):
    return rollup.text_budget(policy_lines(spark, sf_dir), 2000).select("doc_id", C("line_no").cast("long").alias("line_no"))


@query("""WITH d AS (SELECT page_id, least(w, h * 1.25) AS span, ord FROM d_entities WHERE type = 'door'), g AS (SELECT page_id, span, lead(span) OVER (PARTITION BY page_id ORDER BY span, ord) - span AS gap FROM d),
m AS (SELECT page_id, min(span) AS low, max(span) AS high, max(gap) AS gap FROM g GROUP BY 1), f AS (SELECT g.page_id, min(g.span) AS below FROM g JOIN m ON g.page_id = m.page_id AND g.gap = m.gap GROUP BY 1)
SELECT page_id, CASE WHEN gap >= greatest(2, low * 0.12) THEN (below + below + gap) / 2 WHEN high > low * 1.12 THEN low + (high - low) * 0.35 END AS split FROM m LEFT JOIN f USING (page_id)""")
def n9_door_width_split(spark, sf_dir):
    doors = spatial.of_type(entities(spark, sf_dir), "door").select("page_id", "ord", g.opening_span(C("points")).alias("span"))
    return rollup.door_width_split(doors)


@query("WITH m AS (SELECT *, lag(loss, 3) OVER (PARTITION BY job_id ORDER BY epoch) AS before FROM d_training_metrics) SELECT job_id, epoch, loss, before FROM m WHERE before > 0 AND loss > before * 1.08")
def n11_overfit_hints(spark, sf_dir):
    return rollup.overfit_hints(views(spark, sf_dir, "d_training_metrics")).withColumn("epoch", C("epoch").cast("long"))


@query("SELECT page_id, entity_id, CAST(label[6:] AS BIGINT) AS number FROM d_entities WHERE type = 'unit_boundary'")
def k1_ordered_units(spark, sf_dir):
    units = spatial.of_type(entities(spark, sf_dir), "unit_boundary").withColumn("key", t.unit_sort_key(C("label")))
    return units.orderBy("page_id", "key").select("page_id", "entity_id", C("key.number").alias("number"))


@query("""WITH p AS (SELECT building_id AS doc_id, page_id AS page_number, image_ops > 0 AS img, vector_ops * 20 AS chars FROM d_pages), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN img THEN 10 ELSE 0 END + CASE WHEN chars < 400 THEN 5 ELSE 0 END + CASE WHEN chars < 80 THEN 4 ELSE 0 END DESC, page_number) AS n FROM p)
SELECT doc_id, page_number FROM r WHERE n <= 16""")
def k2_vision_pages(spark, sf_dir):
    pages = views(spark, sf_dir, "d_pages").select(C("building_id").alias("doc_id"), C("page_id").alias("page_number"), (C("image_ops") > 0).alias("has_image"), (C("vector_ops") * 20).alias("chars"))
    return rollup.vision_pages(pages).select("doc_id", "page_number")


@query("WITH r AS (SELECT page_id, entity_id, row_number() OVER (PARTITION BY page_id ORDER BY w * h * confidence DESC, ord) AS n FROM d_entities) SELECT page_id, entity_id FROM r WHERE n = 1")
def k3_drawing_area(spark, sf_dir):
    return rollup.drawing_area(entities(spark, sf_dir))


@query()
def k5_nms(spark, sf_dir):
    return rollup.nms(views(spark, sf_dir, "d_tile_regions"))


@query("""WITH s AS (SELECT CASE WHEN entity_id % 9 = 0 THEN '' ELSE CAST(entity_id // 3 AS VARCHAR) END AS id, ord FROM d_entities), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM s) SELECT id, ord FROM r WHERE n = 1 OR id = ''""")
def u1_deduped_regions(spark, sf_dir):
    df = entities(spark, sf_dir).select(F.when(C("entity_id") % 9 == 0, "").otherwise(F.floor(C("entity_id") / 3).cast("string")).alias("id"), "ord")
    return rollup.dedupe_regions(df)


@query("SELECT page_id, string_agg(uid, ',' ORDER BY o) AS unit_ids FROM (SELECT page_id, text[6:] AS uid, min(ord) AS o FROM d_ocr_lines WHERE text LIKE 'UNIT %' GROUP BY 1, 2) a GROUP BY 1")
def u2_page_unit_ids(spark, sf_dir):
    return rollup.page_unit_ids(views(spark, sf_dir, "d_ocr_lines"))


@query("""SELECT DISTINCT page_id, CASE split_part(stem, '_', 1) WHEN '77' THEN NULL ELSE concat('b', split_part(stem, '_', 1)) END AS building, CASE WHEN split_part(stem, '_', 1) IN ('20', '82') THEN 'val' ELSE 'train' END AS split FROM d_shapes""")
def u4_fold_split(spark, sf_dir):
    return rollup.fold_split(views(spark, sf_dir, "d_shapes"), BUILDINGS, TEST)


@query("""WITH s AS (SELECT page_id, concat('b', page_id % 6) AS building, CASE WHEN page_id % 6 = 0 OR page_id % 30 = 1 THEN 'val' ELSE 'train' END AS split FROM d_pages) SELECT building, count(*) AS pages FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def u5_fold_leakage(spark, sf_dir):
    b = C("page_id") % 6
    split = F.when((b == 0) | (C("page_id") % 30 == 1), "val").otherwise("train")
    return rollup.fold_leakage(views(spark, sf_dir, "d_pages").select("page_id", F.concat(F.lit("b"), b.cast("string")).alias("building"), split.alias("split")))


@query("WITH n AS (SELECT building_id AS dataset_id, count(*) AS n FROM d_pages GROUP BY 1), v AS (SELECT dataset_id, n, CASE WHEN n >= 2 THEN greatest(1, floor(n * 0.2 + 0.5)) ELSE 0 END::BIGINT AS val FROM n) SELECT dataset_id, val, n - val AS train FROM v")
def u6_random_split(spark, sf_dir):
    df = rollup.random_split(views(spark, sf_dir, "d_pages").select(C("building_id").alias("dataset_id"), "page_id"))
    return df.groupBy("dataset_id").agg(F.count(F.when(C("split") == "val", 1)).alias("val"), F.count(F.when(C("split") == "train", 1)).alias("train"))


TILES = "tiles AS (SELECT page_id, x, y, 640 AS w, 640 AS h FROM d_pages, (VALUES (0), (512), (660)) a(x), (VALUES (0), (460)) b(y))"


@query(f"WITH {TILES} SELECT * FROM tiles")
def u7_tile_grid(spark, sf_dir):
    return rollup.tile_grid(views(spark, sf_dir, "d_pages"))


@query(f"""WITH {TILES}, c AS (SELECT e.page_id, e.entity_id, t.x::DOUBLE AS tx, t.y::DOUBLE AS ty, greatest(e.x, t.x) - t.x AS x, greatest(e.y, t.y) - t.y AS y, least(e.x + e.w, t.x + 640) - greatest(e.x, t.x) AS w, least(e.y + e.h, t.y + 640) - greatest(e.y, t.y) AS h
  FROM d_entities e JOIN tiles t USING (page_id)) SELECT * FROM c WHERE w >= 2 AND h >= 2""")
def u8_clipped_labels(spark, sf_dir):
    return rollup.clip_labels(entities(spark, sf_dir), rollup.tile_grid(views(spark, sf_dir, "d_pages")))


@query("""WITH p AS (SELECT page_id, building_id AS dataset_id, page_id % 3 = 0 AND building_id % 2 = 0 AS is_tile, CASE WHEN page_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM d_pages WHERE page_id % 7 <> 0), m AS (SELECT dataset_id, max(is_tile::INT) AS m FROM p WHERE split = 'train' GROUP BY 1)
SELECT page_id, dataset_id FROM p JOIN m USING (dataset_id) WHERE split = 'train' AND (m = 0 OR is_tile)""")
def u11_training_pages(spark, sf_dir):
    p = views(spark, sf_dir, "d_pages")
    tile = (C("page_id") % 3 == 0) & (C("building_id") % 2 == 0)
    pages = p.select("page_id", C("building_id").alias("dataset_id"), tile.alias("is_tile"), F.when(C("page_id") % 5 == 0, "test").otherwise("train").alias("split"), (C("page_id") % 7).alias("shapes"))
    return rollup.training_pages(pages).select("page_id", "dataset_id")


@query("""WITH m AS (SELECT page_id AS model_id, building_id AS owner_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 100 END AS t FROM d_pages), r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY t DESC NULLS LAST, model_id DESC) AS n FROM m) SELECT model_id, owner_id, n = 1 AND t IS NOT NULL AS is_active FROM r""")
def u12_active_models(spark, sf_dir):
    at = F.when(C("page_id") % 4 != 0, C("page_id") % 100)
    return rollup.active_model(views(spark, sf_dir, "d_pages").select(C("page_id").alias("model_id"), C("building_id").alias("owner_id"), at.alias("activated_at"))).select("model_id", "owner_id", "is_active")
