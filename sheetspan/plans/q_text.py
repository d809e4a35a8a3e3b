"""Queries of the label and text parsers over whole tables."""

from __future__ import annotations

import ast

from pyspark.sql import functions as F

from ..functions import policy_text
from ..functions import text as t
from ..workspace import table
from .fixtures import entities, views
from .registry import query

C = F.col
NORM = r"trim(regexp_replace(lower(label), '[_\-\s]+', ' ', 'g'))"


def _lines(spark, sf_dir):
    return views(spark, sf_dir, "d_ocr_lines")


@query(f"SELECT {NORM} AS label, count(*) AS regions FROM d_entities GROUP BY 1")
def x1_normalised_labels(spark, sf_dir):
    return entities(spark, sf_dir).groupBy(t.normalise_label(C("label")).alias("label")).agg(F.count("*").alias("regions"))


@query("""SELECT entity_id, CASE WHEN type = 'window' THEN 'window' WHEN label = 'Main Door' THEN 'unit_entrance' ELSE 'internal_room_door' END AS opening
FROM d_entities WHERE type IN ('door', 'window')""")
def x3_opening_types(spark, sf_dir):
    return entities(spark, sf_dir).where("type IN ('door', 'window')").select("entity_id", t.opening_type(C("type"), C("label")).alias("opening"))


_SHARED = "['stairs', 'Stairwell A', 'HALL', 'Hallway 2', 'Foyer', 'Main_Lobby', 'common-corridor B', 'Service Lift', 'lift', 'Stair', 'vestibule', 'Elevator']"


@query(f"""WITH l AS (SELECT CASE WHEN entity_id % 5 = 1 THEN {_SHARED}[entity_id % 12 + 1] ELSE label END AS label FROM d_entities), v AS (SELECT label, lower(label) IN ('communal outdoor garden', 'lobby', 'main_lobby', 'common-corridor b') AS everywhere,
  lower(label) IN ('stair', 'lift', 'elevator') AS exact, lower(label) IN ('stairs', 'stairwell a', 'hall', 'foyer', 'vestibule') AS inferred FROM l)
SELECT label, everywhere OR exact AS server, everywhere OR exact OR inferred AS inference, count(*) AS regions FROM v GROUP BY 1, 2, 3""")
def x4_shared_areas(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ast.literal_eval(_SHARED)))
    df = entities(spark, sf_dir).withColumn("label", F.when(C("entity_id") % 5 == 1, F.element_at(names, (C("entity_id") % 12 + 1).cast("int"))).otherwise(C("label")))
    return df.groupBy("label", t.is_common(C("label")).alias("server"), t.is_common(C("label"), "inference").alias("inference")).agg(F.count("*").alias("regions"))


_KIND = """CASE WHEN label IN ('Bathroom', 'Ensuite') THEN 'bathroom' WHEN label IN ('Bedroom', 'master_bedroom') THEN 'bedroom' WHEN label = 'Balcony' THEN 'balcony'
  WHEN label = 'Communal Outdoor Garden' THEN 'communal_outdoor' ELSE 'internal' END"""


@query(f"SELECT page_id, {_KIND} AS kind, count(*) AS rooms FROM d_entities WHERE type = 'room' GROUP BY 1, 2")
def x5_room_kinds(spark, sf_dir):
    return entities(spark, sf_dir).where("type = 'room'").groupBy("page_id", t.room_kind(C("label")).alias("kind")).agg(F.count("*").alias("rooms"))


@query("SELECT page_id, count(*) AS rooms FROM d_entities WHERE type = 'room' AND label IN ('Bedroom', 'master_bedroom', 'Open Living') GROUP BY 1")
def x6_habitable_rooms(spark, sf_dir):
    return entities(spark, sf_dir).where((C("type") == "room") & t.is_habitable(C("label"))).groupBy("page_id").agg(F.count("*").alias("rooms"))


@query("""SELECT page_id, CASE WHEN bool_or(label = 'Open Living') AND bool_or(entity_id % 13 = 9) THEN 'Living / Dining / Kitchen' WHEN bool_or(label = 'Open Living') THEN 'Open Living'
  WHEN bool_or(entity_id % 13 = 9) THEN 'Kitchen / Dining' END AS label FROM d_entities GROUP BY 1""")
def x7_open_plan_labels(spark, sf_dir):
    texts = entities(spark, sf_dir).select("page_id", C("label").alias("text")).unionByName(_lines(spark, sf_dir).select("page_id", "text"))
    kinds = texts.select("page_id", F.explode_outer(t.open_plan_kinds(C("text"))).alias("kind"))
    return kinds.groupBy("page_id").agg(F.collect_set("kind").alias("kinds")).select("page_id", t.open_plan_label(C("kinds")).alias("label"))


def _per_text(column, sql):
    return f"SELECT page_id, ord, {sql} AS {column} FROM d_ocr_lines"


@query(_per_text("room", "CASE text WHEN 'BED 2' THEN 'Bedroom 2' WHEN 'KITCHEN / DINING' THEN 'Kitchen / Dining' END"))
def x8_room_names(spark, sf_dir):
    return _lines(spark, sf_dir).select("page_id", "ord", t.ocr_room_label(C("text")).alias("room"))


@query("""SELECT label, CASE WHEN label IN ('Bedroom', 'master_bedroom') THEN 'bedroom' WHEN label IN ('Bathroom', 'Ensuite') THEN 'bathroom' WHEN label = 'Open Living' THEN 'living' ELSE 'other' END AS category,
  count(*) AS regions FROM d_entities GROUP BY 1, 2""")
def x9_room_categories(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("label", t.room_category(C("label")).alias("category")).agg(F.count("*").alias("regions"))


@query("""SELECT page_id, ord, CASE WHEN text = 'FIRST FLOOR PLAN' THEN 'First Floor Plan' WHEN text LIKE 'LEVEL %' THEN concat('Level ', text[7:]) END AS level,
  CASE WHEN text = 'FIRST FLOOR PLAN' THEN 1 WHEN text LIKE 'LEVEL %' THEN greatest(CAST(text[7:] AS INT) - 1, 0) END AS level_index FROM d_ocr_lines""")
def x10_levels(spark, sf_dir):
    level = t.parse_level(C("text"))
    return _lines(spark, sf_dir).select("page_id", "ord", level.alias("level"), t.level_index(level).alias("level_index"))


@query("""SELECT page_id, ord, text[6:] AS unit_id FROM d_ocr_lines WHERE text LIKE 'UNIT %'""")
def x11_unit_ids(spark, sf_dir):
    return _lines(spark, sf_dir).select("page_id", "ord", F.explode(t.parse_unit_ids(C("text"))).alias("unit_id"))


@query("SELECT page_id, ord, CASE WHEN text LIKE 'SCALE 1:100%' THEN 100 WHEN text = '1:200' THEN 200 END AS ratio, CASE WHEN text LIKE '%@ A1' THEN 'A1' WHEN text = '@ A3' THEN 'A3' END AS paper FROM d_ocr_lines")
def x12_scales(spark, sf_dir):
    return _lines(spark, sf_dir).select("page_id", "ord", t.parse_scale(C("text")).alias("ratio"), t.parse_paper(C("text")).alias("paper"))


@query("SELECT page_id, ord, 3.9::DOUBLE AS width_m, 3.6::DOUBLE AS depth_m FROM d_ocr_lines WHERE text IN ('3.9m x 3.6m', '3900 x 3600')")
def x13_room_sizes(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("s", t.parse_room_size(C("text"))).where("s IS NOT NULL").select("page_id", "ord", "s.width_m", "s.depth_m")


@query("SELECT page_id, count(*) FILTER (text = 'Type 2B') AS types, max(CASE WHEN text = 'Type 2B' THEN 2 END) AS bedrooms FROM d_ocr_lines GROUP BY 1")
def x14_bedroom_types(spark, sf_dir):
    token = F.regexp_replace(C("text"), r"(?i)^types?[:.\s]+", "")
    df = _lines(spark, sf_dir).withColumn("n", F.when(C("text").rlike("(?i)^type"), t.bedroom_type(token)))
    return df.groupBy("page_id").agg(F.count("n").alias("types"), F.max("n").alias("bedrooms"))


@query("""SELECT page_id, CASE WHEN bool_or(text IN ('FIRST FLOOR PLAN', 'General Arrangement') OR text LIKE 'LEVEL %') THEN 'ga' ELSE 'unknown' END AS sheet FROM d_ocr_lines GROUP BY 1""")
def x15_sheet_types(spark, sf_dir):
    whole = _lines(spark, sf_dir).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.select("page_id", t.sheet_type(C("text")).alias("sheet"))


@query("""SELECT DISTINCT label, CAST(label[6:] AS BIGINT) AS number, '' AS suffix, label[6:] AS key FROM d_entities WHERE type = 'unit_boundary'""")
def x16_unit_keys(spark, sf_dir):
    key = t.unit_sort_key(C("label"))
    return entities(spark, sf_dir).where("type = 'unit_boundary'").select("label", key["number"].alias("number"), key["suffix"].alias("suffix"), t.unit_key(C("label")).alias("key")).distinct()


@query("""SELECT page_id, concat('Scale ', coalesce(CASE WHEN ppm >= 10 THEN printf('%.1f', ppm) ELSE printf('%.2f', ppm) END, '—'), ' on level ', printf('%.2f', level_index::DOUBLE)) AS shown FROM d_pages""")
def x17_filled_templates(spark, sf_dir):
    return views(spark, sf_dir, "d_pages").select("page_id", t.fill_template(F.lit("Scale {ppm} on level {level}"), {"ppm": C("ppm"), "level": C("level_index")}).alias("shown"))


def policy_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


_LINES = "(SELECT doc_id, i - 1 AS line_no, t[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents) d, unnest(range(1, len(t) + 1)) AS u(i))"
_HINTS = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{k}'" for k, p in policy_text.KIND_HINTS.items())
_NOISE = r"(length(trim(text)) < 8 OR regexp_matches(trim(text), '(?i)^page\s+\d+(\s+of\s+\d+)?$') OR regexp_matches(trim(text), '^\d+$') OR (regexp_matches(trim(text), '\.{4,}') AND length(trim(text)) < 80) OR lower(trim(text)) IN ('contents', 'table of contents', 'index'))"
_ITEM = policy_text.LIST_ITEM.removeprefix("(?i)")


@query(rf"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {_NOISE} AS is_noise, regexp_matches(text, '{policy_text.OBLIGATION}') AS obliges, regexp_matches(trim(text), '(?i){_ITEM}') AS is_item,
  CASE {_HINTS} END AS kind, length(trim(text)) BETWEEN 3 AND 100 AND NOT {_NOISE} AND (regexp_matches(trim(text), '^\d+(\.\d+){{0,4}}\s+\S')
  OR regexp_matches(trim(text), '(?i)^(standard|objective|requirement|design|clause|part|section|appendix|element|control)\b')
  OR (length(regexp_replace(trim(text), '[^A-Za-z]', '', 'g')) >= 6 AND regexp_replace(trim(text), '[^A-Za-z]', '', 'g') = upper(regexp_replace(trim(text), '[^A-Za-z]', '', 'g')) AND length(trim(text)) <= 80)) AS is_heading
FROM {_LINES} l""")
def x18_guideline_flags(spark, sf_dir):
    flags = policy_text.guideline_flags(C("text"))
    return policy_lines(spark, sf_dir).select("doc_id", C("line_no").cast("long").alias("line_no"), *(v.alias(k) for k, v in flags.items()))


