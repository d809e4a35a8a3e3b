"""Queries of policy packs: a part of the table as a pack, its shape by the part's size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import policy_packs
from ..workspace import table
from .registry import query

C = F.col
#: Packs by size modulo 4: rules alone in both spellings, rules with guidelines, groups, and no JSON.  @ stands for the part's columns.
_PACKS = (
    '{"rules": [{"code": " @brand ", "name": "@name", "min_area_m2": @size, "room_labels": ["@name", " ", "x "], "requires_scale": true, "severity": "info"}, 5, {"requiredLabels": ["@type"], "clause": ""},'
    ' {"minWallCount": "3", "requiresScale": false}, {"by_bedrooms": {"0": 35, "3+": "90", "2": "wide"}, "name": "Living @name"}]}',
    '{"rules": [{"kind": "apartment_min_pos", "source_text": "@name"}, {"kind": "nonsense", "m2PerDwelling": 25, "code": "C"}, {"kind": "apartment_min_pos", "guidelineId": "mine", "source_text": "@name"}, {"kind": "apartment_min_pos", "name": "second"}],'
    ' "guidelines": [{"name": "@type", "text": "@name", "source_text": "@name", "mapped_kind": "apartment_min_pos", "status": "accepted", "group": "@brand"}, {"name": "second", "mappedKind": "apartment_min_pos", "sourceText": "@name", "clause": "B"}, {"name": " "}]}',
    '{"guidelines": [null, {"text": ""}], "groups": [{"title": "@type", "items": [{"text": "@name", "mapped_kind": "habitable_has_window"}, 7, {"id": "own", "name": "n", "mappedKind": "unknown"},'
    ' {"text": "@name", "mapped_kind": "apartment_min_storage", "clause": "C1"}]}, "no group", {"guidelines": [{"text": "", "name": ""}, {"sourceText": "@brand", "mapped_kind": "room_min_area", "group": "other"}]}]}',
    "@name of @brand",
)


def packs(spark, sf_dir):
    # A part is a small row and a large pack: a file that one task reads would keep all its packs in that task.
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size", "p_type").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    pack = F.lit("")
    for k, text in enumerate(_PACKS):
        t = F.lit(text)
        for word, c in (("@brand", "p_brand"), ("@name", "p_name"), ("@size", "p_size"), ("@type", "p_type")):
            t = F.replace(t, F.lit(word), C(c).cast("string"))
        pack = F.when(C("p_size") % 4 == k, t).otherwise(pack)
    return p.select(C("p_partkey").alias("pack_id"), pack.alias("pack"))


_RULE = "pack_id, n, code, name, kind, guideline_id, clause, severity, requires_scale, source_text, labels, min_area_m2, required, min_wall_count, bands, m2_per_dwelling"


def _case(k: int, n: int | str, **values: str) -> str:
    """One row for each pack of a shape; what is not given is null, but severity and scale."""
    v = {"severity": "'fail'", "requires_scale": "false", "min_area_m2": "CAST(NULL AS DOUBLE)", "min_wall_count": "CAST(NULL AS DOUBLE)", "m2_per_dwelling": "CAST(NULL AS DOUBLE)"} | values | {"pack_id": "p_partkey", "n": f"CAST({n} AS BIGINT)"}
    return f"SELECT {', '.join(f'{v.get(c, "CAST(NULL AS VARCHAR)")} AS {c}' for c in _RULE.split(', '))} FROM part WHERE p_size % 4 = {k}"


@query(
    " UNION ALL ".join(
        [
            _case(0, 0, code="p_brand", name="p_name", kind="'room_min_area'", severity="'info'", requires_scale="true", labels="concat(p_name, ',x')", min_area_m2="CAST(p_size AS DOUBLE)"),
            _case(0, 2, code="'RULE-3'", name="'RULE-3'", kind="'required_labels'", required="p_type"),
            _case(0, 3, code="'RULE-4'", name="'RULE-4'", kind="'min_wall_count'", min_wall_count="CAST(3 AS DOUBLE)"),
            _case(0, 4, code="'RULE-5'", name="concat('Living ', p_name)", kind="'apartment_min_living'", bands="'0=35 3=90'"),
            _case(1, 0, code="'RULE-1'", name="'RULE-1'", kind="'apartment_min_pos'", guideline_id="'g-1'", source_text="p_name"),
            _case(1, 1, code="'C'", name="'C'", kind="'communal_open_space'", m2_per_dwelling="CAST(25 AS DOUBLE)"),
            _case(1, 2, code="'RULE-3'", name="'RULE-3'", kind="'apartment_min_pos'", guideline_id="'mine'", source_text="p_name"),
            _case(1, 3, code="'RULE-4'", name="'second'", kind="'apartment_min_pos'", guideline_id="'g-2'"),
            _case(2, 0, code="'G-1'", name="p_name", kind="'habitable_has_window'", guideline_id="'g-1'", source_text="p_name"),
            _case(2, 3, code="'C1'", name="p_name", kind="'apartment_min_storage'", guideline_id="'g-3'", clause="'C1'", requires_scale="true", source_text="p_name"),
            _case(2, (2 << 32) + 1, code="'G-4'", name="p_brand", kind="'room_min_area'", guideline_id="'g-4'", requires_scale="true", source_text="p_brand"),
        ]
    )
)
def s5_policy_rules(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",")
    bands = F.array_join(F.transform(F.array_sort(F.map_entries("by_bedrooms")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("long").cast("string"))), " ")
    rules = policy_packs.read_policy_rules(packs(spark, sf_dir)).withColumns({"labels": joined("room_labels"), "required": joined("required_labels"), "bands": bands})
    return rules.select(*_RULE.split(", "))


_G = "pack_id, n, guideline_id, group, name, text, clause, source_text, status, mapped_kind"


@query("""SELECT p_partkey AS pack_id, CAST(n AS BIGINT) AS n, guideline_id, CASE title WHEN '@type' THEN p_type WHEN '@brand' THEN p_brand ELSE title END AS "group", CASE name WHEN '@type' THEN p_type WHEN '@name' THEN p_name WHEN '@brand' THEN p_brand ELSE name END AS name,
  CASE txt WHEN '@name' THEN p_name WHEN '@brand' THEN p_brand ELSE txt END AS text, clause, CASE src WHEN '@name' THEN p_name WHEN '@brand' THEN p_brand END AS source_text, status, kind AS mapped_kind
FROM part JOIN (VALUES (1, 0, 'g-1', '@brand', '@type', '@name', NULL, '@name', 'accepted', 'apartment_min_pos'), (1, 1, 'g-2', 'General', 'second', '@name', 'B', '@name', 'pending', 'apartment_min_pos'),
  (2, 0, 'g-1', '@type', '@name', '@name', NULL, NULL, 'pending', 'habitable_has_window'), (2, 2, 'own', '@type', 'n', 'n', NULL, NULL, 'pending', NULL), (2, 3, 'g-3', '@type', '@name', '@name', 'C1', NULL, 'pending', 'apartment_min_storage'),
  (2, 8589934593, 'g-4', 'General', '@brand', '@brand', NULL, '@brand', 'pending', 'room_min_area')) v(k, n, guideline_id, title, name, txt, clause, src, status, kind) ON p_size % 4 = k""")
def s5_guidelines(spark, sf_dir):
    return policy_packs.read_guidelines(packs(spark, sf_dir)).select(*_G.split(", "))


@query("""WITH g AS (SELECT p_partkey // 8 AS doc_id, p_partkey AS part, pos, p_name, p_type, p_brand FROM part JOIN (VALUES (0), (1), (2)) v(pos) ON p_size % 4 = 1
  UNION ALL SELECT p_partkey // 8, p_partkey, 1, NULL, NULL, NULL FROM part WHERE p_size % 4 = 2),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) AS n FROM g)
SELECT CAST(doc_id AS BIGINT) AS doc_id, n, concat('g-', n) AS guideline_id, CASE WHEN pos = 1 AND p_name IS NOT NULL THEN 'B' ELSE concat('G-', n) END AS code, CASE pos WHEN 0 THEN p_type ELSE 'second' END AS name,
  'apartment_min_pos' AS kind, p_name AS source_text, true AS requires_scale FROM m WHERE p_name IS NOT NULL AND pos < 2""")
def s5_merged_rules(spark, sf_dir):
    parts = packs(spark, sf_dir).select(F.floor(C("pack_id") / 8).alias("doc_id"), C("pack_id").alias("part"), "pack")
    return policy_packs.merge_packs(parts)[1].select("doc_id", "n", "guideline_id", "code", "name", "kind", "source_text", "requires_scale")
