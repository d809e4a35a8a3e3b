"""Faults that showed on larger tables only, on rows that have them."""

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sheetspan import workspace
from sheetspan.functions import geometry as g
from sheetspan.functions import text as t
from sheetspan.operators import grid, policy_lines
from sheetspan.plans import q_columns, q_graph, q_hierarchy, q_labels, q_policy, q_policy_packs, q_room_text, q_rollup, q_text_tiles, q_types, q_units, registry  # noqa: F401


def test_labels_work_out_a_text_once(spark):
    """F6 (x8_room_names), F1, F19, F21: the folded text stood in the plan once for each rule that looked at it."""
    df = spark.createDataFrame([("BED 2",), ("Living / Dining",), ("Toilet & bath",), ("2 Bed",), ("W.I.R.",), (None,)], "text string")
    out = df.select("text", t.ocr_room_label(F.col("text")).alias("room"), t.open_plan_kinds(F.col("text")).alias("kinds"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 4
    got = {r["text"]: (r["room"], r["kinds"]) for r in out.collect()}
    assert got["BED 2"] == ("Bedroom 2", []) and got["Living / Dining"] == ("Living / Dining", ["living", "dining"]) and got["2 Bed"][0] is None and got[None][0] is None


def _lineitem(folder, rows):
    """A lineitem table of (orderkey, partkey, suppkey, quantity)."""
    o, p, s, q = zip(*rows, strict=True)
    n = len(rows)
    pq.write_table(pa.table({
        "l_orderkey": pa.array(o, pa.int64()), "l_partkey": pa.array(p, pa.int64()), "l_suppkey": pa.array(s, pa.int64()), "l_linenumber": pa.array([1] * n, pa.int32()),
        "l_quantity": pa.array(q, pa.float64()), "l_extendedprice": pa.array([1.0] * n), "l_discount": pa.array([0.1] * n), "l_shipdate": pa.array([0] * n, pa.timestamp("us")),
    }), f"{folder}/lineitem.parquet")


def test_point_on_a_slanted_side(spark, tmp_path):
    """F4 (c7_regions_over_point): (500.3, 400.7) lies on the right slanted side of both outlines; rounding puts it in for one formula, out for the other."""
    def keys(x, y, h):
        pk = next(p for p in range(60_000) if p * 37 % 1000 == x and 20 + p % 60 * 4 == h)
        return pk, next(s for s in range(800) if (s * 53 + pk) % 800 == y)

    _lineitem(tmp_path, [(0, *keys(453, 244, 136), 12), (8, *keys(441, 112, 232), 24), (16, *keys(441, 300, 232), 24)])
    got = sorted(map(tuple, registry.QUERIES["c7_regions_over_point"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert got == sorted(c.sql(registry.ORACLE_SQL["c7_regions_over_point"]).fetchall()) and {r[0] for r in got} >= {0, 1}


def test_packs_are_not_read_by_one_task(spark):
    """F5, F11 (s5_policy_rules, s5_guidelines): the part table is one small file, so one task parsed every pack."""
    assert q_policy_packs.packs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_grid_regions_take_no_rounds(spark, tmp_path, monkeypatch):
    """F3 (h11_grid_regions): regions took rounds of joins over all runs; boxes were walked along like any outline.  Boxes and the same outlines with one more corner agree."""
    df = spark.createDataFrame([(p, x, y, w, h) for p in (1, 2) for x, y, w, h in ((100.0, 100.0, 300.0, 20.0), (100.0, 300.0, 300.0, 20.0), (100.0, 100.0, 20.0, 220.0), (380.0, 100.0, 20.0, 220.0))], "page_id long, x double, y double, w double, h double")
    pages = df.select("page_id", F.lit(640.0).alias("width_px"), F.lit(640.0).alias("height_px")).distinct()
    box = df.select("page_id", g.rect_points(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("points"))
    more = df.select("page_id", F.array(*(g.point(F.col("x") + a * F.col("w"), F.col("y") + b * F.col("h")) for a, b in ((0, 0), (0.5, 0), (1, 0), (1, 1), (0, 1)))).alias("points"))
    none = df.where("false").select("page_id", F.lit(1).cast("long").alias("unit_id"), F.array(g.point(F.col("x"), F.col("y"))).alias("points"))
    rooms = none.select("page_id", F.col("unit_id").alias("ord"), F.lit("").alias("label"), "points")
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    a, b = (sorted(grid.grid_regions(pages, walls, none, rooms, most=32).collect(), key=str) for walls in (box, more))
    assert a == b and len(a) >= 2 and not list(tmp_path.glob("edges-*"))


def test_runs_of_a_clip_over_batches():
    """Runs of one clip that come in two batches are joined, those of another page or clip are not."""
    rows = [(1, "", 0, 0, 3, 10), (1, "", 0, 5, 9, 11), (1, "", 1, 2, 6, 12), (1, "7", 2, 2, 6, 13), (2, "", 2, 0, 9, 14), (2, "", 4, 0, 9, 15)]
    part = pd.DataFrame(rows, columns=["page_id", "clip", "row", "lo", "hi", "run"])
    for k in range(1, 6):
        out = pd.concat(grid._regions(iter([part.iloc[:k], part.iloc[k:]])))
        assert dict(zip(out["run"], out["region"], strict=True)) == {10: 10, 11: 10, 12: 10, 13: 13, 14: 14, 15: 15}


def test_anchor_rooms_write_what_is_read_twice(spark, tmp_path, monkeypatch):
    """F1 (j13_anchor_rooms): rooms, names and matches were worked out anew wherever they were read."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    registry.QUERIES["j13_anchor_rooms"](spark, "/root/testdata/sf0.001")
    assert [len(list(tmp_path.glob(f"{name}-*"))) for name in ("rooms", "seeds", "matches")] == [1, 1, 1]


def test_lines_of_a_document_are_shuffled_once(spark):
    """F2 (j20_guideline_lines): each token was shuffled once for each stretch of four characters."""
    lines = spark.createDataFrame([(1, 0, 1, "Living rooms shall face north"), (1, 1, 1, "Contents"), (None, 2, 1, "Living rooms shall face north")], "doc_id long, ord int, page long, text string")
    wanted = spark.createDataFrame([(1, "a", "rooms shall face the north"), (None, "b", "rooms shall face the north"), (1, "c", None)], "doc_id long, guideline_id string, excerpt string")
    found = policy_lines.best_lines(wanted, lines)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert [(r["doc_id"], r["guideline_id"], r["ord"], r["n"]) for r in found.collect()] == [(1, "a", 0, 1)]


def test_scales_are_cleaned_once_and_where_there_may_be_one(spark):
    """F16 (a10_sheet_meta), F18, F24: the cleaned text stood in the plan once for each pattern, and every text was cleaned."""
    texts = ["SCALE 1:100 @ A1", "l:100", "I/50", "1 to 200", "1-1OO", "1:1O @ A 3.", "A1x:50 @ A3", "scale: 1.75", "1.100 @ A2", "１：２００", "© A3", "@ iso b2", "L = 20", "1\t:\t25", "UNIT 121", "LEVEL 3", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    text = F.col("text")
    out = df.select("text", t.read_scale(text).alias("s"), t.parse_scale(text).alias("ratio"), t.parse_paper(text).alias("paper"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 3
    plain = {r["text"]: (r["r"], r["p"]) for r in df.select("text", t._ratio_of(t.clean_scale_text(text)).alias("r"), t._paper_of(t.clean_scale_text(text)).alias("p")).collect()}
    got = {r["text"]: (r["ratio"], r["paper"]) for r in out.collect()}
    assert got == plain and {r["text"]: ((r["s"] or {"ratio": None})["ratio"], (r["s"] or {"paper": None})["paper"]) for r in out.collect()} == plain
    assert got["l:100"] == (100, None) and got["SCALE 1:100 @ A1"] == (100, "A1") and got["A1x:50 @ A3"] == (50, "A3")
    levels = df.sparkSession.createDataFrame([("First floor plan",), ("2nd level",), ("Level GF",), ("L 3a",), ("Lower ground plan",), ("Bed",), (None,)], "text string").select(t.parse_level(text).alias("v"))
    assert levels._jdf.queryExecution().optimizedPlan().toString().count("lower(trim(") <= 1
    assert [r["v"] for r in levels.collect()] == ["First Floor Plan", "Level 2", "Ground Floor", "Level 3A", "Lower Ground Plan", None, None]


@pytest.mark.parametrize(("name", "kept"), [
    ("h7_cross_ventilation", ("entities", "rooms", "openings")), ("a7_room_properties", ("entities", "rooms")), ("h2_room_clusters", ("entities", "rooms", "near")), ("a20_unit_wall_counts", ("entities", "rooms")),
    ("h5_merged_text", ("readings",)), ("n6_type_hits", ("type_lines",)), ("h4_merged_tiles", ("tiles",)), ("h8_room_ego", ("entities", "rooms", "openings")), ("j17_scales_of_pages", ("scales", "tokens")),
    ("h3_inferred_units", ("entities",)), ("p8_min_bedroom", ("entities", "pages", "contained")), ("j29_opening_records", ("entities",)), ("n14_resolved_scales", ("scales",)),
])
def test_tables_read_several_times_are_written_once(spark, tmp_path, monkeypatch, name, kept):
    """What a query reads several times was worked out anew each time."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [len(list(tmp_path.glob(f"{table}-*"))) for table in kept] == [1] * len(kept)


def test_centres_and_boxes_read_an_outline_once(spark):
    """F20 (h3_inferred_units), F23, F7: the outline stood in the plan once for each sum, and the centre once for each grid cell bound."""
    df = spark.createDataFrame([("[[0,0],[4,0],[4,2],[0,2]]",), ("[[1,1],[3,5]]",), ("[]",), (None,)], "text string")
    ring = F.transform(F.from_json("text", "array<array<double>>"), lambda p: g.point(p[0], p[1]))
    out = df.select(g.centroid(ring).alias("c"), g.bbox_of(ring).alias("b"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 2
    assert [(*r["c"], *r["b"]) for r in out.collect()] == [(2.0, 1.0, 0.0, 0.0, 4.0, 2.0), (2.0, 3.0, 1.0, 1.0, 2.0, 4.0), (0.0,) * 6, (0.0,) * 6]
