"""Small cases of the hierarchy, the scale of a page, entrances and unit numbers."""

from pyspark.sql import functions as F

from sheetspan.functions import geometry as g
from sheetspan.operators import entrances as en
from sheetspan.operators import rollup
from sheetspan.operators import hierarchy as hi
from sheetspan.operators import text_rows as tr

LINE = "page_id long, ord long, text string, confidence double, x double, y double, w double, h double"
REGION = "page_id long, entity_id long, ord long, type string, label string, status string, confidence double, unit_ref long, unit_text string, printed_m2 double, x double, y double, w double, h double"
PAGE = "page_id long, building_id string, is_floor_plan boolean, ppm double"


def lines(spark, rows):
    df = spark.createDataFrame(rows, LINE)
    return df.withColumn("bbox", F.when(F.col("x").isNotNull(), g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))))


def regions(spark, rows):
    return spark.createDataFrame(rows, REGION).withColumn("points", g.rect_points(*(F.col(c) for c in "xywh")))


def nodes(spark, rows, pages):
    return {(r["kind"], r["node_id"]): r for r in hi.hierarchy(regions(spark, rows), spark.createDataFrame(pages, PAGE)).collect()}


def test_room_takes_unit_by_attribute_then_number_then_place(spark):
    at = lambda i, kind, label, x, ref=None, text=None, status="predicted", w=40.0: (1, i, i, kind, label, status, 0.9, ref, text, None, x, 0.0, w, 40.0)
    rows = [
        at(1, "unit_boundary", "Unit 1", 0.0, w=100.0), at(2, "unit_boundary", "Unit 2", 100.0, w=100.0), at(3, "unit_boundary", "Unit 3", 0.0, status="rejected", w=900.0),
        at(10, "room", "Bedroom", 10.0, ref=2), at(11, "room", "Bath", 10.0, text="unit 2"), at(12, "room", None, 10.0, ref=99), at(13, "room", "Lobby", 10.0),
        at(14, "room", "Store", 500.0), at(20, "door", "", 12.0, w=4.0), at(21, "window", "Window", 700.0),
    ]
    got = nodes(spark, rows, [(1, "B", None, 10.0)])
    assert {i: got["room", str(i)]["unit_id"] for i in range(10, 15)} == {10: "2", 11: "2", 12: "1", 13: None, 14: None}
    assert (got["unit", "2"]["rooms"], got["unit", "2"]["bedrooms"], got["unit", "2"]["bathrooms"], got["unit", "1"]["rooms"]) == (2, 1, 1, 1)
    assert (got["room", "12"]["label"], got["room", "10"]["area_m2"], got["floor", "floor-1"]["rooms"]) == ("Room", 16.0, 5)
    assert got["object", "20"]["label"] == "door" and got["object", "20"]["parent_id"] == "10" and got["object", "20"]["unit_id"] == "2"
    assert got["object", "21"]["parent_id"] == "floor-1" and ("unit", "3") not in got and ("unit", "unit-fallback-1") not in got


def test_pages_without_units_get_a_fallback(spark):
    room = lambda page, i, label, m2: (page, i, i, "room", label, "predicted", 0.5, None, None, m2, 0.0, 0.0, 10.0, 10.0)
    door = (1, 7, 7, "door", "Door", "predicted", 0.5, None, None, None, 2.0, 2.0, 2.0, 2.0)
    pages = [(1, "B", True, 5.0), (2, "B", True, None), (3, "B", False, 5.0), (4, "B", True, 5.0)]
    got = nodes(spark, [room(1, 1, "Bed 1", 3.5), room(1, 2, "Lobby", 9.0), room(2, 3, "Bed", 3.0), room(3, 4, "Bed", 3.0), door], pages)
    units = {k[1]: (r["rooms"], r["bedrooms"], r["area_m2"], r["confidence"]) for k, r in got.items() if k[0] == "unit"}
    assert units == {"unit-fallback-1": (1, 1, 3.5, 0.5), "unit-fallback-2": (1, 1, None, 0.5), "unit-fallback-4": (0, 0, None, 0.5)}
    assert got["room", "1"]["unit_id"] == "unit-fallback-1" and got["object", "7"]["parent_id"] == "1" and got["object", "7"]["unit_id"] is None
    assert not [k for k in got if got[k]["page_id"] == 3]
    assert nodes(spark, [], []) == {}


def test_scale_of_page(spark):
    far = 5000.0
    rows = [
        (1, 1, "1:200", 0.9, 0.0, 0.0, 40.0, 14.0), (1, 2, "SCALE 1:100 @ A1", 0.1, far, 0.0, 40.0, 14.0),
        (2, 1, "1:200", 0.9, 0.0, 0.0, 40.0, 14.0), (2, 2, "@ A3", 0.9, far, 0.0, 40.0, 14.0), (2, 3, "1:50", 0.1, far, 30.0, 40.0, 14.0),
        (3, 1, "1:200", 0.9, 0.0, 0.0, 40.0, 14.0), (3, 2, "Scale", 0.9, far, 0.0, 40.0, 14.0), (3, 3, "1:50", 0.1, far, 30.0, 40.0, 14.0),
        (4, 1, "1:200", 0.5, None, None, None, None), (4, 2, "", 0.5, 0.0, 0.0, 40.0, 14.0), (4, 3, None, 0.5, 0.0, 0.0, 40.0, 14.0), (4, 4, "@ A3", 0.5, None, None, None, None),
        (5, 1, "1:200", 0.5, None, None, None, None), (5, 2, "x", None, None, None, None, None), (5, 3, "@ A3", 0.5, None, None, None, None), (6, 1, "@ A3", 0.5, 0.0, 0.0, 40.0, 14.0),
    ]
    got = {r["page_id"]: (r["declared"], r["source"]) for r in hi.scale_of_page(lines(spark, rows)).collect()}
    assert got == {1: ("1:100 @ A1", "line"), 2: ("1:50 @ A3", "pair"), 3: ("1:50", "ratio"), 4: ("1:200", "ratio"), 5: ("1:200 @ A3", "pair")}


def test_numbers_go_to_the_first_word_that_is_nearest(spark):
    rows = [
        (1, 1, "UNIT", 1.0, 0.0, 0.0, 40.0, 14.0), (1, 2, "apt.", 1.0, 10.0, 30.0, 40.0, 14.0), (1, 3, "# 12a", 1.0, 60.0, 0.0, 20.0, 14.0),
        (1, 4, "7", 1.0, 10.0, 60.0, 40.0, 14.0), (1, 5, "12345", 1.0, 60.0, 2.0, 40.0, 14.0), (2, 1, "Unit", 1.0, 0.0, 0.0, 40.0, 14.0), (2, 2, "3", 1.0, 400.0, 0.0, 40.0, 14.0),
    ]
    got = {(r["page_id"], r["word_ord"], r["unit"]) for r in en.prefix_numbers(lines(spark, rows)).collect()}
    assert got == {(1, 1, "12A"), (1, 2, "7")}


def test_corridor_seeds(spark):
    doors = [(1, 1, 0.0, 0.0, False), (2, 1, 0.0, 1.0, False), (2, 2, 90.0, -1.0, None), (2, 3, 400.0, 300.0, False), (3, 1, 0.0, 0.0, True), (3, 2, 90.0, 0.0, False), (4, 1, 0.0, 0.0, None), (4, 2, 200.0, 200.0, None)]
    df = spark.createDataFrame(doors, "page_id long, ord long, x double, y double, wide boolean")
    got = {}
    for r in en.corridor_seeds(df, 10.0).orderBy("page_id", "k").collect():
        got.setdefault(r["page_id"], []).append((r["x"], r["y"]))
    assert got == {1: [(0.0, -20.0)], 2: [(0.0, -25.0), (0.0, 25.0), (45.0, -25.0), (45.0, 25.0), (90.0, -25.0), (90.0, 25.0)], 3: [(0.0, -20.0)]}


def spans(spark, rows):
    return spark.createDataFrame([(p, i, i, label, float(n)) for p, i, n, label in rows], "page_id long, entity_id long, ord long, label string, span double")


def test_widths_part_at_the_middle_of_the_largest_gap(spark):
    rows = [(1, 1, 20, "Door"), (1, 2, 21, "Door"), (1, 3, 40, "Door"), *((2, 10 + k, 20 + k, "Door") for k in range(4)), (3, 20, 30, "Door"), (4, 30, 30, None), (4, 31, 0, "Main Door")]
    rows += [(5, 40, 20, "Door"), (5, 41, 20.5, "main_door"), (5, 42, 21, "Sub Main Door"), (6, 50, 10, "Door"), (6, 51, 14, "Door"), (6, 52, 18, "Door"), (7, 60, 0, "Door")]
    df = spans(spark, rows)
    assert {r["page_id"]: r["split"] and round(r["split"], 6) for r in rollup.door_width_split(df).collect()} == {1: 30.5, 2: 21.05, 3: None, 4: None, 5: None, 6: 12.0, 7: None}
    auto = {r["entity_id"] for r in rollup.wide_doors(df).where("wide").collect()}
    assert auto == {3, 12, 13, 20, 30, 41, 51, 52}
    fixed = {r["entity_id"] for r in rollup.wide_doors(df, "threshold").where("wide").collect()}
    assert fixed == {3, 20, 30, 41}


def test_entrances_fall_back_from_width_to_place(spark):
    door = lambda page, i, x, span, label="Door": (page, i, i, label, float(span), x, 0.0, 2.0, 2.0)
    rows = [
        door(1, 1, 20.0, 40), door(1, 2, 2.0, 20), door(2, 3, 500.0, 40), door(2, 4, 600.0, 40), door(2, 5, 2.0, 20), door(3, 6, 500.0, 40), door(3, 7, 12.0, 20),
        door(4, 8, 0.0, 40), door(4, 9, 5.0, 20), door(5, 10, 28.0, 20), door(5, 11, 90.0, 20), door(6, 12, 0.0, 20, "Main Door"), door(6, 14, 0.0, 40), door(7, 13, 0.0, 20),
        door(8, 15, 90.0, 20), door(8, 16, 90.0, 20), door(9, 17, 500.0, 20, "Main Door"), door(9, 18, 500.0, 20), door(9, 19, 2.0, 0),
    ]
    df = spark.createDataFrame(rows, "page_id long, entity_id long, ord long, label string, span double, x double, y double, w double, h double").withColumn("points", g.rect_points(*(F.col(c) for c in "xywh")))
    shared = spark.createDataFrame([(p, -10.0, -5.0, 5.0, 10.0) for p in (1, 2, 3, 5, 9)], "page_id long, x double, y double, w double, h double").withColumn("points", g.rect_points(*(F.col(c) for c in "xywh")))
    got = {(r["entity_id"], r["rule"]) for r in en.entrances(df, shared, 16.0).collect()}
    assert got == {(1, "wide_near"), (3, "wide"), (4, "wide"), (7, "near_2"), (8, "wide"), (10, "near_2.5"), (12, "wide"), (14, "wide"), (13, "wide"), (17, "near"), (19, "near")}
    by_least = {(r["entity_id"], r["rule"]) for r in en.entrances(df, shared, 16.0, "threshold").collect()}
    assert by_least == {(1, "wide"), (3, "wide"), (4, "wide"), (6, "wide"), (8, "wide"), (12, "wide"), (14, "wide"), (10, "near_2.5"), (17, "wide")}


def test_text_rows_compare_with_the_first_piece_of_a_row(spark):
    rows = [
        (1, 1, "b  c", 1.0, 50.0, 5.0, 20.0, 10.0), (1, 2, "a", 1.0, 0.0, 0.0, 10.0, 10.0), (1, 3, "d", 1.0, 90.0, 10.0, 10.0, 10.0), (1, 4, " ", 1.0, 0.0, 0.0, 900.0, 10.0), (1, 5, None, 1.0, 0.0, 0.0, 1.0, 1.0),
        (2, 1, "x", 1.0, 5.0, 0.0, 4.0, 1.0), (2, 2, "y", 1.0, 5.0, 0.0, 4.0, 1.0), (3, 1, "", 1.0, 0.0, 0.0, 1.0, 1.0),
    ]
    got = sorted((r["page_id"], r["row"], r["text"], r["x"], r["y"], r["w"], r["h"]) for r in tr.text_rows(lines(spark, rows)).collect())
    assert got == [(1, 1, "a b c", 0.0, 0.0, 70.0, 15.0), (1, 2, "d", 90.0, 10.0, 10.0, 10.0), (2, 1, "x y", 5.0, 0.0, 4.0, 1.0)]
