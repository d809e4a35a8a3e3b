"""Small cases of one-to-one labels, inferred units, text over tiles and enclosed spaces, against plain versions."""

import random

from pyspark.sql import functions as F

from sheetspan.functions import geometry as g
from sheetspan.operators import grid, room_text, text_tiles, types, units
from sheetspan.sources import keypoints


def box_columns():
    return [F.col(c) for c in "xywh"]


def greedy(items, seeds):
    pairs = sorted(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, a[1], b[1]) for a in items for b in seeds if a[0] == b[0])
    out, used = [], set()
    for d, i, s in pairs:
        if ("i", i) not in used and ("s", s) not in used:
            used |= {("i", i), ("s", s)}
            out.append((i, s, d))
    return sorted(out)


def test_assign_greedy_takes_pairs_in_order_of_distance(spark):
    r = random.Random(5)
    at = lambda page, i, k: (page, i, float(r.randrange(k)), float(r.randrange(k)))
    items = [at(i % 3, i, 12 if i % 3 else 3000) for i in range(40)] + [(9, 100, 0.0, 0.0), (8, 101, None, 1.0)]
    seeds = [at(i % 3, 500 + i, 12 if i % 3 else 3000) for i in range(30)] + [(8, 600, 0.0, 0.0), (7, 601, 1.0, 1.0)]
    a = spark.createDataFrame(items, "page_id long, item_id long, x double, y double")
    b = spark.createDataFrame(seeds, "page_id long, seed_id long, sx double, sy double")
    got = sorted((x["item_id"], x["seed_id"], x["d2"]) for x in units.assign_greedy(a, b, reach=64.0).collect())
    assert got == greedy([x for x in items if x[2] is not None], seeds) and len(got) == 30
    assert units.assign_greedy(a.limit(0), b).count() == 0 == units.assign_greedy(a, b.limit(0)).count()


def plain_hull(points):
    p = sorted(set(points))
    if len(p) < 3:
        return p
    half = []
    for own in (p, p[::-1]):
        chain = []
        for c in own:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (c[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (c[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(c)
        half.append(chain[:-1])
    return half[0] + half[1]


def test_hull(spark):
    r = random.Random(6)
    sets = [[(float(r.randrange(k)), float(r.randrange(k))) for _ in range(n)] for k in (2, 4, 9, 100) for n in (1, 2, 3, 5, 20, 60)]
    sets += [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (5.0, 5.0)], [(3.0, y) for y in (4.0, 1.0, 2.0)], []]
    df = spark.createDataFrame(list(enumerate(sets)), "k int, points array<struct<x:double,y:double>>")
    for row in df.select("k", units.hull(F.col("points")).alias("hull")).collect():
        assert [tuple(p) for p in row["hull"]] == plain_hull(sets[row["k"]])
    one = spark.createDataFrame([(0, s) for s in sets], "k int, points array<struct<x:double,y:double>>")
    assert [tuple(p) for p in units.hulls(one, ["k"]).first()["hull"]] == plain_hull([p for s in sets for p in s])


def test_units_are_inferred_around_rooms_that_doors_join(spark):
    region = lambda page, i, kind, label, x, y, w=10.0, h=10.0: (page, i, i, kind, label, "predicted", x, y, w, h)
    rows = [
        region(1, 1, "room", "Bed", 100.0, 0.0), region(1, 2, "room", "Bath", 111.0, 0.0), region(1, 3, "door", "Door", 110.0, 4.0, 1.0, 1.0), region(1, 4, "room", "Kitchen", 0.0, 50.0),
        region(1, 5, "door", "Main Door", -1.0, 54.0, 1.0, 1.0), region(1, 6, "room", "Lobby", 0.0, 62.0), region(1, 7, "room", "Store", 300.0, 300.0), region(1, 8, "unit_boundary", "Unit 7", 299.0, 299.0, 20.0, 20.0),
        region(2, 9, "room", "Bed", 0.0, 0.0), region(3, 10, "room", "Lobby", 0.0, 0.0), region(3, 11, "door", "Door", 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "page_id long, entity_id long, ord long, type string, label string, status string, x double, y double, w double, h double")
    df = df.withColumn("points", g.rect_points(*box_columns())).withColumn("bbox", g.box(*box_columns()))
    got = {r["unit_id"]: r for r in units.infer_units(df, pad=3.0).collect()}
    assert {k: (r["page_id"], r["label"], r["room_ids"], r["entrance_ids"]) for k, r in got.items()} == {1: (1, "Unit 2", [1, 2], []), 4: (1, "Unit 1", [4], [5])}
    assert [tuple(p) for p in got[1]["points"]] == [(100.0, 0.0), (121.0, 0.0), (121.0, 10.0), (100.0, 10.0)] and got[1]["confidence"] == 0.55



READINGS = [
    (1, 1, "BEDROO", 0.9, 0.0, 0.0, 60.0, 10.0, ["right"]), (1, 2, "ROOM 1", 0.8, 50.0, 1.0, 60.0, 10.0, ["left"]), (1, 3, "Kitchen", 0.7, 300.0, 0.0, 70.0, 10.0, None), (1, 4, "kitchen.", 0.9, 303.0, 1.0, 70.0, 10.0, None),
    (2, 5, "Open Plan", 0.5, 0.0, 0.0, 90.0, 10.0, ["right"]), (2, 6, "Plan Liv", 0.5, 80.0, 0.0, 80.0, 10.0, ["left", "right"]), (2, 7, "Living", 0.6, 150.0, 0.0, 60.0, 10.0, ["left"]), (2, 8, "Far", 0.6, 900.0, 0.0, 30.0, 10.0, None),
    (3, 9, "half-", 0.5, 0.0, 0.0, 50.0, 10.0, ["right"]), (3, 10, "way", 0.4, 50.0, 0.0, 30.0, 10.0, None), (4, 11, "Bath", 0.5, None, None, None, None, None), (4, 12, "BATH", 0.6, None, None, None, None, None), (4, 13, " ", 0.6, 0.0, 0.0, 1.0, 1.0, None),
    (5, 14, "Bath", 0.5, 0.0, 0.0, 40.0, 10.0, None), (5, 15, "Bath", 0.5, 0.0, 60.0, 40.0, 10.0, None), (5, 16, None, 0.5, 0.0, 60.0, 40.0, 10.0, None),
]


def test_lines_cut_by_tiles_come_back_whole(spark):
    df = spark.createDataFrame(READINGS, "page_id long, line_id long, text string, confidence double, x double, y double, w double, h double, cuts array<string>")
    df = df.withColumn("bbox", F.when(F.col("x").isNotNull(), g.box(*box_columns())))
    pairs = text_tiles.text_matches(df)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (3, 4), (5, 6), (6, 7), (9, 10), (11, 12)}
    got = {r["line_id"]: (r["text"], r["confidence"], r["parts"], r["bbox"] and (r["bbox"]["x"], r["bbox"]["width"])) for r in text_tiles.merge_text(df, pairs).collect()}
    assert got == {
        1: ("BEDROOM 1", 0.9, 2, (0.0, 110.0)), 3: ("Kitchen", 0.9, 2, (300.0, 73.0)), 5: ("Open Plan Living", 0.6, 3, (0.0, 210.0)), 8: ("Far", 0.6, 1, (900.0, 30.0)), 9: ("halfway", 0.5, 2, (0.0, 80.0)),
        11: ("BATH", 0.6, 2, None), 14: ("Bath", 0.5, 1, (0.0, 40.0)), 15: ("Bath", 0.5, 1, (0.0, 40.0)),
    }
    assert text_tiles.merge_text(df.limit(0), pairs.limit(0)).count() == 0


def flood(open_cells):
    left, out = set(open_cells), []
    while left:
        todo, own = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            own += 1
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(own)
    return out


def test_enclosed_spaces_equal_flood_fill(spark):
    """Walls of one cell on a page of 40 x 30 cells, a pixel each; regions and sizes as a plain flood fill finds them."""
    r = random.Random(7)
    walls = {(row, col) for row in range(30) for col in range(40) if row in (9, 20) or col in (11, 25, 26) or r.random() < 0.05} - {(4, 11), (9, 30)}
    rows = [(1, 0, "wall", "Wall", float(c) + 0.25, float(y) + 0.25, 0.5, 0.5) for y, c in walls]
    df = spark.createDataFrame(rows, "page_id long, ord long, type string, label string, x double, y double, w double, h double").withColumn("points", g.rect_points(*box_columns()))
    pages = spark.createDataFrame([(1, 40.0, 30.0), (2, 40.0, 30.0)], "page_id long, width_px double, height_px double")
    none = df.limit(0).select("page_id", F.col("ord").alias("unit_id"), "points")
    room = spark.createDataFrame([(1, 1, "Room", 0.0, 0.0, 40.0, 30.0), (1, 2, "Bed", 12.0, 10.0, 3.0, 3.0)], "page_id long, ord long, label string, x double, y double, w double, h double").withColumn("points", g.rect_points(*box_columns()))
    found = [x for x in grid.grid_regions(pages, df, none, room).collect() if x["page_id"] == 1]
    want = flood({(y, c) for y in range(30) for c in range(40)} - walls)
    assert sorted(x["cells"] for x in found) == sorted(n for n in want if n >= 8) and len(found) > 5
    assert {x["label"] for x in found} == {"Room", "Bed"} and all(x["area"] == x["cells"] and not x["shared"] for x in found)
    unit = spark.createDataFrame([(1, 7, 12.0, 10.0, 13.0, 10.0)], "page_id long, unit_id long, x double, y double, w double, h double").withColumn("points", g.rect_points(*box_columns()))
    parted = grid.grid_regions(pages, df, unit, room).where("page_id = 1").collect()
    inside = {(y, c) for y in range(10, 20) for c in range(12, 25)}
    want = flood(inside - walls)
    assert sorted(x["cells"] for x in parted if x["unit_id"] == 7) == sorted(n for n in want if n >= 8)
    assert {x["label"] for x in parted if x["unit_id"] is None} == {"Corridor"} and all(x["shared"] == (x["unit_id"] is None) for x in parted)
    open_gap = df.where("y > 9 AND y < 10 AND x > 12 AND x < 14")
    joined = grid.grid_regions(pages, df, none, room, gaps=open_gap).where("page_id = 1").collect()
    want = flood({(y, c) for y in range(30) for c in range(40)} - (walls - {(9, 12), (9, 13)}))
    assert sorted(x["cells"] for x in joined) == sorted(n for n in want if n >= 8)


def test_type_hits_carry_units_and_wait_for_types(spark):
    line = lambda page, i, text, x=None, y=None: (page, i, text, x, y, 40.0, 10.0)
    rows = [
        line(1, 1, "Apartment", 0.0, 0.0), line(1, 2, "56", 50.0, 0.0), line(1, 3, "Type", 0.0, 30.0), line(1, 4, "3B", 0.0, 60.0), line(1, 5, "3B", 0.0, 60.0), line(1, 6, "Studio", 0.0, 900.0),
        line(2, 1, "Unit 29 Type 2B"), line(2, 2, "Type: 1 Bed"), line(2, 3, None), line(2, 4, " "), line(3, 1, "Type"), line(3, 2, "Unit 4"), line(3, 3, "Studio"), line(3, 4, "2B"), line(4, 1, "3B"),
    ]
    df = spark.createDataFrame(rows, "page_id long, ord long, text string, x double, y double, w double, h double").withColumn("bbox", F.when(F.col("x").isNotNull(), g.box(*box_columns())))
    got = sorted((r["page_id"], r["unit"], r["apartment_type"], r["bedrooms"]) for r in types.type_hits(df).collect())
    assert got == [(1, "56", "3B", 3), (2, "29", "1B", 1), (2, "29", "2B", 2), (3, "4", "Studio", 0)]
    assert types.type_hits(df.limit(0)).count() == 0


def test_rooms_are_named_by_text(spark):
    room = lambda page, i, label, x, unit=None, w=100.0: (page, i, i, label, unit, x, 0.0, w, 100.0)
    rows = [room(1, 1, "Room", 0.0, 9), room(1, 2, "Bedroom", 200.0, 9), room(1, 3, "Open Living", 400.0, 9), room(1, 4, "Lobby", 600.0, 9), room(2, 5, "Room", 0.0), room(2, 6, "Room", 5000.0)]
    rooms = spark.createDataFrame(rows, "page_id long, room_id long, ord long, label string, unit_id long, x double, y double, w double, h double").withColumn("points", g.rect_points(*box_columns())).drop("x", "y", "w", "h")
    seeds = [
        (1, 11, "Bedroom 2", 9, 250.0, 50.0), (1, 12, "Kitchen", 9, 450.0, 50.0), (1, 13, "Bathroom", 9, 650.0, 50.0), (1, 14, "Laundry", 9, 50.0, 40.0), (1, 15, "Dining", 9, 460.0, 60.0), (1, 16, "Study", 8, 50.0, 50.0),
        (2, 17, "Study", None, 150.0, 50.0), (2, 18, "Laundry", None, 160.0, 50.0), (2, 19, "Bedroom", None, 2500.0, 50.0),
    ]
    df = spark.createDataFrame(seeds, "page_id long, seed_id long, label string, unit_id long, x double, y double")
    units_ = rooms.limit(0).select("page_id", "unit_id", "points")
    merged = {r["seed_id"]: (r["label"], r["x"], r["merged"]) for r in room_text.cluster_open_plan(df, units_).collect()}
    assert merged[12] == ("Kitchen / Dining", 455.0, 2) and 15 not in merged and merged[11] == ("Bedroom 2", 250.0, 1) and len(merged) == 8
    found = room_text.label_rooms_from_text(rooms, df)
    got = {r["seed_id"]: (r["room_id"], r["label"]) for r in found.collect()}
    assert got == {11: (2, "Bedroom 2"), 15: (3, "Living / Dining"), 14: (1, "Laundry"), 18: (5, "Laundry")}
    anchors = {r["seed_id"]: r["area"] for r in room_text.text_anchor_rooms(df, found, rooms).collect()}
    assert anchors == {13: 5184.0, 16: 5184.0}
    assert room_text.label_rooms_from_text(rooms.limit(0), df).count() == 0 == room_text.label_rooms_from_text(rooms, df.limit(0)).count()


def test_keypoints_of_three_encodings(spark):
    rows = [
        (1, '{"a": {"x": 1, "y": 2, "class": "tip"}, "tail": {"cx": 3, "cy": 4, "visible": "0"}}', None), (2, '[{"x": 1, "y": 2}, {"x": 3, "y": 4, "confidence": 90}]', None), (3, "[1, 2, 1, 3, 4, 0]", ["head", "s"]),
        (4, "[1, 2, 2]", None), (5, '[{"x": 1, "y": 2, "name": "point"}, {"x": 5, "y": 6, "name": "tip"}, {"y": 1, "name": "base"}]', None), (6, None, None), (7, "[]", None), (8, "{}", None), (9, "words", None), (10, '"x"', None),
    ]
    df = spark.createDataFrame(rows, "entity_id long, keypoints string, names array<string>")
    got = sorted((r["entity_id"], r["role"], r["x"], r["y"], r["visibility"], r["confidence"]) for r in keypoints.read_keypoints(df).collect())
    assert got == [
        (1, "base", 3.0, 4.0, "not_labeled", None), (1, "tip", 1.0, 2.0, "visible", None), (2, "base", 1.0, 2.0, "visible", None), (2, "tip", 3.0, 4.0, "visible", 0.9),
        (3, "base", 3.0, 4.0, "not_labeled", None), (3, "tip", 1.0, 2.0, "occluded", None), (5, "tip", 5.0, 6.0, "visible", None),
    ]
