"""Single cases with known answers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetspan.functions import geometry as g
from sheetspan.functions import text as t
from sheetspan.operators import graph, rollup, spatial
from sheetspan.sources import readers, writers
from sheetspan.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ring(*pairs):
    return F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in pairs))


def region(i, type_, label, x, y, w, h):
    pts = [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    return (1, i, i, type_, label, "predicted", 0.9, pts, {"x": float(x), "y": float(y), "width": float(w), "height": float(h)})


SCHEMA = "page_id long, entity_id long, ord long, type string, label string, status string, confidence double, points array<struct<x:double,y:double>>, bbox struct<x:double,y:double,width:double,height:double>"


def test_square_and_ribbon(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    assert one(spark, g.poly_area(square)) == 100
    assert one(spark, g.area_m2(g.poly_area(square), F.lit(10.0))) == 1
    assert one(spark, g.area_m2(g.poly_area(square), F.lit(None).cast("double"))) is None
    assert one(spark, g.wall_thickness(ring((0, 0), (20, 0), (20, 2), (0, 2)))) == 2
    assert one(spark, g.angle_delta(F.lit(0.0), F.lit(350.0))) == 10
    assert one(spark, g.poly_area(ring((0, 0), (1, 1)))) == 0
    assert one(spark, g.long_edge(ring((3, 3), (3, 3)))) is None


def test_apartment_of_two_rooms(spark):
    rows = [
        region(1, "unit_boundary", "Unit A", 300, 90, 260, 170), region(2, "room", "Bedroom", 312, 104, 96, 88), region(3, "room", "Bathroom", 416, 104, 64, 75),
        region(4, "door", "Door", 340, 140, 12, 8), region(5, "room", "Communal Space", 310, 280, 150, 36),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["kind"], r["from_id"], r["to_id"]) for r in spatial.opening_room(df).collect()] == [("room_door_access", 2, 4)]
    assert sorted(r["room_id"] for r in spatial.unit_rooms(df).collect()) == [2, 3]
    assert (2, 3) in {(r["from_id"], r["to_id"]) for r in spatial.room_adjacency(df).collect()}


@pytest.mark.parametrize(("text", "want"), [("SCALE 1:100 @ A1", 100), ("1 to 50", 50), ("Scale 1-200", 200), ("1:5O", 50), ("no scale", None), ("１：１００", 100), ("SCALE l : 75", 75), ("scale 1.100", 100), ("1-200 @ A1", 200), ("1:2OO", 200), ("1:O", None)])
def test_scales(spark, text, want):
    assert one(spark, t.parse_scale(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("3.9m x 3.6 m", (3.9, 3.6)), ("3900 x 3600", (3.9, 3.6)), ("2 x 4", None), ("1:100 x 3", None), ("0.5m x 3m", None)])
def test_room_sizes(spark, text, want):
    got = one(spark, t.parse_room_size(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_unit_ids_and_levels(spark):
    assert one(spark, t.parse_unit_ids(F.lit("Unit 101, apt 12b and UNIT PLAN, U-7"))) == ["101", "12B", "7"]
    assert one(spark, t.parse_level(F.lit("Second floor plan"))) == "Second Floor Plan"
    assert one(spark, t.level_index(F.lit("Basement"))) == -1


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(chain.union(spark.createDataFrame([(500, 600), (600, 500), (700, 700)], "a long, b long"))).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(201)} | {(500, 500), (600, 500)}


def test_job_transitions():
    s = ("queued", 0, None, None)
    for kind, at in (("claim", 0), ("heartbeat", 60_000), ("fail", 100_000)):
        s = jobs.transition(s, kind, 1, at, most=2)
    assert s[:2] == ("queued", 1)
    s = jobs.transition(jobs.transition(s, "claim", 2, 110_000, most=2), "fail", 2, 120_000, most=2)
    assert s[:2] == ("dead", 2)
    running = jobs.transition(("queued", 0, None, None), "claim", 1, 0)
    assert jobs.transition(running, "heartbeat", 1, 130_000)[0] == "queued"


def test_job_stream(spark, tmp_path):
    rows = [(1, 1, 7, "enqueue", 0), (2, 1, 7, "claim", 1), (3, 1, 7, "complete", 30), (4, 2, 8, "claim", 5)]
    df = pd.DataFrame(rows, columns=["event_id", "job_id", "worker_id", "kind", "s"])
    df["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(df["s"], unit="s")
    schema = "event_id long, job_id long, worker_id long, kind string, ts timestamp"
    spark.createDataFrame(df.drop(columns="s"), schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.job_lifecycle(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("jobs").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["job_id"]: (r["status"], r["attempt"]) for r in spark.sql("SELECT * FROM jobs").collect()}
    assert got[1] == ("completed", 1) and got[2][1] == 1


def test_files_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([("train", "p1", 0, 3, [0.5, 0.5, 0.25, 0.5]), ("train", "p1", 1, 1, [0.1, 0.1, 0.2, 0.1, 0.2, 0.3])], "split string, image_id string, ord int, class_id int, coords array<double>")
    writers.write_yolo(labels, f"{tmp_path}/y")
    assert spark.read.text(f"{tmp_path}/y").where("value LIKE '3 0.500000 0.500000 0.250000 0.500000'").count() == 1
    (tmp_path / "l").mkdir()
    (tmp_path / "l/p1.txt").write_text("3 0.5 0.5 0.25 0.5\n1 x 0.1\n1 0.1 0.1 0.2 0.1 0.2 0.3\n0 0.5 0.5 0 0\n")
    sizes = spark.createDataFrame([("p1", 100.0, 200.0)], "image_id string, width double, height double")
    got = {r["class_id"]: tuple(r["bbox"]) for r in readers.read_yolo_labels(spark, f"{tmp_path}/l", sizes).collect()}
    assert got[3] == (37.5, 50.0, 25.0, 100.0) and set(got) == {1, 3}
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"id": "a", "bbox": [1, 2, 3, 4]}\n{"id": "b", "polygon": [[0, 0], [4, 0], [4, 4]]}\n{"id": "c"}\n')
    got = {r["id"]: (len(r["points"]), tuple(r["bbox"])) for r in readers.read_regions(spark, f"{tmp_path}/r").collect()}
    assert got == {"a": (4, (1.0, 2.0, 3.0, 4.0)), "b": (3, (0.0, 0.0, 4.0, 4.0))}
    (tmp_path / "s.json").write_text('{"imageWidth": 10, "imageHeight": 10, "shapes": [{"label": "Room", "shape_type": "rectangle", "points": [[5, 6], [1, 2]]}, {"label": "Bad", "shape_type": "polygon", "points": [[1, 1]]}]}')
    got = readers.read_shapes(spark, f"{tmp_path}/s.json").collect()
    assert [(r["label"], tuple(r["points"][0]), len(r["points"])) for r in got] == [("Room", (1.0, 2.0), 4)]
    (tmp_path / "t.csv").write_text("epoch, train/box_loss, lr, metrics/mAP50\n1, 0.5, 0.1, 0.3\n")
    assert {r["metric"]: r["value"] for r in readers.read_training_results(spark, f"{tmp_path}/t.csv").collect()} == {"train/box_loss": 0.5, "metrics/mAP50": 0.3}


def test_kept_boxes_do_not_overlap(spark):
    rows = [(1, 10, "room", "A", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 11, "room", "A", 0.8, 1.0, 0.0, 10.0, 10.0), (1, 12, "room", "A", 0.7, 50.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "page_id long, region_id long, type string, label string, confidence double, x double, y double, w double, h double")
    assert sorted(r["region_id"] for r in rollup.nms(df).collect()) == [10, 12]
    same = df.select(F.col("page_id").alias("sheet_id"), F.col("region_id").alias("gold_id"), F.col("region_id").alias("ord"), "x", "y", "w", "h")
    m = rollup.match_boxes(same, same.withColumnRenamed("gold_id", "pred_id"))
    assert [r["pq"] for r in rollup.pq(m, same, same).collect()] == [1.0]


def test_published_results_do_not_repeat(spark, tmp_path):
    schema = "job_id long, status string, last_ts timestamp"
    first = spark.sql("SELECT 1L AS job_id, 'completed' AS status, timestamp'2024-01-01' AS last_ts UNION ALL SELECT 2L, 'running', timestamp'2024-01-01'")
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    for batch in range(2):
        if batch:
            spark.sql("SELECT 1L AS job_id, 'completed' AS status, timestamp'2024-01-02' AS last_ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.publish_results(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/v=1").collect()
    assert [(r["job_id"], r["version"].day) for r in got] == [(1, 2)]


def test_regions_cut_at_a_tile_seam_match(spark):
    left, right, inner = (0.0, 0.0, 640.0, 640.0), (640.0, 0.0, 640.0, 640.0), (100.0, 100.0, 300.0, 300.0)
    rows = [
        (1, 1, "wall", "Wall", (600.0, 50.0, 40.0, 10.0), left), (1, 2, "wall", "Wall", (640.0, 50.0, 90.0, 10.0), right),
        (2, 3, "room", "Room", (620.0, 50.0, 20.0, 100.0), left), (2, 4, "room", "Room", (638.0, 50.0, 200.0, 100.0), left),
        (3, 5, "room", "Room", (200.0, 200.0, 40.0, 40.0), inner), (3, 6, "room", "Room", (240.0, 200.0, 40.0, 40.0), inner),
        (4, 7, "room", "Room", (600.0, 50.0, 40.0, 10.0), left), (4, 8, "room", "Room", (660.0, 50.0, 40.0, 10.0), right),
        (5, 9, "wall", "Wall", (600.0, 50.0, 40.0, 10.0), None), (5, 10, "wall", "Wall", (640.0, 50.0, 90.0, 10.0), None),
    ]
    box = "struct<x:double,y:double,width:double,height:double>"
    df = spark.createDataFrame(rows, f"page_id long, region_id long, type string, label string, bbox {box}, tile {box}")
    assert sorted((r["a"], r["b"]) for r in spatial.tile_matches(df).collect()) == [(1, 2), (3, 4)]
    assert spatial.tile_matches(df.drop("tile")).count() == 0
    flat = df.select("*", F.lit(0.5).alias("confidence"), "bbox.x", "bbox.y", F.col("bbox.width").alias("w"), F.col("bbox.height").alias("h"))
    merged = graph.merge_tiles(flat, spatial.tile_matches(df)).where("page_id = 1").collect()
    assert [(r["stitched_from"], r["x"], r["w"]) for r in merged] == [(2, 600.0, 130.0)]


def test_validation_issues_has_every_code(spark):
    pages = spark.createDataFrame([(1, "20_a"), (2, "21_a"), (3, "98_a"), (4, "x_a")], "page_id long, stem string")
    ring = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]]
    rows = [
        (1, " ", "polygon", ring), (1, "Ship", "polygon", ring), (1, "Room", "polygon", ring[:1]), (1, "Room", None, None), (1, "Room", "polygon", ring[::2]),
        (1, "Room", "rectangle", ring[::2]), (2, "Room", "polygon", [[0.0, 0.0], [9.0], [9.0, 9.0]]), (2, "Room", "polygon", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), (3, "Room", "polygon", ring),
    ]
    shapes = spark.createDataFrame(rows, "page_id long, label string, shape_type string, points array<array<double>>")
    check = lambda p, s: {r["code"]: (r["issues"], r["pages"], r["ok"]) for r in rollup.validation_issues(p, s, ["Room"], {"20": "b20", "21": "b21", "98": "b98"}, ({"b21"}, {"b20"})).collect()}
    assert check(pages, shapes) == {
        "EMPTY_LABEL": (1, 1, False), "UNKNOWN_LABEL": (1, 1, False), "BAD_GEOMETRY": (2, 1, False), "OPEN_POLYGON": (1, 1, False), "BAD_POINTS": (1, 1, False),
        "TINY_SHAPE": (1, 1, False), "EMPTY_SHAPES": (1, 1, False), "UNKNOWN_BUILDING": (1, 1, False), "BUILDING_NOT_IN_FOLD": (1, 1, False), "FOLD_LEAKAGE": (1, 0, False),
    }
    assert check(pages.where("page_id <= 1"), shapes.where("page_id = 9")) == {"EMPTY_SHAPES": (1, 1, True)}
