"""Shuffles and writes that grew too large on larger tables, and rows on which the mended steps could go wrong."""

import contextlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sheetspan import workspace
from sheetspan.functions import geometry as g
from sheetspan.operators import graph, grid, room_text, spatial
from sheetspan.plans import q_graph, q_grid, q_hierarchy, q_room_text, q_text_tiles, registry  # noqa: F401


@contextlib.contextmanager
def no_broadcasts(spark):
    """As at large sizes: joins shuffle both sides."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exchanges(df) -> int:
    """Shuffles that the plan makes, reused ones once."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "ReusedExchange" not in line and "Broadcast" not in line for line in text.splitlines())


def boxes(spark, rows, *names):
    """Rows (page_id, entity_id, x, y, w, h, more) with their rectangle as points."""
    df = spark.createDataFrame(rows, "page_id long, entity_id long, x double, y double, w double, h double" + "".join(f", {n}" for n in names))
    return df.withColumn("ord", F.col("entity_id")).withColumn("points", g.rect_points(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def test_names_and_rooms_meet_by_page(spark):
    """F1 (j12_rooms_named_by_text), F3: names were copied into four cells, and their options shuffled twice more."""
    rooms = boxes(spark, [(1, 10, 0.0, 0.0, 100.0, 100.0, "Room", 7), (1, 11, 100.0, 0.0, 100.0, 100.0, "Open Living", 7), (1, 12, 0.0, 100.0, 100.0, 100.0, "Bathroom", None), (2, 13, 0.0, 0.0, 9000.0, 100.0, "Bedroom", None)], "label string", "unit_id long").withColumnRenamed("entity_id", "room_id")
    seeds = spark.createDataFrame([
        (1, 1, "Bedroom 2", 7, 50.0, 50.0), (1, 2, "Kitchen / Dining", 7, 40.0, 50.0), (1, 3, "Bathroom", None, 50.0, 150.0), (1, 4, "Bathroom", None, 99.0, 199.0), (1, 5, "Bedroom", 8, 50.0, 50.0),
        (2, 6, "Bedroom 1", None, 1.0, 50.0), (2, 8, "Study", None, 1.0, 50.0), (3, 9, "Bedroom", None, 1.0, 1.0), (None, 14, "Bedroom", None, 1.0, 1.0),
    ], "page_id long, seed_id long, label string, unit_id long, x double, y double")
    with no_broadcasts(spark):
        out = room_text.label_rooms_from_text(rooms, seeds)
        assert exchanges(out) <= 2
        got = sorted((r["seed_id"], r["room_id"], r["label"], r["unit_id"]) for r in out.collect())
    assert got == [(1, 10, "Bedroom 2", 7), (2, 11, "Living / Dining / Kitchen", 7), (3, 12, "Bathroom", None), (6, 13, "Bedroom 1", None)]


def test_smallest_unit_around_a_point(spark):
    """F1, F3 (j13_anchor_rooms): points were shuffled by page, then by id, then by page again."""
    units = boxes(spark, [(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 50.0, 0.0, 50.0, 100.0), (1, 3, 50.0, 0.0, 50.0, 100.0), (2, 4, 0.0, 0.0, 10.0, 10.0)])
    points = spark.createDataFrame([(1, 1, "a", 10.0, 10.0), (1, 2, None, 60.0, 10.0), (1, 3, "c", 100.0, 10.0), (1, 4, "d", 50.0, 0.0), (2, 5, "e", 60.0, 10.0), (3, 6, "f", 1.0, 1.0), (None, 7, "g", 1.0, 1.0), (1, 8, "h", None, 1.0)], "page_id long, id long, name string, x double, y double")
    with no_broadcasts(spark):
        out = spatial.unit_around(points, spatial.unit_rings(units))
        assert exchanges(out) <= 2
        assert sorted((r["id"], r["name"], r["unit_id"]) for r in out.collect()) == [(1, "a", 1), (2, None, 2), (3, "c", None), (4, "d", 2), (5, "e", None), (6, "f", None), (7, "g", None), (8, "h", None)]


def test_names_read_entities_that_are_written_once(spark, tmp_path, monkeypatch):
    """entities were numbered anew for names, rooms and, twice, units."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    for n, name in enumerate(("j12_rooms_named_by_text", "j13_anchor_rooms", "h12_open_plan_clusters"), 1):
        out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "lineitem" not in "".join(out.inputFiles())
        assert [len(list(tmp_path.glob(f"{table}-*"))) for table in ("entities", "units", "names")] == [n] * 3


def test_hierarchy_reads_what_is_written_once(spark, tmp_path, monkeypatch):
    """F2 (j28_hierarchy): every node kind numbered the entities anew and joined its regions with the pages again wherever they were read."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = registry.QUERIES["j28_hierarchy"](spark, "/root/testdata/sf0.001")
    assert [len(list(tmp_path.glob(f"{table}-*"))) for table in ("entities", "units", "rooms", "objects", "placed")] == [1] * 5
    assert "lineitem" not in "".join(out.inputFiles())
    with no_broadcasts(spark):
        assert exchanges(registry.QUERIES["j28_hierarchy"](spark, "/root/testdata/sf0.001")) < 30


def test_grid_cells_are_not_shuffled(spark, tmp_path, monkeypatch):
    """F4 (h11_grid_regions): every cell was shuffled some five times, every run four times; marks of cells are now dealt by page once."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    planned = []
    monkeypatch.setattr(grid, "stage", lambda df, name: planned.append((name, exchanges(df))) or workspace.stage(df, name))
    with no_broadcasts(spark):
        registry.QUERIES["h11_grid_regions"](spark, "/root/testdata/sf0.001")
    assert dict(planned)["parts"] <= 2 and {"blocked", "held", "runs"}.isdisjoint(dict(planned))
    assert len(list(tmp_path.glob("entities-*"))) == 1


def test_open_cells_over_batches():
    """the parts of runs do not depend on where batches end; units are clips of their own; a part has one name."""
    rows = [  # page_id, nx, ny, row, col, clip, shut, named, ord
        *((7, 4, 2, r, 0, "", 0, 0, 0) for r in (0, 1)), (7, 4, 2, 0, 1, "", 1, 0, 0), (7, 4, 2, 0, 2, "", 0, 1, 5), (7, 4, 2, 1, 2, "", 0, 1, 6), (7, 4, 2, 1, 3, "u", 0, 0, 0), (7, 4, 2, 0, 1, "u", 0, 0, 0),
        *((9, 3, 3, r, 0, "", 1, 0, 0) for r in (0, 1, 2)), (9, 3, 3, 1, 1, "", 1, 0, 0), (9, 3, 3, 1, 2, "", 1, 0, 0),
    ]
    table = pa.table([pa.array([r[i] for r in rows]) for i in range(9)], names=["page_id", "nx", "ny", "row", "col", "clip", "shut", "named", "ord"])
    want = [
        (7, "", 0, 0, 0, 0, 0, 0), (7, "", 0, 1, 0, 1, 0, 0), (7, "", 0, 1, 2, 2, 1, 6), (7, "", 2, 0, 2, 2, 1, 5), (7, "", 2, 0, 3, 3, 0, 0), (7, "u", 3, 1, 3, 3, 0, 0),
        (9, "", 0, 0, 1, 2, 0, 0), (9, "", 2, 2, 1, 2, 0, 0),
    ]
    for size in range(1, len(rows) + 1):
        out = pa.Table.from_batches(list(grid._parts(iter(table.to_batches(size))))).to_pylist()
        regions = {}
        for r in sorted(out, key=lambda r: (r["page_id"], r["clip"], r["row"], r["lo"])):
            regions.setdefault((r["page_id"], r["clip"], r["region"]), []).append((r["row"], r["lo"], r["hi"], r["named"], r["ord"]))
        assert sorted((r["page_id"], r["clip"], r["row"], r["lo"], r["hi"], r["named"], r["ord"]) for r in out) == sorted((p, c, *x) for p, c, _, *x in want)
        assert len(regions) == 4 and len(regions[7, "", min(k[2] for k in regions if k[:2] == (7, ""))]) == 5


def test_components_of_a_page_take_no_rounds(spark, tmp_path, monkeypatch):
    """F5 (h5_merged_text), F6 (h4_merged_tiles): edges of a page went through rounds of joins over all edges; pages too large for a task still do."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    rows = [(1, 5, 4), (1, 4, 3), (1, 9, 8), (1, 3, 9), (2, 21, 20), (2, 22, 22), (None, 31, 30), (None, 32, 31), (3, 40, None), *((4, 100 + k, 101 + k) for k in range(50))]
    edges = spark.createDataFrame(rows, "page long, a long, b long").repartition(3)
    plain = sorted(map(tuple, graph.components(edges).collect()))
    rounds = len(list(tmp_path.glob("edges-*")))
    assert rounds and sorted(map(tuple, graph.components(edges, page="page").collect())) == plain
    assert len(list(tmp_path.glob("edges-*"))) == rounds and len(list(tmp_path.glob("stars-*"))) == 1
    assert graph.components(edges.limit(0), page="page").count() == 0
    part = pd.DataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 6, 5), (2, 9, 8), (2, 10, 9), (3, 12, 11)], columns=["page", "u", "v"])
    for size in (1, 2, 3, 7):
        out = pd.concat(graph._stars(iter([part.iloc[k : k + size] for k in range(0, 7, size)])))
        assert dict(zip(out["u"], out["v"], strict=True)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 8, 9: 8, 10: 8, 11: 11, 12: 11} and out["whole"].all()
    monkeypatch.setattr(graph, "MOST", 1)
    for size in (1, 2, 3, 7):
        out = pd.concat(graph._stars(iter([part.iloc[k : k + size] for k in range(0, 7, size)])))
        again = graph._star(out[["u", "v"]], True)
        assert dict(zip(again["u"], again["v"], strict=True)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 8, 9: 8, 10: 8, 11: 11, 12: 11}
        assert size > 3 or not out["whole"].all()


def test_pages_in_parts_go_through_rounds(spark, monkeypatch):
    """a page that came in parts is joined by the rounds."""
    parts = lambda batches: (graph._star(b.iloc[k : k + 1], False) for b in batches for k in range(len(b)))
    edges = spark.createDataFrame([(1, k + 1, k) for k in range(20)] + [(2, 31, 30)], "page long, a long, b long")
    want = sorted(map(tuple, graph.components(edges).collect()))
    monkeypatch.setattr(graph, "_stars", parts)
    assert sorted(map(tuple, graph.components(edges, page="page").collect())) == want


def test_what_matches_none_is_not_grouped(spark, tmp_path, monkeypatch):
    """readings and tile regions were numbered twice, and those without a match were shuffled to be a group of their own."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    with no_broadcasts(spark):
        for name in ("h4_merged_tiles", "h5_merged_text"):
            out = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
            assert exchanges(out) == 1
    assert len(list(tmp_path.glob("entities-*"))) == 1 and not list(tmp_path.glob("edges-*"))
