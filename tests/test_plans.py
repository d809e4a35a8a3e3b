"""Every registered query with SQL gives the rows of that SQL; the others give rows."""

import math

import duckdb
import pytest

from sheetspan.plans import q_columns, q_entrances, q_graph, q_grid, q_hierarchy, q_keypoints, q_labels, q_policy, q_policy_lines, q_policy_packs, q_rollup, q_room_text, q_spatial, q_streams, q_text, q_text_rows, q_text_tiles, q_types, q_units  # noqa: F401
from sheetspan.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_region_falls_in_a_crop(spark, duck):
    crops = registry.QUERIES["a15_cell_crop_purposes"](spark, SF).collect()
    assert sum(r["regions"] for r in crops) == duck.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert {r["category"] for r in crops} == {"openings", "structure", "full"}
