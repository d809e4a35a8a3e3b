"""Derived tables on which the registered queries run, and the text of their SQL for an oracle."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..workspace import stage, table

VIEWS: dict[str, str] = {}
for _part in re.split(r"^-- view ", (Path(__file__).parent / "views.sql").read_text(), flags=re.M)[1:]:
    _name, _, _sql = _part.partition("\n")
    VIEWS[_name.strip()] = _sql.strip()

_BASE = ("lineitem", "events", "documents", "nation", "customer", "orders", "part", "supplier")


def oracle(sql: str, given: tuple[str, ...] = ()) -> str:
    """A query over derived views as one statement, the views it needs in front, but for those ``given`` as tables."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed and name not in given:
                add(VIEWS[name])
                needed.append(name)

    add(sql)
    sql, parts = sql.strip(), [f"{n} AS (\n{VIEWS[n]})" for n in needed]
    if "JOIN both_ways" in sql:
        return "WITH RECURSIVE " + ",\n".join([*parts, sql.removeprefix("WITH ")])
    if sql.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*parts, sql.removeprefix("WITH RECURSIVE ")])
    if parts and sql.startswith("WITH "):
        return "WITH " + ",\n".join([*parts, sql.removeprefix("WITH ")])
    return "WITH " + ",\n".join(parts) + "\n" + sql if parts else sql


def views(spark: SparkSession, sf_dir: str, name: str, kept: DataFrame | None = None) -> DataFrame:
    """One derived view as a DataFrame; ``kept`` are the rows of d_entities where they are at hand."""
    if kept is not None:
        kept.createOrReplaceTempView("d_entities")
    sql = oracle(f"SELECT * FROM {name}", () if kept is None else ("d_entities",))
    for base in _BASE:
        if re.search(rf"\b{base}\b", sql):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql)


def pentagon(df: DataFrame) -> DataFrame:
    """Adds ``points``, the five-point outline, and ``bbox`` to rows with x, y, w, h."""
    x, y, w, h = (F.col(c) for c in "xywh")
    points = F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x + w / 2, y + h + h / 4), g.point(x, y + h))
    return df.withColumn("points", points).withColumn("bbox", g.box(x, y, w, h))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pentagon(views(spark, sf_dir, "d_entities"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view d_entities, written: its rows are numbered once, however many views and tables are made of it."""
    return stage(views(spark, sf_dir, "d_entities"), "entities")


def kept_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities for queries that read them more than once."""
    return pentagon(kept(spark, sf_dir))
