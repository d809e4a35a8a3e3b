"""Key points of north arrows, in the encodings that detectors write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Fields of a named point, in their spellings, the first that is there counts.
_POINT = "struct<x:double,cx:double,y:double,cy:double,class:string,name:string,label:string,occluded:string,visibility:string,v:string,visible:string,confidence:double,conf:double,score:double>"
#: Names and parts of names of the two roles, words for a visibility; in lower case with single blanks.
TIP, TIP_PARTS = ("north", "point", "n"), ("tip", "head")
BASE, BASE_PARTS = ("origin", "pivot", "s", "south"), ("base", "tail")
HIDDEN, COVERED = ("0", "not labeled", "unlabeled", "hidden", "none", "false"), ("1", "occluded", "invisible")


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[_\-\s]+", " "))


def role(name: Column, at: Column, count: Column) -> Column:
    """tip or base, by a name or what it holds, else by place where there are just two points (base first), else null."""
    n = _plain(F.coalesce(name, F.lit("")))

    def named(words: tuple[str, ...], parts: tuple[str, ...]) -> Column:
        return n.isin(*words) | n.contains(parts[0]) | n.contains(parts[1])

    by_place = F.when(count == 2, F.when(at == 0, "base").otherwise("tip"))
    return F.when(named(TIP, TIP_PARTS), "tip").when(named(BASE, BASE_PARTS), "base").otherwise(by_place)


def visibility(value: Column) -> Column:
    """visible, occluded or not_labeled of a number or a word; visible if there is none or an unknown one."""
    number, word = F.expr("try_cast(_v as double)"), _plain(value)
    known = F.when(number.isNotNull(), F.when(number <= 0, "not_labeled").when(number.cast("int") == 1, "occluded").otherwise("visible"))
    return F.coalesce(known, F.when(word.isin(*HIDDEN), "not_labeled").when(word.isin(*COVERED), "occluded").otherwise("visible"))


def read_keypoints(entities: DataFrame) -> DataFrame:
    """Tip and base of each entity: entity_id, role, x, y, visibility, confidence (null: none given).

    entities: entity_id, keypoints (JSON), names (array of names by place, or null).  ``keypoints`` is a map of named points, a list of points, or a flat
    list of x, y, visibility in threes; which one is told apart row by row.  Points without finite x and y, or without a role, go.  Of several
    points of a role the surest counts (none given: 0), of equals the last.  Confidences over 1 are percent.  Null, empty or other JSON gives nothing.
    """
    text = F.trim("keypoints")
    rows = entities.select("entity_id", F.coalesce("names", F.array().cast("array<string>")).alias("names"), text.alias("t"))
    named = F.map_entries(F.from_json("t", f"map<string,{_POINT}>"))
    listed = F.from_json("t", f"array<{_POINT}>")
    flat = F.from_json("t", "array<double>")
    hint = lambda i: F.get(C("names"), i)

    def of(p: Column, name: Column) -> Column:
        return F.struct(
            F.coalesce(p["class"], p["name"], p["label"], name).alias("name"), F.coalesce(p["x"], p["cx"]).alias("x"), F.coalesce(p["y"], p["cy"]).alias("y"),
            F.when(F.lower(p["occluded"]).isin("true", "1"), "occluded").otherwise(F.coalesce(p["visibility"], p["v"], p["visible"])).alias("v"), F.coalesce(p["confidence"], p["conf"], p["score"]).alias("c"),
        )

    none = lambda kind: F.lit(None).cast(kind)
    triplet = lambda i: F.struct(hint(i).alias("name"), F.get("f", i * 3).alias("x"), F.get("f", i * 3 + 1).alias("y"), F.get("f", i * 3 + 2).cast("string").alias("v"), none("double").alias("c"))
    parts = [
        rows.where("t LIKE '{%'").select("entity_id", F.transform(named, lambda e: of(e["value"], e["key"])).alias("p"), F.lit(2).alias("n")),
        rows.where(r"t RLIKE '^\\[\\s*\\{'").select("entity_id", F.transform(listed, lambda p, i: of(p, hint(i))).alias("p")).withColumn("n", F.size("p")),
        rows.where(r"t RLIKE '^\\[\\s*[-0-9]'").withColumn("f", flat).withColumn("n", F.floor(F.size("f") / 3).cast("int")).where("n > 0").select("entity_id", F.transform(F.sequence(F.lit(0), C("n") - 1), triplet).alias("p"), "n"),
    ]
    points = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("entity_id", "n", F.posexplode("p").alias("at", "p")).select("entity_id", "n", "at", "p.*").withColumnRenamed("v", "_v")
    finite = lambda c: C(c).isNotNull() & ~F.isnan(c) & (F.abs(C(c)) != float("inf"))
    known = points.where(finite("x") & finite("y")).withColumn("role", role(C("name"), C("at"), C("n"))).where("role IS NOT NULL")
    sure = F.when(C("c") > 1, C("c") / 100).otherwise(C("c"))
    best = known.select("entity_id", "role", "at", F.struct("x", "y", visibility(C("_v")).alias("visibility"), sure.alias("confidence")).alias("p"))
    return best.groupBy("entity_id", "role").agg(F.max_by("p", F.struct(F.coalesce("p.confidence", F.lit(0.0)), "at")).alias("p")).select("entity_id", "role", "p.*")
