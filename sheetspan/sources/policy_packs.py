"""Policy packs: JSON of rules and guidelines in several shapes and spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once
from ..workspace import stage

C = F.col
#: The kinds of rules, those made of guidelines that need no scale, severities and states besides the usual ones.
KINDS = (
    "room_min_area", "required_labels", "min_wall_count", "apartment_min_internal", "apartment_min_living", "apartment_min_pos", "apartment_min_bedroom",
    "apartment_min_bathrooms", "apartment_min_storage", "apartment_dual_aspect", "habitable_has_window", "communal_open_space",
)
SCALE_FREE = ("apartment_dual_aspect", "habitable_has_window")
SEVERITIES, STATES = ("uncertain", "info"), ("accepted", "rejected")
NAME_LENGTH, SOURCE_LENGTH = 72, 240
#: Fields of a rule and of a guideline; each may be written with underscores or in camel case.
_RULE_FIELDS = "code name kind guideline_id clause severity requires_scale explanation source_text room_labels min_area_m2 optional_if_absent required_labels min_wall_count by_bedrooms min_dimension_m min_count min_communal_m2 m2_per_dwelling".split()
_GUIDELINE_FIELDS = "id group section name text clause source_text page line_ids rects status mapped_kind design_element level policies policy variable operator value unit".split()
_NUMBERS = ("min_area_m2", "min_wall_count", "min_dimension_m", "min_count", "min_communal_m2", "m2_per_dwelling")
_RECTS = "array<struct<page:long,x:double,y:double,width:double,height:double>>"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _parsed(text: Column, fields: list[str]) -> Column:
    """An object with every field as text, in either spelling; null unless the text is an object."""
    names = dict.fromkeys(x for f in fields for x in (f, _camel(f)))
    return F.when(text.startswith("{"), F.from_json(text, "struct<" + ",".join(f"`{x}`:string" for x in names) + ">"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _raw(o: str, *names: str) -> Column:
    """The first field that is there, in the order given, underscores before camel case."""
    return F.coalesce(*(C(o)[x] for n in names for x in dict.fromkeys((n, _camel(n)))))


def _filled(c: Column) -> Column:
    return once(_strip(c), lambda s: F.when(s != "", s))


def _text(o: str, *names: str) -> Column:
    return _filled(_raw(o, *names))


def _number(o: str, name: str) -> Column:
    return once(_text(o, name).try_cast("double"), lambda n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n))


def _items(text: Column) -> Column:
    """The elements of a JSON array as texts; none of anything else."""
    listed = once(_strip(text), lambda t: F.when(t.startswith("["), F.from_json(t, "array<string>")))
    return F.coalesce(listed, F.array().cast("array<string>"))


def _list(o: str, *names: str) -> Column:
    found = F.filter(F.transform(_items(_raw(o, *names)), lambda x: _strip(x)), lambda x: x != "")
    return once(found, lambda x: F.when(F.size(x) > 0, x))


def _true(c: Column) -> Column:
    return F.coalesce(~_strip(c).isin("", "false", "0"), F.lit(False))


def _bands(o: str) -> Column:
    """Values by number of bedrooms, the last band for three and more; null if there are none."""
    def tell(given: Column) -> Column:
        value = lambda k: F.coalesce(F.try_element_at(given, F.lit(k)), *([F.try_element_at(given, F.lit("3+"))] if k == "3" else [])).try_cast("double")
        entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in "0123")), lambda e: e["value"].isNotNull())
        return once(entries, lambda e: F.when(F.size(e) > 0, F.map_from_entries(e)))

    return once(F.from_json(_raw(o, "by_bedrooms"), "map<string,string>"), tell)


def rule_kind(o: str) -> Column:
    """The kind that a rule states, else the one its fields tell."""
    there = lambda *names: _raw(o, *names).isNotNull()
    named = F.lower(F.concat(F.coalesce(_strip(C(o)["name"]), F.lit("")), F.coalesce(_strip(C(o)["code"]), F.lit(""))))
    stated = _text(o, "kind")
    return (
        F.when(stated.isin(*KINDS), stated).when(_true(_raw(o, "required_labels")), "required_labels").when(there("min_wall_count"), "min_wall_count")
        .when(there("m2_per_dwelling") | C(o)["minCommunalM2"].isNotNull(), "communal_open_space")
        .when(_true(_raw(o, "by_bedrooms")), F.when(named.contains("living"), "apartment_min_living").when(named.rlike("pos|open space|balcony"), "apartment_min_pos").otherwise("apartment_min_internal"))
        .otherwise("room_min_area")
    )


def _amounts(o: str) -> list[Column]:
    return [*(_number(o, x).alias(x) for x in _NUMBERS), _list(o, "room_labels").alias("room_labels"), _list(o, "required_labels").alias("required_labels"), _bands(o).alias("by_bedrooms")]


def _opened(packs: DataFrame) -> DataFrame:
    """pack_id and the texts of a pack's rules, guidelines and groups.  A catalogue, whose first rule names an element and a variable but no kind, is no pack."""
    doc = F.from_json(_strip(C("pack")), "struct<rules:string,guidelines:string,groups:string>")
    rows = packs.select("pack_id", doc.alias("d")).select("pack_id", _items(C("d.rules")).alias("rules"), _items(C("d.guidelines")).alias("guidelines"), _items(C("d.groups")).alias("groups"))
    catalogue = once(
        F.from_json(F.get("rules", F.lit(0)), "map<string,string>"),
        lambda first: F.map_contains_key(first, "design_element") & F.map_contains_key(first, "variable") & ~F.map_contains_key(first, "kind"),
    )
    # Written: rules, guidelines and groups are read from it, and JSON is not parsed again for each.
    return stage(rows.where(~F.coalesce(catalogue, F.lit(False))), "packs")


def _guidelines(items: DataFrame) -> DataFrame:
    """Guidelines of rows with pack_id, n (order), at (place that numbers it, or null), title (of its group, or null) and the parsed object g."""
    text = _strip(_raw("g", "text", "source_text"))
    text = F.when(text != "", text)
    name = F.coalesce(_text("g", "name"), F.substring(text, 1, NAME_LENGTH))
    kind, state = _text("g", "mapped_kind"), _text("g", "status")
    rects = F.filter(F.from_json(_raw("g", "rects"), _RECTS), lambda r: r["page"].isNotNull() & r["x"].isNotNull() & r["y"].isNotNull() & r["width"].isNotNull() & r["height"].isNotNull())
    kept = items.where(C("g").isNotNull()).select("*", name.alias("name"), F.coalesce(text, name).alias("text")).where("name IS NOT NULL")
    at = F.coalesce("at", F.row_number().over(Window.partitionBy("pack_id").orderBy("n")))
    return kept.select(
        "pack_id", "n", F.coalesce(_text("g", "id"), F.concat(F.lit("g-"), at.cast("string"))).alias("guideline_id"), F.coalesce("title", _text("g", "group", "section"), F.lit("General")).alias("group"),
        "name", "text", _text("g", "clause").alias("clause"), _text("g", "source_text").alias("source_text"), _number("g", "page").cast("long").alias("page"), _list("g", "line_ids").alias("line_ids"),
        F.when(F.size(rects) > 0, rects).alias("rects"), F.when(state.isin(*STATES), state).otherwise("pending").alias("status"), F.when(kind.isin(*KINDS), kind).alias("mapped_kind"),
        _text("g", "design_element").alias("design_element"), _text("g", "level").alias("level"), _list("g", "policies", "policy").alias("policies"),
        _text("g", "variable").alias("variable"), _text("g", "operator").alias("operator"), _number("g", "value").alias("value"), _text("g", "unit").alias("unit"),
    )


def read_guidelines(packs: DataFrame) -> DataFrame:
    """The guidelines of packs, one row each: pack_id, n (order in the pack), guideline_id, group, name, text and their further fields.

    packs: pack_id, pack (JSON text, one row a pack).  A pack lists guidelines; where none of them holds a name or text those of its groups count, under the group's
    title.  Without an id a guideline takes its place: in the list, or among those of the groups that count.  What is no object, null, or no JSON gives nothing.
    """
    return _read_guidelines(_opened(packs))


def _read_guidelines(opened: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    flat = opened.select("pack_id", F.posexplode("guidelines").alias("n", "t")).select("pack_id", C("n").cast("long").alias("n"), (C("n") + 1).alias("at"), none.alias("title"), _parsed(C("t"), _GUIDELINE_FIELDS).alias("g"))
    flat = stage(_guidelines(flat), "guidelines")
    group = F.from_json("t", "struct<title:string,name:string,group:string,guidelines:string,items:string>")
    groups = opened.join(flat.select("pack_id").distinct(), "pack_id", "left_anti").select("pack_id", F.posexplode("groups").alias("i", "t")).where(C("t").startswith("{")).select("pack_id", "i", group.alias("o"))
    inner = F.when(_strip(C("o.guidelines")).startswith("["), C("o.guidelines")).otherwise(C("o.items"))
    title = F.coalesce(_filled(F.coalesce("o.title", "o.name", "o.group")), F.lit("General"))
    listed = groups.select("pack_id", "i", title.alias("title"), F.posexplode(_items(inner)).alias("j", "t"))
    order = (C("i").cast("long") * F.lit(1 << 32) + C("j")).alias("n")
    return flat.unionByName(_guidelines(listed.select("pack_id", order, F.lit(None).cast("int").alias("at"), "title", _parsed(C("t"), _GUIDELINE_FIELDS).alias("g"))))


def read_policy_rules(packs: DataFrame) -> DataFrame:
    """The rules of packs, one row each: pack_id, n (order in the pack), code, name, kind, guideline_id, clause, severity, requires_scale and further fields.

    packs as for ``read_guidelines``.  Rules keep a guideline that they name; another one takes the pack's first guideline of its kind with its source text (or
    none either) or its name.  A pack without rules makes one of each guideline that is mapped to a kind.  False, 0 and an empty text are false.
    """
    opened = _opened(packs)
    texts = opened.select("pack_id", F.posexplode("rules").alias("n", "t")).select("pack_id", C("n").cast("long").alias("n"), _parsed(C("t"), _RULE_FIELDS).alias("r")).where("r IS NOT NULL")
    code = F.coalesce(_text("r", "code"), F.concat(F.lit("RULE-"), (C("n") + 1).cast("string")))
    severity = _text("r", "severity")
    own = texts.select(
        "pack_id", "n", code.alias("code"), F.coalesce(_text("r", "name"), code).alias("name"), rule_kind("r").alias("kind"), _text("r", "guideline_id").alias("guideline_id"), _text("r", "clause").alias("clause"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise("fail").alias("severity"), _true(_raw("r", "requires_scale")).alias("requires_scale"), _text("r", "explanation").alias("explanation"),
        _text("r", "source_text").alias("source_text"), _true(_raw("r", "optional_if_absent")).alias("optional_if_absent"), *_amounts("r"),
    )
    own = stage(own, "rules")
    guidelines = stage(_read_guidelines(opened).where("mapped_kind IS NOT NULL").select("pack_id", "n", "guideline_id", "name", "text", "clause", "source_text", "mapped_kind"), "mapped")
    known = guidelines.select("pack_id", C("mapped_kind").alias("kind"), C("n").alias("at"), C("guideline_id").alias("linked"), C("name").alias("g_name"), C("source_text").alias("g_source"))
    fits = C("source_text").eqNullSafe(C("g_source")) | (C("name") == C("g_name"))
    links = own.where("guideline_id IS NULL").select("pack_id", "n", "kind", "name", "source_text").join(known, ["pack_id", "kind"]).where(fits).groupBy("pack_id", "n").agg(F.min_by("linked", "at").alias("linked"))
    linked = own.join(links, ["pack_id", "n"], "left").withColumn("guideline_id", F.coalesce("guideline_id", "linked")).drop("linked")
    made = guidelines.join(own.select("pack_id").distinct(), "pack_id", "left_anti").select(
        "pack_id", "n", F.coalesce("clause", F.upper("guideline_id")).alias("code"), "name", C("mapped_kind").alias("kind"), "guideline_id", "clause", F.lit("fail").alias("severity"),
        (~C("mapped_kind").isin(*SCALE_FREE)).alias("requires_scale"), F.lit(None).cast("string").alias("explanation"), F.coalesce("source_text", F.substring("text", 1, SOURCE_LENGTH)).alias("source_text"),
        F.lit(False).alias("optional_if_absent"), *(F.lit(None).cast(own.schema[x].dataType).alias(x) for x in (*_NUMBERS, "room_labels", "required_labels", "by_bedrooms")),
    )
    return linked.unionByName(made)


def merge_packs(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The guidelines of all packs of a document as one list, numbered anew, and a rule of each that is mapped to a kind.

    parts: doc_id, part (order of packs), pack (JSON).  Only what packs list as guidelines counts, objects of any content.  Both tables have doc_id, n (from 1)
    and guideline_id (g-n); a rule takes over the amounts and the code that stand beside its guideline, else its clause or id as code.
    """
    doc = F.from_json(_strip(C("pack")), "struct<guidelines:string>")["guidelines"]
    fields = [*dict.fromkeys([*_GUIDELINE_FIELDS, *_RULE_FIELDS])]
    items = parts.select("doc_id", "part", F.posexplode(_items(doc)).alias("at", "t")).select("doc_id", "part", "at", _parsed(C("t"), fields).alias("g")).where("g IS NOT NULL")
    items = items.select("*", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "at")).cast("long").alias("n"))
    filled = lambda *names: F.coalesce(*(_filled(C("g")[x]) for x in names))
    text, kind = filled("text", "sourceText", "source_text"), filled("mappedKind", "mapped_kind", "kind")
    name = F.coalesce(_text("g", "name"), F.substring(text, 1, NAME_LENGTH), F.concat(F.lit("Guideline "), C("n").cast("string")))
    source = F.coalesce(filled("sourceText", "source_text"), F.substring(text, 1, SOURCE_LENGTH))
    rows = items.select(
        "doc_id", "n", F.concat(F.lit("g-"), C("n").cast("string")).alias("guideline_id"), F.coalesce(_text("g", "group"), F.lit("General")).alias("group"), name.alias("name"), F.coalesce(text, name).alias("text"),
        _text("g", "clause").alias("clause"), source.alias("source_text"), _number("g", "page").cast("long").alias("page"), _list("g", "line_ids").alias("line_ids"), F.lit("pending").alias("status"),
        F.when(kind.isin(*KINDS), kind).alias("mapped_kind"), "g",
    )
    scale = F.when(C("g.requiresScale").isNotNull(), _true(C("g.requiresScale"))).otherwise(~C("mapped_kind").isin(*SCALE_FREE))
    rules = rows.where("mapped_kind IS NOT NULL").select(
        "doc_id", "n", F.coalesce(_text("g", "code"), C("clause"), F.upper("guideline_id")).alias("code"), "name", C("mapped_kind").alias("kind"), "guideline_id", "clause", "source_text", scale.alias("requires_scale"), *_amounts("g")
    )
    return rows.drop("g"), rules
