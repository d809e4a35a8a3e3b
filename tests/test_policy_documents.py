"""Small cases of policy documents: places of guidelines, packs of rules."""

import random
import re

from sheetspan.operators import policy_lines
from sheetspan.sources import policy_packs

LINES = "doc_id long, line_id string, ord int, page long, x double, y double, width double, height double, text string"
GUIDELINES = "doc_id long, guideline_id string, page long, line_ids array<string>, source_text string, text string, rects array<struct<page:long,x:double,y:double,width:double,height:double>>"
PAGES = "doc_id long, page long, width double, height double"


def plain(text):
    return re.sub("[“”\"']", "", re.sub(r"\s+", " ", text.lower())).strip(" ")


def plain_score(line, excerpt):
    a, b = plain(line), plain(excerpt)
    if not a or not b:
        return 0.0
    if a in b and len(a) >= 16:
        return len(a) / len(b) + 0.4
    if b in a and len(b) >= 16:
        return len(b) / len(a) + 0.35
    words = [w for w in b.split(" ") if len(w) > 3]
    share = sum(w in a for w in words) / len(words) if len(words) >= 3 else 0.0
    return share if share >= 0.55 else 0.0


def plain_best(lines, excerpt):
    hits = sorted((-plain_score(text, excerpt), n, page) for n, page, text in lines if plain_score(text, excerpt) > 0)
    near = [(n, s) for s, n, page in hits if page == hits[0][2] and -s >= -hits[0][0] * 0.7]
    return [n for n, _ in near[:4]]


def test_best_lines_equal_all_pairs(spark):
    """Few words, whole and as parts of others, quotes, stretches without a long word: lines that fit as all pairs find them."""
    r = random.Random(11)
    words = ["living", "livings", "open", "opened", "re'open", "space", "area", "a", "of", "in", "“wall”", "walls", "to", "min", "x"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    short = lambda n: " ".join(r.choice(["a", "of", "in", "to", "x"]) for _ in range(n))
    lines = [(d, n, n // 4, r.choice([text(r.randint(1, 9)), short(9), short(30)])) for d in (1, 2) for n in range(60)]
    own = {d: [(n, p, t) for e, n, p, t in lines if e == d] for d in (1, 2)}
    cut = lambda d: own[d][r.randrange(60)][2][r.randint(0, 4) :][: r.randint(10, 40)]
    asked = [(d, f"g{i}", r.choice([text(r.randint(2, 8)), cut(d), short(8), text(2) + " " + cut(d) + " " + text(2)])) for d in (1, 2) for i in range(80)]
    df = spark.createDataFrame([*((d, n, p, t) for d, n, p, t in lines), (1, 60, 15, None), (1, 61, 15, "  ")], "doc_id long, ord int, page long, text string")
    wanted = spark.createDataFrame([*asked, (1, "none", None), (1, "empty", " "), (3, "no document", "living space area"), (None, "null", "living space area")], "doc_id long, guideline_id string, excerpt string")
    got = {}
    for x in policy_lines.best_lines(wanted, df).orderBy("n").collect():
        got.setdefault((x["doc_id"], x["guideline_id"]), []).append(x["ord"])
    want = {(d, g): plain_best(own[d], e) for d, g, e in asked}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 60


def test_guidelines_are_placed_by_ids_then_text_then_their_own_rectangles(spark):
    line = lambda i, page, x, y, text: (1, f"l{i}", i, page, x, y, 100.0, 10.0, text)
    lines = spark.createDataFrame([line(1, 2, 5.0, 5.0, "Living rooms shall face north"), line(2, 2, 0.0, 20.0, "and open to the garden side"), line(3, 1, 0.0, 0.0, "Contents"), (1, "l3", 4, 1, 7.0, 7.0, 1.0, 1.0, "Contents")], LINES)
    box = [(0, 0.5, 0.5, 0.25, 0.25), (9, 0.5, 0.5, 0.25, 0.25), (2, 10.0, 0.0, 5.0, 5.0)]
    rows = [
        (1, "ids", None, ["l2", "gone", "l3", "l1"], "x", "y", box), (1, "text", 7, ["gone"], None, "living rooms shall face “north” and open to the garden side", None), (1, "source", None, None, "Living rooms shall face", "Contents", None),
        (1, "own", 1, [], "", "nowhere to be found", box), (1, "none", None, None, None, None, []), (None, "null", None, ["l1"], None, "living rooms shall face north", box[2:]),
    ]
    pages = spark.createDataFrame([(1, 1, 200.0, 400.0), (1, 2, 100.0, 100.0)], PAGES)
    found = policy_lines.guideline_lines(spark.createDataFrame(rows, GUIDELINES), lines, pages)
    got = {r["guideline_id"]: (r["source"], r["page"], r["line_ids"], [tuple(x) for x in r["rects"] or []]) for r in found.collect()}
    assert got == {
        "ids": ("ids", 2, ["l2", "gone", "l3", "l1"], [(2, 0.0, 5.0, 105.0, 25.0), (1, 7.0, 7.0, 1.0, 1.0)]),
        "text": ("text", 7, ["l1", "l2"], [(2, 0.0, 5.0, 105.0, 25.0)]), "source": ("text", 2, ["l1"], [(2, 5.0, 5.0, 100.0, 10.0)]),
        "own": ("rects", 1, [], [(1, 100.0, 200.0, 50.0, 100.0), (9, 0.5, 0.5, 0.25, 0.25), (2, 10.0, 0.0, 5.0, 5.0)]), "none": ("none", None, None, []), "null": ("rects", None, ["l1"], [(2, 10.0, 0.0, 5.0, 5.0)]),
    }
    assert policy_lines.guideline_lines(spark.createDataFrame([], GUIDELINES), lines, pages).count() == 0
    assert policy_lines.guideline_lines(spark.createDataFrame(rows, GUIDELINES), lines.limit(0), pages.limit(0)).count() == 6


def test_packs_of_every_shape(spark):
    packs = [
        ("rules", '{"rules": [{"requiresScale": "0", "kind": "room_min_area", "minAreaM2": "9.5", "roomLabels": []}, null, "text", {"minCommunalM2": 0}, {"byBedrooms": {}, "name": "POS"}, {"byBedrooms": {"3": 4}}]}'),
        ("mixed", '{"rules": [{"kind": "room_min_area", "guideline_id": ""}], "guidelines": [{"text": "t", "mappedKind": "room_min_area", "sourceText": "s"}, {"id": 7, "name": "n", "mapped_kind": "room_min_area", "rects": [{"page": 1, "x": 0, "y": 0, "width": 1, "height": 1}, {"page": 2}], "policy": ["A", ""]}], "groups": [{"items": [{"text": "unused"}]}]}'),
        ("catalogue", '{"rules": [{"id": "a", "design_element": "d", "variable": "v"}]}'), ("no list", '{"rules": {"kind": "room_min_area"}, "guidelines": "x", "groups": 3}'), ("list", "[1, 2]"), ("broken", '{"rules": ['), ("empty", ""), ("null", None), (None, '{"rules": [{}]}'),
    ]
    df = spark.createDataFrame(packs, "pack_id string, pack string")
    rules = {(r["pack_id"], r["n"]): (r["code"], r["kind"], r["guideline_id"], r["requires_scale"], r["min_area_m2"], r["by_bedrooms"]) for r in policy_packs.read_policy_rules(df).collect()}
    assert rules == {
        ("rules", 0): ("RULE-1", "room_min_area", None, False, 9.5, None), ("rules", 3): ("RULE-4", "communal_open_space", None, False, None, None), ("rules", 4): ("RULE-5", "apartment_min_pos", None, False, None, None),
        ("rules", 5): ("RULE-6", "apartment_min_internal", None, False, None, {"3": 4.0}), ("mixed", 0): ("RULE-1", "room_min_area", "7", False, None, None), (None, 0): ("RULE-1", "room_min_area", None, False, None, None),
    }
    got = {r["guideline_id"]: (r["pack_id"], r["name"], r["text"], r["group"], len(r["rects"] or []), r["policies"]) for r in policy_packs.read_guidelines(df).collect()}
    assert got == {"g-1": ("mixed", "t", "t", "General", 0, None), "7": ("mixed", "n", "n", "General", 1, ["A"])}
    for none in (df.limit(0), df.where("pack_id = 'broken'")):
        assert policy_packs.read_policy_rules(none).count() == 0 == policy_packs.read_guidelines(none).count()


def test_packs_of_a_document_are_numbered_anew(spark):
    parts = [
        (1, 2, '{"guidelines": [{"id": "x", "text": "third", "kind": "apartment_min_storage", "minCount": 2, "code": "S", "requiresScale": false}]}'), (1, 1, '{"guidelines": [{"name": "first", "mapped_kind": "null"}, 5, {"mappedKind": "apartment_dual_aspect"}]}'),
        (2, 1, '{"rules": [{"kind": "room_min_area"}]}'), (3, 1, None),
    ]
    guidelines, rules = policy_packs.merge_packs(spark.createDataFrame(parts, "doc_id long, part int, pack string"))
    assert [(r["doc_id"], r["guideline_id"], r["name"], r["text"], r["mapped_kind"]) for r in guidelines.orderBy("n").collect()] == [
        (1, "g-1", "first", "first", None), (1, "g-2", "Guideline 2", "Guideline 2", "apartment_dual_aspect"), (1, "g-3", "third", "third", "apartment_min_storage"),
    ]
    assert [(r["code"], r["kind"], r["requires_scale"], r["min_count"]) for r in rules.orderBy("n").collect()] == [("G-2", "apartment_dual_aspect", False, None), ("S", "apartment_min_storage", False, 2.0)]
