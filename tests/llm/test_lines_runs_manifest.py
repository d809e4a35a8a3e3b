import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetspan.llm import line_dedup, manifest, periodic_runs, queries

from .brute import lower
from .test_operators import LONG, ODD, SCHEMA, SF, pairs, tuples

BLANKS = " \t\n\v\f\r"
SHARED = "A line that very many documents hold"
LINES = [
    *((100 + i, f"{SHARED}\nown line of document number {i}\n  {SHARED.upper()}\t") for i in range(5)), (104, f"{SHARED}\nagain under the same key"), (None, f"x\n{SHARED}"),
    (200, "é" * 19 + "\n" + "ü" * 20), (201, "é" * 19 + "\n" + "ü" * 20), (202, "é" * 19 + "\n" + "ü" * 20), (203, "É" * 20), (204, "\n\n"), (205, "\r\n" + SHARED + "\r"),
    *((300 + i, "twice only, this line of text\nthrice, this line of text is there" if i < 2 else "thrice, this line of text is there") for i in range(3)),
    (400, (SHARED + "\n") * 3000), (None, "a line of null keys only, it is"), (None, "a line of null keys only, it is"), (None, "a line of null keys only, it is"),
]


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, "x", 1) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def frames(spark):
    odd = rows_of(spark, ODD)
    return [spark.read.parquet(f"{SF}/documents.parquet"), odd, rows_of(spark, LINES), odd.limit(0)]


def plain_lines(rows):
    """(key, lines, dropped, text) of each row."""
    key = lambda line: lower(line).strip(BLANKS)
    place = lambda d: -(1 << 63) if d is None else d
    holders = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(i)
    last = {k: max(place(rows[i][0]) for i in h) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), place(d)) == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_drop_lines(frames):
    for df in frames:
        want = Counter(plain_lines(pairs(df)))
        for sizes in ({}, {"shard_lines": 3, "block_lines": 7}):
            kept = line_dedup.drop_lines(df, **sizes)
            assert kept.columns == [*df.columns, "n_lines", "n_dropped"] and kept.schema["text"] == df.schema["text"]
            assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in kept.collect()) == want


def test_drop_lines_leaves_odd_columns(spark):
    df = spark.createDataFrame([(2**60 + i, f"{SHARED}\n{i}", i, None if i else 2**60 + 1, "x") for i in range(4)], "doc_id long, text string, `a``b` int, h long, n_lines string")
    rows = line_dedup.drop_lines(df).orderBy("doc_id").collect()
    assert [r.asDict() for r in rows] == [
        {"doc_id": 2**60 + i, "text": f"{SHARED}\n{i}" if i == 3 else str(i), "a`b": i, "h": None if i else 2**60 + 1, "n_lines": 2, "n_dropped": int(i < 3)} for i in range(4)
    ]


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 5000):
        h, f = (r.integers(-(1 << 63), (1 << 63) - 1, n) for _ in range(2))
        h[1::3] = h[0:1]  # lines that agree in one half
        sizes, words, slots = line_dedup.build(h, f)
        assert sorted(slots.tolist()) == list(range(n))
        own = np.zeros(n, np.int64)
        own[slots] = f
        block = line_dedup.Arrays(0, 1, np.array([sizes], np.int64).reshape(1, -1), words, own, own, own)
        assert (block.slots(h, f) == slots).all() and (block.slots(h, f + 1) == -1).all()


def plain_runs(w, times, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, times * q))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(800):
        texts = []
        for _ in range(r.randrange(1, 5)):
            n, letters, own = r.randrange(40), r.choice([1, 2, 3, 5]), []
            for i in range(n):
                own.append(own[i - p] if i and r.random() < 0.9 and (p := r.randrange(1, 4)) <= i else b"%d" % r.randrange(letters))
            texts.append(own)
        for times in (2, 4):
            for w, (found, left) in zip(texts, periodic_runs.of_texts(texts, times, 3), strict=True):
                want = sorted(plain_runs(w, times, 3), key=lambda x: (x[0], x[2]))
                assert [tuple(x) for x in found.tolist()] == want
                assert b" ".join(left).decode() == collapsed([x.decode() for x in w], want)


def test_long_repeats_take_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 50)
    for w in ([b"a"] * 3000, [b"%d" % (i % 77) for i in range(5000)], [b"a", b"b"] * 500 + [b"a"] * 300 + [b"b", b"a"] * 200):
        ((found, _),) = periodic_runs.of_texts([w], 4, 6)
        assert [tuple(x) for x in found.tolist()] == sorted(plain_runs(w, 4, 6), key=lambda x: (x[0], x[2]))


RUNS = [(1, "a a a a a"), (2, "a a a a a a"), (2, "x y x y x y x y z"), (3, "A a A a A a a a a a a a"), (None, "é é\té\né é é é"), (4, "p q r " * 5 + "p"), (5, "u\xa0v " * 9)]


def test_find_runs(spark, frames):
    extra = [(7, "a b " * 4, 1, "x", "y")]
    for df in (*frames, rows_of(spark, RUNS), spark.createDataFrame(extra, "doc_id long, text string, runs int, k string, collapsed string")):
        got = periodic_runs.find(df)
        assert got.columns == ["doc_id", "runs", "collapsed"]
        want = []
        for d, t in pairs(df):
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            known = {LONG: (0, 30_000, 1), LONG + " x": (0, 30_000, 1), (SHARED + "\n") * 3000: (0, 21_000, 7)}
            runs = [known[t]] if t in known else sorted(plain_runs(w, 4, 6), key=lambda x: (x[0], x[2]))
            want.append((d, runs, collapsed(w, runs)))
        have = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()]
        assert sorted(have, key=str) == sorted(want, key=str)


def test_periodic_runs_query_equals_brute_force(spark):
    want = []
    for d, t in pairs(spark.read.parquet(f"{SF}/documents.parquet")):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = sorted(plain_runs(w, 4, 6), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((d, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(w, runs))))
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    found = queries.op12_periodic_runs(spark, SF)
    assert found.columns == names and tuples(found, *names) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 5


def test_planting_survives_odd_rows(spark, frames):
    for df in frames:
        assert queries.with_planted_runs(df.select("doc_id", "text")).count() == df.count()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def plain_tree(nodes, fan):
    """Root, and of each node its proof: (place, the other nodes) level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(proofs):
            run = nodes[at[i] // fan * fan :][:fan]
            p.append((at[i] % fan, run[: at[i] % fan] + run[at[i] % fan + 1 :]))
            at[i] //= fan
        nodes = [sha(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
    return (nodes or [None])[0], proofs


def plain_manifest(rows, fan):
    """(key, leaf, subroot, root, proof) of rows (key, group, leaf)."""
    groups = defaultdict(list)
    for d, g, leaf in rows:
        groups[g].append((d is not None, d or 0, leaf, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in names]
    root, above = plain_tree([t[0] for t in trees], fan)
    out = []
    for g, (subroot, proofs), more in zip(names, trees, above, strict=True):
        out += [(x[3], x[2], subroot, root, own + more) for x, own in zip(sorted(groups[g], key=lambda x: x[:3]), proofs, strict=True)]
    return out


@pytest.mark.parametrize(("fan", "digits"), [(8, 3), (2, 2), (3, 1)])
def test_manifest(spark, frames, fan, digits):
    groups = spark.createDataFrame([(i % 40 if i % 7 else None, f"t{i % 50}", [None, "", "a", "é", "Z"][i % 5], i) for i in range(150)], "doc_id long, text string, lang string, digest int")
    many = spark.createDataFrame([(i, "t", f"g{i % 23:02}", 0) for i in range(23)], "doc_id long, text string, lang string, payload int")
    for df in (groups, many, *(frames[1:] if fan == 8 else [])):
        rows = [(r["doc_id"], r["lang"], sha("-" if r["text"] is None else f"{len(r['text'].encode())}:{r['text']}")) for r in df.collect()]
        got = manifest.manifest(df, manifest.leaf(F.col("text")), extra={"root_of": F.lit(1)}, fan=fan, digits=digits)
        assert got.columns == ["doc_id", "root_of", "leaf", "subroot", "root", "proof"]
        found = got.withColumn("back", manifest.fold(F.col("leaf"), F.col("proof"))).withColumn("wrong", manifest.fold(F.lit("0" * 64), F.col("proof"))).collect()
        have = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["at"], s["others"]) for s in r["proof"]]) for r in found]
        assert sorted(have, key=str) == sorted(plain_manifest(rows, fan), key=str)
        assert all(r["back"] == r["root"] != r["wrong"] for r in found)


def test_merkle_query_equals_brute_force(spark):
    rows, changed = [], {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        framed = lambda text: sha(*(f"{len(str(v).encode())}:{v}" if v is not None else "-" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))  # noqa: E731,B023
        rows.append((r["doc_id"], r["lang"], framed(r["text"])))
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            changed[r["doc_id"]] = framed(None if r["text"] is None else lower(r["text"]))
    want = []
    for d, leaf, subroot, root, proof in plain_manifest(rows, 8):
        now = changed.get(d, leaf)
        for at, others in proof:
            now = sha(*others[:at], now, *others[at:])
        want.append((d, leaf, subroot, root, sha(*(x for _, o in proof for x in o)), now, now == root))
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert tuples(queries.op13_merkle_manifest(spark, SF), *names) == sorted(want, key=str)
    assert 0 < sum(not x[6] for x in want) < len(want)
