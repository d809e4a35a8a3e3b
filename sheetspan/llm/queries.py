"""The registered queries of the operators, each over its whole table at production settings."""

from __future__ import annotations

import string
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import new_path, table
from . import exact_dedup, language_id, line_dedup, manifest, mixing, ngram_join, packing, periodic_runs, pii, records, secrets, tokens, topk, toxicity
from .spans import let

#: Target weights of op1's domains.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


def domain_of():
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..workspace import stage

    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, table(spark, sf_dir, "labels"), domain_of())
    measured = stage(mixing.measure(docs, model), "measured")
    return mixing.rates(measured, mixing.fit(measured, model.domains, TARGETS), model.domains)


def op2_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path()).drop("ids")


def op3_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = language_id.dictionaries(docs.where(_remainder(3) != 1))
    found = language_id.identify(docs.select("doc_id", "text"), content)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), folder, tokens.vocabulary_path())

    def digest(batches):
        for batch in batches:
            n = np.array([len(x) // 4 for x in batch["ids"]], np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "start": batch["start"], "n_tokens": n, "ids_crc32": np.array([zlib.crc32(x) for x in batch["ids"]], np.int64)})

    return records.read_records(spark, folder).mapInPandas(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_rows(pii.find(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest_rows(secrets.find(docs, secrets.train(docs)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_remainder(4) != 2).select("doc_id", "toxic")
    lexicon = toxicity.train_from(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents, where one in ten by h = crc32 of its id repeats words from word a on: word i >= a becomes word
    a + (i - a) % p, where a = g % n, p = 1 + floor((n - a) / (3 + g % 8)) and g = floor(h / 10).  A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), 0)

    def planted(words, g):
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    made = let(F.struct(words.alias("w"), F.floor(h / 10).alias("g")), lambda x: F.when(F.size(x["w"]) > 0, planted(x["w"], x["g"])).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    one = found.select("doc_id", "runs", "collapsed", best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    length, period = -F.col("best.shorter"), F.col("best.period")
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: manifest.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    lowered = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    changed = F.when(_remainder(3) == 0, fields(lowered))
    found = manifest.manifest(docs, fields(F.col("text")), extra={"changed": changed})
    folded = found.withColumn("folded_root", manifest.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", manifest.siblings(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_to_weights, op2_minimum_slack_packing, op3_compression_language_id, op4_exact_top_k, op5_token_records,
        op6_personal_data, op7_ngram_jaccard_join, op8_secret_scan, op9_exact_dedup, op10_toxicity,
        op11_line_dedup, op12_periodic_runs, op13_merkle_manifest,
    )
}

def _merkle_sql(levels: int = 7) -> str:
    """The tree of up to 8 ** levels leaves a group, a level after the other.  At the end of its group's levels a node keeps its digest."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars')))} || {value(text)})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), "
        "lambda c, d: list_reduce(list_prepend(xor(c, d), range(8)), lambda b, k: xor(b >> 1, 3988292384::BIGINT * (b & 1)))), 4294967295::BIGINT)"
    )
    sql = [f"leaves AS (SELECT doc_id, lang, {digest('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest(low)} END AS changed FROM documents)"]

    def tree(name: str, source: str, group: str, ident: str, first: str, order: str) -> None:
        sql.append(
            f"{name}0 AS (SELECT {ident}, {group} AS g, {first} AS h, count(*) OVER (PARTITION BY {group}) AS n, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS r FROM {source})"
        )
        for k in range(levels):
            sql.append(f"{name}{k + 1} AS (SELECT g, r // 8 AS r, (n + 7) // 8 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h, string_agg(h, '' ORDER BY r) AS kids FROM {name}{k} GROUP BY g, r // 8, n)")

    tree("t", "leaves", "lang", "doc_id, leaf, changed", "leaf", "doc_id")
    sql.append(f"subroots AS (SELECT g AS lang, h AS subroot FROM t{levels})")
    tree("u", "subroots", "0", "lang, subroot", "subroot", "lang NULLS FIRST")

    def climb(name: str, source: str, top: str, start: str) -> None:
        """A path up the tree: the node's place, its own and its recomputed digest, and the siblings so far."""
        sql.append(f"{name}0 AS (SELECT *, {start} FROM {source})")
        for k in range(levels):
            own = f"{top}{k + 1}"
            before, after = f"substr({own}.kids, 1, 64 * (p.r % 8)::INT)", f"substr({own}.kids, 64 * (p.r % 8)::INT + 65)"
            sql.append(
                f"{name}{k + 1} AS (SELECT p.* EXCLUDE (r, n, now, others), p.r // 8 AS r, {own}.n AS n, "
                f"CASE WHEN p.n > 1 THEN sha256({before} || now || {after}) ELSE now END AS now, "
                f"CASE WHEN p.n > 1 THEN others || {before} || {after} ELSE others END AS others "
                f"FROM {name}{k} p JOIN {own} ON p.g IS NOT DISTINCT FROM {own}.g AND p.r // 8 = {own}.r)"
            )

    climb("p", "t0", "t", "coalesce(changed, leaf) AS now, '' AS others")
    sql.append(f"joined AS (SELECT p.* EXCLUDE (g, r, n), u0.g, u0.r, u0.n, u0.subroot FROM p{levels} p JOIN u0 ON p.g IS NOT DISTINCT FROM u0.lang)")
    climb("q", "joined", "u", "0 AS unused")
    return "WITH " + ",\n".join(sql) + (
        f"\nSELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, now AS folded_root, now = root AS verified FROM q{levels}, (SELECT h AS root FROM u{levels})"
    )


BLANK = "[\\x20\\x09-\\x0D]"
ORACLE_SQL = {
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""",
    "op9_exact_dedup": f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, text_sha256,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d) w
""",
    "op11_line_dedup": """
WITH l AS (
  SELECT doc_id, place, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
shared AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, coalesce(l.doc_id <> shared.last, false) AS gone FROM l LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op13_merkle_manifest": _merkle_sql(),
}
