"""Queries of sources, sinks, job events and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import hooks, rollup
from ..sources import readers, writers
from ..streaming import jobs
from ..workspace import new_path
from .fixtures import entities, views
from .q_policy import PAGE_RULES, page_rules
from .registry import query

C = F.col
LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM d_job_events) z WHERE n = 1)"
NOW = "2025-01-01 00:00:00"


def _events(spark, sf_dir):
    return views(spark, sf_dir, "d_job_events")


def _plain(df, *names):
    """Timestamps without zone, as an oracle has them."""
    for c in names:
        df = df.withColumn(c, C(c).cast("timestamp_ntz"))
    return df


@query(f"WITH {LAST} SELECT job_id, event_id, worker_id, kind FROM last")
def s8_latest_jobs(spark, sf_dir):
    return readers.latest_jobs(_events(spark, sf_dir)).select("job_id", "event_id", "worker_id", "kind")


@query("SELECT page_id, ord, trim(text) AS text, confidence FROM d_ocr_lines")
def s4_exploded_ocr(spark, sf_dir):
    lines = views(spark, sf_dir, "d_ocr_lines")
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "confidence"))).alias("rows"))
    pages = pages.select("page_id", "rows", F.transform("rows", lambda r: F.struct(F.concat(F.lit(" "), r["text"]).alias("text"), r["confidence"].alias("confidence"))).alias("lines"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("text_hint"))
    flat = readers.explode_ocr(pages).join(pages.select("page_id", "rows"), "page_id")
    return flat.select("page_id", C("rows")[C("ord")]["ord"].alias("ord"), "text", "confidence")


@query(f"""WITH {PAGE_RULES} SELECT unit_id AS unit, rule_code, result, CASE WHEN required IS NOT NULL THEN 'm2' END AS unit_measure, CASE result WHEN 'pass' THEN 'Requirement met.' WHEN 'fail' THEN 'Requirement not met.' ELSE 'Evidence missing.' END AS explanation, 'v1' AS policy_version FROM results""")
def w1_compliance_report(spark, sf_dir):
    return writers.compliance_report(page_rules(spark, sf_dir), "v1").drop("measured", "required", "confidence")


@query()
def w3_evaluation_report(spark, sf_dir):
    gold, pred = views(spark, sf_dir, "d_gold"), views(spark, sf_dir, "d_pred")
    return writers.eval_report(rollup.pq(rollup.match_boxes(gold, pred), gold, pred))


@query()
def w4_analysis_documents(spark, sf_dir):
    return writers.analysis_document(views(spark, sf_dir, "d_pages"), entities(spark, sf_dir), page_rules(spark, sf_dir))


def _yolo(spark, sf_dir):
    df = entities(spark, sf_dir).withColumn("coords", g.to_unit_box(C("bbox"), F.lit(1300.0), F.lit(1100.0))).where("coords IS NOT NULL")
    return df.join(rollup.dense_classes(df), "label").select(F.lit("train").alias("split"), C("page_id").cast("string").alias("image_id"), "ord", "class_id", "coords")


_U = "greatest(0, least(1, {0}))"
_X0, _X1, _Y0, _Y1 = (_U.format(v) for v in ("x / 1300", "(x + w) / 1300", "y / 1100", "(y + h) / 1100"))


@query(f"""WITH k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_id FROM (SELECT DISTINCT label FROM d_entities) z)
SELECT 'train' AS split, CAST(page_id AS VARCHAR) AS image_id, ord, concat_ws(' ', class_id::VARCHAR, printf('%.6f', ({_X0} + {_X1}) / 2)) AS value FROM d_entities JOIN k USING (label)""")
def w5_yolo_lines(spark, sf_dir):
    return writers.yolo_lines(_yolo(spark, sf_dir).withColumn("coords", F.slice("coords", 1, 1)))


@query()
def w6_labelme_round_trip(spark, sf_dir):
    """Documents written, read back as shapes, and counted by label."""
    path = new_path(spark, "labelme")
    docs = writers.labelme_documents(entities(spark, sf_dir).withColumn("shape_type", F.when(C("ord") % 5 == 0, "rectangle").otherwise("polygon")))
    docs.select(C("document").alias("value")).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", readers.LABELME).alias("d")).select(F.explode("d.shapes").alias("s"))
    return back.groupBy("s.label").agg(F.count("*").alias("shapes"))


@query("""SELECT job_id, max(v) AS version FROM (SELECT job_id, max(event_id) AS v FROM d_job_events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT job_id, max(event_id) FROM d_job_events WHERE event_id % 2 = 1 GROUP BY 1) z GROUP BY 1""")
def w7_upserted_jobs(spark, sf_dir):
    half = lambda k: _events(spark, sf_dir).where(C("event_id") % 2 == k).groupBy("job_id").agg(F.max("event_id").alias("version"))
    return writers.upsert(half(0), half(1), "job_id", "version")


@query(f"WITH {LAST} SELECT job_id, worker_id, ts + INTERVAL 120 SECOND AS lease_end FROM last WHERE kind IN ('claim', 'heartbeat') AND ts + INTERVAL 120 SECOND <= TIMESTAMP '{NOW}'")
def t2_expired_leases(spark, sf_dir):
    return _plain(jobs.expired_leases(_events(spark, sf_dir), NOW), "lease_end")


@query(f"WITH {LAST} SELECT job_id, ts FROM last WHERE kind IN ('enqueue', 'fail') OR (kind IN ('claim', 'heartbeat') AND ts + INTERVAL 120 SECOND <= TIMESTAMP '{NOW}') ORDER BY ts, job_id LIMIT 20")
def k4_claimable_jobs(spark, sf_dir):
    return _plain(jobs.claimable(_events(spark, sf_dir), NOW, 20), "ts")


def _progress(spark, sf_dir):
    kind = F.when(C("kind") == "complete", "final").when(C("kind") == "fail", "error").otherwise("tile")
    return _events(spark, sf_dir).select((C("job_id") % 20).alias("run_id"), "ts", kind.alias("kind"), (C("event_id") % 7).alias("regions"))


@query("SELECT job_id % 20 AS run_id, date_trunc('hour', ts) AS hour, count(*) FILTER (kind NOT IN ('complete', 'fail')) AS tiles, sum(event_id % 7)::BIGINT AS regions, max((kind IN ('complete', 'fail'))::INT) AS finished FROM d_job_events GROUP BY 1, 2")
def t3_tile_progress(spark, sf_dir):
    return _plain(jobs.tile_progress(_progress(spark, sf_dir)), "hour")


@query("""WITH s AS (SELECT * FROM (VALUES (1, 'queued', 8), (2, 'rendering_pdf', 15), (3, 'identifying_floor_plan_pages', 23), (4, 'preprocessing', 31), (5, 'running_structural_models', 38),
  (6, 'running_ocr', 46), (7, 'reconstructing_geometry', 54), (8, 'inferring_corridors', 62), (9, 'inferring_units', 69), (10, 'calculating_measurements', 77), (11, 'running_policy_checks', 85),
  (12, 'generating_outputs', 92), (13, 'review_required', 100), (14, 'completed', 100), (15, 'failed', 0)) v(n, stage, percent))
SELECT page_id AS analysis_id, stage, percent::BIGINT AS percent FROM d_pages JOIN s ON n = page_id % 15 + 1""")
def t4_stage_progress(spark, sf_dir):
    names = F.array(*(F.lit(s) for s in (*jobs.STAGES, "completed", "failed")))
    return jobs.stage_progress(views(spark, sf_dir, "d_pages").select(C("page_id").alias("analysis_id"), F.element_at(names, (C("page_id") % 15 + 1).cast("int")).alias("stage")))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY worker_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS brk FROM d_job_events), s AS (SELECT *, sum(brk) OVER (PARTITION BY worker_id ORDER BY ts, event_id) AS sid FROM g)
SELECT worker_id, min(ts) AS first_ts, count(*) AS events FROM s GROUP BY worker_id, sid""")
def t5_worker_sessions(spark, sf_dir):
    return _plain(jobs.worker_sessions(_events(spark, sf_dir), "10 minutes"), "first_ts")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY epoch DESC) AS k FROM d_training_metrics) SELECT job_id, coalesce(max(loss) FILTER (k = 4) > 0 AND max(loss) FILTER (k = 1) > max(loss) FILTER (k = 4) * 1.08, false) AS rising FROM r GROUP BY 1""")
def t7_epoch_monitor(spark, sf_dir):
    return jobs.epoch_monitor(views(spark, sf_dir, "d_training_metrics"))


@query()
def z1_scored_tiles(spark, sf_dir):
    """A batch predictor over tile rows, here one that returns a box in each tile's middle."""
    return hooks.score_tiles(rollup.tile_grid(views(spark, sf_dir, "d_pages")), hooks.middle_box)
