-- view d_entities
WITH b AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
  FROM lineitem)
SELECT CAST(floor(l_orderkey / 8.0) AS BIGINT) AS page_id,
       CAST(l_orderkey * 1000 + rn AS BIGINT) AS entity_id,
       CAST(l_orderkey * 1000 + rn AS BIGINT) AS ord,
       CASE CAST((l_partkey + rn) % 8 AS INT) WHEN 0 THEN 'unit_boundary' WHEN 1 THEN 'door' WHEN 2 THEN 'window'
            WHEN 3 THEN 'wall' WHEN 4 THEN 'fixture' ELSE 'room' END AS type,
       CASE CAST((l_partkey + rn) % 8 AS INT)
            WHEN 0 THEN concat('Unit ', CAST(l_suppkey % 40 AS VARCHAR(12)))
            WHEN 1 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'Main Door' ELSE 'Single Door' END
            WHEN 2 THEN 'Window'
            WHEN 3 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'External Wall' ELSE 'Wall' END
            WHEN 4 THEN 'Sink'
            ELSE CASE CAST(l_suppkey % 10 AS INT) WHEN 0 THEN 'Bedroom' WHEN 1 THEN 'master_bedroom' WHEN 2 THEN 'Bathroom'
                 WHEN 3 THEN 'Ensuite' WHEN 4 THEN 'Open Living' WHEN 5 THEN 'Balcony' WHEN 6 THEN 'Lobby'
                 WHEN 7 THEN 'Store' WHEN 8 THEN 'Communal Outdoor Garden' ELSE 'Room' END END AS label,
       CASE WHEN l_partkey % 17 = 0 THEN 'rejected' WHEN l_partkey % 5 = 0 THEN 'user_confirmed' ELSE 'predicted' END AS status,
       CAST((l_partkey * 37) % 1000 AS DOUBLE) AS x,
       CAST((l_suppkey * 53 + l_partkey) % 800 AS DOUBLE) AS y,
       CAST(20 + l_quantity * 4 AS DOUBLE) AS w,
       CAST(20 + (l_partkey % 60) * 4 AS DOUBLE) AS h,
       CAST(1.0 AS DOUBLE) - CAST(l_discount AS DOUBLE) AS confidence
FROM b

-- view d_pages
SELECT page_id, CAST(page_id % 50 AS BIGINT) AS building_id, CAST(page_id % 9 AS BIGINT) AS level_index,
       CAST(1300 AS DOUBLE) AS width_px, CAST(1100 AS DOUBLE) AS height_px,
       CASE WHEN page_id % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(10 + page_id % 5 AS DOUBLE) END AS ppm,
       CAST(page_id % 30 AS BIGINT) AS vector_ops, CAST(page_id % 3 AS BIGINT) AS image_ops, CAST(page_id % 7 AS BIGINT) AS text_ops
FROM (SELECT DISTINCT page_id FROM d_entities) p

-- view d_ocr_lines
SELECT page_id, ord, confidence, x, y, w, CAST(14 AS DOUBLE) AS h,
       CASE CAST(entity_id % 13 AS INT)
         WHEN 0 THEN concat('UNIT ', CAST(entity_id % 300 AS VARCHAR(12)))
         WHEN 1 THEN 'FIRST FLOOR PLAN' WHEN 2 THEN concat('LEVEL ', CAST(entity_id % 20 AS VARCHAR(12)))
         WHEN 3 THEN 'SCALE 1:100 @ A1' WHEN 4 THEN '1:200' WHEN 5 THEN '@ A3'
         WHEN 6 THEN '3.9m x 3.6m' WHEN 7 THEN '3900 x 3600' WHEN 8 THEN 'BED 2' WHEN 9 THEN 'KITCHEN / DINING'
         WHEN 10 THEN 'Type 2B' WHEN 11 THEN 'LIFT LOBBY' ELSE 'General Arrangement' END AS text
FROM d_entities

-- view d_tile_regions
SELECT page_id, entity_id * 2 AS region_id, type, label, confidence, x, y, w, h FROM d_entities WHERE status <> 'rejected'
UNION ALL
SELECT page_id, entity_id * 2 + 1 AS region_id, type, label, confidence / 2 AS confidence, x + 4 AS x, y + 2 AS y, w, h
FROM d_entities WHERE status <> 'rejected' AND entity_id % 3 = 0

-- view d_seam_regions
SELECT e.page_id, e.entity_id * 8 + t.k AS region_id, e.type, e.label, e.confidence, t.tx, t.ty, CAST(640 AS DOUBLE) AS tw, CAST(640 AS DOUBLE) AS th,
       greatest(e.x, t.tx) AS x, greatest(e.y, t.ty) AS y,
       least(e.x + e.w, t.tx + 640) - greatest(e.x, t.tx) AS w, least(e.y + e.h, t.ty + 640) - greatest(e.y, t.ty) AS h
FROM d_entities e CROSS JOIN (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS tx, CAST(0 AS DOUBLE) AS ty UNION ALL SELECT 1, CAST(640 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT 2, CAST(0 AS DOUBLE), CAST(608 AS DOUBLE) UNION ALL SELECT 3, CAST(640 AS DOUBLE), CAST(608 AS DOUBLE)) t
WHERE e.status <> 'rejected' AND least(e.x + e.w, t.tx + 640) - greatest(e.x, t.tx) >= 2 AND least(e.y + e.h, t.ty + 640) - greatest(e.y, t.ty) >= 2

-- view d_gold
SELECT page_id AS sheet_id, entity_id AS gold_id, ord, x, y, w, h FROM d_entities WHERE type = 'room'

-- view d_pred
SELECT page_id AS sheet_id, entity_id AS pred_id, ord, x + (entity_id % 5) * 8 AS x, y, w, h FROM d_entities
WHERE type = 'room' AND entity_id % 7 <> 0

-- view d_job_events
SELECT user_id AS job_id, event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id % 4 AS BIGINT) AS worker_id,
       CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat'
            WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind
FROM events

-- view d_training_metrics
SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss FROM events

-- view d_shapes
SELECT page_id, ord, concat(CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '20' WHEN 1 THEN '21' WHEN 2 THEN '82' WHEN 3 THEN '98'
         WHEN 4 THEN '118' ELSE '77' END, '_', CAST(page_id AS VARCHAR(12))) AS stem,
       CASE WHEN ord % 41 = 0 THEN '' WHEN ord % 43 = 0 THEN 'Spaceship' ELSE label END AS label,
       CASE WHEN ord % 5 = 0 THEN 'rectangle' ELSE 'polygon' END AS shape_type,
       x, y, CASE WHEN ord % 47 = 0 THEN CAST(1 AS DOUBLE) ELSE w END AS w, CASE WHEN ord % 47 = 0 THEN CAST(1 AS DOUBLE) ELSE h END AS h
FROM d_entities

-- view d_rules
SELECT 'ROOM-BED-MIN' AS code, 'room_min_area' AS kind, 'bed' AS needle, CAST(9 AS DOUBLE) AS min_area, true AS requires_scale, false AS optional
UNION ALL SELECT 'ROOM-LIVING-MIN', 'room_min_area', 'living', CAST(12 AS DOUBLE), true, false
UNION ALL SELECT 'POS-MIN', 'room_min_area', 'balcony', CAST(8 AS DOUBLE), true, true
UNION ALL SELECT 'TYPES-BED', 'required_labels', 'bedroom', CAST(NULL AS DOUBLE), false, false
UNION ALL SELECT 'TYPES-BATH', 'required_labels', 'bathroom', CAST(NULL AS DOUBLE), false, false
UNION ALL SELECT 'WALL-PRESENT', 'min_wall_count', CAST(NULL AS VARCHAR(12)), CAST(1 AS DOUBLE), false, false

-- view d_node_entities
SELECT *, CASE WHEN ord % 11 = 0 THEN entity_id + 1 END AS unit_ref, CASE WHEN ord % 7 = 0 THEN concat('Unit ', CAST(entity_id % 40 AS VARCHAR(12))) END AS unit_text,
       CASE WHEN ord % 13 = 0 THEN CAST(14.04 AS DOUBLE) END AS printed_m2
FROM d_entities

-- view d_scale_lines
SELECT page_id, ord, confidence, x, y, w, h, CASE WHEN page_id % 4 <> 0 AND text LIKE 'SCALE%' THEN CASE WHEN ord % 2 = 0 THEN 'Scale' ELSE 'SCALE 1:50' END
       WHEN page_id % 4 = 3 AND text = '@ A3' THEN 'Notes' ELSE text END AS text
FROM d_ocr_lines

-- view d_number_lines
SELECT page_id, ord, x, y, CAST(40 AS DOUBLE) AS w, h, CASE CAST(entity_id % 5 AS INT) WHEN 0 THEN 'Unit' WHEN 1 THEN concat('# ', CAST(entity_id % 300 AS VARCHAR(12)), 'a')
       WHEN 2 THEN CAST(entity_id % 90 AS VARCHAR(12)) WHEN 3 THEN 'APT.' ELSE text END AS text
FROM d_ocr_lines l JOIN (SELECT page_id AS p, ord AS o, entity_id FROM d_entities) e ON e.p = l.page_id AND e.o = l.ord

-- view d_tile_lines
SELECT l.page_id, l.ord * 2 + k.k AS line_id, l.confidence - k.k * 0.05 AS confidence, greatest(l.x, k.t0) AS x, l.y + k.k AS y, least(l.x + l.w, k.t1) - greatest(l.x, k.t0) AS w, l.h,
       l.x < k.t0 AS cut_left, l.x + l.w > k.t1 AS cut_right,
       substr(l.text, CAST(floor(length(l.text) * (greatest(l.x, k.t0) - l.x) / l.w + 0.5) AS INT) + 1,
              CAST(floor(length(l.text) * (least(l.x + l.w, k.t1) - l.x) / l.w + 0.5) AS INT) - CAST(floor(length(l.text) * (greatest(l.x, k.t0) - l.x) / l.w + 0.5) AS INT)) AS text
FROM d_ocr_lines l CROSS JOIN (SELECT 0 AS k, CAST(0 AS DOUBLE) AS t0, CAST(660 AS DOUBLE) AS t1 UNION ALL SELECT 1, CAST(600 AS DOUBLE), CAST(1300 AS DOUBLE)) k
WHERE least(l.x + l.w, k.t1) - greatest(l.x, k.t0) > 4

-- view d_type_lines
SELECT page_id, ord, x, y, w, h, CASE CAST(ord % 11 AS INT) WHEN 0 THEN concat('Apartment ', CAST(ord % 90 AS VARCHAR(12))) WHEN 1 THEN 'Type' WHEN 2 THEN '3B' WHEN 3 THEN 'Studio' WHEN 4 THEN 'Type: 2 Bed'
       WHEN 5 THEN concat('Unit ', CAST(ord % 70 AS VARCHAR(12)), ' Type 2B') WHEN 6 THEN 'UNIT' WHEN 7 THEN CAST(ord % 80 AS VARCHAR(12)) WHEN 8 THEN '1BR' WHEN 9 THEN 'types.' ELSE text END AS text
FROM d_ocr_lines WHERE text NOT LIKE 'SCALE%'

-- view d_name_lines
SELECT page_id, ord, x, y, w, h, CASE text WHEN 'LIFT LOBBY' THEN 'Living' WHEN '@ A3' THEN 'Bathroom' ELSE text END AS text FROM d_ocr_lines WHERE text IN ('BED 2', 'KITCHEN / DINING', 'LIFT LOBBY', '@ A3')
