"""SQL twins of the queries, written for DuckDB over the same tables."""

from __future__ import annotations

# --- tables ------------------------------------------------------------------------------------------

IMAGES = """SELECT o_orderkey AS image_id,
  concat('img_', lpad(CAST(o_orderkey AS VARCHAR), 8, '0'),
    CASE o_orderkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' ELSE '.png' END) AS image_name,
  CAST(320 + (o_orderkey * 37) % 961 AS INT) AS image_width,
  CAST(240 + (o_orderkey * 53) % 481 AS INT) AS image_height
FROM orders"""

ITEMS = """SELECT l_orderkey AS image_id, l_partkey AS p, concat(l_returnflag, l_linestatus) AS lab,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS k
FROM lineitem"""

DRAFTS = f"""SELECT image_id, run, k AS item_ix, label, CAST(x AS DOUBLE) / 1000 AS xmin, CAST(y AS DOUBLE) / 1000 AS ymin,
  CAST(least(1000, x + w) AS DOUBLE) / 1000 AS xmax, CAST(least(1000, y + h) AS DOUBLE) / 1000 AS ymax,
  CAST(50 + (p + 7 * k + run * 13) % 50 AS DOUBLE) / 100 AS confidence
FROM (
  SELECT image_id, run, k, p, CASE WHEN run = 2 AND p % 47 = 0 THEN 'NO' ELSE lab END AS label,
    (p * 7 + k * 131) % 700 + run * ((p + k * 5 + run * 37) % 13) AS x,
    (p * 11 + k * 71) % 700 + run * ((p + k * 3 + run * 41) % 11) AS y,
    80 + (p * 13) % 220 AS w, 80 + (p * 17) % 220 AS h
  FROM ({ITEMS}) base CROSS JOIN (VALUES (0), (1), (2)) runs(run)
  WHERE (p + k + run * 3) % 29 <> 0)"""

_CLEAN = """CAST((p * 7 + k * 131) % 700 AS DOUBLE) / 1000 AS xmin, CAST((p * 11 + k * 71) % 700 AS DOUBLE) / 1000 AS ymin,
  CAST((p * 7 + k * 131) % 700 + 80 + (p * 13) % 220 AS DOUBLE) / 1000 AS xmax,
  CAST((p * 11 + k * 71) % 700 + 80 + (p * 17) % 220 AS DOUBLE) / 1000 AS ymax"""

HIGH = f"""SELECT image_id, k AS item_ix, lab AS label, {_CLEAN}, CAST(80 + (p + k) % 20 AS DOUBLE) / 100 AS confidence
FROM ({ITEMS})"""

_CLASS = "CASE {0} WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END AS class_id"

TRUTH = f"""SELECT image_id, k AS item_ix, {_CLASS.format('lab')}, {_CLEAN} FROM ({ITEMS}) WHERE (p + k) % 23 <> 0"""

PREDICTED = f"""SELECT image_id, item_ix, {_CLASS.format('label')}, xmin, ymin, xmax, ymax FROM ({DRAFTS}) WHERE run = 2"""

# Boxes of the made-up answers; b counts the items of an order.
_LABEL = "CASE (k + b) % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'car' WHEN 2 THEN 'dog' ELSE 'tree' END"
_W, _H = "80 + (c * 13 + b * 17) % 220", "80 + (k * 17 + b * 29) % 220"

MADE = f"""SELECT k, b, run, label, x, y, least(1000, x + w) AS x2, least(1000, y + h) AS y2, conf
FROM (
  SELECT o_orderkey AS k, o_custkey AS c, b, run,
    CASE WHEN run = 2 AND (c + b) % 7 = 0 THEN 'cat' ELSE {_LABEL} END AS label,
    (c * 7 + b * 131 + k) % 700 + run * ((c + b * 5 + run * 37) % 13) AS x,
    (c * 11 + b * 71 + k * 3) % 700 + run * ((c + b * 3 + run * 41) % 11) AS y,
    {_W} AS w, {_H} AS h, 50 + (c + 7 * b + run * 13) % 50 AS conf
  FROM orders CROSS JOIN range(6) bs(b) CROSS JOIN (VALUES (0), (1), (2)) runs(run)
  WHERE b < o_orderkey % 6 AND (c + b + run * 3) % 29 <> 0)"""

_UNIT3 = "CASE WHEN k % 8 = 3 AND {0} <= 1 THEN CAST({0} AS DOUBLE) ELSE CAST({0} AS DOUBLE) / 1000 END"

ANSWERED = f"""SELECT image_id, run, row_number() OVER (PARTITION BY image_id, run ORDER BY b) - 1 AS item_ix, label,
  xmin, ymin, xmax, ymax, confidence
FROM (
  SELECT k AS image_id, run, b, label, {_UNIT3.format('x')} AS xmin, {_UNIT3.format('y')} AS ymin,
    {_UNIT3.format('x2')} AS xmax, {_UNIT3.format('y2')} AS ymax,
    CASE WHEN k % 8 = 5 THEN 1.0::DOUBLE ELSE CAST(conf AS DOUBLE) / 100 END AS confidence
  FROM ({MADE}) WHERE k % 8 < 6)
WHERE xmin < xmax AND ymin < ymax"""

FULL_BOXES = f"""SELECT k AS image_id, b AS item_ix, label, CAST(x AS DOUBLE) / 1000 AS xmin, CAST(y AS DOUBLE) / 1000 AS ymin,
  CAST(least(1000, x + w) AS DOUBLE) / 1000 AS xmax, CAST(least(1000, y + h) AS DOUBLE) / 1000 AS ymax, confidence, high_confidence
FROM (
  SELECT o_orderkey AS k, o_custkey AS c, b, {_LABEL} AS label, (c * 7 + b * 131 + k) % 700 AS x,
    (c * 11 + b * 71 + k * 3) % 700 AS y, {_W} AS w, {_H} AS h,
    CAST(50 + (c + 7 * b) % 50 AS DOUBLE) / 100 AS confidence, CAST(80 + (c + b) % 20 AS DOUBLE) / 100 AS high_confidence
  FROM orders CROSS JOIN range(6) bs(b) WHERE b < o_orderkey % 6)"""

# Facts of the full answers, one row per order.
FULL = """SELECT o_orderkey AS image_id, o_orderkey AS k, o_custkey AS c, o_orderpriority AS priority, o_orderstatus AS order_status,
  (o_custkey * 7 + o_orderkey) % 700 AS sx, (o_custkey * 11 + o_orderkey * 3) % 700 AS sy,
  80 + (o_custkey * 13) % 220 AS sw, 80 + (o_orderkey * 17) % 220 AS sh
FROM orders"""

KEYPOINTS = """SELECT o_orderkey AS image_id, q, concat('kp', CAST(q AS VARCHAR)) AS name,
  CAST((o_orderkey * 31 + q * 97) % 1000 AS DOUBLE) / 1000 AS x, CAST((o_orderkey * 43 + q * 89) % 1000 AS DOUBLE) / 1000 AS y,
  (o_orderkey + q) % 4 <> 0 AS visible, CAST(50 + (o_orderkey + q) % 50 AS DOUBLE) / 100 AS confidence
FROM orders CROSS JOIN range(3) qs(q) WHERE o_orderkey % 3 = 0"""

FULL_CONFIDENCES = f"""SELECT image_id, CAST(k % 100 AS DOUBLE) / 100 AS confidence FROM ({FULL})
UNION ALL SELECT image_id, confidence FROM ({FULL_BOXES})
UNION ALL SELECT image_id, CAST(c % 100 AS DOUBLE) / 100 FROM ({FULL}) WHERE k % 2 = 1
UNION ALL SELECT image_id, 0.75::DOUBLE FROM ({FULL}) WHERE k % 3 = 0
UNION ALL SELECT image_id, confidence FROM ({KEYPOINTS})
UNION ALL SELECT image_id, 0.5::DOUBLE FROM ({FULL}) WHERE k % 4 = 0
UNION ALL SELECT image_id, 0.25::DOUBLE FROM ({FULL}) WHERE k % 5 = 0"""


def _pixel(value: str, size: str) -> str:
    return f"greatest(0, least({size}, CAST(round_even({value} * {size}, 0) AS INT)))"


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_BOX6 = _round("xmin", "ymin", "xmax", "ymax")

# --- greedy matching as a recursion over the left boxes ------------------------------------------------


def _greedy(left: str, right: str, pairs: str, label: str, threshold: float = 0.5) -> str:
    """CTEs up to ``g``: per group (image_id, i, j) the boxes x and y, the step s, matches m with IoUs v."""
    inter = (
        "(greatest(0, least(x[s].c, y[q].c) - greatest(x[s].a, y[q].a))"
        " * greatest(0, least(x[s].d, y[q].d) - greatest(x[s].b, y[q].b)))"
    )
    areas = "((x[s].c - x[s].a) * (x[s].d - x[s].b) + (y[q].c - y[q].a) * (y[q].d - y[q].b) - " + inter + ")"
    bag = "list({'label': " + label + ", 'ix': item_ix, 'a': xmin, 'b': ymin, 'c': xmax, 'd': ymax} ORDER BY item_ix) AS bx"
    return f"""lb AS (SELECT image_id, run, {bag} FROM ({left}) GROUP BY ALL),
rb AS (SELECT image_id, run, {bag} FROM ({right}) GROUP BY ALL),
pp AS ({pairs}),
g AS (
  SELECT image_id, i, j, x, y, 1 AS s, []::BIGINT[] AS m, []::BIGINT[] AS l, []::DOUBLE[] AS v FROM pp
  UNION ALL
  SELECT image_id, i, j, x, y, s + 1, CASE WHEN hit THEN list_append(m, -best.nq) ELSE m END,
    CASE WHEN hit THEN list_append(l, s) ELSE l END, CASE WHEN hit THEN list_append(v, best.v) ELSE v END
  FROM (SELECT *, best.v >= {threshold} AS hit FROM (
    SELECT *, list_max(list_transform(range(1, len(y) + 1), lambda q: {{'v': CASE
      WHEN list_contains(m, q) OR x[s].label <> y[q].label THEN 0.0::DOUBLE ELSE {inter} / {areas} END, 'nq': -q}})) AS best
    FROM g WHERE s <= len(x) AND len(y) > 0))),
done AS (SELECT * FROM g WHERE s = len(x) + 1 OR len(y) = 0)"""


_ALL_PAIRS = """SELECT im.image_id, i, j, coalesce(b1.bx, []) AS x, coalesce(b2.bx, []) AS y
FROM ({images}) im CROSS JOIN (VALUES (0, 1), (0, 2), (1, 2)) v(i, j)
LEFT JOIN lb b1 ON b1.image_id = im.image_id AND b1.run = i LEFT JOIN rb b2 ON b2.image_id = im.image_id AND b2.run = j"""

_SCORE = """CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0
  ELSE coalesce(list_sum(v), 0.0) / greatest(len(x), len(y)) END"""

_ORDERS = "SELECT o_orderkey AS image_id FROM orders"


def _scores(boxes: str, images: str) -> str:
    ctes = _greedy(boxes, boxes, _ALL_PAIRS.format(images=images), "label")
    return f"WITH RECURSIVE {ctes}, scored AS (SELECT image_id, i, j, len(x) AS n_i, len(y) AS n_j, {_SCORE} AS score FROM done)"


def _consistency(boxes: str, images: str) -> str:
    return f"{_scores(boxes, images)} SELECT image_id, round(avg(score), 6) AS consistency FROM scored GROUP BY image_id"


_DETECTION_PAIRS = """SELECT lb.image_id, 0 AS i, 1 AS j, lb.bx AS x, coalesce(rb.bx, []) AS y
FROM lb LEFT JOIN rb ON rb.image_id = lb.image_id"""

_MATCHED = (
    "WITH RECURSIVE "
    + _greedy(
        f"SELECT *, 0 AS run FROM ({PREDICTED})", f"SELECT *, 0 AS run FROM ({TRUTH})", _DETECTION_PAIRS, "class_id"
    )
    + """, matched AS (SELECT image_id, x[li].ix AS left_ix, y[ri].ix AS right_ix, x[li].label AS class_id, iou
  FROM (SELECT image_id, x, y, unnest(l) AS li, unnest(m) AS ri, unnest(v) AS iou FROM done))"""
)


def _evaluation(by: str = "", all_images: bool = False) -> str:
    seen = "" if all_images else f"WHERE image_id IN (SELECT image_id FROM ({PREDICTED}))"
    select = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{_MATCHED}, rows AS (
  SELECT class_id, 1 AS p, 0 AS t, 0 AS tp, 0.0::DOUBLE AS iou FROM ({PREDICTED})
  UNION ALL SELECT class_id, 0, 1, 0, 0.0::DOUBLE FROM ({TRUTH}) {seen}
  UNION ALL SELECT class_id, 0, 0, 1, iou FROM matched),
totals AS (SELECT {select}sum(tp)::BIGINT AS tp, (sum(p) - sum(tp))::BIGINT AS fp, (sum(t) - sum(tp))::BIGINT AS fn, sum(iou) AS s
  FROM rows {group})
SELECT {select}tp AS true_positive, fp AS false_positive, fn AS false_negative,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(s / nullif(tp, 0), 0.0), 6) AS mean_iou FROM totals"""


# --- Jaccard -------------------------------------------------------------------------------------------


def _jaccard(values: str, pairs: str) -> str:
    return f"""WITH vals AS ({values}),
bags AS (SELECT image_id, run, list_distinct(list(value)) AS bag FROM vals GROUP BY ALL),
pp AS (SELECT im.image_id, coalesce(b1.bag, []) AS x, coalesce(b2.bag, []) AS y
  FROM (SELECT DISTINCT image_id FROM vals) im CROSS JOIN (VALUES {pairs}) v(i, j)
  LEFT JOIN bags b1 ON b1.image_id = im.image_id AND b1.run = i LEFT JOIN bags b2 ON b2.image_id = im.image_id AND b2.run = j)
SELECT image_id, round(avg(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0
  ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END), 6) AS consistency
FROM pp GROUP BY image_id"""


# --- class ids -----------------------------------------------------------------------------------------

_DRAFT_FIRST = f"""SELECT label, min((image_name, item_ix)) AS first_seen, count(*) AS n
FROM (SELECT * FROM ({DRAFTS}) WHERE run = 0) d JOIN ({IMAGES}) im USING (image_id) GROUP BY label"""
_DRAFT_CLASSES = f"SELECT label, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INT) AS class_id FROM ({_DRAFT_FIRST})"

_SEGMENTS = f"""SELECT image_id, k, c, CAST(sx AS DOUBLE) / 1000 AS x, CAST(sy AS DOUBLE) / 1000 AS y,
  CAST(sx + sw AS DOUBLE) / 1000 AS x2, CAST(sy + sh AS DOUBLE) / 1000 AS y2, CAST(2 * sx + sw AS DOUBLE) / 1000 / 2 AS mid
FROM ({FULL})"""


def _full_classes(segments: bool) -> str:
    rows = f"SELECT image_id, 0 AS kind_ix, item_ix, label FROM ({FULL_BOXES})"
    if segments:
        rows += f" UNION ALL SELECT image_id, 1, 0, 'region' FROM ({FULL}) WHERE k % 2 = 1"
    return f"""SELECT label, CAST(row_number() OVER (ORDER BY min((image_name, kind_ix, item_ix))) - 1 AS INT) AS class_id
FROM ({rows}) JOIN ({IMAGES}) USING (image_id) GROUP BY label"""


_SIZED_BOXES = f"""SELECT b.*, image_name, image_width, image_height, {_pixel('xmin', 'image_width')} AS px1,
  {_pixel('ymin', 'image_height')} AS py1, {_pixel('xmax', 'image_width')} AS px2, {_pixel('ymax', 'image_height')} AS py2
FROM ({FULL_BOXES}) b JOIN ({IMAGES}) USING (image_id)"""

_NUMBERED = f"SELECT image_id, row_number() OVER (ORDER BY image_name) AS id, image_name, image_width, image_height FROM ({IMAGES})"

_STEM = "regexp_replace(image_name, '\\.[^.]*$', '')"
_YOLO = """printf('%d %.6f %.6f %.6f %.6f', class_id, (xmin + xmax) / 2, (ymin + ymax) / 2, xmax - xmin, ymax - ymin)"""


def _spixel(value: str, size: str) -> str:
    return f"CAST(round_even({value} * {size}, 0) AS INT)"


_W_, _H_ = "image_width", "image_height"
_POLY = {
    "ax": _spixel("x", _W_),
    "ay": _spixel("y", _H_),
    "ex": _spixel("x2", _W_),
    "ey": _spixel("y2", _H_),
    "mx": _spixel("mid", _W_),
}

_ANNOTATIONS = f"""WITH n AS ({_NUMBERED}), classes AS ({_full_classes(True)}),
rows AS (
  SELECT n.id AS image_id, 0 AS kind_ix, item_ix, label, px1 AS rx, py1 AS ry, greatest(0, px2 - px1) AS bw,
    greatest(0, py2 - py1) AS bh, '' AS polygon, confidence AS score
  FROM ({_SIZED_BOXES}) b JOIN n USING (image_id)
  UNION ALL
  SELECT id, 1, 0, 'region', ax, ay, ex - ax, ey - ay,
    concat_ws(',', ax, ay, ex, ay, ex, ey, mx, ey), CAST(c % 100 AS DOUBLE) / 100
  FROM (SELECT n.id, s.k, s.c, {', '.join(f'{e} AS {n}' for n, e in _POLY.items())}
    FROM ({_SEGMENTS}) s JOIN n USING (image_id)) WHERE k % 2 = 1)
SELECT row_number() OVER (ORDER BY image_id, kind_ix, item_ix) AS id, image_id, class_id + 1 AS category_id,
  rx AS bbox_x, ry AS bbox_y, bw AS bbox_w, bh AS bbox_h, bw * bh AS area, 0 AS iscrowd, polygon, round(score, 6) AS score
FROM rows JOIN classes USING (label)"""

_VOC_OBJECT = """concat('  <object>\n    <name>', label, '</name>\n    <pose>Unspecified</pose>\n    <truncated>0</truncated>\n',
  '    <difficult>0</difficult>\n    <confidence>', printf('%.6f', confidence), '</confidence>\n    <bndbox>\n      <xmin>', px1,
  '</xmin>\n      <ymin>', py1, '</ymin>\n      <xmax>', px2, '</xmax>\n      <ymax>', py2, '</ymax>\n    </bndbox>\n  </object>\n')"""

_VOC = f"""WITH objects AS (SELECT image_id, string_agg({_VOC_OBJECT}, '' ORDER BY item_ix) AS body FROM ({_SIZED_BOXES}) GROUP BY image_id)
SELECT concat({_STEM}, '.xml') AS file_name,
  concat('<?xml version=''1.0'' encoding=''utf-8''?>\n<annotation>\n  <folder>images</folder>\n  <filename>', image_name,
    '</filename>\n  <path>/data/images/', image_name, '</path>\n  <source>\n    <database>Unknown</database>\n  </source>\n',
    '  <size>\n    <width>', image_width, '</width>\n    <height>', image_height,
    '</height>\n    <depth>3</depth>\n  </size>\n  <segmented>0</segmented>\n', coalesce(body, ''), '</annotation>') AS content
FROM ({IMAGES}) LEFT JOIN objects USING (image_id)"""

_MODEL = "CASE WHEN image_id % 3 = 0 THEN 'pro-vision' ELSE 'mini-vision' END"
_FULL_MEAN = f"SELECT image_id, avg(confidence) AS mean_confidence FROM ({FULL_CONFIDENCES}) GROUP BY image_id"

_CUSTOM = f"""WITH labels AS (SELECT image_id, count(*) AS n, string_agg(concat('"', label, '"'), ',' ORDER BY item_ix) AS body
  FROM ({FULL_BOXES}) GROUP BY image_id)
SELECT concat({_STEM}, '.json') AS file_name,
  concat('{{"image": "', image_name, '", "size": [', image_width, ', ', image_height, '], "model": "', {_MODEL},
    '", "n": ', coalesce(n, 0), ', "labels": [', coalesce(body, ''), '], "consistency": ',
    CAST(CAST(image_id % 101 AS DOUBLE) / 100 AS VARCHAR), '}}') AS content
FROM ({IMAGES}) LEFT JOIN labels USING (image_id)"""

_RECORDS = f"""WITH first AS (SELECT * FROM ({_SIZED_BOXES}) WHERE item_ix = 0)
SELECT f.image_id, im.image_name, CAST(im.image_width AS BIGINT) AS image_width, 'all' AS task_type,
  CASE WHEN f.image_id % 3 = 0 THEN 'pro-vision' ELSE 'mini-vision' END AS source_model,
  round(CAST(f.image_id % 101 AS DOUBLE) / 100, 6) AS consistency_score, round(mean_confidence, 6) AS mean_confidence,
  priority AS class_label, b.label AS box_label, CASE WHEN b.label IS NOT NULL THEN 0::BIGINT END AS box_class_id,
  round(b.xmin, 6) AS box_xmin, CAST(py2 AS BIGINT) AS box_pixel_ymax, round((b.xmin + b.xmax) / 2, 6) AS box_x_center,
  CASE WHEN b.label IS NOT NULL THEN 1::BIGINT END AS box_category, CAST(px2 - px1 AS BIGINT) AS box_coco_width,
  CAST((px2 - px1) * (py2 - py1) AS BIGINT) AS box_area,
  CASE WHEN f.k % 2 = 1 THEN CAST(round_even(s.x2 * im.image_width, 0) AS BIGINT) END AS polygon_x,
  CASE WHEN f.k % 2 = 1 THEN round(s.mid, 6) END AS polygon_mid,
  CASE WHEN f.k % 3 = 0 THEN 'person' END AS pose_label,
  CASE WHEN f.k % 3 = 0 THEN CASE WHEN (f.k + 1) % 4 <> 0 THEN 'true' ELSE 'false' END END AS keypoint_visible,
  CASE WHEN f.k % 4 = 0 THEN concat(order_status, '-', priority) END AS read_text,
  CASE WHEN f.k % 4 = 0 THEN CAST(greatest(0, {_pixel('s.x2', 'im.image_width')} - {_pixel('s.x', 'im.image_width')}) AS BIGINT) END AS text_pixel_width,
  CASE WHEN f.k % 5 = 0 THEN CAST(f.c + 1 AS VARCHAR) END AS track_id, CASE WHEN f.k % 5 = 0 THEN f.k % 50 END AS frame_id
FROM ({FULL}) f JOIN ({IMAGES}) im USING (image_id) JOIN ({_SEGMENTS}) s USING (image_id)
JOIN ({_FULL_MEAN}) m USING (image_id) LEFT JOIN first b ON b.image_id = f.image_id"""

_RADIUS = "greatest(3, CAST(floor(image_height * 0.005) AS INT))"


def _rectangle(layer: int, colour: str, caption: str) -> str:
    return f"""SELECT image_id, {layer} AS layer, 0 AS item_ix, 0 AS part_ix, 'rectangle' AS shape, '{colour}' AS colour, 2 AS n_points,
  x * image_width AS x1, y * image_height AS y1, x2 * image_width AS x2, y2 * image_height AS y2, NULL AS radius,
  {caption} AS caption, x * image_width AS caption_x, y * image_height AS caption_y
FROM ({_SEGMENTS}) JOIN ({FULL}) USING (image_id, k, c) JOIN ({IMAGES}) USING (image_id)"""


_OVERLAY_ROWS = f"""SELECT image_id, 0 AS layer, item_ix, 0 AS part_ix, 'rectangle' AS shape,
  CASE WHEN image_id % 3 = 0 THEN 'red' ELSE 'green' END AS colour, 2 AS n_points, xmin * image_width AS x1,
  ymin * image_height AS y1, xmax * image_width AS x2, ymax * image_height AS y2, NULL::INT AS radius, NULL::VARCHAR AS caption,
  xmin * image_width AS caption_x, ymin * image_height AS caption_y FROM ({_SIZED_BOXES})
UNION ALL SELECT image_id, 1, 0, 0, 'polygon', 'yellow', 4, x * image_width, y * image_height, mid * image_width,
  y2 * image_height, NULL, NULL, x * image_width, y * image_height FROM ({_SEGMENTS}) JOIN ({IMAGES}) USING (image_id) WHERE k % 2 = 1
UNION ALL SELECT image_id, 2, 0, row_number() OVER (PARTITION BY image_id ORDER BY q) - 1, 'circle', 'cyan', 1, x * image_width,
  y * image_height, x * image_width, y * image_height, {_RADIUS}, name, x * image_width + {_RADIUS} + 2, y * image_height
  FROM ({KEYPOINTS}) JOIN ({IMAGES}) USING (image_id) WHERE visible
UNION ALL SELECT image_id, 2, 0, count(*), 'caption', 'cyan', 1, arg_min(x, q) * any_value(image_width),
  arg_min(y, q) * any_value(image_height), arg_min(x, q) * any_value(image_width), arg_min(y, q) * any_value(image_height),
  NULL, NULL, arg_min(x, q) * any_value(image_width), arg_min(y, q) * any_value(image_height)
  FROM ({KEYPOINTS}) JOIN ({IMAGES}) USING (image_id) WHERE visible GROUP BY image_id
UNION ALL SELECT * FROM ({_rectangle(3, 'orange', "concat(order_status, '-', priority)")}) WHERE image_id % 4 = 0
UNION ALL SELECT * FROM ({_rectangle(4, 'magenta', "concat(CAST(c + 1 AS VARCHAR), ':car')")}) WHERE image_id % 5 = 0
UNION ALL SELECT image_id, 5, 0, 0, 'banner', 'black', 2, 0, 0, image_width, greatest(30, CAST(floor(image_height * 0.04) AS INT)),
  NULL, concat('Model: ', {_MODEL}), 10.0, 5.0 FROM ({IMAGES})"""

_OVERLAY = f"""SELECT image_id, layer::INT AS layer, item_ix::INT AS item_ix, part_ix::INT AS part_ix, shape, colour,
  n_points::BIGINT AS n_points, {_round('x1', 'y1', 'x2', 'y2')}, radius::INT AS radius, caption, {_round('caption_x', 'caption_y')}
FROM ({_OVERLAY_ROWS})"""

_STREAM = f"""SELECT priority AS label FROM ({FULL}) UNION ALL SELECT label FROM ({FULL_BOXES})
UNION ALL SELECT 'region' FROM ({FULL}) WHERE k % 2 = 1 UNION ALL SELECT 'person' FROM ({FULL}) WHERE k % 3 = 0
UNION ALL SELECT 'text' FROM ({FULL}) WHERE k % 4 = 0 UNION ALL SELECT 'car' FROM ({FULL}) WHERE k % 5 = 0"""


def _distribution(labels: str) -> str:
    return f"""SELECT label, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()) * 100, 6) AS percentage
FROM ({labels}) GROUP BY label"""


# --- the cascade over the made-up answers ----------------------------------------------------------------

_RUN = f"""{_scores(ANSWERED, _ORDERS)},
per_image AS (SELECT image_id, avg(score) AS c FROM scored GROUP BY image_id),
draft AS (SELECT image_id, avg(confidence) AS m, count(*) AS n, sum(xmin + ymax) AS s FROM ({ANSWERED}) WHERE run = 0 GROUP BY image_id),
high AS (SELECT image_id, avg(high_confidence) AS m, count(*) AS n, sum(xmin + ymax) AS s FROM ({FULL_BOXES}) GROUP BY image_id),
final AS (SELECT p.image_id, CASE WHEN c < 0.75 THEN 'Escalated' ELSE 'Consistent' END AS status,
  CASE WHEN c < 0.75 THEN 'pro-vision' ELSE 'mini-vision' END AS source_model, round(c, 6) AS consistency_score,
  round(coalesce(CASE WHEN c < 0.75 THEN high.m ELSE draft.m END, 0.0), 6) AS mean_confidence,
  round(1.0 - (c + coalesce(draft.m, 0.0)) / 2, 6) AS uncertainty_score,
  coalesce(CASE WHEN c < 0.75 THEN high.n ELSE draft.n END, 0) AS n_boxes,
  round(coalesce(CASE WHEN c < 0.75 THEN high.s ELSE draft.s END, 0.0), 6) AS box_sum,
  CASE WHEN p.image_id % 8 = 7 THEN 9 ELSE 3 END AS low_attempts, CASE WHEN c < 0.75 THEN 1 ELSE 0 END AS high_attempts,
  round((c + coalesce(draft.m, 0.0)) / 2, 6) AS reliability
  FROM per_image p LEFT JOIN draft USING (image_id) LEFT JOIN high USING (image_id))"""

_PATHS = f"""'{{"yolo":"/data/labeled/' || {_STEM} || '.txt"}}'"""

_FAILS = "CASE WHEN (image_id + run) % 20 = 0 THEN 3 WHEN (image_id + run) % 10 = 0 THEN 2 WHEN (image_id + run) % 5 = 0 THEN 1 ELSE 0 END"

_CALLS = f"""SELECT image_id, run, CASE WHEN bad OR fails = 3 THEN 3 ELSE fails + 1 END::BIGINT AS attempts,
  NOT bad AND fails < 3 AS ok, CASE WHEN fails = 3 THEN 'no answer in time' WHEN bad THEN 'invalid value' END AS error,
  CASE WHEN fails = 3 THEN 0 ELSE coalesce(n, 0) END AS n_boxes
FROM (SELECT image_id, run, image_id % 8 = 7 AS bad, {_FAILS} AS fails
  FROM ({_ORDERS}) CROSS JOIN (VALUES (0), (1), (2)) runs(run))
LEFT JOIN (SELECT image_id, run, count(*) AS n FROM ({ANSWERED}) GROUP BY ALL) USING (image_id, run)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The answer shape asked for, by task type, and the texts around it, written out apart from the operator.
_BOX_SHAPE = '"xmin": float, "ymin": float, "xmax": float, "ymax": float, "confidence": float}]}'
_SHAPES = {
    "classification": 'Return image classification results strictly as JSON:\n{"classifications": [{"label": "class_name", "confidence": float}]}',
    "object_detection": 'Return object detection results strictly as JSON:\n{"boxes": [{"label": "class_name", ' + _BOX_SHAPE,
    "segmentation": 'Return polygon segmentation results strictly as JSON:\n'
    '{"segments": [{"label": "class_name", "polygon": [{"x": float, "y": float}], "confidence": float}]}',
    "pose_estimation": 'Return pose estimation results strictly as JSON:\n'
    '{"poses": [{"label": "person", "confidence": float, "keypoints": [{"name": "nose", "x": float, "y": float, "visible": bool, "confidence": float}]}]}',
    "ocr": 'Return OCR/text-region results strictly as JSON:\n{"texts": [{"text": "recognized text", ' + _BOX_SHAPE,
    "tracking": 'Return tracking labels strictly as JSON:\n{"tracks": [{"track_id": "id", "frame_id": int, "label": "class_name", ' + _BOX_SHAPE,
    "all": 'Return any visible labels strictly as JSON using these keys as applicable:\n'
    '{"classifications": [], "boxes": [], "segments": [], "poses": [], "texts": [], "tracks": []}\n'
    "boxes/texts/tracks use xmin, ymin, xmax, ymax. segments use polygon points. poses use keypoints.",
}
_BEFORE_SHAPE = "You label images for training data.\n"
_AFTER_SHAPE = (
    "\nGive every coordinate as a share of the image's width or height, from 0.0 to 1.0.\nIn boxes and regions, xmin is less than xmax"
    " and ymin less than ymax.\nAnswer with the JSON object alone: no code fence, no text before or after it."
)
_ASKED = "Name and locate each object that stands out in this image. Answer in JSON."
_SCHEMA_CASE = "CASE task_type " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in _SHAPES.items())

_PARSED_POINTS = """SELECT image_id, j, q, label, confidence, CASE WHEN x <= 1 THEN x::DOUBLE ELSE x::DOUBLE / 1000 END AS x,
  CASE WHEN y <= 1 THEN y::DOUBLE ELSE y::DOUBLE / 1000 END AS y
FROM (SELECT p_partkey AS image_id, j, q, concat(p_type, ' ', CAST(j AS VARCHAR)) AS label, CAST(p_size AS DOUBLE) / 100 AS confidence,
    (p_partkey * 31 + j * 17 + q * 97) % 1000 AS x, (p_partkey * 43 + j * 19 + q * 89) % 1000 AS y
  FROM part CROSS JOIN range(3) js(j) CROSS JOIN range(5) qs(q)
  WHERE j <= p_partkey % 3 AND q < 2 + (p_partkey + j) % 4 AND (p_partkey + j) % 4 > 0)"""

_INT_UNIT = "CASE WHEN {0} <= 1 THEN {0}::DOUBLE ELSE {0}::DOUBLE / 1000 END"

ORACLES: dict[str, str] = {
    "consistency_score": _consistency(DRAFTS, _ORDERS),
    "pair_scores": f"""{_scores(DRAFTS, _ORDERS)}
SELECT image_id, i AS run_i, j AS run_j, n_i, n_j, round(score, 6) AS score FROM scored
WHERE image_id IN (SELECT image_id FROM ({DRAFTS}))""",
    "consistency_segments": _consistency(
        f"""SELECT image_id, run, item_ix, label, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
FROM (SELECT image_id, run, item_ix, label,
    CASE pt WHEN 0 THEN xmin WHEN 3 THEN (xmin + xmax) / 2 ELSE xmax END AS x, CASE WHEN pt < 2 THEN ymin ELSE ymax END AS y
  FROM ({DRAFTS}) CROSS JOIN range(4) pts(pt)) GROUP BY ALL""",
        _ORDERS,
    ),
    "consistency_classes": _jaccard(
        "SELECT user_id AS image_id, event_id % 3 AS run, concat(event_type, '_', CAST(event_id % 7 AS VARCHAR)) AS value FROM events",
        "(0, 1), (0, 2), (1, 2)",
    ),
    "consistency_texts": _jaccard(
        "SELECT conv_id AS image_id, turn % 2 AS run, text AS value FROM conversations", "(0, 1)"
    ),
    "consistency_tracks": _jaccard(
        "SELECT user_id % 20 AS image_id, event_id % 2 AS run, concat(CAST(user_id AS VARCHAR), ':', event_type) AS value FROM events",
        "(0, 1)",
    ),
    "consistency_keypoints": _jaccard(
        """SELECT vec_id % 100 AS image_id, vec_id % 2 AS run, concat('kp', CAST((vec_id + kp) % 9 AS VARCHAR)) AS value
FROM embeddings CROSS JOIN range(5) kps(kp) WHERE (vec_id + kp) % 4 <> 0""",
        "(0, 1)",
    ),
    "iou_pairs": f"""WITH d AS MATERIALIZED ({DRAFTS}), p AS (
  SELECT a.image_id, a.run AS run_i, b.run AS run_j, a.label, a.item_ix AS left_ix, b.item_ix AS right_ix,
    greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS inter,
    (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) AS areas
  FROM d a JOIN d b ON a.image_id = b.image_id AND a.label = b.label WHERE a.run < b.run)
SELECT image_id, run_i, run_j, label, left_ix, right_ix, round(inter / (areas - inter), 6) AS iou FROM p WHERE inter / (areas - inter) >= 0.5""",
    "cascade_status": f"""{_scores(DRAFTS, _ORDERS)},
per_image AS (SELECT image_id, avg(score) AS c FROM scored GROUP BY image_id),
draft AS (SELECT image_id, avg(confidence) AS m FROM ({DRAFTS}) WHERE run = 0 GROUP BY image_id),
high AS (SELECT image_id, avg(confidence) AS m FROM ({HIGH}) GROUP BY image_id)
SELECT p.image_id, CASE WHEN c < 0.75 THEN 'Escalated' ELSE 'Consistent' END AS status,
  CASE WHEN c < 0.75 THEN 'pro-vision' ELSE 'mini-vision' END AS source_model, round(c, 6) AS consistency_score,
  round(coalesce(CASE WHEN c < 0.75 THEN high.m ELSE draft.m END, 0.0), 6) AS mean_confidence,
  round(1.0 - (c + coalesce(draft.m, 0.0)) / 2, 6) AS uncertainty_score
FROM per_image p LEFT JOIN draft USING (image_id) LEFT JOIN high USING (image_id)""",
    "cascade_final": f"""{_RUN}
SELECT image_id, status, source_model, consistency_score, mean_confidence, uncertainty_score, n_boxes, box_sum FROM final""",
    "run_metrics": f"""{_RUN}
SELECT image_name AS image, status, source_model, 'mini-vision' AS low_model, 'pro-vision' AS high_model,
  'object_detection' AS task_type, n_boxes AS objects, 0::BIGINT AS classifications, n_boxes AS boxes, 0::BIGINT AS segments,
  0::BIGINT AS poses, 0::BIGINT AS texts, 0::BIGINT AS tracks, low_attempts::BIGINT AS low_api_attempts,
  high_attempts::BIGINT AS high_api_attempts, consistency_score, mean_confidence, uncertainty_score, reliability,
  low_attempts * 0.5::DOUBLE + high_attempts * 2.0::DOUBLE AS elapsed_sec,
  concat('/data/labeled/', {_STEM}, '.txt') AS label_path, {_PATHS} AS label_paths,
  concat('/data/visualized/vis_', image_name) AS visualization_path
FROM final JOIN ({IMAGES}) USING (image_id)""",
    "efficiency_report": f"""{_RUN},
t AS (SELECT count(*) AS n, sum(n_boxes)::BIGINT AS o, count_if(status = 'Escalated') AS e, sum(low_attempts)::BIGINT AS la,
  sum(high_attempts)::BIGINT AS ha, sum(low_attempts) * 0.5::DOUBLE + sum(high_attempts) * 2.0::DOUBLE AS s FROM final)
SELECT n AS n_images, 0::BIGINT AS failed, o AS total_objects, n * 45.0::DOUBLE AS manual_seconds, s AS total_seconds,
  round((n * 45.0::DOUBLE - s) / (n * 45.0::DOUBLE) * 100, 6) AS time_saved_pct, la AS low_api_attempts, ha AS high_api_attempts,
  n - e AS low_only, e AS escalated, round((n - e) / n * 100, 6) AS cost_saved_pct FROM t""",
    "answer_outcomes": f"""SELECT image_id, run, image_id % 8 <> 6 AS parse_ok, image_id % 8 <> 7 AS ok, coalesce(n, 0) AS n_boxes
FROM ({_ORDERS}) CROSS JOIN (VALUES (0), (1), (2)) runs(run)
LEFT JOIN (SELECT image_id, run, count(*) AS n FROM ({ANSWERED}) GROUP BY ALL) USING (image_id, run)""",
    "parse_boxes": f"SELECT image_id, run, item_ix, label, {_BOX6}, {_round('confidence')} FROM ({ANSWERED})",
    "parse_classifications": """SELECT event_id AS image_id, j AS item_ix,
  concat(event_type, '_', CAST((event_id + j) % 7 AS VARCHAR)) AS label,
  round(CASE WHEN (event_id * 7 + j * 13) % 100 <= 1 THEN ((event_id * 7 + j * 13) % 100)::DOUBLE
    ELSE ((event_id * 7 + j * 13) % 100)::DOUBLE / 100 END, 6) AS confidence
FROM events CROSS JOIN range(3) js(j) WHERE j <= event_id % 3""",
    "parse_segments": f"""SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY j) - 1 AS item_ix, q AS pt_ix, label,
  {_round('x', 'y', 'confidence')} FROM ({_PARSED_POINTS})""",
    "parse_poses": f"""SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY q) - 1 AS point_ix, 'person' AS label,
  round((70 + lab)::DOUBLE / 100, 6) AS pose_confidence, concat('kp', CAST(q AS VARCHAR)) AS name,
  round({_INT_UNIT.format('xi')}, 6) AS x, round({_INT_UNIT.format('yi')}, 6) AS y, (image_id + q) % 5 IN (0, 2, 4) AS visible,
  round((50 + (image_id + q) % 50)::DOUBLE / 100, 6) AS confidence
FROM (SELECT vec_id AS image_id, label AS lab, q, (vec_id * 31 + q * 97) % 1000 AS xi, (vec_id * 43 + q * 89) % 1000 AS yi
  FROM embeddings CROSS JOIN range(5) qs(q) WHERE (vec_id + q) % 6 <> 0)""",
    "parse_texts": """SELECT doc_id AS image_id, 0::BIGINT AS item_ix, text, round(CAST((doc_id * 13) % 600 AS DOUBLE) / 1000, 6) AS xmin,
  round(CAST((doc_id * 17) % 600 AS DOUBLE) / 1000, 6) AS ymin,
  round(CAST((doc_id * 13) % 600 + 50 + n_chars % 300 AS DOUBLE) / 1000, 6) AS xmax,
  round(CAST((doc_id * 17) % 600 + 40 AS DOUBLE) / 1000, 6) AS ymax, 0.6::DOUBLE AS confidence
FROM documents WHERE text <> ''""",
    "parse_tracks": f"""SELECT * FROM (SELECT event_id AS image_id, 0::BIGINT AS item_ix, CAST(user_id AS VARCHAR) AS track_id,
  event_id % 50 AS frame_id, event_type AS label, {_INT_UNIT.format('(event_id * 7 % 800)')} AS xmin,
  {_INT_UNIT.format('(event_id * 11 % 800)')} AS ymin, CAST((event_id * 7) % 800 + 100 AS DOUBLE) / 1000 AS xmax,
  CAST((event_id * 11) % 800 + 100 AS DOUBLE) / 1000 AS ymax, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence
FROM events WHERE user_id <> 0) WHERE xmin < xmax AND ymin < ymax""",
    "answer_bodies": "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents",
    "loose_answers": """SELECT image_id, k <> 2 AS parse_ok, k <> 3 AS ok, CASE k WHEN 0 THEN 'NaN, "Infinity' WHEN 1 THEN 'b' END AS label,
  CASE k WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 0.25::DOUBLE END AS xmin, CASE WHEN k < 2 THEN round(image_id % 90 / 100.0, 6)::DOUBLE END AS ymin,
  CASE k WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS xmax, CASE WHEN k < 2 THEN 1::DOUBLE END AS ymax,
  CASE WHEN k < 2 THEN 1::DOUBLE END AS confidence
FROM (SELECT o_orderkey AS image_id, o_orderkey % 4 AS k FROM orders)""",
    "six_decimals": """SELECT image_id, printf('%.6f', h) AS half, printf('%.6f', h * (1 + pow(2::DOUBLE, -52))) AS above,
  printf('%.6f', h * (1 - pow(2::DOUBLE, -53))) AS below, printf('%.6f', h * 3 - 1) AS far
FROM (SELECT o_orderkey AS image_id, ((o_orderkey % 1000000)::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS h FROM orders)""",
    "scaled_numbers": """SELECT event_id, round(greatest(0, least(1, CASE WHEN value > 1 THEN value / 1000 ELSE value END)), 6) AS coordinate,
  round(greatest(0, least(1, CASE WHEN value > 1 THEN value / 100 ELSE value END)), 6) AS confidence,
  round(greatest(0, least(1, CASE WHEN value / 100 > 1 THEN value / 100 / 1000 ELSE value / 100 END)), 8) AS unit_coordinate
FROM events""",
    "pixel_boxes": f"""SELECT image_id, item_ix, px1 AS px_xmin, py1 AS px_ymin, px2 AS px_xmax, py2 AS px_ymax,
  greatest(0, px2 - px1) AS px_width, greatest(0, py2 - py1) AS px_height
FROM (SELECT image_id, item_ix, {_pixel('xmin', 'image_width')} AS px1, {_pixel('ymin', 'image_height')} AS py1,
    {_pixel('xmax', 'image_width')} AS px2, {_pixel('ymax', 'image_height')} AS py2
  FROM (SELECT * FROM ({DRAFTS}) WHERE run = 0) JOIN ({IMAGES}) USING (image_id))""",
    "center_boxes": f"""SELECT image_id, item_ix, round((xmin + xmax) / 2, 6) AS x_center, round((ymin + ymax) / 2, 6) AS y_center,
  round(xmax - xmin, 6) AS width, round(ymax - ymin, 6) AS height FROM ({DRAFTS}) WHERE run = 0""",
    "segment_boxes": f"""SELECT image_id, run, item_ix, label, {_BOX6}, {_round('confidence')} FROM ({DRAFTS})""",
    "class_ids": _DRAFT_CLASSES,
    "yolo_lines": f"""SELECT image_id, item_ix, class_id, {_YOLO} AS line
FROM (SELECT * FROM ({DRAFTS}) WHERE run = 0) JOIN ({_DRAFT_CLASSES}) USING (label)""",
    "yolo_round_trip": f"""SELECT image_id, item_ix, class_id, {_BOX6} FROM ({TRUTH})
WHERE (image_id + item_ix) % 17 <> 0 AND (image_id + item_ix) % 19 <> 0""",
    "broken_label_lines": f"""SELECT image_id, item_ix, '0 0.5 nought 0.1 0.1' AS line FROM ({TRUTH})
WHERE (image_id + item_ix) % 19 = 0""",
    "coco_images": f"SELECT id, image_name AS file_name, image_width AS width, image_height AS height FROM ({_NUMBERED})",
    "coco_annotations": _ANNOTATIONS,
    "coco_categories": f"SELECT class_id + 1 AS id, label AS name, 'object' AS supercategory FROM ({_full_classes(True)})",
    "yolo_documents": f"""WITH lines AS (SELECT image_id, string_agg({_YOLO} || chr(10), '' ORDER BY item_ix) AS body
  FROM ({FULL_BOXES}) JOIN ({_full_classes(False)}) USING (label) GROUP BY image_id)
SELECT concat({_STEM}, '.txt') AS file_name, coalesce(body, '') AS content FROM ({IMAGES}) LEFT JOIN lines USING (image_id)""",
    "voc_documents": _VOC,
    "custom_documents": _CUSTOM,
    "vision_records": _RECORDS,
    "overlay_primitives": _OVERLAY,
    "kind_counts": """SELECT image_id, 1::BIGINT AS classifications, b AS boxes, s AS segments, p AS poses, t AS texts, r AS tracks,
  1 + b + s + p + t + r AS objects
FROM (SELECT o_orderkey AS image_id, o_orderkey % 6 AS b, (o_orderkey % 2 = 1)::BIGINT AS s, (o_orderkey % 3 = 0)::BIGINT AS p,
  (o_orderkey % 4 = 0)::BIGINT AS t, (o_orderkey % 5 = 0)::BIGINT AS r FROM orders)""",
    "mean_confidences": f"SELECT image_id, round(mean_confidence, 6) AS mean_confidence FROM ({_FULL_MEAN})",
    "label_bags": f"""SELECT image_id, priority AS value FROM ({FULL}) UNION ALL SELECT image_id, label FROM ({FULL_BOXES})
UNION ALL SELECT image_id, 'region' FROM ({FULL}) WHERE k % 2 = 1 UNION ALL SELECT image_id, 'person' FROM ({FULL}) WHERE k % 3 = 0
UNION ALL SELECT image_id, concat(order_status, '-', priority) FROM ({FULL}) WHERE k % 4 = 0
UNION ALL SELECT image_id, concat(CAST(c + 1 AS VARCHAR), ':car') FROM ({FULL}) WHERE k % 5 = 0
UNION ALL SELECT image_id, name FROM ({KEYPOINTS}) WHERE visible""",
    "label_paths": f"""SELECT image_id, concat('{{"yolo":"/data/labeled/', s, '.txt","pascal_voc":"/data/labeled/', s,
  '.xml","coco":"/data/labeled/coco_annotations.json","vision_json":"/data/labeled/vision_annotations.jsonl","custom":"/data/labeled/',
  s, '.json"}}') AS paths, concat('/data/labeled/', s, '.txt') AS label_path, concat('/data/labeled/', s, '.xml') AS label_path_without_yolo
FROM (SELECT image_id, {_STEM} AS s FROM ({IMAGES}))""",
    "detection_eval": _evaluation(),
    "detection_eval_all_images": _evaluation(all_images=True),
    "detection_eval_by_class": _evaluation("class_id"),
    "folder_evaluation": _evaluation(),
    "detection_matches": f"{_MATCHED} SELECT image_id, left_ix, right_ix, round(iou, 6) AS iou FROM matched",
    "missed_truth": f"""{_MATCHED} SELECT t.image_id, t.item_ix, t.class_id, {_BOX6} FROM ({TRUTH}) t
WHERE image_id IN (SELECT image_id FROM ({PREDICTED}))
  AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = t.image_id AND m.right_ix = t.item_ix)""",
    "class_distribution": _distribution(_STREAM),
    "language_distribution": _distribution("SELECT lang AS label FROM documents"),
    "event_distribution": _distribution("SELECT event_type AS label FROM events"),
    "imbalance_report": f"""WITH d AS ({_DRAFT_FIRST}), e AS (SELECT count(*) AS n_classes,
  (SELECT label FROM d ORDER BY n DESC, first_seen LIMIT 1) AS max_label, (SELECT label FROM d ORDER BY n, first_seen LIMIT 1) AS min_label,
  max(n) AS max_n, min(n) AS min_n FROM d)
SELECT *, round(max_n / min_n, 6) AS ratio, n_classes > 1 AND max_n / min_n > 3 AS imbalanced,
  CASE WHEN n_classes > 1 AND max_n / min_n > 3 THEN concat('Uneven classes: far more labels of ''', max_label,
    ''' than of ''', min_label, '''; gather or augment examples of the rarer ones.') END AS suggestion FROM e""",
    "class_report": f"""SELECT CAST(row_number() OVER (ORDER BY first_seen) AS INT) AS line_no,
  printf('- %s: %d (%.1f%%)', label, n, n / (sum(n) OVER ()) * 100) AS line FROM ({_DRAFT_FIRST})""",
    "inference_drafts": _CALLS,
    "error_quarantine": f"SELECT image_id, run, error, 0::BIGINT AS n_boxes FROM ({_CALLS}) WHERE NOT ok",
    "api_attempts": f"""SELECT 'low' AS tier, sum(attempts)::BIGINT AS api_attempts, count_if(ok) AS successful_predictions,
  count_if(NOT ok) AS failed_predictions FROM ({_CALLS})""",
    "image_sizes": f"""SELECT image_id, CASE WHEN image_id % 5 < 4 THEN image_width END AS image_width,
  CASE WHEN image_id % 5 < 4 THEN image_height END AS image_height FROM ({IMAGES})""",
    "unreadable_images": f"SELECT image_id, image_name, 'unreadable image' AS error FROM ({IMAGES}) WHERE image_id % 11 = 0",
    "inference_resume": f"""SELECT image_id, 'low' AS tier, run FROM ({_ORDERS}) CROSS JOIN (VALUES (0), (1), (2)) runs(run)
WHERE (image_id + run) % 4 = 0""",
    "resumed_run": f"""SELECT image_id, run, CASE WHEN kept THEN attempts ELSE 1 END::BIGINT AS attempts, true AS ok,
  CASE WHEN kept THEN n_boxes ELSE 0 END::BIGINT AS n_boxes, NOT kept AS asked_again
FROM (SELECT *, ok AND (image_id + run) % 4 <> 0 AS kept FROM ({_CALLS}))""",
    "changed_prompt": f"""SELECT image_id, run, prompt, CASE prompt WHEN 'first' THEN attempts ELSE 1 END::BIGINT AS attempts,
  CASE prompt WHEN 'first' THEN n_boxes ELSE 0 END::BIGINT AS n_boxes
FROM ({_CALLS}) CROSS JOIN (VALUES ('first'), ('second')) p(prompt) WHERE ok OR prompt = 'second'""",
    "prompt_rows": f"""SELECT image_id, task_type, concat({_quoted(_BEFORE_SHAPE)}, {_SCHEMA_CASE}
  ELSE {_quoted(_SHAPES["object_detection"])} END, {_quoted(_AFTER_SHAPE)}) AS system_message, {_quoted(_ASKED)} AS prompt,
  CASE WHEN image_id % 3 = 2 THEN 'image/png' ELSE 'image/jpeg' END AS media_type
FROM (SELECT image_id, CASE image_id % 8 WHEN 0 THEN 'classification' WHEN 1 THEN 'object_detection' WHEN 2 THEN 'segmentation'
  WHEN 3 THEN 'pose_estimation' WHEN 4 THEN 'ocr' WHEN 5 THEN 'tracking' WHEN 6 THEN 'all' ELSE 'other' END AS task_type
  FROM ({IMAGES}))""",
    "file_names": """SELECT page_id, file_name, regexp_replace(file_name, '([^.])\\.[^.]*$', '\\1') AS stem,
  CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS media_type,
  page_id % 4 IN (0, 2) AS is_image, base64(encode(html)) AS content_base64
FROM (SELECT *, concat(string_split(url, '/')[-1], CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.webp' WHEN 2 THEN '.jpeg' ELSE '' END)
  AS file_name FROM pages)""",
}
