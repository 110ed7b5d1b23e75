"""Label tables and model answers derived row by row from the driver's tables.

The same arithmetic stands in SQL in ``oracles``. All numbers are integers until
the last step, so both engines get the same doubles.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.operators.groups import dealt_parts
from tagloom.operators.inference import Timed
from tagloom.functions.answers import parse_answers
from tagloom.functions.labels import mean_confidence
from tagloom.functions.values import uncertainty

# The stand-in models travel to the workers by value: these need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUNS = (0, 1, 2)
LOW_MODEL = "mini-vision"
HIGH_MODEL = "pro-vision"
IMAGE_FOLDER = "/data/images"

TEMPLATE = (
    '{{"image": "{image_name}", "size": [{image_width}, {image_height}], "model": "{source_model}", '
    '"n": {object_count}, "labels": {labels_json}, "consistency": {consistency_score}}}'
)


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


IMAGE_COLUMNS = (
    "o_orderkey AS image_id",
    "concat('img_', lpad(CAST(o_orderkey AS STRING), 8, '0'),"
    " CASE o_orderkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' ELSE '.png' END) AS image_name",
    "CAST(320 + (o_orderkey * 37) % 961 AS INT) AS image_width",
    "CAST(240 + (o_orderkey * 53) % 481 AS INT) AS image_height",
)


IMAGE_NAMES = tuple(column.rsplit(" AS ", 1)[1] for column in IMAGE_COLUMNS)


def images(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*IMAGE_COLUMNS).withColumn(
        "image_path", F.concat(F.lit(f"{IMAGE_FOLDER}/"), "image_name")
    )


#: Rows of lineitem that a task numbers
ITEM_ROWS = 500_000
#: Rows of a task's share: each becomes several long texts that are parsed again
SPREAD_ROWS = 25_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """The table in at least as many partitions as there are cores, more as it grows: a file of one row group is one task.

    A table of as many partitions stays as it is.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // SPREAD_ROWS)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, key)


# --- long tables from lineitem ---------------------------------------------------------------------


def _items(t: Tables) -> DataFrame:
    """Every row of lineitem: an order's items are numbered anew, as its line numbers repeat. Ties are equal rows here."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    read = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    # by rows, not by bytes: the shuffle compresses well, and a task sorts its rows in memory
    return read.repartition(dealt_parts(read, ITEM_ROWS), "l_orderkey").select(
        F.col("l_orderkey").alias("image_id"),
        F.row_number().over(order).cast("bigint").alias("k"),
        F.col("l_partkey").alias("p"),
        F.concat("l_returnflag", "l_linestatus").alias("lab"),
    )


_CORNERS = [f"CAST({c} AS DOUBLE) / 1000 AS {n}" for n, c in (("xmin", "x"), ("ymin", "y"), ("xmax", "x2"), ("ymax", "y2"))]


def draft_boxes(t: Tables) -> DataFrame:
    """Boxes of three drafts per image, jittered and sometimes missing or relabelled."""
    return (
        _items(t)
        .withColumn("run", F.explode(F.array(*[F.lit(r) for r in RUNS])))
        .filter("(p + k + run * 3) % 29 <> 0")
        .selectExpr(
            "image_id",
            "run",
            "k",
            "p",
            "CASE WHEN run = 2 AND p % 47 = 0 THEN 'NO' ELSE lab END AS label",
            "(p * 7 + k * 131) % 700 + run * ((p + k * 5 + run * 37) % 13) AS x",
            "(p * 11 + k * 71) % 700 + run * ((p + k * 3 + run * 41) % 11) AS y",
            "80 + (p * 13) % 220 AS w",
            "80 + (p * 17) % 220 AS h",
        )
        .selectExpr("*", "least(1000, x + w) AS x2", "least(1000, y + h) AS y2")
        .selectExpr(
            "image_id",
            "run",
            "k AS item_ix",
            "label",
            *_CORNERS,
            "CAST(50 + (p + 7 * k + run * 13) % 50 AS DOUBLE) / 100 AS confidence",
        )
    )


def _clean_boxes(t: Tables) -> DataFrame:
    return _items(t).selectExpr(
        "image_id",
        "k",
        "p",
        "lab",
        "(p * 7 + k * 131) % 700 AS x",
        "(p * 11 + k * 71) % 700 AS y",
        "(p * 7 + k * 131) % 700 + 80 + (p * 13) % 220 AS x2",
        "(p * 11 + k * 71) % 700 + 80 + (p * 17) % 220 AS y2",
    )


def high_boxes(t: Tables) -> DataFrame:
    return _clean_boxes(t).selectExpr(
        "image_id", "k AS item_ix", "lab AS label", *_CORNERS, "CAST(80 + (p + k) % 20 AS DOUBLE) / 100 AS confidence"
    )


CLASS_OF = "CASE lab WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END"


def truth_boxes(t: Tables) -> DataFrame:
    return (
        _clean_boxes(t)
        .filter("(p + k) % 23 <> 0")
        .selectExpr("image_id", "k AS item_ix", f"{CLASS_OF} AS class_id", *_CORNERS)
    )


def predicted_boxes(t: Tables) -> DataFrame:
    """The third draft with class ids, to be evaluated against the truth."""
    return (
        draft_boxes(t)
        .filter("run = 2")
        .withColumnRenamed("label", "lab")
        .selectExpr("image_id", "item_ix", f"{CLASS_OF} AS class_id", "xmin", "ymin", "xmax", "ymax")
    )


def draft_segments(t: Tables) -> DataFrame:
    """Polygons of four points around the draft boxes: ..., segment."""
    corner = "named_struct('x', {}, 'y', {})"
    points = ", ".join(
        corner.format(*xy)
        for xy in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("(xmin + xmax) / 2", "ymax"))
    )
    return (
        draft_boxes(t)
        .selectExpr(
            "image_id",
            "run",
            "item_ix",
            f"named_struct('label', label, 'polygon', array({points}), 'confidence', confidence) AS segment",
        )
    )


# --- label values from events, conversations and embeddings ----------------------------------------


def class_values(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "user_id AS image_id",
        "CAST(event_id % 3 AS INT) AS run",
        "concat(event_type, '_', CAST(event_id % 7 AS STRING)) AS value",
    )


def text_values(t: Tables) -> DataFrame:
    return t.conversations.selectExpr("conv_id AS image_id", "CAST(turn % 2 AS INT) AS run", "text AS value")


def track_values(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "user_id % 20 AS image_id",
        "CAST(event_id % 2 AS INT) AS run",
        "concat(CAST(user_id AS STRING), ':', event_type) AS value",
    )


def keypoint_values(t: Tables) -> DataFrame:
    return (
        t.embeddings.select("vec_id", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("kp"))
        .filter("(vec_id + kp) % 4 <> 0")
        .selectExpr(
            "vec_id % 100 AS image_id", "CAST(vec_id % 2 AS INT) AS run", "concat('kp', CAST((vec_id + kp) % 9 AS STRING)) AS value"
        )
    )


# --- model answers, one per row of a table ----------------------------------------------------------

LABEL_OF = "CASE (k + {b}) % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'car' WHEN 2 THEN 'dog' ELSE 'tree' END"
X_OF = "(c * 7 + {b} * 131 + k) % 700"
Y_OF = "(c * 11 + {b} * 71 + k * 3) % 700"
W_OF = "80 + (c * 13 + {b} * 17) % 220"
H_OF = "80 + (k * 17 + {b} * 29) % 220"


def _member(name: str, value: str) -> str:
    """Null, which ``concat_ws`` leaves out, if the value is."""
    return f"concat('\"{name}\":', {value})"


def _box_text(b: int, members: dict[str, str]) -> str:
    return f"concat('{{', concat_ws(',', {', '.join(_member(*m) for m in members.items())}), '}}')".replace("{b}", str(b))


def _boxes_text(keep: str, label: str, x: str, y: str, conf: str, kind: str | None = None) -> str:
    """The JSON boxes b = 0..4 of a row with columns k and c, joined by commas; plain expressions, so that they are compiled.

    ``kind`` names the column with the way numbers are written: 3 as integers, 4 as texts, 5 without confidence.
    """
    unit, cent = "CAST(CAST({} AS DOUBLE) / 1000 AS STRING)", "CAST(CAST({} AS DOUBLE) / 100 AS STRING)"

    def number(value: str) -> str:
        real = unit.format(value)
        return f"CASE {kind} WHEN 3 THEN CAST({value} AS STRING) WHEN 4 THEN concat('\"', {real}, '\"') ELSE {real} END" if kind else real

    confidence = cent.format(conf)
    if kind:
        whole = f"CAST({conf} AS STRING)"
        confidence = f"CASE {kind} WHEN 3 THEN {whole} WHEN 4 THEN concat('\"', {whole}, '\"') WHEN 5 THEN NULL ELSE {confidence} END"
    members = {
        "label": f"concat('\"', {label}, '\"')",
        "xmin": number(x),
        "ymin": number(y),
        "xmax": number(f"least(1000, {x} + {W_OF})"),
        "ymax": number(f"least(1000, {y} + {H_OF})"),
        "confidence": confidence,
    }
    if kind:
        members["note"] = f"CASE {kind} WHEN 5 THEN '\"n\"' END"
    kept = [f"CASE WHEN {b} < k % 6 AND {keep.replace('{b}', str(b))} THEN {_box_text(b, members)} END" for b in range(5)]
    return f"concat_ws(',', {', '.join(kept)})"


_EMPTY_LABEL = '{"label":"","xmin":0.1,"ymin":0.1,"xmax":0.9,"ymax":0.9,"note":"n"}'
_NULL_CORNER = '{"label":"car","xmin":null,"ymin":0.1,"xmax":0.9,"ymax":0.9,"confidence":0.5}'


def _answer_text(inner: str) -> str:
    """What models do to their answers, by image_id % 8; ``inner`` holds the boxes as text."""
    plain = f"concat('{{\"boxes\":[', {inner}, ']}}')"
    more = lambda box: f"concat('{{\"boxes\":[', concat_ws(',', nullif({inner}, ''), '{box}'), ']}}')"
    return f"""CASE k % 8
  WHEN 0 THEN {plain}
  WHEN 1 THEN concat('Here are the boxes:\\n```json\\n', {plain}, '\\n```\\nAnything else?')
  WHEN 2 THEN concat('```\\n', {plain}, '\\n```')
  WHEN 3 THEN {plain}
  WHEN 4 THEN {plain}
  WHEN 5 THEN {more(_EMPTY_LABEL)}
  WHEN 6 THEN left({plain}, length({plain}) - 2)
  ELSE {more(_NULL_CORNER)}
END"""


def _draft_text(run: str) -> str:
    """Boxes of a draft as text, by columns k, c and run."""
    return _boxes_text(
        "(c + {b} + run * 3) % 29 <> 0",
        f"CASE WHEN run = 2 AND (c + {{b}}) % 7 = 0 THEN 'cat' ELSE {LABEL_OF} END",
        f"{X_OF} + run * ((c + {{b}} * 5 + run * 37) % 13)",
        f"{Y_OF} + run * ((c + {{b}} * 3 + run * 41) % 11)",
        "50 + (c + 7 * {b} + run * 13) % 50",
        "(k % 8)",
    ).replace("run", run)


# In one projection with an expression that isn't compiled, long ones become methods of their own; in whole-stage code they
# would make one method that is too long for the JVM to compile.
_UNCOMPILED = "transform(array({0}), v -> v)[0] AS {0}"


def box_answers(t: Tables) -> DataFrame:
    """Answers of three drafts per order: image_id, run, raw_text."""
    return (
        spread(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("o_orderkey AS k", "o_custkey AS c")
        .withColumn("run", F.explode(F.array(*[F.lit(r) for r in RUNS])))
        .selectExpr("k", _UNCOMPILED.format("run"), f"{_draft_text('run')} AS inner_text")
        .selectExpr("k AS image_id", "run", f"{_answer_text('inner_text')} AS raw_text")
    )


def run_images(t: Tables) -> DataFrame:
    """Images of a labelling run, with ``o_custkey``, of which :func:`with_answers` makes the texts the stand-in models give."""
    return (
        t.orders.selectExpr(*IMAGE_COLUMNS, "o_custkey")
        .withColumn("image_path", F.concat(F.lit(f"{IMAGE_FOLDER}/"), "image_name"))
    )


def with_answers(requests: DataFrame) -> DataFrame:
    """Add ``canned``, the text of a request by its tier and run; made where it is asked for, so that no shuffle carries texts."""
    strong = _boxes_text("true", LABEL_OF, X_OF, Y_OF, "80 + (c + {b}) % 20")
    made = requests.selectExpr("*", "image_id AS k", "o_custkey AS c")
    made = made.selectExpr("*", _UNCOMPILED.format("c").replace("AS c", "AS same"), f"CASE tier WHEN 'high' THEN {strong} ELSE {_draft_text('run')} END AS inner_text")
    whole = "concat('{\"boxes\":[', inner_text, ']}')"
    return made.selectExpr("*", f"CASE tier WHEN 'high' THEN {whole} ELSE {_answer_text('inner_text')} END AS canned").drop("k", "c", "same", "inner_text")


def full_answers(t: Tables) -> DataFrame:
    """One answer per order with all six kinds of labels, next to the image facts."""
    made = _boxes_text("true", LABEL_OF, X_OF, Y_OF, "50 + (c + 7 * {b}) % 50")
    unit = "CAST({} AS DOUBLE) / 1000"
    x, y = unit.format("sx"), unit.format("sy")
    x2, y2, mid = unit.format("sx + sw"), unit.format("sy + sh"), unit.format("2 * sx + sw") + " / 2"
    point = "named_struct('x', {}, 'y', {})"
    polygon = ", ".join(point.format(*xy) for xy in ((x, y), (x2, y), (x2, y2), (mid, y2)))
    keypoint = (
        "transform(sequence(0, 2), q -> named_struct('name', concat('kp', CAST(q AS STRING)),"
        " 'x', CAST((k * 31 + q * 97) % 1000 AS DOUBLE) / 1000, 'y', CAST((k * 43 + q * 89) % 1000 AS DOUBLE) / 1000,"
        " 'visible', (k + q) % 4 <> 0, 'confidence', CAST(50 + (k + q) % 50 AS DOUBLE) / 100))"
    )
    corners = f"'xmin', {x}, 'ymin', {y}, 'xmax', {x2}, 'ymax', {y2}"
    some = "CASE WHEN {} THEN array({}) ELSE array() END"
    return (
        spread(t.orders, "o_orderkey").selectExpr(
            "o_orderkey AS k",
            "o_custkey AS c",
            "o_orderpriority AS priority",
            "o_orderstatus AS order_status",
            "(o_custkey * 7 + o_orderkey) % 700 AS sx",
            "(o_custkey * 11 + o_orderkey * 3) % 700 AS sy",
            "80 + (o_custkey * 13) % 220 AS sw",
            "80 + (o_orderkey * 17) % 220 AS sh",
            *IMAGE_COLUMNS,
        )
        .selectExpr("*", f"{made} AS made")
        .selectExpr(
            *IMAGE_NAMES,
            "concat('{\"boxes\":[', made, '],', substring(to_json(named_struct("
            "'classifications', array(named_struct('label', priority, 'confidence', CAST(k % 100 AS DOUBLE) / 100)),"
            " 'segments', "
            + some.format(
                "k % 2 = 1",
                f"named_struct('label', 'region', 'polygon', array({polygon}), 'confidence', CAST(c % 100 AS DOUBLE) / 100)",
            )
            + ", 'poses', "
            + some.format("k % 3 = 0", f"named_struct('keypoints', {keypoint}, 'confidence', 0.75D)")
            + ", 'texts', "
            + some.format(
                "k % 4 = 0", f"named_struct('text', concat(order_status, '-', priority), {corners}, 'confidence', 0.5D)"
            )
            + ", 'tracks', "
            + some.format(
                "k % 5 = 0",
                f"named_struct('track_id', c + 1, 'frame_id', k % 50, 'label', 'car', {corners}, 'confidence', 0.25D)",
            )
            + ")), 2)) AS raw_text",
        )
    )


def final_labels(t: Tables) -> DataFrame:
    """The full answers as a table of final results with image facts and scores."""
    parsed = parse_answers(full_answers(t)).drop("raw_text", "parse_ok", "ok", "error")
    return (
        parsed.withColumn("image_path", F.concat(F.lit(f"{IMAGE_FOLDER}/"), "image_name"))
        .withColumn("task_type", F.lit("all"))
        .withColumn("status", F.when(F.col("image_id") % 3 == 0, "Escalated").otherwise("Consistent"))
        .withColumn("source_model", F.when(F.col("image_id") % 3 == 0, HIGH_MODEL).otherwise(LOW_MODEL))
        .withColumn("consistency_score", (F.col("image_id") % 101).cast("double") / 100)
        .withColumn("mean_confidence", mean_confidence())
        .withColumn("uncertainty_score", uncertainty(F.col("consistency_score"), F.col("mean_confidence")))
    )


def class_answers(t: Tables) -> DataFrame:
    return spread(t.events, "event_id").selectExpr(
        "event_id AS image_id",
        "to_json(named_struct('classifications', transform(filter(sequence(0, 2), j -> j <= event_id % 3), j ->"
        " named_struct('label', concat(event_type, '_', CAST((event_id + j) % 7 AS STRING)),"
        " 'confidence', (event_id * 7 + j * 13) % 100)))) AS raw_text",
    )


def segment_answers(t: Tables) -> DataFrame:
    return spread(t.part, "p_partkey").selectExpr(
        "p_partkey AS image_id",
        "to_json(named_struct('segments', transform(filter(sequence(0, 2), j -> j <= p_partkey % 3), j ->"
        " named_struct('label', concat(p_type, ' ', CAST(j AS STRING)),"
        " 'polygon', transform(filter(sequence(0, 4), q -> q < 2 + (p_partkey + j) % 4), q -> named_struct("
        " 'x', (p_partkey * 31 + j * 17 + q * 97) % 1000, 'y', (p_partkey * 43 + j * 19 + q * 89) % 1000)),"
        " 'confidence', CAST(p_size AS DOUBLE) / 100)))) AS raw_text",
    )


def pose_answers(t: Tables) -> DataFrame:
    """Keypoints with an empty name now and then, and visibility as text, number or boolean."""
    return spread(t.embeddings, "vec_id").selectExpr(
        "vec_id AS image_id",
        "concat('{\"poses\": [{\"confidence\": ', CAST(70 + label AS STRING), ', \"keypoints\": [',"
        " array_join(transform(sequence(0, 4), q -> concat('{\"name\": \"',"
        " CASE WHEN (vec_id + q) % 6 = 0 THEN '' ELSE concat('kp', CAST(q AS STRING)) END,"
        " '\", \"x\": ', CAST((vec_id * 31 + q * 97) % 1000 AS STRING), ', \"y\": ', CAST((vec_id * 43 + q * 89) % 1000 AS STRING),"
        " CASE (vec_id + q) % 5 WHEN 0 THEN ', \"visible\": \" Yes \"' WHEN 1 THEN ', \"visible\": 0'"
        " WHEN 2 THEN ', \"visible\": true' WHEN 3 THEN ', \"visible\": \"hidden\"' ELSE '' END,"
        " ', \"confidence\": ', CAST(50 + (vec_id + q) % 50 AS STRING), '}')), ', '), ']}]}') AS raw_text",
    )


def text_answers(t: Tables) -> DataFrame:
    """Whole document texts as read text regions, inside a fenced block."""
    return spread(t.documents, "doc_id").selectExpr(
        "doc_id AS image_id",
        "concat('```json\\n', to_json(named_struct('texts', array(named_struct('text', text,"
        " 'xmin', CAST((doc_id * 13) % 600 AS DOUBLE) / 1000, 'ymin', CAST((doc_id * 17) % 600 AS DOUBLE) / 1000,"
        " 'xmax', (doc_id * 13) % 600 + 50 + n_chars % 300, 'ymax', (doc_id * 17) % 600 + 40,"
        " 'confidence', 60)))), '\\n```') AS raw_text",
    )


def track_answers(t: Tables) -> DataFrame:
    return spread(t.events, "event_id").selectExpr(
        "event_id AS image_id",
        "to_json(named_struct('tracks', array(named_struct('track_id', user_id, 'frame_id', CAST(event_id % 50 AS STRING),"
        " 'label', event_type, 'xmin', (event_id * 7) % 800, 'ymin', (event_id * 11) % 800,"
        " 'xmax', (event_id * 7) % 800 + 100, 'ymax', (event_id * 11) % 800 + 100,"
        " 'confidence', CAST(event_id % 100 AS DOUBLE) / 100)))) AS raw_text",
    )


# --- stand-in models --------------------------------------------------------------------------------


def canned_model():
    """Answers each request with the text in its ``canned`` column."""

    def predict(batch):
        return list(batch["canned"])

    return predict


def timed(factory, seconds):
    """The model of ``factory``, which says of each call that it took so long."""

    def made():
        predict = factory()
        return lambda batch: [Timed(answer, seconds) for answer in predict(batch)]

    return made


def unreliable_model():
    """As the canned model, but calls fail by key: one in 5 once, one in 10 twice, one in 20 always."""

    def predict(batch):
        failures = [
            3 if key % 20 == 0 else 2 if key % 10 == 0 else 1 if key % 5 == 0 else 0
            for key in batch["image_id"] + batch["run"]
        ]
        return [
            TimeoutError("no answer in time") if attempt <= n else text
            for text, attempt, n in zip(batch["canned"], batch["attempt"], failures)
        ]

    return predict


def other_model():
    """A model that always answers, with one classification and no boxes."""
    return lambda batch: ['{"classifications": [{"label": "seen"}]}'] * len(batch)


def image_headers(t: Tables) -> DataFrame:
    """Images with the leading bytes of a PNG or JPEG of their size: plain, with other chunks before it, progressive, and cut short."""
    width, height = (lambda n, c=c: F.lpad(F.hex(F.col(c)), n, "0") for c in ("image_width", "image_height"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    size = text("0000000D49484452", width(8), height(8), "0802000000")
    other = F.repeat(F.lit("AB"), (F.col("image_id") % 3000).cast("int"))
    long_other = lambda n: F.lpad(F.hex(F.col("image_id") % 3000 + n), 4 if n else 8, "0")
    frame = text("001108", height(4), width(4), "03012200021101031101")
    jfif = "FFD8FFE000104A46494600010100000100010000"
    kinds = [
        text("89504E470D0A1A0A", size),
        text("89504E470D0A1A0A", long_other(0), "74455874", other, "00000000", size),
        text(jfif, "FFC0", frame),
        text(jfif, "FFE1", long_other(2), other, "FFFFFFC4000600112233", "FFC2", frame),
        text(jfif, "FFE1", long_other(2), other, "FFC20011"),
    ]
    return images(t).select("image_id", F.unhex(F.element_at(F.array(*kinds), (F.col("image_id") % 5 + 1).cast("int"))).alias("content"))


def loose_answers(t: Tables) -> DataFrame:
    """Answers that JSON readers take or refuse: bare numbers, repeated keys, text behind the value."""
    at = "CAST((o_orderkey % 90) / 100 AS DECIMAL(4, 2))"
    box = f'"xmin": {{0}}, "ymin": \', {at}, \', "xmax": {{1}}, "ymax": Infinity'
    kinds = [
        '{"boxes": [{"label": "NaN, \\\\"Infinity", ' + box.format("-Infinity", "NaN") + ', "confidence": NaN}]}',
        '{"boxes": [], "boxes": [{"label": "a", "label": "b", "xmin": 0.9, ' + box.format("0.25", "0.5") + "}]}",
        '{"boxes": [{"label": "c", ' + box.format("0", "1") + "}]} and more",
        '{"tracks": [{"track_id": "1", "label": "d", "frame_id": NaN}]}',
    ]
    texts = ", ".join(f"concat('{k}')" for k in kinds)
    return t.orders.selectExpr("o_orderkey AS image_id", f"element_at(array({texts}), cast(o_orderkey % 4 AS int) + 1) AS raw_text")
