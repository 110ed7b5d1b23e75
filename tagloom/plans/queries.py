"""One query per operator over the driver's tables; each takes (spark, folder) and gives a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import values as V
from tagloom.functions.answers import answer_json_text, parse_answers
from tagloom.functions.geometry import center_form, pixel_box, segment_to_box
from tagloom.functions.labels import items_of, label_bag, mean_confidence
from tagloom.operators import cascade, consistency, evaluate, ids, inference, insight, matching, metrics, overlay
from tagloom.plans import fixtures, labeling
from tagloom.plans.fixtures import HIGH_MODEL, LOW_MODEL, RUNS, Tables
from tagloom.plans.stages import stage, stage_root
from tagloom.schemas import CORNERS, KINDS
from tagloom.sinks import documents, files
from tagloom.sources import headers, yolo

Query = Callable[[SparkSession, str], DataFrame]
_REGISTER: dict[str, Query] = {}

OUT = "/data/labeled"
VIS = "/data/visualized"
FORMATS = ["yolo", "pascal_voc", "coco", "vision_json", "custom"]


def query(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _REGISTER[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
    return function


def registered() -> dict[str, Query]:
    return dict(_REGISTER)


def _r(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(name or column)


def _corners(*more: str) -> list[Column]:
    return [_r(c) for c in (*CORNERS, *more)]


# --- consistency -------------------------------------------------------------------------------------


def _consistency(images: DataFrame, scores: DataFrame, runs: Sequence[int]) -> DataFrame:
    scored = consistency.image_consistency(images, scores, runs)
    return scored.select("image_id", _r("consistency_score", "consistency"))


@query
def consistency_score(t: Tables) -> DataFrame:
    scores = consistency.pair_scores(RUNS, boxes=fixtures.draft_boxes(t))
    return _consistency(t.orders.selectExpr("o_orderkey AS image_id"), scores, RUNS)


@query
def pair_scores(t: Tables) -> DataFrame:
    return consistency.box_pair_scores(fixtures.draft_boxes(t), RUNS).select(
        "image_id", "run_i", "run_j", "n_i", "n_j", _r("score")
    )


@query
def consistency_segments(t: Tables) -> DataFrame:
    boxes = fixtures.draft_segments(t).select("image_id", "run", "item_ix", segment_to_box(F.col("segment")).alias("b"))
    boxes = boxes.select("image_id", "run", "item_ix", "b.*")
    images = t.orders.selectExpr("o_orderkey AS image_id")
    return _consistency(images, consistency.pair_scores(RUNS, segments=boxes), RUNS)


def _value_consistency(values: DataFrame, runs: Sequence[int]) -> DataFrame:
    return _consistency(values.select("image_id").distinct(), consistency.pair_scores(runs, values=values), runs)


@query
def consistency_classes(t: Tables) -> DataFrame:
    return _value_consistency(fixtures.class_values(t), RUNS)


@query
def consistency_texts(t: Tables) -> DataFrame:
    return _value_consistency(fixtures.text_values(t), (0, 1))


@query
def consistency_tracks(t: Tables) -> DataFrame:
    return _value_consistency(fixtures.track_values(t), (0, 1))


@query
def consistency_keypoints(t: Tables) -> DataFrame:
    return _value_consistency(fixtures.keypoint_values(t), (0, 1))


@query
def iou_pairs(t: Tables) -> DataFrame:
    drafts, last = fixtures.draft_boxes(t).drop("confidence"), RUNS[-1]
    left = drafts.filter(f"run < {last}").withColumnRenamed("run", "run_i").withColumn("run_j", F.expr(f"explode(sequence(run_i + 1, {last}))"))
    right = drafts.filter("run > 0").withColumnRenamed("run", "run_j").withColumn("run_i", F.expr("explode(sequence(0, run_j - 1))"))
    return matching.candidate_pairs(left, right, ["image_id", "run_i", "run_j", "label"]).select(
        "image_id",
        "run_i",
        "run_j",
        "label",
        F.col("left_item_ix").alias("left_ix"),
        F.col("right_item_ix").alias("right_ix"),
        _r("iou"),
    )


# --- cascade -----------------------------------------------------------------------------------------


@query
def cascade_status(t: Tables) -> DataFrame:
    drafts = fixtures.draft_boxes(t)
    images = t.orders.selectExpr("o_orderkey AS image_id")
    scores = consistency.image_consistency(images, consistency.pair_scores(RUNS, boxes=drafts), RUNS)
    mean = lambda df, name: df.groupBy("image_id").agg(F.avg("confidence").alias(name))
    escalated = cascade.needs_high_tier(F.col("consistency_score"))
    draft = F.coalesce("draft_confidence", F.lit(0.0))
    return (
        scores.join(mean(drafts.filter("run = 0"), "draft_confidence"), "image_id", "left")
        .join(mean(fixtures.high_boxes(t), "high_confidence"), "image_id", "left")
        .select(
            "image_id",
            cascade.status(F.col("consistency_score")).alias("status"),
            F.when(escalated, HIGH_MODEL).otherwise(LOW_MODEL).alias("source_model"),
            _r("consistency_score"),
            _r(F.when(escalated, F.coalesce("high_confidence", F.lit(0.0))).otherwise(draft), "mean_confidence"),
            _r(V.uncertainty(F.col("consistency_score"), draft), "uncertainty_score"),
        )
    )


def _labelled_run(t: Tables) -> labeling.Run:
    """The whole chain, with stand-ins that give the texts of the fixtures."""
    low = labeling.Tier(LOW_MODEL, fixtures.timed(fixtures.canned_model, 0.5))
    high = labeling.Tier(HIGH_MODEL, fixtures.timed(fixtures.canned_model, 2.0))
    options = labeling.Options(backoff_seconds=0.0, batch_size=4096, complete=fixtures.with_answers)
    # stored, as real image tables are: each attempt and tier reads the requests again
    return labeling.label_images(stage(fixtures.run_images(t), "run-images"), low, high, options)


@query
def cascade_final(t: Tables) -> DataFrame:
    run = _labelled_run(t)
    return run.final.select(
        "image_id",
        "status",
        "source_model",
        _r("consistency_score"),
        _r("mean_confidence"),
        _r("uncertainty_score"),
        F.size("boxes").cast("bigint").alias("n_boxes"),
        _r(F.aggregate("boxes", F.lit(0.0), lambda acc, b: acc + b["xmin"] + b["ymax"]), "box_sum"),
    )


@query
def run_metrics(t: Tables) -> DataFrame:
    run = _labelled_run(t)
    records = metrics.with_reliability(labeling.metrics(run, OUT, VIS))
    return records.select(
        "image",
        "status",
        "source_model",
        "low_model",
        "high_model",
        "task_type",
        *[F.col(c).cast("bigint").alias(c) for c in ("objects", *KINDS, "low_api_attempts", "high_api_attempts")],
        _r("consistency_score"),
        _r("mean_confidence"),
        _r("uncertainty_score"),
        _r("reliability"),
        _r("elapsed_sec"),
        "label_path",
        "label_paths",
        "visualization_path",
    )


@query
def efficiency_report(t: Tables) -> DataFrame:
    run = _labelled_run(t)
    report = metrics.efficiency_report(run.images, labeling.metrics(run, OUT, VIS))
    return report.select(
        "n_images",
        "failed",
        "total_objects",
        "manual_seconds",
        "total_seconds",
        _r("time_saved_pct"),
        "low_api_attempts",
        "high_api_attempts",
        "low_only",
        "escalated",
        _r("cost_saved_pct"),
    )


# --- parsing -----------------------------------------------------------------------------------------


@query
def answer_outcomes(t: Tables) -> DataFrame:
    return parse_answers(fixtures.box_answers(t)).select(
        "image_id", "run", "parse_ok", "ok", F.size("boxes").cast("bigint").alias("n_boxes")
    )


def _parsed(answers: DataFrame, kind: str, *keys: str) -> DataFrame:
    return (
        parse_answers(answers)
        .select("image_id", *keys, F.posexplode(items_of(kind)).alias("item_ix", "item"))
        .select("image_id", *keys, F.col("item_ix").cast("bigint").alias("item_ix"), "item.*")
    )


@query
def parse_boxes(t: Tables) -> DataFrame:
    return _parsed(fixtures.box_answers(t), "boxes", "run").select(
        "image_id", "run", "item_ix", "label", *_corners("confidence")
    )


@query
def parse_classifications(t: Tables) -> DataFrame:
    return _parsed(fixtures.class_answers(t), "classifications").select(
        "image_id", "item_ix", "label", _r("confidence")
    )


@query
def parse_segments(t: Tables) -> DataFrame:
    return (
        _parsed(fixtures.segment_answers(t), "segments")
        .select("image_id", "item_ix", "label", "confidence", F.posexplode("polygon").alias("pt_ix", "p"))
        .select(
            "image_id", "item_ix", F.col("pt_ix").cast("bigint").alias("pt_ix"), "label", _r("p.x", "x"), _r("p.y", "y"), _r("confidence")
        )
    )


@query
def parse_poses(t: Tables) -> DataFrame:
    return (
        _parsed(fixtures.pose_answers(t), "poses")
        .select("image_id", "label", F.col("confidence").alias("pc"), F.posexplode("keypoints").alias("point_ix", "k"))
        .select(
            "image_id",
            F.col("point_ix").cast("bigint").alias("point_ix"),
            "label",
            _r("pc", "pose_confidence"),
            "k.name",
            _r("k.x", "x"),
            _r("k.y", "y"),
            "k.visible",
            _r("k.confidence", "confidence"),
        )
    )


@query
def parse_texts(t: Tables) -> DataFrame:
    return _parsed(fixtures.text_answers(t), "texts").select(
        "image_id", "item_ix", "text", *_corners("confidence")
    )


@query
def parse_tracks(t: Tables) -> DataFrame:
    return _parsed(fixtures.track_answers(t), "tracks").select(
        "image_id", "item_ix", "track_id", "frame_id", "label", *_corners("confidence")
    )


@query
def answer_bodies(t: Tables) -> DataFrame:
    """JSON part of whole documents, bare, fenced as json with prose around, or fenced without a name."""
    wrapped = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('Sure.\\n```json\\n', text, '\\n```\\nDone.')"
        " ELSE concat('```', text, '```') END"
    )
    return t.documents.select("doc_id", wrapped.alias("answer")).select("doc_id", answer_json_text("answer").alias("body"))


@query
def loose_answers(t: Tables) -> DataFrame:
    parsed = parse_answers(fixtures.loose_answers(t))
    return parsed.select("image_id", "parse_ok", "ok", F.inline_outer("boxes")).select("image_id", "parse_ok", "ok", "label", *_corners("confidence"))


@query
def six_decimals(t: Tables) -> DataFrame:
    """Numbers halfway between two steps of six decimals, as near as a double gets, and their neighbours."""
    half = (F.col("o_orderkey") % 1000000 + 0.5) / 1e6
    numbers = {"half": half, "above": half * (1 + 2.0**-52), "below": half * (1 - 2.0**-53), "far": half * 3 - 1}
    return t.orders.select(F.col("o_orderkey").alias("image_id"), *[V.fixed(number.cast("double"), 6).alias(name) for name, number in numbers.items()])


@query
def scaled_numbers(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        _r(V.coordinate(F.col("value")), "coordinate"),
        _r(V.confidence(F.col("value")), "confidence"),
        F.round(V.coordinate(F.col("value") / 100), 8).alias("unit_coordinate"),
    )


# --- boxes and exports -------------------------------------------------------------------------------


def _first_drafts(t: Tables) -> DataFrame:
    return fixtures.draft_boxes(t).filter("run = 0").drop("run")


def _draft_labels(t: Tables) -> DataFrame:
    """Labels of the first drafts with the order in which class ids are given."""
    return (
        _first_drafts(t)
        .join(fixtures.images(t).select("image_id", "image_name"), "image_id")
        .select("image_name", F.lit(1).alias("kind_ix"), "item_ix", "label")
    )


def _box() -> dict[str, Column]:
    return {c: F.col(c) for c in CORNERS}


@query
def pixel_boxes(t: Tables) -> DataFrame:
    px = pixel_box(_box(), F.col("image_width"), F.col("image_height"))
    return (
        _first_drafts(t)
        .join(fixtures.images(t), "image_id")
        .select("image_id", "item_ix", px.alias("px"))
        .select("image_id", "item_ix", *[F.col(f"px.{c}").alias(f"px_{c}") for c in (*CORNERS, "width", "height")])
    )


@query
def center_boxes(t: Tables) -> DataFrame:
    return (
        _first_drafts(t)
        .select("image_id", "item_ix", center_form(_box()).alias("c"))
        .select("image_id", "item_ix", *[_r(f"c.{n}", n) for n in ("x_center", "y_center", "width", "height")])
    )


@query
def segment_boxes(t: Tables) -> DataFrame:
    return (
        fixtures.draft_segments(t)
        .select("image_id", "run", "item_ix", segment_to_box(F.col("segment")).alias("b"))
        .select("image_id", "run", "item_ix", "b.label", *[_r(f"b.{c}", c) for c in (*CORNERS, "confidence")])
    )


@query
def class_ids(t: Tables) -> DataFrame:
    return ids.class_ids(_draft_labels(t))


@query
def yolo_lines(t: Tables) -> DataFrame:
    return documents.yolo_lines(_first_drafts(t), ids.class_ids(_draft_labels(t)))


@query
def yolo_round_trip(t: Tables) -> DataFrame:
    """Truth boxes written as label lines, with some broken ones, and read again."""
    line = F.concat_ws(
        " ",
        F.col("class_id").cast("string"),
        *[V.fixed(center_form(_box())[n], 6) for n in ("x_center", "y_center", "width", "height")],
    )
    broken = (
        F.when((F.col("image_id") + F.col("item_ix")) % 17 == 0, F.lit("0 0.5 0.5 0.1"))
        .when((F.col("image_id") + F.col("item_ix")) % 19 == 0, F.lit("0 0.5 nought 0.1 0.1"))
        .otherwise(F.concat(F.lit("  "), line, F.lit("\t")))
    )
    lines = fixtures.truth_boxes(t).select("image_id", "item_ix", broken.alias("line"))
    return yolo.parse_label_lines(lines)[0].select("image_id", "item_ix", "class_id", *_corners())


@query
def broken_label_lines(t: Tables) -> DataFrame:
    lines = fixtures.truth_boxes(t).select(
        "image_id",
        "item_ix",
        F.when((F.col("image_id") + F.col("item_ix")) % 19 == 0, "0 0.5 nought 0.1 0.1").otherwise("0 .5 .5 1e-1 .1").alias("line"),
    )
    return yolo.parse_label_lines(lines)[1]


def _numbered_images(t: Tables) -> DataFrame:
    return documents.coco_images(fixtures.images(t))


@query
def coco_images(t: Tables) -> DataFrame:
    return _numbered_images(t).select("id", "file_name", "width", "height")


@query
def coco_annotations(t: Tables) -> DataFrame:
    final = stage(fixtures.final_labels(t).select("image_id", "image_name", "boxes", "segments"), "final")
    classes = ids.class_ids(documents.exported_labels(final, segments=True))
    boxes, segments = (
        final.select("image_id", F.posexplode(kind).alias("item_ix", "item")).select("image_id", "item_ix", "item.*")
        for kind in ("boxes", "segments")
    )
    made = documents.coco_annotations(_numbered_images(t), classes, boxes, segments)
    return made.select(
        "id",
        "image_id",
        "category_id",
        *[F.get("bbox", F.lit(i)).alias(f"bbox_{n}") for i, n in enumerate(("x", "y", "w", "h"))],
        "area",
        "iscrowd",
        F.coalesce(F.array_join(F.get("segmentation", F.lit(0)), ","), F.lit("")).alias("polygon"),
        _r("score"),
    )


@query
def coco_categories(t: Tables) -> DataFrame:
    final = stage(fixtures.final_labels(t).select("image_name", "boxes", "segments"), "final")
    return documents.coco_categories(ids.class_ids(documents.exported_labels(final, segments=True)))


@query
def yolo_documents(t: Tables) -> DataFrame:
    final = stage(fixtures.final_labels(t), "final")
    classes = ids.class_ids(documents.exported_labels(final))
    return documents.yolo_documents(documents.with_class_ids(final, classes))


@query
def voc_documents(t: Tables) -> DataFrame:
    return documents.voc_documents(fixtures.final_labels(t))


@query
def custom_documents(t: Tables) -> DataFrame:
    final = stage(fixtures.final_labels(t), "final")
    classes = ids.class_ids(documents.exported_labels(final))
    return documents.custom_documents(documents.with_class_ids(final, classes), fixtures.TEMPLATE)


@query
def vision_records(t: Tables) -> DataFrame:
    """Members of the JSON records, read back from their text."""
    lines = documents.vision_records(fixtures.final_labels(t))
    record = lines.select("image_id", F.parse_json("record").alias("record"))
    text = lambda path: F.variant_get("record", f"$.{path}", "string")
    whole = lambda path, name: F.variant_get("record", f"$.{path}", "bigint").alias(name)
    real = lambda path, name: _r(F.variant_get("record", f"$.{path}", "double"), name)
    return record.select(
        "image_id",
        text("image_name").alias("image_name"),
        whole("image_width", "image_width"),
        text("task_type").alias("task_type"),
        text("source_model").alias("source_model"),
        real("consistency_score", "consistency_score"),
        real("mean_confidence", "mean_confidence"),
        text("classifications[0].label").alias("class_label"),
        text("boxes[0].label").alias("box_label"),
        whole("boxes[0].class_id", "box_class_id"),
        real("boxes[0].normalized.xmin", "box_xmin"),
        whole("boxes[0].pixel.ymax", "box_pixel_ymax"),
        real("boxes[0].yolo.x_center", "box_x_center"),
        whole("boxes[0].coco.category_id", "box_category"),
        whole("boxes[0].coco.bbox[2]", "box_coco_width"),
        whole("boxes[0].coco.area", "box_area"),
        whole("segments[0].polygon_pixels[2].x", "polygon_x"),
        real("segments[0].polygon[3].x", "polygon_mid"),
        text("poses[0].label").alias("pose_label"),
        text("poses[0].keypoints[1].visible").alias("keypoint_visible"),
        text("texts[0].text").alias("read_text"),
        whole("texts[0].pixel.width", "text_pixel_width"),
        text("tracks[0].track_id").alias("track_id"),
        whole("tracks[0].frame_id", "frame_id"),
    )


@query
def overlay_primitives(t: Tables) -> DataFrame:
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    return overlay.overlay_primitives(fixtures.final_labels(t)).select(
        "image_id",
        "layer",
        "item_ix",
        "part_ix",
        "shape",
        "colour",
        F.size("points").cast("bigint").alias("n_points"),
        _r(first["x"], "x1"),
        _r(first["y"], "y1"),
        _r(last["x"], "x2"),
        _r(last["y"], "y2"),
        "radius",
        F.when(F.col("shape") == "banner", F.substring_index("caption", " | ", 1))
        .when((F.col("shape") == "circle") | F.col("layer").isin(3, 4), F.col("caption"))
        .alias("caption"),
        _r("caption_x"),
        _r("caption_y"),
    )


@query
def kind_counts(t: Tables) -> DataFrame:
    counts = metrics.kind_counts(fixtures.final_labels(t))
    return counts.select("image_id", *[F.col(c).cast("bigint").alias(c) for c in (*KINDS, "objects")])


@query
def mean_confidences(t: Tables) -> DataFrame:
    return fixtures.final_labels(t).select("image_id", _r(mean_confidence(), "mean_confidence"))


@query
def label_bags(t: Tables) -> DataFrame:
    return fixtures.final_labels(t).select("image_id", F.explode(label_bag()).alias("value"))


@query
def label_paths(t: Tables) -> DataFrame:
    paths = metrics.label_paths(F.col("image_path"), OUT, FORMATS)
    no_yolo = metrics.label_paths(F.col("image_path"), OUT, ["custom", "pascal_voc"])
    return fixtures.images(t).select(
        "image_id",
        F.to_json(paths).alias("paths"),
        metrics.representative_path(paths).alias("label_path"),
        metrics.representative_path(no_yolo).alias("label_path_without_yolo"),
    )


# --- evaluation --------------------------------------------------------------------------------------


def _stored_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return stage(fixtures.predicted_boxes(t), "predicted"), stage(fixtures.truth_boxes(t), "truth")


def _outcomes(t: Tables, **options) -> DataFrame:
    return evaluate.detection_outcomes(*_stored_sides(t), **options)


def _rounded_evaluation(totals: DataFrame, *by: str) -> DataFrame:
    return totals.select(
        *by, "true_positive", "false_positive", "false_negative", _r("precision"), _r("recall"), _r("mean_iou")
    )


@query
def detection_eval(t: Tables) -> DataFrame:
    return _rounded_evaluation(evaluate.evaluation(_outcomes(t)))


@query
def detection_eval_all_images(t: Tables) -> DataFrame:
    return _rounded_evaluation(evaluate.evaluation(_outcomes(t, count_unpredicted_images=True)))


@query
def detection_eval_by_class(t: Tables) -> DataFrame:
    return _rounded_evaluation(evaluate.evaluation(_outcomes(t), ["class_id"]), "class_id")


@query
def folder_evaluation(t: Tables) -> DataFrame:
    """Predictions and truth written as label files with blanks, ``%`` and other signs in their names, read again and compared."""
    root = f"{stage_root(t.spark)}/label-folders-{uuid.uuid4().hex}"
    for role, boxes in (("predicted", fixtures.predicted_boxes(t)), ("truth", fixtures.truth_boxes(t))):
        line = F.struct("item_ix", documents.yolo_line({c: F.col(c) for c in CORNERS}, F.col("class_id")).alias("line"))
        lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: F.concat(x["line"], F.lit("\n")))
        name = F.concat(F.lit("img "), F.col("image_id"), F.lit(" 100%25+é.txt")).alias("file_name")
        files.write_label_files(boxes.groupBy("image_id").agg(F.array_join(lines, "").alias("content")).select(name, "content"), f"{root}/{role}")
    return _rounded_evaluation(labeling.evaluate_folders(t.spark, f"{root}/predicted", f"{root}/truth"))


@query
def detection_matches(t: Tables) -> DataFrame:
    return evaluate.match_detections(*_stored_sides(t)).select(
        "image_id", "left_ix", "right_ix", _r("iou")
    )


@query
def missed_truth(t: Tables) -> DataFrame:
    return evaluate.missed_truth(*_stored_sides(t)).select(
        "image_id", "item_ix", "class_id", *_corners()
    )


# --- insight -----------------------------------------------------------------------------------------


def _shares(distribution: DataFrame) -> DataFrame:
    return distribution.select("label", "n", _r("percentage"))


@query
def class_distribution(t: Tables) -> DataFrame:
    return _shares(insight.class_distribution(insight.label_stream(fixtures.final_labels(t))))


@query
def language_distribution(t: Tables) -> DataFrame:
    return _shares(insight.class_distribution(t.documents.selectExpr("lang AS label")))


@query
def event_distribution(t: Tables) -> DataFrame:
    return _shares(insight.class_distribution(t.events.selectExpr("event_type AS label")))


@query
def imbalance_report(t: Tables) -> DataFrame:
    distribution = insight.class_distribution(_draft_labels(t), insight.ORDER)
    return insight.imbalance(distribution).withColumn("ratio", _r("ratio"))


@query
def class_report(t: Tables) -> DataFrame:
    return insight.report_lines(insight.class_distribution(_draft_labels(t), insight.ORDER))


# --- inference ---------------------------------------------------------------------------------------


def _requests(t: Tables) -> DataFrame:
    """One request per image and run, of which :func:`fixtures.with_answers` makes the text the stand-in model will give; stored, as retries read it again."""
    requests = t.orders.select(
        F.col("o_orderkey").alias("image_id"),
        F.lit("low").alias("tier"),
        F.explode(F.array(*[F.lit(r) for r in RUNS])).alias("run"),
        F.lit(LOW_MODEL).alias("model"),
        "o_custkey",
    )
    return stage(requests, "requests")


def _answered(t: Tables) -> DataFrame:
    return inference.infer(_requests(t), fixtures.unreliable_model, backoff_seconds=0.0, batch_size=4096, complete=fixtures.with_answers)


@query
def inference_drafts(t: Tables) -> DataFrame:
    return _answered(t).select(
        "image_id",
        "run",
        F.col("attempts").cast("bigint").alias("attempts"),
        "ok",
        "error",
        F.size("boxes").cast("bigint").alias("n_boxes"),
    )


@query
def error_quarantine(t: Tables) -> DataFrame:
    return _answered(t).filter(~F.col("ok")).select("image_id", "run", "error", F.size("boxes").cast("bigint").alias("n_boxes"))


@query
def api_attempts(t: Tables) -> DataFrame:
    return metrics.attempts_per_tier(_answered(t))


@query
def unreadable_images(t: Tables) -> DataFrame:
    images = fixtures.images(t).withColumn(
        "image_width", F.when(F.col("image_id") % 11 == 0, F.lit(-1)).otherwise(F.col("image_width"))
    )
    return inference.split_readable(images)[1].select("image_id", "image_name", "error")


@query
def image_sizes(t: Tables) -> DataFrame:
    return headers.sizes_of(fixtures.image_headers(t), "content")


@query
def inference_resume(t: Tables) -> DataFrame:
    """Requests that are left when the answers of some images are already stored."""
    requests = fixtures.box_answers(t).select("image_id", F.lit("low").alias("tier"), "run")
    done = requests.filter("(image_id + run) % 4 <> 0")
    return inference.remaining_requests(requests, done).select("image_id", "tier", "run")


def _answer_log(t: Tables) -> str:
    return f"{stage_root(t.spark)}/answer-log-{uuid.uuid4().hex}"


@query
def resumed_run(t: Tables) -> DataFrame:
    """A run that got through three quarters of its requests, taken up again by a model that says something else.

    Only what has no good answer in the log is asked, failed requests included.
    """
    requests, log = _requests(t), _answer_log(t)
    inference.infer(requests.filter("(image_id + run) % 4 <> 0"), fixtures.unreliable_model, backoff_seconds=0.0, batch_size=4096, store=log, complete=fixtures.with_answers)
    rows = inference.infer(requests, fixtures.other_model, backoff_seconds=0.0, batch_size=4096, store=log, complete=fixtures.with_answers)
    return rows.select(
        "image_id",
        "run",
        F.col("attempts").cast("bigint").alias("attempts"),
        "ok",
        F.size("boxes").cast("bigint").alias("n_boxes"),
        (F.size("classifications") > 0).alias("asked_again"),
    )


@query
def changed_prompt(t: Tables) -> DataFrame:
    """Two runs on one log with different prompts: the second is asked everything anew, and the log has both."""
    requests, log = _requests(t), _answer_log(t)
    for prompt, model in (("first", fixtures.unreliable_model), ("second", fixtures.other_model)):
        inference.infer(
            requests, model, backoff_seconds=0.0, batch_size=4096, store=log, complete=lambda sent, p=prompt: fixtures.with_answers(sent).withColumn("prompt", F.lit(p))
        )
    prompts = [
        inference.with_fingerprint(requests, lambda sent, p=p: sent.withColumn("prompt", F.lit(p))).select("image_id", "run", "asked", F.lit(p).alias("prompt"))
        for p in ("first", "second")
    ]
    answers = inference.read_answers(t.spark, log).filter("ok").select("image_id", "run", "asked", "attempts", "boxes")
    return answers.join(prompts[0].unionByName(prompts[1]), ["image_id", "run", "asked"]).select(
        "image_id", "run", "prompt", F.col("attempts").cast("bigint").alias("attempts"), F.size("boxes").cast("bigint").alias("n_boxes")
    )


@query
def prompt_rows(t: Tables) -> DataFrame:
    tasks = (
        "CASE image_id % 8 WHEN 0 THEN 'classification' WHEN 1 THEN 'object_detection' WHEN 2 THEN 'segmentation'"
        " WHEN 3 THEN 'pose_estimation' WHEN 4 THEN 'ocr' WHEN 5 THEN 'tracking' WHEN 6 THEN 'all' ELSE 'other' END"
    )
    requests = fixtures.images(t).withColumn("task_type", F.expr(tasks))
    return inference.with_prompts(requests).select("image_id", "task_type", "system_message", "prompt", "media_type")


@query
def file_names(t: Tables) -> DataFrame:
    """Names, stems, media types and base64 text of the files behind web addresses."""
    url = F.col("url")
    name = F.concat(V.base_name(url), F.element_at(F.array(*[F.lit(s) for s in (".PNG", ".webp", ".jpeg", "")]), (F.col("page_id") % 4 + 1).cast("int")))
    return t.pages.select(
        "page_id",
        name.alias("file_name"),
        V.stem(name).alias("stem"),
        V.media_type(name).alias("media_type"),
        V.is_image_name(name).alias("is_image"),
        V.base64_text(F.encode("html", "utf-8")).alias("content_base64"),
    )
