"""Images in folders, model calls, files out and in again."""

import json
import pathlib
import struct
import xml.etree.ElementTree as ET
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.operators import cascade, consistency, inference, metrics
from tagloom.functions.values import fixed
from tagloom.operators.ids import dense_ids
from tagloom.plans import labeling
from tagloom.plans.stages import stage
from tagloom.schemas import KINDS, RUN_METRICS_COLUMNS
from tagloom.sinks import answers, documents, files
from tagloom.sinks.formats import file_extension, label_formats
from tagloom.sources import images as image_source
from tagloom.sources import yolo
from tagloom.streaming import incremental

TEMPLATE = '{{"image": "{image_name}", "n": {object_count}, "objects": {objects_json}, "c": {consistency_score:.3f}}}'


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    pixels = zlib.compress((b"\0" + b"\x40\x80\xc0" * width) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "raw"
    (root / "deeper").mkdir(parents=True)
    for n, name in enumerate(["a.png", "b.PNG", "c.png"]):
        (root / name).write_bytes(png(40 + n, 20))
    (root / "broken.png").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    (root / "deeper" / "d.png").write_bytes(png(5, 5))
    return str(root)


def test_scan_and_sizes(spark, folder):
    assert {r.image_name for r in image_source.scan_images(spark, folder).collect()} == {"a.png", "b.PNG", "c.png", "broken.png"}
    plan = image_source.scan_images(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    sizes = {r.image_name: (r.image_width, r.image_height) for r in image_source.image_sizes(spark, folder).collect()}
    assert sizes == {"a.png": (40, 20), "b.PNG": (41, 20), "c.png": (42, 20), "broken.png": (None, None)}
    headers = image_source.scan_images(spark, folder, with_content=True).select(
        "image_name", image_source.png_size(F.col("content")).alias("s")
    )
    assert {r.image_name: tuple(r.s) if r.s else None for r in headers.collect()}["b.PNG"] == (41, 20)


def jpeg(width, height, frame=0xC0, before=b""):
    head = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"
    return head + before + bytes([0xFF, frame, 0, 17, 8]) + struct.pack(">HH", height, width) + bytes(10) + b"\xff\xda\x00\x02" + bytes(50)


def segment(marker, size):
    return bytes([0xFF, marker]) + struct.pack(">H", size + 2) + b"\xff" * size


def test_sizes_from_leading_bytes(spark, tmp_path):
    """Only headers are read: large segments before the size are jumped over, pixels needn't be there."""
    thumbnail = segment(0xE1, 60_000) + segment(0xE2, 65_000) + b"\xff\xff" + segment(0xDB, 65) + segment(0xC4, 30)
    text = struct.pack(">I4s", 9000, b"tEXt") + bytes(9004)
    good = png(33, 44)
    files_ = {
        "plain.jpg": (jpeg(640, 480), (640, 480)),
        "progressive.jpeg": (jpeg(70, 30, 0xC2, thumbnail), (70, 30)),
        "named.png": (jpeg(5, 6, 0xC1), (5, 6)),
        "chunks.PNG": (good[:8] + text + good[8:], (33, 44)),
        "a %20 b.png": (good[:24], (33, 44)),
        "cut.png": (good[:20], None),
        "cut.jpg": (jpeg(9, 9, 0xC0, thumbnail)[:100_000], None),
        "scan.jpg": (b"\xff\xd8\xff\xda\x00\x02" + jpeg(9, 9), None),
        "nothing.jpg": (b"", None),
        "zero.jpg": (jpeg(0, 9), None),
        "text.jpg": (b"GIF89a" * 9, None),
    }
    for name, (content, _) in files_.items():
        (tmp_path / name).write_bytes(content)
    for whole in (False, True):
        found = {r.image_name: (r.image_width, r.image_height) for r in image_source.image_sizes(spark, str(tmp_path), whole).collect()}
        assert found == {name: size or (None, None) for name, (content, size) in files_.items() if content}  # empty files aren't listed


def test_few_bytes_are_read():
    from tagloom.sources import headers

    content, read = jpeg(70, 30, 0xC2, segment(0xE1, 60_000) * 4), []
    fetch = lambda at, n: read.append(n) or content[at : at + n]
    assert headers.image_size(headers._ranges(fetch)) == (70, 30) and sum(read) <= 6 * headers.RANGE_BYTES


def draft_factory():
    """Answers by image name; b differs between runs, c fails once."""

    def box(x, label="dög & <co>"):
        return {"label": label, "xmin": x, "ymin": 0.25, "xmax": x + 0.5, "ymax": 0.75, "confidence": 0.5}

    def answer(row):
        if row.image_name == "c.png" and row.attempt == 1:
            return ConnectionError("down")
        assert bytes(row.content).startswith(b"\x89PNG")
        x = 0.25 if row.image_name != "b.PNG" else 0.25 * row.run
        return json.dumps({"boxes": [box(x)]}, ensure_ascii=False)

    return lambda batch: [answer(row) for row in batch.itertuples()]


def strong_factory():
    return lambda batch: ['{"boxes": [{"label": "cat", "xmin": 0.1, "xmax": 0.9, "ymin": 0.1, "ymax": 0.9}]}'] * len(batch)


@pytest.fixture
def run(spark, folder, tmp_path):
    scanned = image_source.with_image_ids(image_source.scan_images(spark, folder))
    sizes = image_source.image_sizes(spark, folder).select("image_path", "image_width", "image_height")
    images = scanned.join(sizes, "image_path", "left")
    options = labeling.Options(
        formats="all", template=TEMPLATE, extension="json", backoff_seconds=0.0, store=str(tmp_path / "answers"), read_content=True
    )
    return labeling.label_images(
        images, labeling.Tier("small-haiku", draft_factory), labeling.Tier("big-opus", strong_factory), options
    )


def test_whole_run(spark, run, folder, tmp_path):
    out = tmp_path / "labeled"
    final = {r.image_name: r for r in run.final.collect()}
    assert {name: r.status for name, r in final.items()} == {"a.png": "Consistent", "b.PNG": "Escalated", "c.png": "Consistent"}
    assert [r.image_name for r in run.errors.collect()] == ["broken.png"]
    attempts = {(r.tier, r.run, r.attempts) for r in run.responses.collect()}
    assert ("low", 0, 2) in attempts and ("high", 0, 1) in attempts

    written = labeling.export(run, str(out))
    assert set(written) == {"classes", "yolo", "pascal_voc", "coco", "vision_json", "custom"}
    assert (out / "classes.txt").read_text() == "dög & <co>\ncat"
    assert (out / "a.txt").read_text() == "0 0.500000 0.500000 0.500000 0.500000\n"
    assert (out / "b.txt").read_text().startswith("1 ")

    voc = ET.fromstring((out / "a.xml").read_bytes())
    assert voc.findtext("object/name") == "dög & <co>" and voc.findtext("folder") == "raw"
    assert [voc.findtext(f"object/bndbox/{c}") for c in ("xmin", "ymin", "xmax", "ymax")] == ["10", "5", "30", "15"]
    assert (out / "a.xml").read_text().startswith("<?xml version='1.0' encoding='utf-8'?>\n<annotation>\n  <folder>raw</folder>")

    coco = json.loads((out / "coco_annotations.json").read_text())
    assert [i["file_name"] for i in coco["images"]] == ["a.png", "b.PNG", "c.png"]
    assert [(a["id"], a["image_id"], a["category_id"]) for a in coco["annotations"]] == [(1, 1, 1), (2, 2, 2), (3, 3, 1)]
    assert coco["annotations"][0]["bbox"] == [10, 5, 20, 10] and coco["annotations"][0]["area"] == 200
    assert coco["categories"][1] == {"id": 2, "name": "cat", "supercategory": "object"}

    custom = json.loads((out / "b.json").read_text())
    assert custom["n"] == 1 and custom["objects"][0]["class_id"] == 1 and custom["c"] < 0.75
    records = spark.read.json(str(out / "vision_annotations.jsonl"))
    assert records.count() == 3 and {"poses", "tracks", "uncertainty_score"} <= set(records.columns)

    table = labeling.metrics(run, str(out), "/vis")
    assert tuple(table.columns) == RUN_METRICS_COLUMNS
    csv, jsonl = files.write_run_metrics(table, str(out))
    back = {r.image: r for r in spark.read.csv(csv, header=True, escape='"').collect()}
    assert back["c.png"].low_api_attempts == "6" and back["b.PNG"].high_api_attempts == "1"
    assert json.loads(back["a.png"].label_paths)["pascal_voc"] == f"{out}/a.xml"
    assert back["a.png"].label_path == f"{out}/a.txt" and back["a.png"].visualization_path == "/vis/vis_a.png"
    assert spark.read.json(jsonl).count() == 3

    tables = labeling.report(run, str(out), "/vis")
    efficiency = tables["efficiency"].first()
    assert (efficiency.n_images, efficiency.failed, efficiency.escalated, efficiency.low_only) == (4, 1, 1, 3)
    assert efficiency.cost_saved_pct == 75.0 and efficiency.manual_seconds == 180.0
    assert {r.label: r.n for r in tables["distribution"].collect()} == {"dög & <co>": 2, "cat": 1}
    assert not tables["imbalance"].first().imbalanced
    banner = tables["overlay"].filter("shape = 'banner'").first()
    assert banner.caption.startswith("Model: ")

    # labels against themselves, and against a truth with one file missing and one box more
    same = labeling.evaluate_folders(spark, str(out), str(out)).first()
    assert (same.true_positive, same.false_positive, same.false_negative, same.mean_iou) == (3, 0, 0, 1.0)
    truth = tmp_path / "truth"
    truth.mkdir()
    (truth / "a.txt").write_text("0 0.5 0.5 0.5 0.5\n0 0.1 0.1 0.1 0.1\nbroken line\n1 a b c d\n")
    (truth / "unseen.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    (truth / "classes.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    some = labeling.evaluate_folders(spark, str(out), str(truth)).first()
    assert (some.true_positive, some.false_positive, some.false_negative) == (1, 2, 1)
    every = labeling.evaluate_folders(spark, str(out), str(truth), count_unpredicted_images=True).first()
    assert every.false_negative == 2

    # every answer is stored, so a restarted run has nothing left to ask
    stored = inference.read_answers(spark, run.options.store)
    assert stored.count() == run.responses.count() == 10
    requests = inference.draft_requests(run.images, "small-haiku").filter("image_name <> 'broken.png'")
    assert inference.remaining_requests(requests, stored).count() == 0


def test_failed_answers_end_empty(spark):
    requests = spark.range(6).select(
        F.col("id").alias("image_id"), F.lit("low").alias("tier"), F.lit(0).alias("run"), F.lit("m").alias("model")
    )

    def factory():
        def predict(batch):
            if (batch["image_id"] == 5).any():
                raise OSError("whole batch")
            return ['{"boxes": null}' if i == 4 else "{}" for i in batch["image_id"]]

        return predict

    rows = {r.image_id: r for r in inference.infer(requests, factory, backoff_seconds=0.0, batch_size=1).collect()}
    assert [rows[i].attempts for i in range(6)] == [1, 1, 1, 1, 3, 3]
    assert rows[4].error == "invalid value" and rows[5].error == "whole batch"
    assert [rows[i].ok for i in range(6)] == [True] * 4 + [False] * 2 and rows[5].boxes == []


def test_content_in_the_requests_or_read_by_the_worker(spark, folder):
    def factory():
        return lambda batch: [f'{{"classifications": [{{"label": "{len(c)}"}}]}}' for c in batch["content"]]

    scanned = image_source.with_image_ids(image_source.scan_images(spark, folder, with_content=True))
    missing = scanned.limit(1).select("image_name", F.lit("/no/such/file.png").alias("image_path"), "n_bytes", "content", F.lit(0).cast("bigint").alias("image_id"))
    carried = inference.infer(inference.draft_requests(scanned, "m", drafts=1), factory, backoff_seconds=0.0)
    lazy = inference.draft_requests(scanned.unionByName(missing).drop("content"), "m", drafts=1)
    read = inference.infer(lazy, factory, backoff_seconds=0.0, read_content=True)
    sizes = lambda df: {r.image_id: [c.label for c in r.classifications] for r in df.collect()}
    assert sizes(read.filter("ok")) == sizes(carried) and len(sizes(carried)) == 4
    (row,) = read.filter("NOT ok").collect()
    assert row.image_id == 0 and row.error.startswith("unreadable image")


def test_unreadable_images_are_errors(spark, tmp_path):
    (tmp_path / "here.png").write_bytes(png(4, 4))
    rows = [(n, f"{name}.png", f"{tmp_path}/{name}.png", 4, 4) for n, name in enumerate(["here", "gone"])]
    images = spark.createDataFrame(rows, "image_id long, image_name string, image_path string, image_width int, image_height int")
    options = labeling.Options(backoff_seconds=0.0, read_content=True)
    run = labeling.label_images(images, labeling.Tier("low", strong_factory), labeling.Tier("high", strong_factory), options)
    assert [r.image_name for r in run.final.collect()] == ["here.png"]
    ((name, error),) = [(r.image_name, r.error) for r in run.errors.collect()]
    assert name == "gone.png" and error.startswith("unreadable image")
    assert {r.attempts for r in run.responses.filter("image_id = 1").collect()} == {0}


def test_a_second_run_on_a_store_asks_only_the_rest(spark, tmp_path):
    def requests(n):
        return spark.range(n).select(F.col("id").alias("image_id"), F.lit("low").alias("tier"), F.lit(0).alias("run"))

    def factory():
        return lambda batch: ["{}" if i or a == 3 else TimeoutError("late") for i, a in zip(batch["image_id"], batch["attempt"])]

    def later_factory():
        def predict(batch):
            assert set(batch["image_id"]) <= {5, 6}
            return ["{}"] * len(batch)

        return predict

    store = str(tmp_path / "answers")
    first = {r.image_id: r for r in inference.infer(requests(5), factory, backoff_seconds=0.1, store=store).collect()}
    assert first[0].attempts == 3 and first[0].elapsed_sec >= 0.3 and first[1].attempts == 1
    rows = inference.infer(requests(7), later_factory, backoff_seconds=0.0, store=store).collect()
    assert sorted((r.image_id, r.attempts, r.ok) for r in rows) == [(0, 3, True)] + [(i, 1, True) for i in range(1, 7)]
    assert inference.read_answers(spark, store).count() == 7


REQUEST = "image_id long, tier string, run int, model string, temperature double, task_type string, image_width int"


def request_rows(spark, n=6, model="m", temperature=0.7, task_type="ocr", width=4):
    return spark.createDataFrame([(i, "low", 0, model, temperature, task_type, width) for i in range(n)], REQUEST)


def test_another_question_is_asked_anew(spark, tmp_path):
    """Model, prompt, temperature, task type and image are part of a stored answer's key."""
    store = str(tmp_path / "answers")

    def saying(word):
        return lambda: lambda batch: [json.dumps({"classifications": [{"label": word}]})] * len(batch)

    def ask(word, prompt="p", **changed):
        with_prompt = lambda sent: sent.withColumn("prompt", F.lit(prompt))
        rows = inference.infer(request_rows(spark, **changed), saying(word), backoff_seconds=0.0, store=store, complete=with_prompt).collect()
        assert len(rows) == changed.get("n", 6)
        return {r.classifications[0].label for r in rows}

    assert ask("one") == {"one"} and ask("two") == {"one"}
    assert ask("three", prompt="q") == {"three"} and ask("four") == {"one"} and ask("five", prompt="q") == {"three"}
    for n, changed in enumerate(({"model": "other"}, {"temperature": 0.0}, {"task_type": "all"}, {"width": 5})):
        assert ask(f"new {n}", **changed) == {f"new {n}"} and ask("late", **changed) == {f"new {n}"}
    assert ask("six", n=8) == {"one", "six"}
    assert inference.read_answers(spark, store).count() == 8 + 5 * 6


def test_answers_to_other_questions_are_not_parsed_and_lone_ones_not_sorted(spark, tmp_path):
    store = str(tmp_path / "answers")

    def model():
        return lambda batch: ["{}"] * len(batch)

    inference.infer(request_rows(spark), model, backoff_seconds=0.0, store=store)
    inference.infer(request_rows(spark, model="other"), model, backoff_seconds=0.0, store=store)
    asked = inference.with_fingerprint(request_rows(spark, 2, model="other"))
    rows = inference.read_answers(spark, store, requests=asked)
    assert sorted((r.image_id, r.model) for r in rows.collect()) == [(0, "other"), (1, "other")]
    stored = rows._jdf.queryExecution().optimizedPlan()
    assert "Aggregate" not in stored.toString() and "settled-answers" in rows.inputFiles()[0]


def test_failed_requests_are_asked_again_by_the_next_run(spark, tmp_path):
    store = str(tmp_path / "answers")

    def broken():
        return lambda batch: ["{}" if i else TimeoutError("late") for i in batch["image_id"]]

    first = {r.image_id: r for r in inference.infer(request_rows(spark, 3), broken, backoff_seconds=0.0, store=store).collect()}
    assert [first[i].ok for i in range(3)] == [False, True, True] and first[0].attempts == 3
    settled = {r.image_id: r.ok for r in inference.read_answers(spark, store).collect()}
    assert settled == {0: False, 1: True, 2: True}
    again = inference.infer(request_rows(spark, 3), lambda: lambda batch: ["{}"] * len(batch), backoff_seconds=0.0, store=store)
    assert {r.image_id: (r.ok, r.attempts) for r in again.collect()} == {0: (True, 1), 1: (True, 1), 2: (True, 1)}
    assert {r.image_id: r.ok for r in inference.read_answers(spark, store).collect()} == {0: True, 1: True, 2: True}


def test_a_killed_run_loses_one_piece_at_most(spark, tmp_path):
    """The worker dies in the middle; what it had written is not asked for again."""
    store = str(tmp_path / "answers")

    def dying():
        made = []

        def predict(batch):
            made.extend(batch["image_id"])
            if len(made) > 25:
                import os

                os._exit(1)
            return ["{}"] * len(batch)

        return predict

    with pytest.raises(Exception):
        inference.infer(request_rows(spark, 60), dying, backoff_seconds=0.0, batch_size=5, store=store, partitions=1, piece_rows=10).collect()
    kept = {r.image_id for r in inference.read_answers(spark, store).collect()}
    assert len(kept) == 20
    asked = str(tmp_path / "asked")

    def careful():
        def predict(batch):
            pathlib.Path(asked).open("a").writelines(f"{i}\n" for i in batch["image_id"])
            return ["{}"] * len(batch)

        return predict

    rows = inference.infer(request_rows(spark, 60), careful, backoff_seconds=0.0, store=store).collect()
    assert sorted(r.image_id for r in rows) == list(range(60)) and all(r.ok for r in rows)
    assert {int(x) for x in pathlib.Path(asked).read_text().split()} == set(range(60)) - kept


def test_repeated_answers_read_the_same(spark, tmp_path):
    """A task that ran twice leaves two answers: the first good one counts, at every reading."""
    store = str(tmp_path / "answers")
    for word in ("late", "later"):
        factory = lambda word=word: lambda batch: [json.dumps({"classifications": [{"label": word}]})] * len(batch)
        asked = inference.with_fingerprint(request_rows(spark)).withColumn("attempt", F.lit(1))
        asker = inference._asker(asked.schema, factory, 0.0, 64, False)
        inference.log_answers(asked, asker, inference._LOGGED, f"{store}/ask={word}")
    for _ in range(2):
        assert {r.classifications[0].label for r in inference.read_answers(spark, store).collect()} == {"late"}


def test_argument_rules():
    assert label_formats("all") == ["yolo", "pascal_voc", "coco", "vision_json"]
    assert label_formats(" COCO, yolo,coco,") == ["coco", "yolo"]
    assert label_formats("") == ["yolo"] and label_formats([]) == ["yolo"]
    assert label_formats("yolo", "segmentation") == ["vision_json"]
    assert label_formats("coco", template="x") == ["coco", "custom"]
    for bad in ("tfrecord", "custom"):
        with pytest.raises(ValueError):
            label_formats(bad)
    assert file_extension("txt") == ".txt" and file_extension(".txt") == ".txt"
    with pytest.raises(ValueError):
        cascade.check_models("m", "m")
    cascade.check_models("m", "m", allow_same_model=True)
    with pytest.warns(UserWarning):
        cascade.check_models("x-opus", "x-haiku")


def test_templates_are_checked_first(spark):
    for bad in ("{nothing}", "{image_name!r}", "{image_name:>10}"):
        with pytest.raises(ValueError):
            documents.compile_template(bad)


def test_empty_prediction_files_count(spark, tmp_path):
    """An image for which nothing was predicted has an empty file: its truth is missed, unlike that of an image without a file."""
    for role, found in {"pred": {"a b.txt": "", "c%20.txt": "1 0.5 0.5 0.2 0.2\n"}, "true": {"a b.txt": "0 0.5 0.5 0.2 0.2", "c%20.txt": "1 0.5 0.5 0.2 0.2", "d.txt": "0 0.5 0.5 1 1"}}.items():
        (tmp_path / role).mkdir()
        for name, text in found.items():
            (tmp_path / role / name).write_text(text)
    row = labeling.evaluate_folders(spark, str(tmp_path / "pred"), str(tmp_path / "true")).first()
    assert (row.true_positive, row.false_positive, row.false_negative) == (1, 0, 1)
    assert {r.file_stem for r in yolo.label_files(spark, str(tmp_path / "pred")).collect()} == {"a b", "c%20"}


def test_stage_tables_go_at_the_end_of_their_scope(spark):
    from tagloom.plans.stages import stage, stage_root, stage_scope

    folder = pathlib.Path(stage_root(spark).removeprefix("file:")) / "tagloom"
    stage(spark.range(3), "kept").count()
    before = set(folder.iterdir())
    with stage_scope(spark):
        assert stage(spark.range(3), "inside").count() == 3 and len(set(folder.iterdir()) - before) == 1
        with stage_scope(spark):
            stage(spark.range(2), "deeper")
        assert len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before
    with pytest.raises(ZeroDivisionError), stage_scope(spark):
        stage(spark.range(3), "failing")
        1 / 0
    assert set(folder.iterdir()) == before


def test_shared_file_names_are_refused(spark, tmp_path):
    twins = spark.createDataFrame([("a.txt", "1"), ("a.txt", "2")], "file_name string, content string")
    with pytest.raises(ValueError):
        files.write_label_files(twins, str(tmp_path))


def coco_of(spark, n, folder, partitions):
    images = spark.range(1, n + 1).selectExpr("id", "concat('n', id) AS file_name", "1 AS width", "1 AS height")
    none = spark.sql(
        "SELECT id, id AS image_id, 1 AS category_id, array(1) AS bbox, 1 AS area, 0 AS iscrowd, array() AS segmentation,"
        " 1D AS score FROM range(0)"
    )
    classes = spark.sql("SELECT 'a' AS label, 0 AS class_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 1).lower())
    try:
        return pathlib.Path(files.write_coco(images, none, documents.coco_categories(classes), str(folder)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_documents_are_one_file_of_the_same_bytes_at_every_size(spark, tmp_path):
    """However many parts are written side by side, the file is the same, and nothing else is left in the folder."""
    for n in (0, 10, 300_000):
        one, many = (coco_of(spark, n, tmp_path / f"{n}-{p}", p) for p in (1, 8))
        assert one.is_file() and one.read_bytes() == many.read_bytes()
        assert [i["id"] for i in json.loads(one.read_text())["images"]] == list(range(1, n + 1))
        assert [x.name for x in many.parent.iterdir()] == ["coco_annotations.json"]
    classes = spark.range(5000).selectExpr("concat('l', id) AS label", "cast(id AS int) AS class_id")
    assert pathlib.Path(files.write_class_list(classes, str(tmp_path / "c"))).read_text() == "\n".join(f"l{i}" for i in range(5000))
    assert files.write_class_list(classes.limit(0), str(tmp_path / "none")) is None


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    files.register(spark)
    rows = spark.range(100).repartition(8).selectExpr("concat(id, '.txt') AS file_name", "if(id = 77, raise_error('stop'), 'x') AS content")
    with pytest.raises(Exception):
        files.write_label_files(rows, str(tmp_path / "named"), check_names=False)
    with pytest.raises(Exception):
        files.write_one_file(rows, ["file_name"], F.col("content"), str(tmp_path / "one"), "doc.txt")
    assert not [p for folder in ("named", "one") if (tmp_path / folder).exists() for p in (tmp_path / folder).iterdir()]
    files.write_label_files(rows.filter("file_name <> '77.txt'").withColumn("file_name", F.concat(F.lit("a % "), "file_name")), str(tmp_path / "named"))
    assert sorted(p.name for p in (tmp_path / "named").iterdir()) == sorted(f"a % {i}.txt" for i in range(100) if i != 77)


def test_run_records_are_written_by_the_run(spark, run, tmp_path):
    csv, jsonl = labeling.record(run, str(tmp_path / "out"), "/vis")
    assert pathlib.Path(csv).is_file() and pathlib.Path(csv).read_text().splitlines()[0] == ",".join(RUN_METRICS_COLUMNS)
    rows = [json.loads(line) for line in pathlib.Path(jsonl).read_text().splitlines()]
    assert [r["image"] for r in rows] == ["a.png", "b.PNG", "c.png"] and tuple(rows[0]) == RUN_METRICS_COLUMNS
    assert run.written["metrics_csv"] == csv


def test_class_ids_do_not_depend_on_the_way(spark, run):
    classes = spark.createDataFrame([("cat", 1), ("dög & <co>", 0)], "label string, class_id int")
    for size in (1 << 15, 0):
        ids = {r.image_name: r.class_ids for r in documents.with_class_ids(run.final, classes, size).collect()}
        assert ids == {"a.png": [0], "b.PNG": [1], "c.png": [0]}
    plan = documents.with_class_ids(run.final, classes)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan


def test_dense_ids_have_no_gaps(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    rows = dense_ids(df, ["k"], "id", start=1).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.id)] == sorted(r.k for r in rows)
    assert sorted(r.id for r in rows) == list(range(1, 1001))


def test_label_lines(spark):
    lines = spark.createDataFrame(
        [("f", 0, " 1.9 0.5 0.5 0.2 0.4 "), ("f", 1, "1 2 3 4"), ("f", 2, "x 1 1 1 1"), ("f", 3, "")],
        "file_stem string, item_ix int, line string",
    )
    good, broken = yolo.parse_label_lines(lines)
    (row,) = good.collect()
    assert row.class_id == 1 and [round(row[c], 6) for c in ("xmin", "ymin", "xmax", "ymax")] == [0.4, 0.3, 0.6, 0.7]
    assert [r.item_ix for r in broken.collect()] == [2]


def test_counts_over_a_stream(spark, run, tmp_path):
    source = str(tmp_path / "results")
    run.final.write.parquet(source)
    stream = spark.readStream.schema(run.final.schema).parquet(source)
    query = (
        incremental.running_class_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    )
    try:
        query.processAllAvailable()
        assert {r.label: r.n for r in spark.table("counts").collect()} == {"dög & <co>": 2, "cat": 1}
    finally:
        query.stop()


def test_images_arrive(spark, folder, tmp_path):
    query = (
        incremental.arriving_images(spark, folder)
        .select("image_name")
        .writeStream.format("memory")
        .queryName("arrived")
        .start()
    )
    try:
        query.processAllAvailable()
        assert {r.image_name for r in spark.table("arrived").collect()} == {"a.png", "b.PNG", "c.png", "broken.png"}
    finally:
        query.stop()


def test_a_label_line_is_made_and_read_once(spark):
    line = F.format_string("0 0.5 0.5 0.%d 0.2", F.col("id") + 1)
    lines = spark.range(9).select("id", F.when(F.col("id") == 4, F.lit("0 0.5 \t0.5 0.2 0.2")).when(F.col("id") == 5, F.lit("0  1")).otherwise(line).alias("line"))
    boxes, broken = yolo.parse_label_lines(lines)
    plan = boxes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1
    assert sorted(r.id for r in boxes.collect()) == [0, 1, 2, 3, 4, 6, 7, 8] and broken.count() == 0


def test_decimals_that_round_plainly_are_not_formatted(spark):
    numbers = [0.1, 0.25, 1.0, 0.999999, 0.9999996, 1e-7, 4.9e-7, -0.3, -1e-7, 0.0, -0.0, 2.0**20 + 0.3, 1e12, -1e15, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(numbers)], "n int, x double").select("n", fixed(F.col("x"), 6).alias("t"))
    java = {float("inf"): "Infinity", None: "null"}
    want = ["NaN" if x != x else java[x] if x in java else f"{x:.6f}" for x in numbers]
    assert [r.t for r in sorted(rows.collect(), key=lambda r: r.n)] == want
    assert rows._jdf.queryExecution().analyzed().toString().count("lpad(") > 1  # not only next to the middle of two steps


@pytest.mark.parametrize("repeats", [0, 1])
def test_only_repeated_answers_are_sorted(spark, tmp_path, repeats):
    rows = [(1, "a", 5.0, "p"), (2, "b", 6.0, "q"), (None, "c", 7.0, "r")] + [(1, "d", 4.0, "s"), (None, None, 3.0, "t")] * repeats
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, "image_id bigint, raw_text string, answered_at double, piece string").write.parquet(path)
    log = spark.read.parquet(path)
    first = answers.first_where_repeated(log, ["image_id"], [F.col("raw_text").isNull()])
    assert {(r.image_id, r.raw_text) for r in first.collect()} == {(1, "d" if repeats else "a"), (2, "b"), (None, "c")}
    assert sorted(map(str, first.collect())) == sorted(map(str, answers.first_of_each(log, ["image_id"], [F.col("raw_text").isNull()]).collect()))
    assert ("Exchange" in first._jdf.queryExecution().executedPlan().toString()) == bool(repeats)


def test_only_failed_requests_are_looked_through_for_the_next_attempt(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(inference, "stage", lambda df, name: stored.setdefault(name, stage(df, name)))
    keys = [(k, "low", 0) for k in range(40)] + [(7, "low", 0)]  # a request that stands twice
    requests = spark.createDataFrame(keys, "image_id long, tier string, run int")

    def factory():
        return lambda batch: ["{}" if k % 4 != 3 or (k == 11 and a == 2) else TimeoutError("late") for k, a in zip(batch["image_id"], batch["attempt"])]

    answers = inference.infer(requests, factory, backoff_seconds=0.0)
    assert sorted(r.image_id for r in stored["requests-2"].collect()) == [3, 7, 7, *range(11, 40, 4)]
    assert 11 not in {r.image_id for r in stored["requests-3"].collect()}
    assert {r.image_id: r.attempts for r in answers.collect()} == {k: 1 if k % 4 != 3 else 2 if k == 11 else 3 for k in range(40)}


def test_labels_are_counted_before_the_records_are_joined(spark):
    kinds = ", ".join(f"CAST(array() AS array<{schema}>) AS {kind}" for kind, schema in KINDS.items())
    rest = "concat(id, '.png') AS image_name, concat('/in/', id, '.png') AS image_path, 4 AS image_width, 'all' AS task_type, 'm' AS source_model"
    scores = "'Consistent' AS status, 1D AS consistency_score, 0.5D AS mean_confidence, 0.5D AS uncertainty_score"
    final = stage(spark.sql(f"SELECT id AS image_id, {rest}, {scores}, {kinds} FROM range(5)"), "final")
    attempts = spark.sql("SELECT id AS image_id, 3L AS low_api_attempts, 0L AS high_api_attempts, 1.5D AS elapsed_sec FROM range(4)")
    records = metrics.run_metrics(final, attempts, "low", "high", "/out", ["yolo"], "/vis")
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("size(boxes") > plan.index("Join")  # below it
    assert sorted((r.image, r.objects, r.boxes, r.low_api_attempts) for r in records.collect()) == [(f"{n}.png", 0, 0, 3 if n < 4 else 0) for n in range(5)]


def test_drafts_are_scored_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(consistency, "RESULT_ROWS", 10)
    kinds = ", ".join(f"CAST(array() AS array<{schema}>) AS {kind}" for kind, schema in KINDS.items())
    scored = consistency.score_results(stage(spark.sql(f"SELECT id DIV 3 AS image_id, CAST(id % 3 AS int) AS run, {kinds} FROM range(300)"), "results"))
    assert scored.rdd.getNumPartitions() == 30
    assert {(r.image_id, r.consistency_score) for r in scored.collect()} == {(n, 1.0) for n in range(100)}
