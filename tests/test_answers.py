import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions.answers import parse_answers
from tagloom.functions.values import fixed
from tagloom.schemas import KINDS

BOX = '{"label": "a", "xmin": 0.1, "ymin": 0.2, "xmax": 0.5, "ymax": 0.6, "confidence": 0.9}'
A_BOX = [("a", 0.1, 0.2, 0.5, 0.6, 0.9)]


def parse(spark, *texts):
    df = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "n int, raw_text string")
    rows = sorted(parse_answers(df).collect(), key=lambda r: r.n)
    return rows


def plain(items):
    return [tuple(plain(v) if isinstance(v, list) else v for v in item) for item in items]


def boxes(*items):
    return '{"boxes": [' + ", ".join(items) + "]}"


def test_wrappings(spark):
    body = boxes(BOX)
    texts = [
        body,
        f"Here:\n```json\n{body}\n```\nand more ```json [] ```",
        f"```\n{body}\n```",
        f"  \n{body}\t",
        f"```json{body}```",
    ]
    for row in parse(spark, *texts):
        assert row.ok and row.parse_ok and plain(row.boxes) == A_BOX


@pytest.mark.parametrize("text", ["", "no json", '{"boxes": [', boxes(BOX) + " and so on", "```", "{'boxes': []}", '{"a": 1} {"b": 2}'])
def test_unparsable_text_is_an_answer_without_labels(spark, text):
    (row,) = parse(spark, text)
    assert row.ok and not row.parse_ok and not any(row[kind] for kind in KINDS)


BAD = [
    "[]",
    "3",
    '"text"',
    "null",
    '{"boxes": null}',
    '{"boxes": 3}',
    '{"boxes": "abc"}',
    '{"boxes": {"a": 1}}',
    '{"boxes": [null]}',
    '{"boxes": ["a"]}',
    '{"boxes": [[]]}',
    boxes('{"label": "a", "xmin": null}'),
    boxes('{"label": "a", "xmin": "left"}'),
    boxes('{"label": "a", "xmin": []}'),
    boxes('{"label": "", "confidence": null}'),
    boxes('{"label": ["a"]}'),
    boxes('{"label": {"a": 1}}'),
    boxes(BOX, '{"label": "b", "ymax": null}'),
    '{"classifications": [{"label": "a", "confidence": "high"}]}',
    '{"segments": [{"label": "a", "polygon": null}]}',
    '{"segments": [{"label": "", "polygon": [{"x": null}]}]}',
    '{"segments": [{"label": "a", "polygon": [{}, {}, {}], "confidence": null}]}',
    '{"segments": [{"label": "a", "polygon": [1]}]}',
    '{"poses": [{"label": null, "keypoints": [{"name": "k"}]}]}',
    '{"poses": [{"keypoints": [{"name": "k", "x": null}]}]}',
    '{"poses": [{"keypoints": [{"name": ["k"]}]}]}',
    '{"texts": [{"text": "a", "xmin": null}]}',
    '{"tracks": [{"track_id": 1, "label": "a", "frame_id": null}]}',
    '{"tracks": [{"track_id": 1, "label": "a", "frame_id": "1.5"}]}',
]


def test_one_bad_item_spoils_the_answer(spark):
    for text, row in zip(BAD, parse(spark, *BAD)):
        assert row.parse_ok and not row.ok and row.error == "invalid value", text
        assert not any(row[kind] for kind in KINDS), text


GOOD = [
    ('{"boxes": ""}', "boxes", []),
    ('{"boxes": {}}', "boxes", []),
    ('{"other": [null]}', "boxes", []),
    (boxes('{"label": ["a"], "xmin": 1}'), "boxes", []),
    (boxes('{"label": "a"}'), "boxes", [("a", 0.0, 0.0, 1.0, 1.0, 1.0)]),
    (boxes('{"label": null}', '{"label": 0}', '{"label": false}', '{"label": []}', "{}"), "boxes", []),
    (boxes('{"label": 7}', '{"label": true}', '{"label": "0"}'), "boxes", [(x, 0.0, 0.0, 1.0, 1.0, 1.0) for x in ("7", "True", "0")]),
    (boxes('{"label": "a", "xmin": 100, "ymin": "200", "xmax": 5000, "ymax": 1.5, "confidence": 80}'), "boxes", []),
    (boxes('{"label": "a", "xmin": 1, "xmax": 500}'), "boxes", []),
    (boxes('{"label": "a", "xmin": -5, "xmax": 500, "confidence": -1}'), "boxes", [("a", 0.0, 0.0, 0.5, 1.0, 0.0)]),
    (boxes('{"label": "a", "confidence": 250, "extra": [1]}'), "boxes", [("a", 0.0, 0.0, 1.0, 1.0, 1.0)]),
    (boxes('{"label": "{x}", "confidence": true}'), "boxes", [("{x}", 0.0, 0.0, 1.0, 1.0, 1.0)]),
    (boxes('{"label": "true"}', '{"label": "[]"}'), "boxes", [(x, 0.0, 0.0, 1.0, 1.0, 1.0) for x in ("true", "[]")]),
    ('{"classifications": [{"label": "a", "confidence": "50"}, {"label": ""}]}', "classifications", [("a", 0.5)]),
    ('{"segments": [{"label": "a", "polygon": [{}, {"x": 500}]}]}', "segments", []),
    ('{"segments": [{"label": "a", "polygon": [], "confidence": null}]}', "segments", []),
    (
        '{"segments": [{"label": "a", "polygon": [{}, {"x": 500}, {"y": "0.5", "z": 1}]}]}',
        "segments",
        [("a", [(0.0, 0.0), (0.5, 0.0), (0.0, 0.5)], 1.0)],
    ),
    ('{"poses": [{"keypoints": [{"name": "", "x": null}]}]}', "poses", []),
    ('{"poses": [{"label": "", "keypoints": [{"name": "k"}], "confidence": 50}]}', "poses", [("", [("k", 0.0, 0.0, True, 1.0)], 0.5)]),
    ('{"texts": [{"text": "\\u00e9 \\"q\\"\\n", "xmin": 0.5}]}', "texts", [('é "q"\n', 0.5, 0.0, 1.0, 1.0, 1.0)]),
    (
        '{"tracks": [{"track_id": 7, "label": "a", "frame_id": 3.9}, {"track_id": "b", "label": "c", "frame_id": " 12 "}]}',
        "tracks",
        [("7", 3, "a", 0.0, 0.0, 1.0, 1.0, 1.0), ("b", 12, "c", 0.0, 0.0, 1.0, 1.0, 1.0)],
    ),
    ('{"tracks": [{"track_id": 0, "label": "a", "frame_id": null}]}', "tracks", []),
]


def test_items_are_kept_or_dropped_one_by_one(spark):
    for (text, kind, want), row in zip(GOOD, parse(spark, *[g[0] for g in GOOD])):
        assert row.ok and row.parse_ok, text
        assert plain(row[kind]) == want, text


def test_visibility(spark):
    values = [True, False, 1, 0, -1, 0.5, "true", " YES ", "1", "visible", "no", "2", None, [], {}]
    points = ", ".join(f'{{"name": "k", "visible": {json.dumps(v)}}}' for v in values)
    (row,) = parse(spark, f'{{"poses": [{{"keypoints": [{points}, {{"name": "k"}}]}}]}}')
    seen = [k.visible for k in row.poses[0].keypoints]
    assert seen == [True, False, True, False, False, True, True, True, True, True, False, False, False, False, False, True]


def test_failed_call(spark):
    (row,) = parse(spark, None)
    assert not row.ok and row.error == "no answer" and row.boxes == []


def test_long_text_is_read_whole(spark):
    word = "lorem \\\" ipsum "
    (row,) = parse(spark, '{"texts": [{"text": "' + word * 20_000 + '"}]}')
    assert row.texts[0].text == 'lorem " ipsum ' * 20_000


def test_schema_is_the_declared_one(spark):
    df = parse_answers(spark.createDataFrame([("{}",)], "raw_text string"))
    for kind, item in KINDS.items():
        assert df.schema[kind].dataType.elementType.simpleString() == item.replace("struct<", "struct<"), kind


def test_loose_json(spark):
    """NaN and Infinity outside texts, the last of repeated keys; broken tokens and trailing text stay unreadable."""
    box = '"ymin": 0, "ymax": 1}'
    rows = [
        ('{"boxes": [{"label": "NaN \\" -Infinity", "xmin": -Infinity, "xmax": NaN, ' + box + "]}", True, True, [('NaN " -Infinity', 0.0, 1.0)]),
        ('{"boxes": [{"label": "a", "xmin": 0.5, "xmin": 0.25, "xmax": Infinity, ' + box + ']}', True, True, [("a", 0.25, 1.0)]),
        ('{"boxes": 5, "boxes": []}', True, True, []),
        ('{"boxes": [{"label": "a", "xmin": NaNs, ' + box + "]}", False, True, []),
        ('{"boxes": []} NaN', False, True, []),
        ('{"tracks": [{"track_id": "t", "label": "x", "frame_id": Infinity}]}', True, False, []),
        ('{"boxes": [{"label": "' + "N I " * 3000 + '", "xmin": NaN, ' + box + "]}", True, True, []),
    ]
    df = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "n int, raw_text string")
    got = {r.n: (r.parse_ok, r.ok, [(b.label, b.xmin, b.xmax) for b in r.boxes]) for r in parse_answers(df).collect()}
    assert got == {n: r[1:] for n, r in enumerate(rows)}


def test_fixed_decimals_of_the_exact_value(spark):
    rng = random.Random(3)
    halves = [(rng.randint(0, 10**6) + 0.5) / 1e6 for _ in range(3000)]
    numbers = [x for h in halves for x in (h, math.nextafter(h, 2), math.nextafter(h, -1))]
    numbers += [0.1234565, 5e-7, -5e-7, 2.5e-7, 0.0, 1.0, -3.1234565, 123456.0000005, 1 / 128, 3 / 2**21, 7e9 + 0.5, rng.random()]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", fixed(F.col("x"), 6).alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.x:.6f}" for r in rows]


PLAIN = [
    boxes(BOX, '{"label": "b", "xmin": 100, "ymin": "200", "xmax": "0.5", "ymax": 600}', '{"label": "", "xmin": 0.1}', '{"xmin": 0.1}'),
    boxes('{"label": "7 cars", "xmin": null}'),
    '{"tracks": [{"track_id": 17, "frame_id": "4", "label": "a"}], "texts": [{"text": "a \\"null\\" text"}]}',
    '{"poses": [{"keypoints": [{"name": "nose", "x": 3, "visible": false}, {"name": ""}]}, {"keypoints": []}], "other": [1, {"a": null}]}',
    '{"segments": [{"label": "s", "polygon": [{"x": 1, "y": 2}, {"x": 0.3}, {}]}], "classifications": [{"label": "1-URGENT"}]}',
    "{}",
]
ODD = [
    boxes('{"label": 7}'), boxes('{"label": "7"}'), boxes('{"label": true}'), boxes('{"label": 1e400}'), boxes('{"label": "#null"}'), boxes('{"label": null}'),
    boxes('{"xmin": true, "label": "a"}'), boxes('{"xmin": "x", "label": "a"}'), boxes('{"label": ["a"]}'), '{"boxes": null}', '{"boxes": ""}', '{"boxes": {}}',
    boxes(BOX) + ',"z":"#end"}', "{'boxes': []}", boxes('{"label": "a", "xmax": NaN}'), '{"tracks": [{"track_id": 0, "label": "a"}]}',
]


@pytest.mark.parametrize("text", PLAIN + ODD)
def test_plain_answers_are_read_in_one_pass_with_the_same_result(spark, text):
    from tagloom.functions import answers

    body = answers._body_sql("raw_text")
    df = spark.createDataFrame([(text,)], "raw_text string")
    plain_one = answers._let("body", body, answers._plain_sql("body"))
    any_one = answers._let("body", body, answers._any_sql("body"))
    row = df.selectExpr(f"to_json({plain_one}) AS plain", f"to_json({any_one}) AS whole").first()
    assert row.plain == row.whole if text in PLAIN else row.plain in (None, row.whole)


NUMERIC = [
    boxes(BOX, '{"label": "b", "xmin": 100, "ymin": 200.5, "xmax": -0, "ymax": 1e999}', '{"label": "", "xmin": 0.1}', '{"xmin": 0.1}', '{"label": "tree"}'),
    '{"boxes": [{"label": "a", "xmin": 0.5, "xmin": 0.25, "xmax": 123456789012345678901234567890, "confidence": 100}], "boxes": [{"label": "c"}]}',
    '{"tracks": [{"track_id": 17, "frame_id": "4", "label": "a"}, {"track_id": "t", "label": ""}], "texts": [{"text": "0.5 km"}, {"text": "x", "xmax": 900}]}',
    '{"poses": [{"label": "p", "keypoints": [{"name": "nose", "x": 3, "visible": false}, {"name": "", "confidence": 70}]}, {"keypoints": []}, {}]}',
    '{"segments": [{"label": "s", "polygon": [{"x": 1, "y": 2}, {"x": 0.3}, {}], "confidence": 7}, {"label": "s"}], "classifications": [{"label": "1-URGENT"}]}',
    "{}",
]


@pytest.mark.parametrize("text", NUMERIC + PLAIN + ODD + [boxes('{"label": "a", "xmin": "NaN"}'), boxes('{"label": "a", "xmin": [0.5]}'), '{"tracks": [{"track_id": "1", "label": "d", "frame_id": -1}]}'])
def test_numbers_are_read_as_numbers_with_the_same_result(spark, text):
    from tagloom.functions import answers

    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # as parse_answers does
    df = spark.createDataFrame([(text,)], "raw_text string")
    one = lambda read: answers._let("body", answers._body_sql("raw_text"), read)
    row = df.selectExpr(f"to_json({one(answers._numeric_sql('body'))}) AS read", f"to_json({one(answers._any_sql('body'))}) AS whole").first()
    assert row.read == row.whole if text in NUMERIC + PLAIN[1:] else row.read in (None, row.whole)
    # the answer is there without the other two ways
    if text in NUMERIC:
        alone = answers._numeric_sql("body").replace(answers._plain_sql("body"), "NULL")
        assert df.selectExpr(f"to_json({one(alone)}) AS read").first().read == row.whole


def test_mean_confidence_makes_its_list_once(spark):
    from tagloom.functions.labels import mean_confidence

    parsed = parse_answers(spark.createDataFrame([('{"boxes": [{"label": "a", "confidence": 0.5}], "poses": [{"keypoints": [{"name": "n", "confidence": 0.7}], "confidence": 0.3}]}',), ("{}",)], "raw_text string"))
    assert [round(r.m, 9) for r in parsed.select(mean_confidence().alias("m")).collect()] == [0.5, 0.0]
    assert parsed.select(mean_confidence().alias("m"))._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1


CUT = ['{"boxes":[' + BOX, '{"boxes": [', '{"boxes":[{"label":"a","xmin":0.1},{"label":"b"}', '{"boxes":[{"label":"[a]"}', '{"a":[]}}', "[", '"[']
WHOLE = [boxes(BOX), "", "[]", '{"a": "["}', '{"a": "}{", "b": 1}', '{"a": "\\"["}', '1,"#end"]', "1],[2", '{"boxes": []} and {']


def test_text_whose_brackets_do_not_pair_up_is_told_without_reading_it(spark):
    from tagloom.functions import answers

    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = spark.createDataFrame([(text,) for text in CUT + WHOLE[:-1]], "body string")
    rows = df.selectExpr("body", f"{answers._cut_sql('body')} AS cut", f"to_json({answers._any_sql('body')}) AS whole", f"to_json({answers._answer_sql('body')}) AS read").collect()
    assert {r.body for r in rows if r.cut} == set(CUT)
    assert all(r.read == r.whole for r in rows)
    (row,) = parse(spark, WHOLE[-1])
    assert row.ok and not row.parse_ok
    nulls = [boxes('{"label": ":null", "xmin":null}'), boxes('{"label":"a","xmax":null}'), '{"a":":null","boxes":[{"label":"b"}]}', boxes('{"label":"x null","confidence":null}')]
    for text, row in zip(nulls, parse(spark, *nulls)):
        assert row.parse_ok and row.ok == ("xm" not in text and "conf" not in text), text
