"""From the free text of a model answer to typed label arrays, as Spark SQL over VARIANT.

What JSON readers commonly take counts as JSON: bare NaN and Infinity, and of repeated keys the last. The latter is a setting of
the session (``spark.sql.variant.allowDuplicateKeys``), which :func:`parse_answers` switches on.

An answer is judged as a whole: one item that cannot be read (not an object, a
coordinate that is null or not a number, a label that is a list) makes the
answer not ``ok`` and leaves it without labels. Items that are merely unusable
(no label, an empty box, too few points) are dropped one by one.

Most answers are plain: JSON whose members have the types asked for. These are read by ``from_json`` in one pass, which is
several times faster: with numbers as numbers (:func:`_numeric_sql`), or, where some come as texts or null, with all members as texts
(:func:`_plain_sql`). Whatever these can't tell for sure is left to VARIANT. The result is the same.

The expressions are SQL text: one parse by the JVM instead of thousands of
calls to build the same tree from Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.schemas import KINDS

# Appended behind the answer inside an array: text after the JSON value then breaks the parse.
_END = "#end"

_SPACE = r"r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$'"
# Begins and ends with a sign that is no space: nothing to strip. Only the ends are looked at.
_STRIPPED = "(startswith({0}, '{{') AND endswith({0}, '}}') OR ascii({0}) BETWEEN 33 AND 126 AND ascii(substring({0}, -1, 1)) BETWEEN 33 AND 126)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _strip(text: str) -> str:
    whole = f"CASE WHEN {_STRIPPED.format('t')} THEN t ELSE regexp_replace(t, {_SPACE}, '') END"
    # the pattern tries each place of a text, so that most blanks go before
    trimmed = _let("t", "btrim(s, ' \\t\\n\\r')", whole)
    return _let("s", text, f"CASE WHEN {_STRIPPED.format('s')} THEN s ELSE {trimmed} END")


def _body_sql(text: str) -> str:
    rest = f"substring({text}, locate('```json', {text}) + 7)"
    closed = _let("rest", rest, f"CASE WHEN contains(rest, '```') THEN substring_index(rest, '```', 1) ELSE {text} END")
    fenced = f"CASE WHEN contains({text}, '```json') THEN {closed} ELSE {text} END"
    bare = "startswith(body, '```') AND endswith(body, '```')"
    inner = _strip("substring(body, 4, greatest(length(body) - 6, 0))")
    return _let("body", _strip(fenced), f"CASE WHEN {bare} THEN {inner} ELSE body END")


# Up to the next bare token: whole strings, and all that doesn't begin with the token's first letter.
_BEFORE_NAN = r"""((?:[^"N]++|"(?:[^"\\]++|\\.)*+"|N(?!aN))*+)"""
_BEFORE_INFINITY = r"""((?:[^"I]++|"(?:[^"\\]++|\\.)*+"|I(?!nfinity))*+)"""


def _plain_numbers(body: str) -> str:
    """Bare NaN as a text that reads as that number, bare Infinity as a number beyond any scale."""
    nan = rf"""regexp_replace({body}, r'(?s)\G{_BEFORE_NAN}NaN', '$1"NaN"')"""
    both = rf"regexp_replace({nan}, r'(?s)\G{_BEFORE_INFINITY}Infinity', '$19e307')"
    return f"CASE WHEN contains({body}, 'NaN') OR contains({body}, 'Infinity') THEN {both} ELSE {body} END"


def answer_json_text(text_column: str) -> Column:
    """JSON part of an answer: the first fenced json block, else the text without bare fences."""
    return F.expr(_body_sql(f"`{text_column}`"))


def parse_answer(text_column: str) -> Column:
    """Struct of ``parse_ok``, ``ok`` and the six label arrays of one answer text."""
    return F.expr(_answer_sql(f"`{text_column}`"))


def parse_answers(responses: DataFrame, text_column: str = "raw_text") -> DataFrame:
    """Add ``parse_ok``, ``ok``, ``error`` and the six label arrays to a table of answers.

    Unparsable text is a good answer without labels (``parse_ok`` false); a null
    text, left by a failed call, is a bad one.
    """
    responses.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    answered = F.col(text_column).isNotNull()
    return responses.withColumn("_answer", parse_answer(text_column)).select(
        *responses.columns,
        F.col("_answer.parse_ok").alias("parse_ok"),
        (answered & F.col("_answer.ok")).alias("ok"),
        F.when(~answered, "no answer").when(~F.col("_answer.ok"), "invalid value").alias("error"),
        *[F.col(f"_answer.{kind}").alias(kind) for kind in KINDS],
    )


# --- the answer as a whole -------------------------------------------------------------------------


def _answer_sql(text: str) -> str:
    read = f"coalesce({_numeric_sql('body')}, {_any_sql('body')})"
    return _let("body", _body_sql(text), f"CASE WHEN {_cut_sql('body')} THEN {_plain_answer('true', _NO_LABELS, 'false')} ELSE {read} END")


def _cut_sql(body: str) -> str:
    """True only for text that is surely no JSON, as its brackets outside strings don't pair up: each reader would fail on it, which is dear.

    Without a backslash, strings are what stands between a quote and the next. Without ``_END`` in it, text is read up to the
    end behind it, or not at all. An object that ends with a list, as nearly all answers do, is left to the readers uncounted.
    """
    unequal = lambda text: " OR ".join(f"octet_length(replace({text}, '{a}', '')) <> octet_length(replace({text}, '{b}', ''))" for a, b in ("[]", "{}"))
    outside = _let("outside", f"""regexp_replace({body}, '"[^"]*"', '')""", unequal("outside"))
    return f"(NOT endswith({body}, ']}}') AND ({unequal(body)}) AND NOT contains({body}, r'\\') AND NOT contains({body}, '{_END}') AND {outside})"


def _any_sql(body: str) -> str:
    """The answer in ``body``, whatever its members are."""
    doc = f"try_parse_json(concat('[', {_plain_numbers(body)}, ',\"{_END}\"]'))"
    readable = (
        f"coalesce(try_variant_get(doc, '$[1]', 'string') = '{_END}' AND variant_get(doc, '$[2]', 'variant') IS NULL, false)"
    )
    is_object = "try_variant_get(doc, '$[0]', 'map<string,variant>') IS NOT NULL"
    items = [f"'{kind}', {_read_kind(kind)}" for kind in KINDS]
    fine = " AND ".join(f"coalesce(items.{kind}.fine, true)" for kind in KINDS)
    ok = f"coalesce(CASE WHEN readable THEN {fine} AND {is_object} ELSE true END, false)"

    def kept(kind: str) -> str:
        usable = f"transform(filter(items.{kind}.judged, i -> i.keep), i -> i.value)"
        none = f"CAST(array() AS array<{KINDS[kind]}>)"
        return f"'{kind}', CASE WHEN ok AND items.{kind} IS NOT NULL THEN coalesce({usable}, {none}) ELSE {none} END"

    result = f"named_struct('parse_ok', readable, 'ok', ok, {', '.join(kept(kind) for kind in KINDS)})"
    for name, value in (("ok", ok), ("items", f"named_struct({', '.join(items)})"), ("readable", readable), ("doc", doc)):
        result = _let(name, value, result)
    return result


# A bare null as a text of its own, so that it isn't taken for a missing member.
_NULL = "#null"
_BEFORE_NULL = r"""((?:[^"n]++|"(?:[^"\\]++|\\.)*+"|n(?!ull))*+)"""
_PLAIN_BYTES = 1_000_000
_JSON_OPTIONS = "'mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_bad', 'allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false'"
_NO_LABELS = {kind: f"CAST(array() AS array<{KINDS[kind]}>)" for kind in KINDS}


def _plain_answer(ok: str, values: dict[str, str], parse_ok: str = "true") -> str:
    members = ", ".join(f"'{kind}', {values[kind]}" for kind in KINDS)
    return f"named_struct('parse_ok', {parse_ok}, 'ok', {ok}, {members})"


def _numeric_sql(body: str) -> str:
    """The answer if it is sure with its numbers read as numbers; null if it is for VARIANT; else that of :func:`_plain_sql`.

    A missing number is the only null here: answers with the word aren't tried, to save time neither are those that begin a box with a
    text for a number, and any other type makes ``from_json`` fill ``_bad``.
    """
    kinds = ", ".join(f"{kind}: array<struct<{_NUMERIC[kind][0]}>>" for kind in KINDS)
    other = f"""octet_length({body}) > {_PLAIN_BYTES} OR contains({body}, '"xmin":"') OR contains({body}, 'null') OR contains({body}, '{_END}')"""
    whole = f"""concat('{{"a":', {body}, ',"z":"{_END}"}}')"""
    read = f"CASE WHEN NOT ({other}) THEN from_json({whole}, 'struct<a: struct<{kinds}>, z: string, _bad: string>', map({_JSON_OPTIONS})) END"
    made = ", ".join(f"'{kind}', {_NUMERIC[kind][1].replace('{0}', f'typed.a.{kind}')}" for kind in KINDS)
    sure = " AND ".join(f"coalesce(forall(made.{kind}, i -> {_NUMERIC[kind][2]}), true)" for kind in KINDS)
    kept = {kind: f"coalesce(filter(made.{kind}, i -> coalesce({_NUMERIC[kind][3]}, false)), {_NO_LABELS[kind]})" for kind in KINDS}
    kept = {kind: f"transform({kept[kind]}, i -> {_NUMERIC[kind][4]})" if _NUMERIC[kind][4] else kept[kind] for kind in KINDS}
    good = _let("made", f"named_struct({made})", f"CASE WHEN {sure} THEN {_plain_answer('true', kept)} END")
    fine = f"typed.z = '{_END}' AND typed._bad IS NULL AND typed.a IS NOT NULL"
    return _let("typed", read, f"CASE WHEN {fine} THEN {good} ELSE {_plain_sql(body)} END")


def _plain_sql(body: str) -> str:
    """The answer if its members have the types asked for, else null. All members are read as texts.

    A number and a text of the same digits count alike, so a text that casts is enough for a number; a text that might come from
    something else (``_NOT_SURELY_TEXT``) is not. Any other type, repeated objects of different types or a broken end
    make ``from_json`` fill ``_bad``.
    """
    kinds = ", ".join(f"{kind}: array<struct<{_PLAIN[kind][0]}>>" for kind in KINDS)
    # a quote before it ends a string where no backslash is about; if it begins one, the marked text is no JSON, and left to VARIANT
    after_key = rf"""NOT contains({body}, r'\') AND NOT contains(replace({body}, '":null', ''), 'null') THEN replace({body}, '":null', '":"{_NULL}"')"""
    marked = rf"""CASE WHEN NOT contains({body}, 'null') THEN {body} WHEN {after_key} ELSE regexp_replace({body}, r'(?s)\G{_BEFORE_NULL}null', '$1"{_NULL}"') END"""
    own = f"octet_length({body}) > {_PLAIN_BYTES} OR contains({body}, '{_END}') OR contains({body}, '{_NULL}')"
    whole = f"""concat('{{"a":', {marked}, ',"z":"{_END}"}}')"""
    read = f"CASE WHEN NOT ({own}) THEN from_json({whole}, 'struct<a: struct<{kinds}>, z: string, _bad: string>', map({_JSON_OPTIONS})) END"
    none = _NO_LABELS

    nulls = " OR ".join(
        f"coalesce(exists(read.a.{kind}, i -> {' OR '.join(f"coalesce(i.{key} = '{_NULL}', false)" for key in keys)}), false)"
        for kind, keys in {"classifications": _CONFIDENCE, "boxes": _BOX, "texts": _BOX, "tracks": _BOX}.items()
    )
    made = ", ".join(f"'{kind}', {_PLAIN[kind][1].replace('{0}', f'read.a.{kind}')}" for kind in KINDS)
    sure = " AND ".join(f"coalesce(forall(made.{kind}, i -> {_PLAIN[kind][2]}), true)" for kind in KINDS)
    kept = {kind: f"coalesce(filter(made.{kind}, i -> coalesce({_PLAIN[kind][3]}, false)), {none[kind]})" for kind in KINDS}
    # the values of an item without what only the checks need
    kept = {kind: f"transform({kept[kind]}, i -> {_PLAIN[kind][4]})" if _PLAIN[kind][4] else kept[kind] for kind in KINDS}
    good = _let("made", f"named_struct({made})", f"CASE WHEN {sure} THEN {_plain_answer('true', kept)} END")
    judged = f"CASE WHEN contains({body}, 'null') AND ({nulls}) THEN {_plain_answer('false', none)} ELSE {good} END"
    return _let("read", read, f"CASE WHEN read.z = '{_END}' AND read._bad IS NULL AND read.a IS NOT NULL THEN {judged} END")


def _read_kind(kind: str) -> str:
    """Null if the answer has no such key, else the judged items and whether all of them are fine.

    The list is cast in one go to typed structs. A field that is then null may be
    missing, null or unreadable; only for those the item itself (``items[i]``) is looked at.
    """
    cast, judged = _READERS[kind]
    path = f"'$[0].{kind}'"
    both = _let(
        "items",
        f"try_variant_get(doc, {path}, 'array<variant>')",
        _let("judged", f"transform(typed, (t, i) -> {judged})", f"named_struct('judged', judged, 'fine', {_list_fine('raw')})"),
    )
    read = _let("typed", f"try_variant_get(doc, {path}, 'array<struct<{cast}>>')", both)
    return f"CASE WHEN readable THEN {_let('raw', f'variant_get(doc, {path}, {_VARIANT})', f'CASE WHEN raw IS NOT NULL THEN {read} END')} END"


_VARIANT = "'variant'"


def _list_fine(raw: str) -> str:
    """A list of objects without a bad one; something else only if there is nothing to iterate."""
    return (
        f"CASE WHEN typed IS NULL THEN to_json({raw}) IN ('\"\"', '{{}}')"
        " ELSE NOT exists(typed, t -> t IS NULL) AND NOT exists(judged, j -> j.bad) END"
    )


# --- members of an item: t is its typed struct, items[i] the item as it came -------------------------


def _number(key: str, default: str, typed: str = "t", item: str = "items[i]") -> str:
    """Number or numeric text; the default if the key is missing, null if it is there and unreadable."""
    return f"coalesce({typed}.{key}, CASE WHEN variant_get({item}, '$.{key}', 'variant') IS NULL THEN {default} END)"


def _unit(value: str, scale: int) -> str:
    """Scaled to 0..1: what is above 1 counts on the 0..scale range. Null stays null."""
    return f"CASE WHEN {value} <= 1D THEN greatest(0D, {value}) WHEN {value} > 1D THEN least(1D, {value} / {scale}D) END"


def _units(defaults: dict[str, float], typed: str = "t", item: str = "items[i]") -> str:
    return ", ".join(
        f"{_unit(_number(key, f'{default}D', typed, item), 100 if key == 'confidence' else 1000)} AS `{key}`"
        for key, default in defaults.items()
    )


# A text that looks like this may come from a number, a boolean, a list or an object.
_NOT_SURELY_TEXT = r"r'^([-0-9\[{]|true$|false$)'"


def _named(key: str, name: str, typed: str = "t", item: str = "items[i]") -> str:
    """Start of the JSON text of a member, null if missing (it tells the type), and its string value."""
    text = f"{typed}.{key}"
    unsure = f"{text} IS NULL OR rlike({text}, {_NOT_SURELY_TEXT})"
    json = (
        f"CASE WHEN {unsure} THEN to_json(variant_get({item}, '$.{key}', 'variant'))"
        f" WHEN {text} = '' THEN '\"\"' ELSE '\"' END"
    )
    return f"{json} AS `{name}_json`, {text} AS `{name}_text`"


def _truthy(raw: str, name: str) -> str:
    """Neither missing nor null, false, zero or empty."""
    json = f"{raw}.{name}_json"
    return (
        f"CASE WHEN {json} IS NULL OR {json} IN ('null', 'false', '\"\"', '[]', '{{}}') THEN false"
        f" WHEN rlike({json}, '^[-0-9]') THEN try_cast({json} AS DOUBLE) <> 0 ELSE true END"
    )


def _nested(raw: str, name: str) -> str:
    json = f"{raw}.{name}_json"
    return f"coalesce(startswith({json}, '[') OR startswith({json}, '{{'), false)"


def _text(raw: str, name: str) -> str:
    return f"CASE {raw}.{name}_json WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE {raw}.{name}_text END"


def _flag(raw: str, name: str) -> str:
    """Loose boolean: true unless missing, numbers by sign, a few words, all else false."""
    json, words = f"{raw}.{name}_json", "'true', '1', 'yes', 'visible'"
    return (
        f"CASE WHEN {json} IS NULL OR {json} = 'true' THEN true"
        f" WHEN startswith({json}, '\"') THEN lower({_strip(f'{raw}.{name}_text')}) IN ({words})"
        f" WHEN rlike({json}, '^[-0-9]') THEN try_cast({json} AS DOUBLE) > 0 ELSE false END"
    )


def _any_null(raw: str, *keys: str) -> str:
    return "(" + " OR ".join(f"{raw}.{key} IS NULL" for key in keys) + ")"


def _fields(raw: str, *keys: str) -> str:
    return ", ".join(f"{raw}.{key} AS `{key}`" for key in keys)


_CONFIDENCE = {"confidence": 1.0}
_BOX = {"xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0, **_CONFIDENCE}
_BOX_CAST = ", ".join(f"{key}: double" for key in _BOX)
_HAS_AREA = "(r.xmin < r.xmax AND r.ymin < r.ymax)"


# --- one reader per kind: the typed cast of an item, and {bad, keep, value} of it -----------------------


def _judge(members: str, keep: str, bad: str, value: str) -> str:
    """Bring the members of an item into a struct ``r`` once, then judge it."""
    verdict = _let(
        "keep",
        f"coalesce({keep}, false)",
        f"named_struct('bad', coalesce({bad}, true), 'keep', keep, 'value', struct({value}))",
    )
    return _let("r", f"struct({members})", verdict)


def _boxed(name: str) -> tuple[str, str]:
    """Boxes and text regions differ only in the member that names them."""
    return f"{name}: string, {_BOX_CAST}", _judge(
        f"{_named(name, name)}, {_units(_BOX)}",
        f"{_truthy('r', name)} AND {_HAS_AREA}",
        f"{_any_null('r', *_BOX)} OR (keep AND {_nested('r', name)})",
        f"{_text('r', name)} AS `{name}`, {_fields('r', *_BOX)}",
    )


_CLASSIFICATION = (
    "label: string, confidence: double",
    _judge(
        f"{_named('label', 'label')}, {_units(_CONFIDENCE)}",
        _truthy("r", "label"),
        f"{_any_null('r', 'confidence')} OR (keep AND {_nested('r', 'label')})",
        f"{_text('r', 'label')} AS label, {_fields('r', 'confidence')}",
    ),
)


def _points(key: str, cast: str, members: str, keep: str | None = None) -> str:
    """Nested list under a key as {fine, points}: fine if it is missing or a list of objects."""
    point = f"struct({members})"
    listed = f"transform(nested_typed, (n, j) -> {point})"
    if keep:
        listed = f"filter({listed}, k -> {keep})"
    fine = (
        "CASE WHEN nested_typed IS NULL THEN nested_raw IS NULL OR to_json(nested_raw) IN ('\"\"', '{}')"
        " ELSE NOT exists(nested_typed, n -> n IS NULL) END"
    )
    made = f"named_struct('fine', {fine}, 'points', coalesce({listed}, array()))"
    for name, target in (("nested_items", "array<variant>"), ("nested_typed", f"array<struct<{cast}>>"), ("nested_raw", "variant")):
        get = "variant_get" if target == "variant" else "try_variant_get"
        made = _let(name, f"{get}(items[i], '$.{key}', '{target}')", made)
    return made


_XY = {"x": 0.0, "y": 0.0}

_SEGMENT = (
    "label: string, confidence: double",
    _judge(
        f"{_named('label', 'label')}, {_units(_CONFIDENCE)},"
        f" {_points('polygon', 'x: double, y: double', _units(_XY, 'n', 'nested_items[j]'))} AS polygon",
        f"{_truthy('r', 'label')} AND size(r.polygon.points) >= 3",
        f"NOT r.polygon.fine OR exists(r.polygon.points, p -> {_any_null('p', 'x', 'y')})"
        f" OR (keep AND ({_any_null('r', 'confidence')} OR {_nested('r', 'label')}))",
        f"{_text('r', 'label')} AS label, r.polygon.points AS polygon, {_fields('r', 'confidence')}",
    ),
)

_KEYPOINT_MEMBERS = ", ".join(
    (
        _named("name", "name", "n", "nested_items[j]"),
        _units({**_XY, **_CONFIDENCE}, "n", "nested_items[j]"),
        _named("visible", "visible", "n", "nested_items[j]"),
    )
)
_KEYPOINT = f"{_text('k', 'name')} AS name, {_fields('k', 'x', 'y')}, {_flag('k', 'visible')} AS visible, {_fields('k', 'confidence')}"

_POSE = (
    "label: string, confidence: double",
    _judge(
        f"{_named('label', 'label')}, {_units(_CONFIDENCE)}, "
        + _points(
            "keypoints",
            "name: string, x: double, y: double, visible: string, confidence: double",
            _KEYPOINT_MEMBERS,
            _truthy("k", "name"),
        )
        + " AS keypoints",
        "size(r.keypoints.points) > 0",
        "NOT r.keypoints.fine"
        f" OR exists(r.keypoints.points, k -> {_any_null('k', 'x', 'y', 'confidence')} OR {_nested('k', 'name')})"
        f" OR (keep AND ({_any_null('r', 'confidence')} OR coalesce(r.label_json = 'null', false) OR {_nested('r', 'label')}))",
        f"CASE WHEN r.label_json IS NULL THEN 'person' ELSE {_text('r', 'label')} END AS label,"
        f" transform(r.keypoints.points, k -> struct({_KEYPOINT})) AS keypoints, {_fields('r', 'confidence')}",
    ),
)

_TRACK = (
    f"track_id: string, frame_id: bigint, label: string, {_BOX_CAST}",
    _judge(
        f"{_named('track_id', 'id')}, {_named('label', 'label')}, {_units(_BOX)}, {_number('frame_id', '0L')} AS frame_id",
        f"{_truthy('r', 'id')} AND {_truthy('r', 'label')} AND {_HAS_AREA}",
        f"{_any_null('r', *_BOX)} OR (keep AND ({_any_null('r', 'frame_id')} OR {_nested('r', 'label')}))",
        f"{_text('r', 'id')} AS track_id, r.frame_id AS frame_id, {_text('r', 'label')} AS label, {_fields('r', *_BOX)}",
    ),
)

_READERS: dict[str, tuple[str, str]] = {
    "classifications": _CLASSIFICATION,
    "boxes": _boxed("label"),
    "segments": _SEGMENT,
    "poses": _POSE,
    "texts": _boxed("text"),
    "tracks": _TRACK,
}


# --- plain items: i is the item once its numbers are made ----------------------------------------------
# The texts of an item, its members made from them (null where that fails), whether they are sure, whether the
# item is kept, and its value if that differs.


def _plain_numbers_of(item: str, defaults: dict[str, float]) -> str:
    return ", ".join(f"CASE WHEN {item}.{key} IS NULL THEN {default}D ELSE try_cast({item}.{key} AS DOUBLE) END AS `{key}`" for key, default in defaults.items())


def _plain_units(item: str, defaults: dict[str, float]) -> str:
    return ", ".join(f"{_unit(f'{item}.{key}', 100 if key == 'confidence' else 1000)} AS `{key}`" for key in defaults)


def _there(item: str, *keys: str) -> str:
    return " AND ".join(f"{item}.{key} IS NOT NULL" for key in keys)


# A text of these may come from a number, a boolean, a list, an object, or a marked null.
_NOT_SURELY_PLAIN = r"""r'(?s)^(?:-?[0-9][-+0-9.eE]*\z|true\z|false\z|[\[{#"])'"""


def _sure_text(text: str) -> str:
    return f"({text} IS NULL OR NOT rlike({text}, {_NOT_SURELY_PLAIN}))"


def _texts(defaults: dict[str, float]) -> str:
    return ", ".join(f"{key}: string" for key in defaults)


def _plain_boxed(name: str, more: str = "", extra: str = "") -> tuple[str, str, str, str, str]:
    numbers = f"transform({{0}}, t -> struct({extra}t.{name} AS `{name}`, {_plain_numbers_of('t', _BOX)}))"
    fields = f"{more}n.{name} AS `{name}`, {_plain_units('n', _BOX)}"
    area = "i.xmin < i.xmax AND i.ymin < i.ymax"
    return (
        f"{name}: string, {_texts(_BOX)}",
        f"transform({numbers}, n -> struct({fields}))",
        f"{_there('i', *_BOX)} AND {_sure_text(f'i.{name}')}",
        f"i.{name} <> '' AND {area}",
        "",
    )


_ID = r"r'^[1-9][0-9]{0,17}$'"
_FRAME = "CASE WHEN t.frame_id IS NULL THEN 0L WHEN rlike(t.frame_id, r'^[0-9]{1,18}$') THEN try_cast(t.frame_id AS BIGINT) END AS frame_id, "
_track = _plain_boxed("label", "n.track_id AS track_id, n.frame_id AS frame_id, ", "t.track_id AS track_id, " + _FRAME)

_POINT_NUMBERS = f"struct({_plain_numbers_of('q', _XY)})"
_POINT_UNITS = f"struct({_plain_units('q', _XY)})"
_KEY = {**_XY, **_CONFIDENCE}
_VISIBLE = "CASE WHEN q.visible IS NULL THEN true WHEN q.visible = 'true' THEN true WHEN q.visible = 'false' THEN false END AS visible"
_KEY_NUMBERS = f"struct(q.name AS name, {_plain_numbers_of('q', _KEY)}, {_VISIBLE})"
_KEY_UNITS = f"struct(q.name AS name, {_plain_units('q', _XY)}, q.visible AS visible, {_plain_units('q', _CONFIDENCE)})"


def _nested_plain(key: str, numbers: str, units: str) -> str:
    return f"coalesce(transform(transform(t.{key}, q -> {numbers}), q -> {units}), array()) AS {key}"


def _plain_list(key: str, numbers: str, units: str) -> str:
    listed = f"struct(t.label AS label, {_nested_plain(key, numbers, units)}, {_plain_numbers_of('t', _CONFIDENCE)})"
    return f"transform(transform({{0}}, t -> {listed}), n -> struct(n.label AS label, n.{key} AS {key}, {_plain_units('n', _CONFIDENCE)}))"


_PLAIN: dict[str, tuple[str, str, str, str, str]] = {
    "classifications": (
        "label: string, confidence: string",
        f"transform(transform({{0}}, t -> struct(t.label AS label, {_plain_numbers_of('t', _CONFIDENCE)})), n -> struct(n.label AS label, {_plain_units('n', _CONFIDENCE)}))",
        f"i.confidence IS NOT NULL AND {_sure_text('i.label')}",
        "i.label <> ''",
        "",
    ),
    "boxes": _plain_boxed("label"),
    "segments": (
        f"label: string, polygon: array<struct<{_texts(_XY)}>>, confidence: string",
        _plain_list("polygon", _POINT_NUMBERS, _POINT_UNITS),
        f"i.confidence IS NOT NULL AND {_sure_text('i.label')} AND forall(i.polygon, q -> {_there('q', *_XY)})",
        "i.label <> '' AND size(i.polygon) >= 3",
        "",
    ),
    "poses": (
        f"label: string, keypoints: array<struct<name: string, {_texts(_KEY)}, visible: string>>, confidence: string",
        _plain_list("keypoints", _KEY_NUMBERS, _KEY_UNITS),
        f"i.confidence IS NOT NULL AND {_sure_text('i.label')} AND forall(i.keypoints, q -> {_there('q', *_KEY, 'visible')} AND {_sure_text('q.name')})",
        "exists(i.keypoints, q -> coalesce(q.name <> '', false))",
        "struct(coalesce(i.label, 'person') AS label, filter(i.keypoints, q -> coalesce(q.name <> '', false)) AS keypoints, i.confidence AS confidence)",
    ),
    "texts": _plain_boxed("text"),
    "tracks": (
        f"track_id: string, frame_id: string, {_track[0]}",
        _track[1],
        f"{_track[2]} AND i.frame_id IS NOT NULL AND ({_sure_text('i.track_id')} OR rlike(i.track_id, {_ID}))",
        f"i.track_id <> '' AND {_track[3]}",
        "",
    ),
}


# --- the same with numbers as numbers, in one pass: a missing one is the default, and none is unreadable ----------------------


def _numeric_units(item: str, defaults: dict[str, float]) -> str:
    def unit(key: str, default: float) -> str:
        value = f"{item}.{key}"
        return f"CASE WHEN {value} <= 1D THEN greatest(0D, {value}) WHEN {value} > 1D THEN least(1D, {value} / {100 if key == 'confidence' else 1000}D) ELSE {default}D END"

    return ", ".join(f"{unit(key, default)} AS `{key}`" for key, default in defaults.items())


def _numbers(defaults: dict[str, float]) -> str:
    return ", ".join(f"{key}: double" for key in defaults)


def _numeric_boxed(name: str, more: str = "") -> tuple[str, str, str, str, str]:
    return (
        f"{name}: string, {_numbers(_BOX)}",
        f"transform({{0}}, t -> struct({more}t.{name} AS `{name}`, {_numeric_units('t', _BOX)}))",
        _sure_text(f"i.{name}"),
        f"i.{name} <> '' AND i.xmin < i.xmax AND i.ymin < i.ymax",
        "",
    )


def _numeric_list(key: str, point: str) -> str:
    return f"transform({{0}}, t -> struct(t.label AS label, coalesce(transform(t.{key}, q -> struct({point})), array()) AS {key}, {_numeric_units('t', _CONFIDENCE)}))"


_numeric_track = _numeric_boxed("label", f"t.track_id AS track_id, {_FRAME}")

_NUMERIC: dict[str, tuple[str, str, str, str, str]] = {
    "classifications": (
        "label: string, confidence: double",
        f"transform({{0}}, t -> struct(t.label AS label, {_numeric_units('t', _CONFIDENCE)}))",
        _sure_text("i.label"),
        "i.label <> ''",
        "",
    ),
    "boxes": _numeric_boxed("label"),
    "segments": (
        f"label: string, polygon: array<struct<{_numbers(_XY)}>>, confidence: double",
        _numeric_list("polygon", _numeric_units("q", _XY)),
        _sure_text("i.label"),
        "i.label <> '' AND size(i.polygon) >= 3",
        "",
    ),
    "poses": (
        f"label: string, keypoints: array<struct<name: string, {_numbers(_KEY)}, visible: string>>, confidence: double",
        _numeric_list("keypoints", f"q.name AS name, {_numeric_units('q', _XY)}, {_VISIBLE}, {_numeric_units('q', _CONFIDENCE)}"),
        f"{_sure_text('i.label')} AND forall(i.keypoints, q -> q.visible IS NOT NULL AND {_sure_text('q.name')})",
        _PLAIN["poses"][3],
        _PLAIN["poses"][4],
    ),
    "texts": _numeric_boxed("text"),
    "tracks": (
        f"track_id: string, frame_id: string, {_numeric_track[0]}",
        _numeric_track[1],
        f"{_numeric_track[2]} AND i.frame_id IS NOT NULL AND ({_sure_text('i.track_id')} OR rlike(i.track_id, {_ID}))",
        f"i.track_id <> '' AND {_numeric_track[3]}",
        "",
    ),
}
