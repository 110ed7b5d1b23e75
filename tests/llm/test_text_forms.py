"""Filter audit, fill-in-middle and chat formatting against plain versions, with nulls, ties, repeats and long texts."""

import hashlib
import itertools
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import audit, chat, infill


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- filter audit

AUDITED = "doc_id long, text string, source string, mask int, part string, words string, rows long, same string"


def plain_audit(rows, labels):
    fails = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)}
        found |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        fails.append({x for x, bad in found.items() if bad})
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out = {}
    for part in {r[2] or "" for r in rows}:
        inside = [(f, r[0]) for f, r in zip(fails, rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                before = set(order[:step])
                removed = [i for f, i in inside if x in f and not f & before]
                shapley[x] += len(removed)
                out[part, "".join(order), step + 1] = [
                    sum(not f & (before | {x}) for f, _ in inside),
                    len(removed),
                    sum(x in f and bool(f & before) for f, _ in inside),
                    sum(f == {x} for f, _ in inside),
                    sum(i in good and i is not None for i in removed),
                    sum(i in toxic and i is not None for i in removed),
                ]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 9, "x", "y", 3, "z") for r in rows], AUDITED)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audited(audit.cells(audit.failure_masks(docs), marks)).collect()
    assert len({tuple(r)[:3] for r in found}) == len(found)
    return {tuple(r)[:3]: tuple(r)[3:] for r in found}


def test_audit_equals_a_plain_version(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(1, long, "a"), (2, long, "b"), (2, long, "b"), (3, long, None), (None, long, "a"), (4, long.upper(), "a"), (5, None, "a"), (6, "", "")]
    rows += [(7, "one # two", "a"), (8, "so " * 900_000, "b"), (9, "SO " * 300 + "|", "b"), (10, "é ß" * 120, "c"), (1, long + " $", "a"), (None, None, "c")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (4, None, 1), (5, 0, None), (8, 1, 1), (None, 1, 1), (77, 1, 1)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_one_large_group_of_copies(spark):
    rows = [(i, "same text", "hot" if i % 3 else "cold") for i in range(3000)]
    got = audited(spark, rows, [(i, 1, 0) for i in range(0, 3000, 2)])
    assert got["hot", "EABCD", 1] == (0, 2000, 0, 0, 1000, 0, 2000 * 60)  # first half of the time before A, which fails too
    assert got["cold", "EABCD", 1][:2] == (1, 999) and got["cold", "ABCDE", 1][:2] == (0, 1000)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


def test_audit_with_other_filters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "a", "s")], "doc_id long, text string, source string")
    masks = audit.failure_masks(docs, {"L": F.char_length("text") > 1})
    counts = audit.audited(audit.cells(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "LE")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in counts.collect()}
    assert got == {("LE", 1): (2, 1, 2), ("LE", 2): (1, 1, 2), ("EL", 1): (2, 1, 2), ("EL", 2): (1, 1, 2)}


# ---- fill-in-middle

FILLED = "doc_id long, text string, units string, frames string, n string, form int"


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "One two,\n three 4 5", "é" * 50, "<P>", "x <S> y", "a<M", "<", "<<S", "P>", "日本 abc 語" * 9, "\x00\t\r\n", "tail <P"]


@pytest.mark.parametrize("size", [4, 7, 64, infill.FRAME_BYTES])
def test_stored_texts_and_cuts(monkeypatch, size):
    monkeypatch.setattr(infill, "FRAME_BYTES", size)
    pack = zstandard.ZstdCompressor()
    for text in [t for t in TEXTS if t] + ["abc" * 40 + "é, " * 30, "x" * 300]:
        data = text.encode()
        kept = infill.Stored.write([data[i : i + 5] for i in range(0, len(data), 5)], pack)
        assert b"".join(kept.stream()) == data and max(map(len, (zstandard.decompress(f) for f in kept.frames))) <= size
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
        assert kept.units[-1] == len(units) and kept.chars[-1] == len(text)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert kept.cut(k) == (len(before.encode()), len(before))
        for mark in (b"<P>", b"abc", "é, ".encode(), "語".encode()):
            for start in (0, 3, len(data) // 2):
                assert kept.find(mark, start) == data.find(mark, start)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab <>PSMé語\n"), max_size=60), st.integers(0, 10**6))
def test_any_text_is_rebuilt_from_its_output(text, doc_id):
    pack = zstandard.ZstdCompressor()
    kept = infill.Stored.write([text.encode()], pack)
    form, low, high = infill.plan(doc_id, kept.units[-1], any(m in text for m in ("<P>", "<S>", "<M>")))
    out = infill.Stored.write(infill.rearranged(kept, form, kept.cut(low)[0], kept.cut(high)[0]), pack)
    n, wanted_form, _, _, wanted = plain_fill(doc_id, text)
    assert (kept.units[-1], form, b"".join(out.stream()).decode()) == (n, wanted_form, wanted)
    assert b"".join(infill.restored(out, form)).decode() == text


def test_fill_in_middle(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(None, "no id at all"), (5, "five"), (5, "five"), (900, "é long, word" * 60_000), (901, "x" * 700_000)]
    docs = spark.createDataFrame([(*r, "u", "f", "n", 1) for r in rows], FILLED)
    outputs = infill.filled(infill.stored(docs))
    wanted = [(i, *plain_fill(i, t), t or "") for i, t in rows]
    got = sorted(map(tuple, infill.digests(outputs).collect()), key=str)
    assert got == sorted(((i, n, form, p, m, sha(out), sha(text)) for i, n, form, p, m, out, text in wanted), key=str)
    texts = sorted(map(tuple, infill.output_texts(outputs).collect()), key=str)
    assert texts == sorted(((i, form, out) for i, _, form, _, _, out, _ in wanted), key=str)
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    assert infill.digests(infill.filled(infill.stored(docs.limit(0)))).count() == 0


# ---- chat formatting

TURNS = "conv_id long, turn long, role string, text string, task string, part string, formatted string, loss string"
SAID = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST]", "<s><s>", "", None, "plain é 語\n", "<", "/s>", "[", "\\", "</s", "[/INST]\n", "x</s>\n<s>[INST] user [/INST]\n"]


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        size = sum(24 + len(role) + len(t) + len(re.findall(r"<\\*/?s>|\[\\*/?INST\]", f"{role}\n{t}")) for *_, role, t in turns)
        out[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for *_, role, t in turns)), len(loss), sha(loss), size)
    return out


def chats(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], TURNS)
    return chat.formatted(frame)


def read_back(spark, rows):
    found = chat.read_back(chats(spark, rows)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>[]/sINST\\a\n é"), max_size=40))
def test_escapes_leave_no_control_string_and_come_off_again(text):
    hidden = chat.escaped(text.encode()).decode()
    assert chat.unescaped(hidden) == text and not re.search(r"</?s>|\[/?INST\]", hidden)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text(st.sampled_from("<>[]/sINST\\a\n é"), max_size=30)), min_size=1, max_size=12))
def test_assembly_equals_joined_strings(turns):
    headers = [chat.OPEN + h + chat.CLOSE_ROLE for h in (b"user", b"", "é".encode())]
    buffer, bounds, inner = chat.assemble([memoryview(t.encode()) for _, t in turns], headers, chat.np.array([h for h, _ in turns]))
    made = [headers[h] + chat.escaped(t.encode()) + chat.CLOSE for h, t in turns]
    data = buffer.to_pybytes()
    assert [data[a:b] for a, b in zip(bounds, bounds[1:])] == made
    assert [data[a:b] for a, b in inner] == [chat.escaped(t.encode()) for _, t in turns]


def test_chat_format(spark):
    rows = [(c, t, role, SAID[(c + 3 * t) % len(SAID)]) for c in range(60) for t, role in enumerate(["system", "user", "assistant"] * (1 + c % 3))]
    rows += [(-7, 0, "user", SAID[0]), (-7, 1, "assistant", SAID[0]), (None, 1, None, "x"), (None, None, "assistant", "last"), (None, 1, "a [/INST]\nb", "role")]
    rows += [(100, 0, "assistant", "tie b"), (100, 0, "assistant", "tie a"), (100, 0, "assistant", "tie a"), (101, 0, "assistant", "é[INST]" * 300_000)]
    assert read_back(spark, rows) == plain_chat(rows)
    shares = chats(spark, rows).where("conv_id = -7").orderBy("task", "part").collect()
    text = "".join(s.formatted for s in shares)
    hidden = "<\\/s>[\\INST] ok [\\/INST]"
    assert text == f"<s>[INST] user [/INST]\n{hidden}</s>\n<s>[INST] assistant [/INST]\n{hidden}</s>\n"
    assert [s.formatted[x.start : x.end] for s in shares for x in s.loss] == [hidden]
    assert read_back(spark, []) == {}


def test_one_conversation_over_many_tasks(spark):
    rows = [(5, t, "assistant" if t % 2 else "user", f"turn {t} " + "<s>" * (t % 3)) for t in range(4000)] + [(c, 0, "user", "x") for c in (4, 6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert chats(spark, rows).where("conv_id = 5").select("task").distinct().count() > 1
        assert read_back(spark, rows) == plain_chat(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_inside_a_task_are_digested_there_and_long_ones_handed_on(monkeypatch):
    monkeypatch.setattr(chat, "HELD_CHARS", 60)
    texts = {1: ["a"], 2: ["b"], 3: ["c"] * 5, 4: ["d"], None: ["e"], 6: ["f"]}
    shares = [(c, 0, i, f"<s>[INST] user [/INST]\n{t}</s>\n", []) for c, ts in texts.items() for i, t in enumerate(ts)]
    columns = [chat.pa.array(list(x), f.type) for x, f in zip(zip(*shares), chat._SPLIT)]
    batch = chat.pa.RecordBatch.from_arrays(columns, ["conv_id", "task", "part", "formatted", "loss"])
    out = [r for b in chat._in_place(iter([batch.slice(0, 4), batch.slice(4)])) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"]) for r in out if r["formatted"] is None] == [(2, 1), (4, 1), (None, 1)]
    handed_on = [(r["conv_id"], r["part"]) for r in out if r["formatted"] is not None]
    assert handed_on == [(1, 0), *((3, i) for i in range(5)), (6, 0)]
