"""Methods against enumeration and brute force, hot lists, clashing names, and the pipeline against plain stages."""

import itertools
import re

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontam, html, linededup, linking, mixing, resample, tokens, toxicity
from tagloom.llm.oracles import CONTAMINATION


def test_marginals_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    chains = np.array([0, 1, 6, 9])
    emissions, transitions = rng.normal(0, 2, 16), rng.normal(0, 1, (2, 2))
    p, pairs = toxicity.marginals(emissions, chains, transitions, pairs=True)
    want, want_pairs = np.zeros(16), np.zeros((2, 2))
    for begin, end in zip(chains, np.append(chains[1:], 16)):
        total, states, steps = 0.0, np.zeros(end - begin), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=end - begin):
            score = sum(emissions[begin + i] for i, s in enumerate(path) if s) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
            weight = np.exp(score)
            total += weight
            states += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                steps[a, b] += weight
        want[begin:end] = states / total
        want_pairs += steps / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_toxicity_learns_from_a_bounded_sample(spark, monkeypatch):
    """Whole texts up to the bound in bytes, long chains and long texts included; scores cover every row."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "LONGEST", 5_000)
    rng = np.random.default_rng(4)
    plain = [" ".join(f"word{w}" for w in rng.integers(0, 60, 30)) for _ in range(600)]
    rows = [(i, t.replace(" ", f" vile{i % 5} ", 1) if i % 3 == 0 else t, f"x{i}", 1, 0.5) for i, t in enumerate(plain)]
    rows += [(1000, "calm " * 3000, "x", 1, 0.5), (1001, "calm " * 3000 + "vile1", "x", 1, 0.5), (1002, None, "x", 1, 0.5), (1003, "", "x", 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, place int, toxic double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 600, 2)] + [(1000, 1)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert len(scores) == len(rows)
    assert [i for i in range(600) if (scores[i] >= 0.5) != (i % 3 == 0)] == []
    assert scores[1000] < 0.5 <= scores[1001] and scores[1002] == scores[1003] < 0.5


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def plain_line_removals(rows):
    """(doc, line) places that go: exact components of all lines by character shingles, the first place stays."""
    places = [(d, n, x.strip(" \t\r\f\v 　")) for d, t in rows for n, x in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    lines = sorted({p[2] for p in places})
    sets, holders = [shingles(x) for x in lines], {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        met = {}
        for g in s:
            for j in holders[g]:
                if j > i:
                    met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    group = {x: find(i) for i, x in enumerate(lines)}
    first = {}
    for d, n, x in sorted(places):
        first.setdefault(group[x], (d, n))
    return {(d, n) for d, n, x in places if first[group[x]] != (d, n)}


def test_line_dedup_equals_brute_force_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_line_removals([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {(r.doc_id, r.line_no) for r in linededup.duplicate_lines(docs).collect()}
    assert want and got <= want and len(got) >= 0.995 * len(want)


@pytest.mark.parametrize("rows", [3, 20_000])
def test_long_lists_are_dealt_into_parts(spark, monkeypatch, rows):
    monkeypatch.setattr(linking, "LIST_ROWS", rows)
    rng = np.random.default_rng(12)
    base = ["".join(chr(97 + i) for i in rng.integers(0, 26, 200)) for _ in range(3)]
    lines = []
    for i in range(90):
        line = list(base[i % 3])
        for at in rng.integers(0, 200, rng.integers(0, 3)):
            line[at] = str(rng.integers(0, 10))
        lines.append("".join(line))
    docs = [(i, x) for i, x in enumerate(lines)]
    frame = spark.createDataFrame([(i, x, 1, "k") for i, x in docs], "doc_id long, text string, id int, line string")
    assert {(r.doc_id, r.line_no) for r in linededup.duplicate_lines(frame).collect()} == plain_line_removals(docs)


@pytest.mark.parametrize(("bits", "both_ways"), [(64, True), (256, True), (256, False), (1024, False)])
def test_marks_leave_no_link_out(spark, bits, both_ways):
    """Pairs that the marks rule out are no links, with every number of marks."""
    rng = np.random.default_rng(6)
    lead = rng.integers(0, 2**63, 60, dtype=np.uint64)
    members = []
    for _ in range(40):
        keep = lead[rng.random(60) < rng.choice([0.5, 0.7, 0.95])]
        members.append(np.concatenate([keep, rng.choice(lead ^ np.uint64(5), rng.choice([2, 30]), replace=False)]))
    rows, links = [], []
    for i, j in itertools.combinations(range(40), 2):
        x, y = members[i], members[j]
        marks = [linking.marks(np.setdiff1d(m, lead), bits) + (linking.marks(np.setdiff1d(lead, m), bits) if both_ways else []) for m in (x, y)]
        rows.append((i, j, len(x), len(y), len(np.intersect1d(x, lead)), len(np.intersect1d(y, lead)), *marks))
        both = len(np.intersect1d(x, y))
        if 9 * both >= 4 * (len(x) + len(y)):
            links.append((i, j))
    names = "x_id long, y_id long, x_exact int, y_exact int, x_has int, y_has int"
    frame = spark.createDataFrame(rows, f"{names}, x_marks array<long>, y_marks array<long>")
    out = [(r.x_id, r.y_id) for r in frame.where(~linking._apart(bits // 64, both_ways)).collect()]
    assert links and set(links) <= set(out) and len(out) < len(rows)


def test_gumbel_top_k_is_exact(spark):
    docs = spark.createDataFrame([(i, f"good words {i % 7}" if i % 2 else f"bad stuff {i % 5}") for i in range(400)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(0, 300)] + [(None, 1)], "doc_id long, quality int")
    rows = resample.resampled(docs, labels).collect()
    k = round(0.5 * 401)
    steps = sorted((int(np.floor(r.key * resample._STEP)) for r in rows), reverse=True)
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in rows if np.floor(r.key * resample._STEP) >= steps[k - 1]}
    ratios, share = resample.log_ratios(docs, labels)
    counts = np.zeros((2, resample.SIZE))
    for i, text in [(r.doc_id, r.text) for r in docs.collect()]:
        places, _ = resample._grams([memoryview(text.encode())])
        np.add.at(counts[0], places, 1)
        if i is not None and i < 300 and i % 2:
            np.add.at(counts[1], places, 1)
    prior = (counts[0] + 1) / (counts[0].sum() + resample.SIZE)
    target = (counts[1] + prior * 1000) / (counts[1].sum() + 1000)
    assert share == 0.5 and np.allclose(ratios, np.log(target / prior))
    assert resample.resampled(docs.limit(0), labels).count() == 0


CLASHES = "size string, rank string, weight string, target string, n_rows string, turn string, position string, taken string, positions string, source_size string"


def test_mixing_with_clashing_names_and_without_ids(spark):
    rows = [(None if i % 2 else i, "w " * (1 + i % 9) + str(i), f"s{i % 3}" if i % 7 else None, *"abcdefghij") for i in range(600)]
    rows += [(1, None, "s1", *"abcdefghij"), (2, "", "s1", *"abcdefghij")]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHES}")
    plan = mixing.planned(frame)
    for source in ("s0", "s1", "s2", None):
        own = plan.where(F.col("source").eqNullSafe(source)).collect()
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 and all(r.taken <= 3 * r.size for r in own)
    order = mixing.training_order(frame)
    assert {"rank", "weight", "n_rows"} <= set(order.columns) and len(set(order.columns)) == len(order.columns)
    got = order.collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and sum(r.size for r in got) == sum(r.taken for r in plan.collect())
    assert {r["rank"] for r in got} == {"b"}
    assert [tuple(r) for r in mixing.training_order(frame).select("text", "turn", "position").orderBy("text", "turn").collect()] == [
        tuple(r) for r in order.select("text", "turn", "position").orderBy("text", "turn").collect()
    ]
    assert mixing.training_order(frame.limit(0)).count() == 0


def test_contamination_of_repeated_items_equals_its_sql(spark):
    run = " ".join(f"w{i}" for i in range(14))
    items = [("b", run), ("b", run), ("a", run.upper()), ("c", "one two"), (None, "w3 w4"), ("d", ""), ("e", None)]
    texts = [(1, f"x {run} y"), (2, "One two w3, w4"), (3, None), (4, " ".join(f"w{i}" for i in range(2, 13))), (5, "clean")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    answer = con.execute(CONTAMINATION)
    names = [d[0] for d in answer.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in answer.fetchall()}
    got = {r.doc_id: r.asDict() for r in decontam.contamination(docs, bench).collect()}
    assert got[1]["n_items"] == 3 + 1 and got == {i: {c: w[c] for c in got[i]} for i, w in want.items()}


LONG = "word " * 60


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>{LONG}</p><p><a href=x>a paragraph that is a link</a></p><p>{LONG}</p>", f"{LONG.strip()}\na paragraph that is a link\n{LONG.strip()}"),
        (f"<div><article><a href=a>t</a> teaser</article><article>teaser 2</article></div><div><h1>Head</h1><p>{LONG}</p></div>", f"Head\n{LONG.strip()}"),
        ("<article>short</article><div>around it</div>", "short"),
        (f"<ul><li><a href=x>home</a></li></ul><h2>Title</h2><p>{LONG}</p><ul><li><a href=y>next</a></li></ul>", f"Title\n{LONG.strip()}"),
        ("<div>" * 3000 + "<article><p>deep" + "</b></div>" * 3000, "deep"),
        ("<p>a<p>b</div></p></article><table><tr><td>c<td>d", "a\nb\nc\nd"),
        ("<article>" + "<p>x &amp; y</p>" * 5000 + "</article>", "\n".join(["x & y"] * 5000)),
    ],
)
def test_main_text_by_line_blocks(page, text):
    assert html.main_text(page) == text


def test_pages_with_extra_columns_and_repeats(spark):
    rows = [(1, "u", "<article>one", "x", 2)] * 3 + [(None, None, None, "x", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html.extracted(pages).collect()), key=str)
    assert got == sorted([(1, "u", "one", 3)] * 3 + [(None, None, "", 0)], key=str)
    assert html.extracted(pages.limit(0)).count() == 0


def test_token_limits_of_an_empty_table(spark):
    assert tokens.limits(tokens.length_histogram(spark.createDataFrame([], "text string"))).count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Each stage against a plain version of it, on what the stage before kept."""
    rng = np.random.default_rng(8)
    line = lambda n=14: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    item = line(12)
    rows = [(i, "\n".join(line() for _ in range(4)), "en", f"s{i % 2}") for i in range(60)]
    rows += [(100 + i, f"{line()} vile{i % 3} {line()}", "en", "s0") for i in range(40)]
    shared = line()
    rows += [(200, f"{shared}\n{line()}", "en", "s0"), (201, f"{line()}\n{shared}.", "en", "s1")]
    rows += [(300, line(80), "en", "s1")]
    words = rows[-1][1].split()[:79] + ["changed"]
    rows += [(301, "\n".join(" ".join(words[i : i + 3]) for i in range(0, 80, 3)), "en", "s0"), (302, f"{line()} {item.upper()} {line()}", "en", "s1"), (None, line(), None, None)]
    docs = [(*r, len(r[1])) for r in rows] + [(400, "", "en", "s1", 0), (401, None, None, "s1", None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 140)) for i in [*range(0, 60, 2), *range(100, 140, 2)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")

    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        tables[name] = now.collect()
    texts = {name: {r.doc_id: r.text for r in found} for name, found in tables.items()}

    kept = [d for d in docs if d[0] is None or not 100 <= d[0] < 140]
    assert sorted(map(str, texts["toxicity"])) == sorted(str(d[0]) for d in kept)

    gone = plain_line_removals([(d[0] if d[0] is not None else 10**9, d[1]) for d in kept])
    lines = {d[0]: None if d[1] is None else "\n".join(x for n, x in enumerate(d[1].split("\n")) if (d[0], n) not in gone) for d in kept}
    assert texts["line_dedup"] == lines and any(n for _, n in gone)
    assert all(r.n_chars == len(r.text) for r in tables["line_dedup"] if r.text is not None)

    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] for i in range(max(1, len(w) - 4)) if w}
    near = {b for (a, s), (b, t) in itertools.permutations(lines.items(), 2) if a is not None and b is not None and a < b and grams(s) and 5 * len(grams(s) & grams(t)) >= 4 * len(grams(s) | grams(t))}
    assert near == {301} and set(texts["ngram_join"]) == set(lines) - near
    assert set(texts["decontamination"]) == set(lines) - near - {302}
    for name in texts:
        assert name == "mixing" or tables[name][0].__fields__ == columns

    mixed = tables["mixing"]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts["decontamination"].items()}
    assert set(texts["mixing"]) <= {i for i, n in size.items() if n}
    source = {d[0]: d[3] for d in docs}
    sums = {s: sum(n for i, n in size.items() if source[i] == s) for s in ("s0", "s1", None)}
    weights, cap = dict(zip(("s0", "s1", None), (5, 2, 1))), {s: 3 * n for s, n in sums.items()}
    target, open_, total = {}, set(sums), sum(sums.values())
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap[s]}
        target |= {s: cap[s] for s in over} if over else {s: level * weights[s] for s in open_}
        open_ = open_ - over if over else set()
    for s in sums:
        own = [r for r in mixed if r.source == s]
        assert abs(own[0].target - target[s]) < 1e-6 and abs(sum(r.size for r in own) - target[s]) <= max(n for i, n in size.items() if source[i] == s) / 2
        assert max((sum(r.doc_id == i for r in own) for i in {r.doc_id for r in own}), default=0) <= 3
