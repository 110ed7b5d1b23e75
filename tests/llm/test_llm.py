"""Every operator against a plain version, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import decontam, html, langid, linededup, linking, mixing, ngramjoin, resample, textvec, tokens, topk, toxicity

LONG = " ".join(f"w{i}" for i in range(400))
NEAR = LONG.replace("w200 ", "other ")
TEXTS = [(1, LONG), (2, NEAR), (3, LONG.upper()), (4, None), (5, ""), (6, "a b"), (7, "A  b"), (8, "x" * 200_000), (9, " . "), (1, LONG), (None, "a b")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, id long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, 0.5) for i, t in rows], DOCS)


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(sets))]


def test_shingles_equal_a_plain_version():
    texts = ["One two THREE four five six", "one two three four five six", "", "one two", "é ß " * 5, "y" * 70_000 + " z"]
    hashes, rows = textvec.words([memoryview(t.encode()) for t in texts], textvec.WHITE)
    got, of = textvec.shingles(hashes, rows, len(texts), 5)
    assert [int((of == i).sum()) for i in range(len(texts))] == [2, 2, 0, 1, 6, 1]
    assert (got[of == 0] == got[of == 1]).all()
    assert len(np.unique(got)) == len(set().union(*(grams(t) for t in texts)))


def test_ngram_join(spark):
    got = {(r[0], r[1], r[2]) for r in ngramjoin.jaccard_components(docs(spark, TEXTS)).collect()}
    assert got == {(1, 396, 1), (2, 396, 1), (3, 396, 1), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9), (None, 1, 6)}
    assert ngramjoin.jaccard_components(docs(spark, [])).count() == 0


def test_ngram_join_of_edited_copies(spark):
    rng, base = np.random.default_rng(5), [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            words[at] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    got = dict(ngramjoin.jaccard_components(docs(spark, rows)).select("doc_id", "component_id").collect())
    assert [got[i] for i, _ in rows] == components([grams(t) for _, t in rows])


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer"
    rows = [(2, f"{line}\nunique line of document two"), (1, f"\n  {line}!\nab\nab"), (3, None), (4, ""), (5, line), (5, line)]
    got = {(r[0], r[1]) for r in linededup.duplicate_lines(docs(spark, rows)).collect()}
    assert got == {(2, 0), (1, 3), (5, 0)}
    texts = sorted((r.doc_id, r.text) for r in linededup.without_duplicate_lines(docs(spark, rows)).collect() if r.text is not None)
    assert texts == [(1, f"\n  {line}!\nab"), (2, "unique line of document two"), (4, ""), (5, ""), (5, "")]
    assert linededup.duplicate_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_edited_copies(spark):
    rng, base = np.random.default_rng(9), "".join(chr(97 + i) for i in np.random.default_rng(8).integers(0, 26, 300))
    lines = [base]
    for _ in range(80):
        line = list(base)
        for at in rng.integers(0, 300, rng.integers(0, 4)):
            line[at] = str(rng.integers(0, 10))
        lines.append("".join(line))
    rows = [*enumerate(lines), (500, base[::-1]), (501, base[:150] + base[::-1]), (502, base[:150] + base[::-1] + "z" * 90_000)]
    got = {(r.doc_id, r.kept_doc) for r in linededup.duplicate_lines(docs(spark, rows)).collect()}
    assert got == {(i, 0) for i in range(1, 81)} | {(502, 501)}


def test_decontamination(spark):
    items = [("i1", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), ("i2", "A-b"), ("i3", None), ("i4", ""), ("i2", "a b"), ("i5", "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 20, 8):  # one block, and many
        got = {r.doc_id: r for r in decontam.contamination(docs(spark, TEXTS), bench, size).collect() if r.doc_id is not None}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (400, 11, 1)
        assert (got[6].n_hit, got[6].n_items, got[6].items_sha256) == (2, 2, hashlib.sha256(b"i2,i2").hexdigest())
        assert [got[i].contaminated for i in (4, 5, 8, 9)] == [False] * 4 and got[4].n_words == 0
        assert {r.doc_id for r in decontam.clean_documents(docs(spark, TEXTS), bench, size).collect()} == {4, 5, 8, 9}
    best = {(r.item_id, r.item_word): (r.length, r.doc_id, r.doc_word) for r in decontam.longest_matches(docs(spark, TEXTS), bench).collect()}
    assert best["i1", 0] == (11, 1, 5)
    assert decontam.contamination(docs(spark, TEXTS), bench.limit(0)).where("contaminated").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)] + [(300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (303, [1.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(frame, frame.vec_id % 50 == 0).collect())
    vectors = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows[:300]}
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(vectors[q] @ vectors[c]), c) for c in vectors if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), frame.vec_id % 50 == 0).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 10 else None) for i in range(300)] + [(1000, None, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.planned(frame).collect()
    assert len(plan) == 301 and all(r.taken <= 3 * r.size for r in plan)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 6
    order = [(r.position, r.doc_id) for r in mixing.training_order(frame).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.positions) for r in plan)
    assert mixing.planned(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>A &amp; B</h1><p>one\n two<p>three</article><footer>no</footer>", "A & B\none two\nthree"),
        ("<nav><a>m</a></nav><main><p>x</p><aside>side</aside><div class='comments'>c</div><form>f</form><p>y</main>", "x\ny"),
        ("<p class='notice'>n</p><p>plain <b>text</b> & < more", "plain text & < more"),
        ("<script>if (a < b) {}</script><p>" + "long " * 40 + "</p><ul><li><a href=x>link</a></li></ul>", ("long " * 40).strip()),
    ],
)
def test_html(page, text):
    assert html.main_text(page) == text


def test_token_limits(spark):
    rows = docs(spark, [*TEXTS, (20, "the cat sat"), (21, "the cat sat <|endoftext|>")])
    table = tokens.limits(tokens.length_histogram(rows)).cache()
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    lengths = [len(encode(r.text or "")) for r in rows.collect()]
    assert table.agg({"n_docs": "sum"}).first()[0] == len(lengths)
    for limit in (0, 2, 3, 50, 10**6):
        assert tokens.truncated_total(table, limit) == sum(min(n, limit) for n in lengths)
    for r in table.collect():
        assert r.docs_from == sum(n >= r.length for n in lengths) and r.truncated_total == sum(min(n, r.length) for n in lengths)
    assert tokens.length_at(table, 0.5) == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_language(spark):
    parts = {"en": "the ing and of tion", "de": "und ung der sch ein"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(parts[g].split(), 30)), g) for i, g in enumerate(["en", "de"] * 60)]
    frame = spark.createDataFrame([*rows, (900, None, None), (901, "12 34", None), (902, "", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.classified(frame, langid.fit(frame)).collect()}
    assert all(got[i].lang_pred == g and 0 <= got[i].score <= 1 for i, _, g in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in langid.classified(frame, langid.fit(frame.limit(0))).collect()} == {"und"}


def test_toxicity(spark):
    rng, plain = np.random.default_rng(2), [f"{a}{b}" for a in "kmpst" for b in ("or", "al", "en", "iv")]
    rows = []
    for i in range(240):
        words = list(rng.choice(plain, 12))
        if i % 3 == 0:
            words[int(rng.integers(0, 12))] = str(rng.choice(["vilebad", "vilerot"]))
        rows.append((i, " ".join(words) + ".", int(i % 3 == 0)))
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 160], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(frame, toxicity.fit(frame, labels)).collect()}
    assert all((got[i].score >= 0.5) == bool(y) for i, _, y in rows)
    for i, t, y in rows:
        assert all(t[a:b].startswith("vile") for a, b in got[i].spans) and bool(got[i].spans) == bool(y)
    assert got[900].score < 0.5 and got[901].score < 0.5
    assert toxicity.scored(frame, toxicity.fit(frame, labels.limit(0))).count() == len(rows) + 2


def test_resampling(spark):
    rows = [(i, "good words stand here in order" if i % 5 else "### !! zz ### qq") for i in range(200)] + [(900, None)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(100)], "doc_id long, quality int")
    got = resample.resampled(docs(spark, rows), labels).collect()
    kept = [r.doc_id for r in got if r.selected]
    assert len(got) == 201 and abs(len(kept) - round(0.8 * 201)) <= 1 and sum(i % 5 == 0 for i in kept) <= 4
    assert resample.resampled(docs(spark, rows), labels.limit(0)).where("selected").count() == 201


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids and ids <= {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def test_line_pairs_equal_plain_sets():
    """Sizes, intersections and marks of short, middling and long lines, several pairs of one leader together."""
    draw = np.random.default_rng(5)
    pairs = []
    for leader, length in enumerate((3, 60, 60, 3000)):
        line = "".join(draw.choice(list("abcdefgh é"), length))
        for member in range(20):
            other = list(line)
            for _ in range(draw.integers(0, 8)):
                other[draw.integers(len(other))] = "z"
            pairs.append((leader, 100 * leader + member, line, "".join(other)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], ["a", "b", "line_a", "line_b"])
    got = pa.Table.from_batches(list(linededup._intersections(iter([batch])))).to_pylist()

    def shingles(line):
        return {line[i : i + 5] for i in range(max(1, len(line) - 4))}

    def hashes(line):
        return {int(v) >> 12 for v in linededup._shingles([memoryview(line.encode())])[0]}

    def marked(values):
        return linking.marks(np.array(sorted(values), dtype=np.uint64))

    for (a, b, x, y), row in zip(pairs, got, strict=True):
        both = len(shingles(x) & shingles(y))
        assert (row["a"], row["b"], row["n_a"], row["n_b"], row["shared"]) == (a, b, len(shingles(x)), len(shingles(y)), both)
        assert row["marks"] == marked(hashes(y) - hashes(x)) + marked(hashes(x) - hashes(y))


def test_bands_meet_pairs_at_the_threshold():
    """Of pairs of sets with similarity 0.8, at most 0.5 % agree in no band."""
    rng, n = np.random.default_rng(41), 4000
    both, only = rng.integers(0, 2**64, (n, 80), dtype=np.uint64), rng.integers(0, 2**64, (2, n, 10), dtype=np.uint64)
    bounds = np.arange(n + 1) * 90
    a, b = (linededup._bands(np.hstack([both, side]).reshape(-1), bounds) for side in only)
    assert int((a == b).any(axis=1).sum()) >= n * 0.995


def test_documents_that_share_an_id_or_have_none_are_their_own(spark):
    """Lines go from the documents that repeat them only, and of copies without id one row stays."""
    import corpus_pipeline

    again = "a line that a document without id repeats word for word"
    a, b = f"first of a\n{again}", "quite another text\nits second line is found nowhere else"
    c, d = f"one more text\n{again}", "of the same id but not\nthe same second line as the other"
    rows = docs(spark, [(1, again), (None, a), (None, a), (None, b), (7, c), (7, d), (None, ""), (None, "")])
    left = corpus_pipeline.drop_repeated_lines(spark, rows, "")
    got = sorted((r.doc_id or 0, r.text) for r in left.collect())
    assert got == [(0, ""), (0, ""), (0, "first of a"), (0, "first of a"), (0, b), (1, again), (7, "of the same id but not\nthe same second line as the other"), (7, "one more text")]
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, left, "").collect())
    assert kept == [(0, ""), (0, ""), (0, "first of a"), (0, b), (1, again), (7, d), (7, "one more text")]
    near = docs(spark, [(3, LONG), (None, LONG.upper()), (None, "a text of its own"), (5, NEAR)])
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, near, "").collect())
    assert kept == [(0, "a text of its own"), (3, LONG)]


def test_ngram_join_links_repeated_and_missing_ids(spark):
    """Texts under one id, and rows without id, are verified like all others; a chain runs through a row without id."""
    words = LONG.split()
    chain = [" ".join(words), " ".join(f"x{i}" if i % 40 == 20 and i < 320 else w for i, w in enumerate(words))]
    chain.append(" ".join(f"y{i}" if i % 40 == 5 and i < 320 else w for i, w in enumerate(chain[1].split())))
    assert components([grams(t) for t in (chain[0], chain[2])]) == [0, 1] and components([grams(t) for t in chain]) == [0, 0, 0]
    for texts in (chain, chain[::-1]):
        got = {(r[0], r[2]) for r in ngramjoin.jaccard_components(docs(spark, [(10, texts[0]), (None, texts[1]), (12, texts[2])])).collect()}
        assert got == {(10, 10), (None, 10), (12, 10)}
    rows = [(3, LONG), (3, NEAR), (5, NEAR), (3, "of its own")]
    got = sorted({(r.text_hash, r.component) for r in ngramjoin._grouped(docs(spark, rows)).where("n_shingles > 1").collect()})
    assert len(got) == 2 and got[0][1] == got[1][1]


def test_resampling_counts_all_good_documents(spark):
    frame = spark.range(50_000).selectExpr("id as doc_id", "if(id % 5 = 0, 'bad', concat('w', id % 7)) as text")
    labels = frame.selectExpr("doc_id", "int(text <> 'bad') as quality")
    ratios, share = resample.log_ratios(frame, labels)
    raw = np.zeros(resample.SIZE)
    place = {t: int(resample._grams([memoryview(t.encode())])[0][0]) for t in ["bad", *(f"w{i}" for i in range(7))]}
    for r in frame.groupBy("text").count().collect():
        raw[place[r["text"]]] += r["count"]
    target = raw.copy()
    target[place["bad"]] = 0
    prior = (raw + 1) / (raw.sum() + resample.SIZE)
    assert share == 0.8 and np.allclose(ratios, np.log((target + prior * 1000) / (target.sum() + 1000) / prior))


def test_language_of_few_texts_in_many_copies_is_learned(spark):
    frame = spark.range(60_000).selectExpr("if(id % 3 = 0, 'und der sch', 'ung ein die') as text", "'de' as lang")
    english = spark.createDataFrame([(f"the ing and of {i}", "en") for i in range(20)], "text string, lang string")
    assert set(langid.fit(frame.union(english))["langs"]) == {"de", "en"}


def test_top_k_of_large_vectors(spark):
    rows = [(0, [3.0, 1.0]), (1, [2.0**50, 1.0]), (2, [2.0**50, -1.0]), (3, [-(2.0**45), 0.0]), (4, [1.0, 1.0]), (5, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(frame, frame.vec_id == 4, scale=1).orderBy("rank").collect()]
    assert got == [(1, 2**50 + 1), (2, 2**50 - 1), (0, 4), (3, -(2**45))]
    for wide in (2.0**40, 2.0**70):  # its score with itself scaled, and its component, don't fit
        large = spark.createDataFrame([(1, [wide]), (2, [wide])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="doesn't fit 64 bits"):
            topk.top_k(large, large.vec_id == 1).collect()
