import random
from itertools import combinations

import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions.geometry import MATCHES, greedy_match_sql
from tagloom.operators import consistency, evaluate, groups, matching
from tagloom.operators.groups import rank_in_group
from tagloom.schemas import KINDS

BOXES = "image_id bigint, item_ix bigint, label string, xmin double, ymin double, xmax double, ymax double"


def make_boxes(seed, images=6, most=14, grid=6, labels="ab", copies=0.3):
    """Boxes on a coarse grid, so that copies, ties and contests between neighbours are common."""
    rng = random.Random(seed)
    rows = []
    for image in range(images):
        made = []
        for ix in range(rng.randint(0, most)):
            if made and rng.random() < copies:
                label, *box = rng.choice(made)
            else:
                x, y = rng.randint(0, grid), rng.randint(0, grid)
                label, box = rng.choice(labels), [x / 16, y / 16, (x + rng.randint(2, 5)) / 16, (y + rng.randint(2, 5)) / 16]
            made.append((label, *box))
            rows.append((image, ix * 3 + rng.randint(0, 2), label, *box))
    return rows


def as_dicts(rows):
    names = [part.split()[0] for part in BOXES.split(", ")]
    return [dict(zip(names, row)) for row in rows]


def expected_matches(left, right, threshold):
    left, right = as_dicts(left), as_dicts(right)
    pick = lambda rows, image: [r for r in rows if r["image_id"] == image]
    return sorted(
        (image, a, b, round(v, 9))
        for image in {r["image_id"] for r in left}
        for a, b, v in brute.match(pick(left, image), pick(right, image), threshold)
    )


def got_matches(df):
    return sorted((r.image_id, r.left_ix, r.right_ix, round(r.iou, 9)) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_both_ways_match_like_the_rule(spark, seed, threshold):
    left, right = make_boxes(seed), make_boxes(seed + 100)
    want = expected_matches(left, right, threshold)
    a, b = (spark.createDataFrame(rows, BOXES) for rows in (left, right))
    assert got_matches(matching.match_boxes(a, b, ["image_id"], threshold)) == want
    assert got_matches(matching.match_boxes(a, b, ["image_id"], threshold, limit=0)) == want


def test_crowd_of_copies(spark):
    """One image with nothing but copies of two boxes: capacities are handed out in item order."""
    one, two = (0.1, 0.1, 0.5, 0.5), (0.1, 0.1, 0.5, 0.6)
    left = [(1, n, "a", *(one if n % 3 else two)) for n in range(300)]
    right = [(1, n, "a", *(two if n % 5 else one)) for n in range(200)]
    a, b = (spark.createDataFrame(rows, BOXES) for rows in (left, right))
    assert got_matches(matching.match_boxes(a, b, ["image_id"], limit=10)) == expected_matches(left, right, 0.5)


def test_chain_of_contests(spark):
    """Each left box wants the right box its predecessor may take."""
    left = [(1, n, "a", n / 64, 0.0, (n + 4) / 64, 0.5) for n in range(24)]
    right = [(1, n, "a", (n + 1) / 64, 0.0, (n + 5) / 64, 0.5) for n in range(24)]
    for rows in (left, left[::-1]):
        ordered = [(r[0], n, *r[2:]) for n, r in enumerate(rows)]
        a, b = (spark.createDataFrame(x, BOXES) for x in (ordered, right))
        assert got_matches(matching.match_boxes(a, b, ["image_id"], limit=0)) == expected_matches(ordered, right, 0.5)


def test_chain_of_a_thousand_boxes(spark, monkeypatch):
    """One component that is one long path: found in a number of rounds like its logarithm, and matched in one pass."""
    from tagloom.operators import components

    rounds, stored = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: rounds.append(name) or stored(df, name))
    monkeypatch.setattr(matching, "_match_in_rounds", None)
    # boxes that reach 0.5 only with their next neighbour
    left = [(1, n, "a", 2 * n / 16, 0.0, (2 * n + 5) / 16, 0.5) for n in range(500)]
    right = [(1, n, "a", (2 * n + 1) / 16, 0.0, (2 * n + 6) / 16, 0.5) for n in range(500)]
    order = list(range(500))
    random.Random(3).shuffle(order)
    left = [(1, order[r[1]], *r[2:]) for r in left]
    a, b = (spark.createDataFrame(x, BOXES) for x in (left, right))
    assert got_matches(matching.match_boxes(a, b, ["image_id"], limit=0)) == expected_matches(left, right, 0.5)
    assert 5 <= len(rounds) <= 2 * 10 + 2


@pytest.mark.parametrize("seed", range(2))
def test_giant_components_match_like_the_rule(spark, seed):
    """Components too large for one task are matched in rounds; ``component_rows`` doesn't change the result."""
    left, right = make_boxes(seed + 40, images=3, most=20), make_boxes(seed + 140, images=3, most=20)
    a, b = (spark.createDataFrame(rows, BOXES) for rows in (left, right))
    for rows in (0, 12):
        got = matching.match_boxes(a, b, ["image_id"], 0.3, limit=0, component_rows=rows)
        assert got_matches(got) == expected_matches(left, right, 0.3)


def test_components_of_links(spark):
    from tagloom.operators.components import connected

    rng = random.Random(11)
    links = [(n, n + 1) for n in range(100, 400) if n % 50] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(links)
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        low, high = sorted((find(x), find(y)))
        root[high] = low
    got = {r.id: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for x, y in links if x != y} | {y for x, y in links if x != y}
    assert got == {x: find(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_cells_meet_in_blocks(spark, monkeypatch):
    """Near copies share a cell; blocks of it meet in different tasks, every pair once."""
    monkeypatch.setattr(matching, "CELL_BLOCK", 8)
    rng = random.Random(5)

    def near(n):
        return [(1, i, "a", 0.2 + rng.random() / 500, 0.2, 0.6 + rng.random() / 500, 0.6) for i in range(n)]

    left, right = near(60) + [(2, 900, "a", 0.1, 0.1, 0.2, 0.2)], near(45) + [(2, 901, "a", 0.1, 0.1, 0.2, 0.21)]
    a, b = (spark.createDataFrame(x, BOXES) for x in (left, right))
    pairs = matching.grid_pairs(a, b, ["image_id", "label"])
    assert sorted((r.left_item_ix, r.right_item_ix) for r in pairs.collect()) == sorted([(i, j) for i in range(60) for j in range(45)] + [(900, 901)])
    assert got_matches(matching.match_boxes(a, b, ["image_id"], limit=10)) == expected_matches(left, right, 0.5)


def test_nothing_to_match(spark):
    a = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 0.1, 0.1)], BOXES)
    b = spark.createDataFrame([(1, 0, "b", 0.0, 0.0, 0.1, 0.1)], BOXES)
    for limit in (0, 10):
        assert matching.match_boxes(a, b, ["image_id"], limit=limit).count() == 0


@pytest.mark.parametrize("threshold", [0.0, -1.0, 1.5])
def test_threshold_must_be_a_share(spark, threshold):
    a = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 0.1, 0.1)], BOXES)
    with pytest.raises(ValueError):
        matching.match_boxes(a, a, ["image_id"], threshold)


@pytest.mark.parametrize("threshold", [0.1, 0.5, 1.0])
def test_grid_finds_every_pair(spark, threshold):
    rng = random.Random(7)

    def rows():
        for n in range(250):
            w, h = 10 ** rng.uniform(-3, 0), 10 ** rng.uniform(-3, 0)
            x, y = rng.uniform(-0.2, 1.2), rng.uniform(0, 1)
            yield (n % 2, n, "a", x, y, x + w, y + h)

    left = list(rows())
    right = [
        (r[0], r[1], "a", *(c + d for c, d in zip(r[3:], (rng.uniform(-0.1, 0.1) * (r[5] - r[3]), 0.0, 0.0, 0.0)))) for r in left
    ] + [(r[0], r[1] + 1000, *r[2:]) for r in left[:20]]
    a, b = (spark.createDataFrame(x, BOXES) for x in (left, right))
    want = {
        (p["item_ix"], q["item_ix"])
        for p in as_dicts(left)
        for q in as_dicts(right)
        if p["image_id"] == q["image_id"] and brute.iou(p, q) >= threshold
    }
    for limit in (0, 1000):
        got = matching.candidate_pairs(a, b, ["image_id", "label"], threshold, limit=limit)
        assert {(r.left_item_ix, r.right_item_ix) for r in got.collect()} == want
    assert want


def test_rank_over_blocks(spark):
    rows = [(n % 2, n * 997) for n in range(1000)]
    df = spark.createDataFrame(rows, "g int, ix bigint")
    ranks = {(r.g, r.ix): r.rank for r in rank_in_group(df, ["g"], "ix", "rank").collect()}
    for g in (0, 1):
        of_group = sorted(ix for h, ix in rows if h == g)
        assert [ranks[g, ix] for ix in of_group] == list(range(1, len(of_group) + 1))


def test_pair_scores_do_not_depend_on_the_way(spark):
    runs = [(run, row) for run in range(3) for row in make_boxes(run, images=5)]
    schema = "run int, " + BOXES
    df = spark.createDataFrame([(run, *row) for run, row in runs], schema)
    want = {}
    for image in {row[0] for _, row in runs}:
        by_run = [as_dicts([row for r, row in runs if r == run and row[0] == image]) for run in range(3)]
        for i, j in combinations(range(3), 2):
            want[image, i, j] = round(brute.score(by_run[i], by_run[j]), 9)
    for limit in (0, 512):
        scores = consistency.box_pair_scores(df, (0, 1, 2), limit=limit).collect()
        assert {(r.image_id, r.run_i, r.run_j): round(r.score, 9) for r in scores} == want


def test_results_score_the_same_in_rows_and_by_joins(spark):
    box = "struct('a' AS label, {x}D AS xmin, 0D AS ymin, {x}D + 0.5D AS xmax, 0.5D AS ymax, 1D AS confidence)"

    def result(image, run, boxes=(), texts=()):
        columns = [f"CAST(array() AS array<{KINDS[kind]}>) AS {kind}" for kind in KINDS if kind not in ("boxes", "texts")]
        columns.append(f"CAST(array({', '.join(box.format(x=x) for x in boxes)}) AS array<{KINDS['boxes']}>) AS boxes")
        read = ", ".join(f"struct('{t}' AS text, 0D AS xmin, 0D AS ymin, 1D AS xmax, 1D AS ymax, 1D AS confidence)" for t in texts)
        columns.append(f"CAST(array({read}) AS array<{KINDS['texts']}>) AS texts")
        return f"SELECT {image}L AS image_id, {run} AS run, {', '.join(columns)}"

    results = spark.sql(
        " UNION ALL ".join(
            [
                result(1, 0, [0.0, 0.1]),
                result(1, 1, [0.1]),
                result(2, 0, [0.2], ["x"]),
                result(2, 1, [0.2], ["y"]),
                result(3, 0, [], ["x", "y"]),
                result(3, 1, [], ["y", "z"]),
                result(4, 0),
                result(4, 1),
                result(5, 0, [0.3]),
                result(5, 1),
            ]
        )
    )
    # greedy: in image 1 the first box takes the only partner, though the second fits it exactly
    want = {1: round(2 / 3 / 2, 6), 2: 1.0, 3: round(1 / 3, 6), 4: 1.0, 5: 0.0}
    for limit in (512, 0):
        scored = consistency.score_results(results, limit=limit)
        got = {r.image_id: round(r.consistency_score, 6) for r in scored.collect()}
        assert got == want
    single = consistency.score_results(results.filter("run = 0"))
    assert {r.consistency_score for r in single.collect()} == {1.0}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.sampled_from([0.2, 0.5, 0.75]))
def test_fold_matches_like_the_rule(spark, seed, threshold):
    left, right = make_boxes(seed, images=1), make_boxes(seed + 1, images=1)
    collect = lambda rows: spark.createDataFrame(rows, BOXES).agg(
        F.sort_array(F.collect_list(F.struct("item_ix", "label", "xmin", "ymin", "xmax", "ymax"))).alias("b")
    )
    both = collect(left).withColumnRenamed("b", "l").join(collect(right).withColumnRenamed("b", "r"))
    row = both.select("l", "r", F.expr(greedy_match_sql("l", "r", threshold)).cast(MATCHES).alias("m")).first()
    got = [(row.l[m.left_pos].item_ix, row.r[m.right_pos].item_ix, round(m.iou, 9)) for m in row.m]
    assert got == [(a, b, round(v, 9)) for a, b, v in brute.match(as_dicts(left), as_dicts(right), threshold)]
    assert len({b for _, b, _ in got}) == len(got)


def _plain_outcomes(predicted, truth, listed, every):
    """tp, fp, fn and the sum of IoU by (image, class), as a loop counts them."""
    out = {}
    for image, kind in {(b["image_id"], b["class_id"]) for b in predicted + truth}:
        mine = [[{**b, "label": kind} for b in side if (b["image_id"], b["class_id"]) == (image, kind)] for side in (predicted, truth)]
        found = brute.match(*mine)
        n_true = len(mine[1]) if every or (image is not None and image in listed) else 0
        if mine[0] or n_true:
            out[image, kind] = (len(found), len(mine[0]) - len(found), n_true - len(found), round(sum(f[2] for f in found), 9))
    return out


@pytest.mark.parametrize("limit", [3, 512])
def test_outcomes_are_counted_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluate, "TASK_ROWS", 20)
    schema = "image_id bigint, class_id int, item_ix bigint, xmin double, ymin double, xmax double, ymax double"
    rng = random.Random(5)

    def side(images):
        rows = []
        for n in range(200):
            x, y = rng.randint(0, 3) / 10, rng.randint(0, 3) / 10
            rows.append({"image_id": rng.choice(images), "class_id": rng.choice([0, 1, 2]), "item_ix": n, "xmin": x, "ymin": y, "xmax": x + 0.5, "ymax": y + 0.4})
        return rows

    predicted, truth = side([*range(20), None]), side([*range(10, 40), None])
    tables = [spark.createDataFrame([tuple(r.values()) for r in rows], schema) for rows in (predicted, truth)]
    names = {b["image_id"] for b in predicted}
    files = {3, 12, 15, 35}
    listing = spark.createDataFrame([(i,) for i in files], "image_id bigint")
    for listed, options in ((names, {}), (names, {"count_unpredicted_images": True}), (files, {"predicted_images": listing}))[:: 2 if limit == 3 else 1]:
        got = evaluate.detection_outcomes(*tables, limit=limit, **options)
        rows = {(r.image_id, r.class_id): (r.tp, r.fp, r.fn, round(r.iou_sum, 9)) for r in got.collect()}
        assert rows == _plain_outcomes(predicted, truth, listed, "count_unpredicted_images" in options)
    # no join of boxes, and as many tasks as the rows ask for, however well they compress
    plan = evaluate.detection_outcomes(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
    assert evaluate.detection_outcomes(*tables).rdd.getNumPartitions() == 20


def test_large_groups_are_found_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(groups, "_BLOCK", 7)
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS item_ix").unionByName(spark.range(5).selectExpr("9L AS k", "id * 1000 AS item_ix"))
    df = df.unionByName(spark.range(4).selectExpr("CAST(null AS BIGINT) AS k", "id AS item_ix"))
    cold, hot = groups.split_hot(df, ["k"], 5, task_rows=10)
    assert {r.k for r in hot.collect()} == {0, 1, 2}
    assert sorted(str(r.k) for r in cold.collect()) == ["9"] * 5 + ["None"] * 4
