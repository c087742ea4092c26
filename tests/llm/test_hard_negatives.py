"""Hard negatives against plain Python: ties, repeated rows, odd vectors, numbers beyond doubles, several rounds."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatstrata.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, every=100, positives=5, negatives=10, percent=(30, 90)):
    kept = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    long = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for k, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        same = sorted((-dot(v, w), j) for m, (j, other, w) in enumerate(kept) if other == label and m != k)[:positives]
        for p, pid in same:
            found = sorted((-dot(v, w), j) for j, other, w in kept if other != label and percent[0] * -p <= 100 * dot(v, w) <= percent[1] * -p)
            out += [(i, pid, r, nid, long(-p), long(-n)) for r, (n, nid) in enumerate(found[:negatives], 1)]
    return collections.Counter(out)


def check(spark, rows, **how):
    got = collections.Counter(tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), **how).collect())
    assert got == brute_force(rows, **how)
    return got


def cloud(n, width=8, seed=1, crowd=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.3 * rng.normal(size=width)], int(i * 7 % 4)) for i in range(n)]
    return [(i, rows[0][1] if i % 3 < crowd else v, label) for i, v, label in rows]


def test_a_cloud(spark):
    assert check(spark, cloud(1200))


def test_many_equal_vectors_and_repeated_rows(spark):
    rows = cloud(600, crowd=1)
    assert check(spark, rows + rows[:130] + [rows[200]] * 40)


def test_rounds_and_full_cells(spark, monkeypatch):
    """Small blocks, so that crowded cells are split and later rounds know earlier scores (the driver sets both)."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hn, "FIRST_BLOCKS", 3)
    monkeypatch.setattr(hn, "BATCH", 4)
    assert check(spark, cloud(700, crowd=1), every=20)


def test_odd_rows(spark):
    rows = cloud(150, width=3)
    rows += [
        (1000, None, 1), (1001, [1.0, None, 2.0], 1), (1002, [1.0, math.nan, 2.0], 1), (1003, [math.inf, 0.0, 0.0], 1), (1004, [1.0, 1.0, 1.0], None),
        (None, [1.0, 1.0, 1.0], 1), (1100, [], 1), (1200, [2.0], 2), (1300, [0.5, 0.25, 0.0, 4.0, 1.0], 3), (-100, [1.0, -1.0, 1.0], 0),
    ]
    assert check(spark, rows)
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("block", "at", "salt", "vector", "slot")}))
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_force(rows)


def test_numbers_beyond_doubles(spark):
    rng = random.Random(5)
    big = [(i, [float(rng.randrange(10**4, 10**6)) for _ in range(4)], i % 2) for i in range(60)]
    assert check(spark, big, every=10)
    huge = [*big, (600, [1e30, -1e30, 1.0, 2.0], 0), (601, [1e30, -1e30, 1.0, 2.0], 0), (602, [9e29, 0.0, 0.0, 0.0], 1)]
    rows = hn.hard_negatives(spark.createDataFrame(huge, SCHEMA), every=10).where("anchor_id = 600").collect()
    assert {(r.positive_id, r.positive_score) for r in rows if r.positive_id == 601} <= {(601, 2**63 - 1)}


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [], 1), (101, [], 1), (102, [], 2)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_boxes_bound_all_products():
    rng = np.random.default_rng(3)
    vectors = np.floor(50 * rng.normal(size=(700, 6)))
    tree = hn.Tree(np.arange(700), np.zeros(700, np.int64), vectors)
    anchors = np.floor(50 * rng.normal(size=(9, 6)))
    for leaves in (True, False):
        least, most = tree.bounds(anchors, leaves)
        step = hn.LEAF * (1 if leaves else hn.FAN)
        for j in range(most.shape[1]):
            products = anchors @ vectors[j * step : (j + 1) * step].T
            assert (least[:, j] <= products.min(axis=1)).all() and (products.max(axis=1) <= most[:, j]).all()


def test_search_opens_few_boxes(monkeypatch):
    """In a clustered block, boxes below the k-th score stay closed."""
    opened = []
    monkeypatch.setattr(hn, "_scores", lambda rows, anchor: (opened.append(len(rows)), rows @ anchor)[1])
    rng = np.random.default_rng(4)
    vectors = np.floor(1000 * np.repeat(np.eye(16), 512, axis=0) + rng.normal(size=(8192, 16)))
    tree = hn.Tree(np.arange(8192), np.zeros(8192, np.int64), vectors)
    anchor = vectors[5:6]
    node, leaf = tree.bounds(anchor, False), tree.bounds(anchor, True)
    best = hn.Best(5, -math.inf, math.inf, -math.inf)
    hn._search(tree, anchor[0], 0, True, 5, (node[0][0], node[1][0], leaf[0][0], leaf[1][0]), [best])
    expect = sorted(((-s, i) for i, s in enumerate(vectors @ anchor[0]) if i != 5))[:5]
    assert [(-s, i) for s, i in zip(best.scores, best.ids)] == expect and sum(opened) <= 512


def test_no_vectors_reach_the_driver(spark, monkeypatch):
    """The cuts are fitted in a task and no plan broadcasts, though all files are far below the threshold."""
    fetched, plans = [], []
    plan_of = lambda frame: frame._jdf.queryExecution().executedPlan().toString()

    class Watched(hn.Stored):
        def __call__(self, frame):
            plans.append(plan_of(frame))
            return super().__call__(frame)

    kind = type(spark.range(0))
    collect = kind.collect
    monkeypatch.setattr(hn, "Stored", Watched)
    monkeypatch.setattr(kind, "toArrow", lambda frame: pytest.fail("rows as Arrow in the driver"))
    monkeypatch.setattr(kind, "collect", lambda frame: (fetched.append(frame.schema), collect(frame))[1])
    plans.append(plan_of(hn.hard_negatives(spark.createDataFrame(cloud(600), SCHEMA))))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert fetched and not any("array" in s.simpleString() for s in fetched)


def test_cuts_of_a_task_are_those_of_its_rows():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(500, 5))
    parts = [pa.record_batch({"vector": pa.array(list(v), pa.list_(pa.float64()))}) for v in (vectors[:200], vectors[200:])]
    rows = [r for b in hn._fit(iter(parts), 5, 64) for r in b.to_pylist()]
    levels = [(r["coordinate"], hn.unpack(r["cuts"], np.float64).reshape(r["slabs"], -1)) for r in rows]
    fitted, whole = hn.Cuts.of(levels), hn.Cuts(vectors, 64)
    assert fitted.cells == whole.cells and (fitted.cell(vectors) == whole.cell(vectors)).all()
    assert hn.Cuts.of([]).cells == 1 and not [r for b in hn._fit(iter([]), 5, 64) for r in b.to_pylist()]
