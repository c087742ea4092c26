"""The LSH forest against brute force: crowds of near copies, chains, passages, odd rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heatstrata.llm import lsh_forest as lf


def sets_of(rows, size=4):
    out = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        out.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute_force(rows):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def run(docs_of, rows):
    got = lf.near_copies(docs_of(*rows)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def crowd(n, rng, base, edits):
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"r{rng.random()}"
        rows.append((i, " ".join(w)))
    return rows


def test_crowds_chains_and_passages(docs_of):
    rng = random.Random(7)
    rows = crowd(300, rng, [f"b{i}" for i in range(120)], [0, 1, 2, 3, 5, 8])
    w = [f"c{i}" for i in range(100)]
    for i in range(12):  # a chain: each differs a little from the one before
        w = list(w)
        w[(i * 8) % 100] = f"d{i}"
        rows.append((500 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(600 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.choice([5, 10, 14, 40])))) for i in range(60)]
    rows += [(700 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(100)]
    assert run(docs_of, rows) == brute_force(rows)


def test_a_crowd_of_many_regions(docs_of):
    """More near copies than a region holds, some far from all but a few others."""
    rng = random.Random(8)
    rows = crowd(1500, rng, [f"b{i}" for i in range(90)], [0, 1, 1, 2, 3])
    assert run(docs_of, rows) == brute_force(rows)


def test_ends_of_tasks_lose_no_link(spark, docs_of):
    """So few rows over so many tasks that two neighbours are in one task only if all DEEP values are equal; these have no such tree."""
    rows = [(i, " ".join([f"s272_{j}" for j in range(92)] + [f"{own}272_{j}" for j in range(10)])) for i, own in enumerate("ab")]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 120)
    try:
        assert run(docs_of, rows) == brute_force(rows) == [(0, 99, 0), (1, 99, 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_cut_runs_are_named():
    """Every class of a run that was cut has the run's name, however the rows come; other runs have none."""
    runs = [(1, 3), (2, 1), (3, 700), (4, 5), (5, lf.REGION + 1), (6, 1), (7, 9), (8, 1)]
    places = [b"\0" + run.to_bytes(2, "big") * 3 + (i // 3).to_bytes(2, "big") * 5 for run, n in runs for i in range(n)]
    keys = [i.to_bytes(2, "big") for i in range(len(places))]
    torn = {i for i, p in enumerate(places) if p[2] in (1, 3, 5, 8)}
    for step in (1, 97, 1000):
        batches = [pa.record_batch([pa.array(places[i : i + step]), pa.array(keys[i : i + step])], names=["place", "key"]) for i in range(0, len(places), step)]
        out = pa.Table.from_batches(list(_with_task(lf._regions, iter(batches)))).to_pylist()
        named = {int.from_bytes(r["key"], "big"): r["run"] for r in out if r["run"]}
        assert set(named) == torn and all(places[i].startswith(run) for i, run in named.items())


def test_sets_meet_in_blocks(spark):
    """Cells of several blocks give the pairs that comparing all sets gives, under different labels only."""
    rng = random.Random(9)
    base = list(range(1, 91))
    sets = [sorted({t if rng.random() > 0.04 else rng.randrange(1, 1 << 40) for t in base}) for _ in range(400)]
    key = [i.to_bytes(16, "big") for i in range(400)]
    rest = [(key[i], key[i % 390], np.array(t, np.uint64).tobytes()) for i, t in enumerate(sets)]
    cells = []
    for blocks in (1, 3):
        for x in range(blocks):
            for y in range(x, blocks):
                rows = [i for i in range(400) if i % blocks in (x, y)]
                described = pa.record_batch([pa.array(c, pa.binary()) for c in zip(*(rest[i] for i in rows))], names=["key", "label", "tokens"])
                made = pa.Table.from_batches(list(lf._sketches(iter([described])))).combine_chunks().to_batches()[0]
                n = made["n"].to_numpy()
                columns = {**{c: made[c] for c in ("key", "label", "n", "bits")}, "rest": pa.array(n), "block": pa.array([i % blocks for i in rows], pa.int32())}
                cells.append((blocks, pa.record_batch({"cell": pa.array(np.full(len(rows), len(cells))), **columns})))
    links = {(key[a], key[b]) for a in range(400) for b in range(a) if a % 390 != b % 390 and _links(set(sets[a]), set(sets[b]))}
    for blocks in (1, 3):
        met = [(r["a"], r["b"]) for out in lf._meet(iter([c for k, c in cells if k == blocks]), 80) for r in out.to_pylist()]
        met = {(max(p), min(p)) for p in met}
        assert links <= met and all(int.from_bytes(a, "big") % 390 != int.from_bytes(b, "big") % 390 for a, b in met)
        assert len(met - links) < 0.25 * (400 * 399 / 2 - len(links))


def test_the_exact_join_lists_no_tokens_of_crowds(spark, monkeypatch):
    """Of sets in crowds, only tokens that other components have too are rows, and only the rarest; pairs are those of brute force."""
    rng = random.Random(10)
    sets = []
    for c in range(3):  # crowds with a third of their tokens in common
        base = list(range(30)) + list(range(100 * (c + 1), 100 * (c + 1) + 60))
        sets += [(c, sorted({t if rng.random() > 0.03 else rng.randrange(1000, 1 << 40) for t in base})) for _ in range(80)]
    base = list(range(400, 490))
    for i in range(60):  # sets of their own around one text, some of which link
        sets.append((100 + i, sorted({t if rng.random() > rng.choice([0.02, 0.15]) else rng.randrange(1000, 1 << 40) for t in base})))
    names = [i.to_bytes(16, "big") for i in range(len(sets))]
    columns = "cls long, key binary, label binary, tokens binary"
    rest = spark.createDataFrame([(7 * i, names[i], names[label], lf.words.mix(np.array(t, np.uint64)).tobytes()) for i, (label, t) in enumerate(sets)], columns)
    rows = []

    class Counted(lf.Stored):
        def __call__(self, frame):
            out = super().__call__(frame)
            rows.append(out.count())
            return out

    store = Counted(spark)
    rest = lf.Stored(spark)(rest)
    where = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][0] != sets[b][0]]
    links = {(names[a], names[b]) for a, b in where if _links(set(sets[a][1]), set(sets[b][1]))}
    assert len(links) > 100
    for block in (lf.BLOCK, 25):
        monkeypatch.setattr(lf, "BLOCK", block)
        met = {(max(r.a, r.b), min(r.a, r.b)) for r in lf._prefix_pairs(rest, store, 80).collect()}
        assert links <= {(bytes(a), bytes(b)) for a, b in met}
        assert all(min(int.from_bytes(x, "big") for x in p) >= 240 for p in met)
    assert max(rows) <= len(sets)  # no table has a row for each token of a set


def _links(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_odd_rows(docs_of):
    long = " ".join(f"w{i % 4001}x{i % 17}" for i in range(60_000))
    rows = [
        (1, long), (2, None), (None, "one two three four five"), (3, ""), (4, " \n\t "), (5, "same words here again"), (5, "Same WORDS here again"), (6, "x"),
        (7, long + " and more"), (8, "X"), (None, "x"), (9, "one two"), (9, "quite other words than those"), (None, None), (10, "Ä x y z"), (11, "ä x y z"),
    ]
    assert run(docs_of, rows) == brute_force(rows)
    clash = docs_of(*rows).withColumns({c: F.lit("clash") for c in ("n", "key", "label", "values", "bytes", "region", "least", "kept")})
    assert lf.near_copies(clash).count() == len(rows)
    assert lf.near_copies(docs_of()).collect() == []


def test_regions_keep_neighbours():
    """Runs longer than a region are cut without a gap, however the rows come in batches."""
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, 3, size=(5000, lf.DEEP)).astype(">u2").view(np.uint8).reshape(5000, -1).view(f"S{2 * lf.DEEP}").ravel())
    raw = np.frombuffer(values.tobytes(), np.uint8).reshape(5000, -1)
    places = [b"\0" + r.tobytes() for r in raw]
    keys = [i.to_bytes(2, "big") for i in range(5000)]
    found = []
    for step in (1, 97, 1000, 5000):
        batches = [pa.record_batch([pa.array(places[i : i + step]), pa.array(keys[i : i + step])], names=["place", "key"]) for i in range(0, 5000, step)]
        regions = {}
        for out in _with_task(lf._regions, iter(batches)):
            for r, k in zip(out.column("region").to_pylist(), out.column("key").to_pylist()):
                regions.setdefault(r, []).append(int.from_bytes(k, "big"))
        sizes = [len(m) for m in regions.values()]
        assert max(sizes) <= lf.REGION and min(sizes) >= 2
        assert all(m == list(range(m[0], m[0] + len(m))) for m in regions.values())
        common = lf._common(np.frombuffer(b"".join(places), np.uint8).reshape(5000, -1))
        inside = {i for m in regions.values() for i in m}
        assert all(i in inside for i in range(1, 5000) if common[i] >= lf.SHALLOW and lf.REGION not in sizes)
        found.append(inside)
    assert found[0] == found[-1]


def _with_task(fn, batches):
    class Task:
        @staticmethod
        def partitionId():
            return 3

    real = lf.TaskContext.get
    lf.TaskContext.get = staticmethod(lambda: Task)
    try:
        yield from fn(batches)
    finally:
        lf.TaskContext.get = real


def test_signatures_estimate():
    rng = np.random.default_rng(2)
    shared, near = rng.integers(0, 1 << 63, 800, np.uint64), []
    for _ in range(200):
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 100, np.uint64)]) for _ in range(2))
        near.append((lf._signature(a).astype(np.uint8) == lf._signature(b).astype(np.uint8)).sum())
    assert abs(np.mean(near) / lf.VALUES - 0.8) < 0.02 and min(near) >= lf.AGREE
