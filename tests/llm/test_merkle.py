"""The Merkle manifest against plain Python, with trees of more than one chunk."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatstrata.llm import merkle_manifest as mm

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree_paths(nodes):
    """Root and, for each node, its runs from the lowest level up."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, places):
            first = at - at % 16
            path.append((at % 16, nodes[first : first + 16]))
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        places = [at // 16 for at in places]
    return nodes[0], paths


def brute_force(rows):
    by_source = collections.defaultdict(list)
    for row in rows:
        by_source[row[3]].append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(by_source[source], key=lambda m: m[:3])
        trees.append((members, *tree_paths([m[2] for m in members])))
    root, above = tree_paths([t[1] for t in trees])
    out = []
    for (members, subroot, paths), top in zip(trees, above):
        for (_, _, leaf, row), path in zip(members, paths):
            whole = path + top
            proof = digest(*[d for at, run in whole for i, d in enumerate(run) if i != at])
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf_of(row, lowered(row[1])) if chosen else leaf
            for at, run in whole:
                folded = digest(*run[:at], folded, *run[at + 1 :])
            out.append((row[0], leaf, subroot, root, proof, folded, folded == root))
    return out


def check(spark, rows):
    got = [tuple(r) for r in mm.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert collections.Counter(got) == collections.Counter(brute_force(rows))
    return got


def test_trees_of_several_chunks(spark):
    sizes = {"hot": 2 * mm.CHUNK + 3, "b": mm.CHUNK, "c": 257, "d": 16, "e": 1, None: 17, "é": 2, "": 1}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 1_000_003, f"Text {i} Äb" if i % 3 else "no capitals", "en", source, i))
    got = check(spark, rows)
    assert any(not r[6] for r in got) and sum(r[6] for r in got) > len(got) / 2


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (None, "A", "en", "a", 1), (None, None, None, "a", None), (5, "", "en", "a", 0), (5, "B", "en", "a", 1),
        (5, "B", "en", "a", 1), (-7, "X" * 100_000, "en", "b", 100_000), (13, "ABC", "en", "b", 3),
    ]
    got = check(spark, rows)
    assert len(got) == len(rows)
    assert check(spark, rows[:1])[0][6] is True


def test_many_equal_rows_and_sources(spark):
    check(spark, [(3, "Same", "en", "a", 4)] * 600 + [(i, "x", "en", f"s{i:03d}", 1) for i in range(300)])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mm.merkle_manifest(empty).collect() == []
    rows = [(1, "A", "en", "a", 1), (2, "B", "en", "a", 1)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "leaf", "root", "n", "idx", "chunk", "range", "at", "salt", "name")})
    assert collections.Counter(tuple(r) for r in mm.merkle_manifest(clash).collect()) == collections.Counter(brute_force(rows))


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, mm.CHUNK])
def test_sweeps_agree_with_levels(n):
    nodes = [digest(str(i)) for i in range(n)]
    root, paths = tree_paths(nodes)
    levels = mm._sweep_up(nodes, True)
    assert levels[-1] == [root]
    assert [mm._read_path(mm._write_path(p)) for p in mm._sweep_down(levels, [])] == paths
