"""Merkle manifest of a document table: a leaf, a proof and a check of it for each document.

The trees are built by time-forward processing. A node's label is (level, place). Digests are messages
to the label of the parent, taken from a priority queue in the order of the labels; then a reversed
sweep sends each node's proof suffix (the runs of siblings above it) to its children. Nodes of one tree
are numbered in order, and CHUNK consecutive ones, a whole number of levels, are swept together; the
digests of the chunks are the messages of the next, CHUNK times smaller, pass, which Spark's sorted
shuffles deliver between tasks. No pass gathers a tree: a hot source is many chunks, and what a task
holds is one chunk and log(n) runs of siblings.

Odd rows: a null in any column hashes as ``-``; null doc_ids come first within their source; repeated
rows are a leaf each, in any order, since they are equal; rows with equal doc_id but other content are
ordered by their leaf. An empty table has no rows. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatstrata.llm.stored import Stored

#: Nodes in a run, and levels that are swept in one task.
ARITY, LEVELS = 16, 3
CHUNK = ARITY**LEVELS
#: Rows of a sorted range, about.
RANGE_ROWS = 1 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PACKS = "tree string, chunk long, n long, names array<string>, digests binary, forged array<binary>, top binary"
_SUFFIXES = "tree string, name string, chunk long, suffix binary, subroot binary"
#: Runs above a node, from its own to the root: (its place in the run, hex digests of the run).
Path = list[tuple[int, list[str]]]


def _hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf_digest(**fields: Column) -> Column:
    """Digest of a row: each field as UTF-8 byte count, ``:``, value, or ``-`` for null."""
    texts = [c.cast("string") for c in fields.values()]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, forged): forged is the digest of the tampered row, null where nothing is tampered."""
    fields = {c: F.col(c) for c in FIELDS}
    tampered = fields | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf_digest(**fields)).alias("leaf"),
        F.when(chosen, F.unhex(leaf_digest(**tampered))).alias("forged"),
    )


def _count_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range and the place among the rows of the same tree in this sorted range."""
    last, seen, task = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("tree").dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        at = np.arange(len(codes)) - np.repeat(first, np.diff([*first, len(codes)]))
        trees = [coded.dictionary[int(codes[i])].as_py() for i in (0, -1)]
        if trees[0] == last:
            at[: first[1] if len(first) > 1 else len(codes)] += seen
        last, seen = trees[1], int(at[-1]) + 1
        yield pa.record_batch(
            [*batch.columns, pa.array(np.full(len(codes), task), pa.int32()), pa.array(at, pa.int64())],
            names=[*batch.schema.names, "range", "at"],
        )


def numbered(nodes: DataFrame, order: list[str], store: Stored) -> DataFrame:
    """nodes (stored) with their place ``idx`` in their tree and the tree's size ``n``.

    One sort by ranges, which cut hot trees anywhere; the sizes of the pieces give each piece its offset.
    """
    spark = nodes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes.count() / RANGE_ROWS))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(997))  # equal rows need no order, but may be many
    ordered = nodes.withColumn("salt", salt).repartitionByRange(ranges, "tree", *order, "salt").sortWithinPartitions("tree", *order).drop("salt")
    schema = T.StructType([*ordered.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("at", T.LongType())])
    cut = store(ordered.mapInArrow(_count_inside, schema))
    pieces = cut.groupBy("tree", "range").agg(F.count("*").alias("rows"))
    offsets = pieces.select(
        "tree", "range",
        F.expr("coalesce(sum(rows) OVER (PARTITION BY tree ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset"),
        F.expr("sum(rows) OVER (PARTITION BY tree) AS n"),
    )
    return cut.join(offsets, ["tree", "range"]).withColumn("idx", F.col("at") + F.col("offset")).drop("range", "at", "offset")


def _sweep_up(digests: list[str], whole: bool) -> list[list[str]]:
    """Digests of every level of a chunk; of a whole tree up to its root, else LEVELS levels."""
    levels, sizes = [digests], [len(digests)]
    while (sizes[-1] > 1) if whole else (len(sizes) <= LEVELS):
        sizes.append(math.ceil(sizes[-1] / ARITY))
        levels.append([])
    queue = [(1, i // ARITY, i, d) for i, d in enumerate(digests)] if len(sizes) > 1 else []
    heapq.heapify(queue)
    while queue:
        level, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, place):
            run.append(heapq.heappop(queue)[3])
        levels[level].append(_hash(run))
        if level + 1 < len(sizes):
            heapq.heappush(queue, (level + 1, place // ARITY, place, levels[level][-1]))
    return levels


def _sweep_down(levels: list[list[str]], above: Path) -> Iterator[Path]:
    """The path of each node of the lowest level, given the path above the chunk."""
    paths = [above]
    for level in reversed(levels[:-1]):
        runs = [level[i : i + ARITY] for i in range(0, len(level), ARITY)]
        paths = [[(i % ARITY, runs[i // ARITY]), *paths[i // ARITY]] for i in range(len(level))]
    return iter(paths)


def _fold(digest: str, path: Path) -> str:
    for at, run in path:
        digest = _hash([*run[:at], digest, *run[at + 1 :]])
    return digest


def _write_path(path: Path) -> bytes:
    return b"".join(bytes([at, len(run)]) + bytes.fromhex("".join(run)) for at, run in path)


def _read_path(raw: bytes) -> Path:
    path, i = [], 0
    while i < len(raw):
        end = i + 2 + 32 * raw[i + 1]
        path.append((raw[i], [raw[j : j + 32].hex() for j in range(i + 2, end, 32)]))
        i = end
    return path


def _hexes(raw: bytes) -> list[str]:
    return [raw[i : i + 32].hex() for i in range(0, len(raw), 32)]


def _pack(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("idx")
    digests = b"".join(nodes["digest"].to_pylist())
    n = nodes["n"][0].as_py()
    top = _sweep_up(_hexes(digests), n <= CHUNK)[-1][0]
    row = {
        "tree": nodes["tree"][0].as_py(), "chunk": nodes["chunk"][0].as_py(), "n": n, "names": nodes["name"].to_pylist(),
        "digests": digests, "forged": nodes["forged"].to_pylist(), "top": bytes.fromhex(top),
    }
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary()), pa.binary())
    return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


def _climb(nodes: DataFrame, store: Stored) -> tuple[list[DataFrame], DataFrame]:
    """The chunks of each pass, and the root (tree, top) of each tree."""
    passes: list[DataFrame] = []
    roots = None
    while True:
        chunked = nodes.withColumn("chunk", F.expr(f"idx div {CHUNK}"))
        passes.append(store(chunked.groupBy("tree", "chunk").applyInArrow(_pack, _PACKS)))
        done = passes[-1].where(F.col("n") <= CHUNK).select("tree", "top")
        roots = done if roots is None else roots.union(done)
        open_ = passes[-1].where(F.col("n") > CHUNK)
        if not open_.limit(1).count():
            return passes, roots
        nodes = open_.select(
            "tree", F.col("chunk").alias("idx"), F.expr(f"(n + {CHUNK - 1}) div {CHUNK} AS n"), F.lit(None).cast("string").alias("name"),
            F.col("top").alias("digest"), F.lit(None).cast("binary").alias("forged"),
        )


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[Path]]]:
    """The paths of the nodes of each chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            levels = _sweep_up(_hexes(row["digests"]), row["n"] <= CHUNK)
            yield row, list(_sweep_down(levels, _read_path(row["suffix"])))


def _send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, paths in _opened(batches):
        first = row["chunk"] * CHUNK
        yield pa.record_batch(
            {
                "tree": pa.array([row["tree"]] * len(paths), pa.string()),
                "name": pa.array(row["names"], pa.string()),
                "chunk": pa.array(range(first, first + len(paths)), pa.int64()),
                "suffix": pa.array([_write_path(p) for p in paths], pa.binary()),
                "subroot": pa.array([row["subroot"]] * len(paths), pa.binary()),
            }
        )


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, paths in _opened(batches):
        own = _hexes(row["digests"])
        proofs = [_hash([d for at, run in p for d in (*run[:at], *run[at + 1 :])]) for p in paths]
        folded = [_fold(f.hex() if f else d, p) for d, f, p in zip(own, row["forged"], paths)]
        n = len(own)
        yield pa.record_batch(
            {
                "doc_id": pa.array([None if x is None else int(x) for x in row["names"]], pa.int64()),
                "leaf": pa.array(own, pa.string()),
                "subroot": pa.array([row["subroot"].hex()] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
            }
        )


def _descend(passes: list[DataFrame], suffixes: DataFrame, store: Stored) -> DataFrame:
    """The lowest chunks joined with their suffix. suffixes (tree, suffix, subroot): what lies above each tree's root."""
    sent = None
    for level in reversed(range(len(passes))):
        roots = passes[level].where(F.col("n") <= CHUNK).select("tree").distinct()
        here = roots.join(suffixes, "tree").select("tree", F.lit(0).cast("long").alias("chunk"), "suffix", "subroot")
        if sent is not None:
            here = here.unionByName(sent.select("tree", "chunk", "suffix", "subroot"))
        joined = passes[level].join(here, ["tree", "chunk"])
        if level:
            sent = store(joined.mapInArrow(_send_suffixes, _SUFFIXES))
    return joined


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs.

    docs needs the columns of FIELDS. Rows whose id is chosen are tampered with before their fold.
    """
    store = Stored(docs.sparkSession)
    rows = numbered(store(leaves(docs)), ["doc_id", "leaf"], store)
    nodes = rows.select("tree", "idx", "n", F.col("doc_id").cast("string").alias("name"), F.col("leaf").alias("digest"), "forged")
    passes, subroots = _climb(nodes, store)
    trees = store(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")))
    above, roots = _climb(numbered(trees, ["name"], store).withColumn("forged", F.lit(None).cast("binary")), store)
    found = roots.first()
    top = docs.sparkSession.createDataFrame([("", b"", b"")], "tree string, suffix binary, subroot binary")
    tops = _descend(above, top, store).mapInArrow(_send_suffixes, _SUFFIXES).select(F.col("name").alias("tree"), "suffix")
    suffixes = store(tops.join(subroots, "tree").select("tree", "suffix", F.col("top").alias("subroot")))
    checked = _descend(passes, suffixes, store).mapInArrow(_check, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(found["top"].hex() if found else None).cast("string")
    return checked.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
