"""Hard negatives of anchor vectors by inner product, from STR-packed R-trees.

1. Vectors are dealt to blocks by sort-tile-recursive packing: quantiles of one coordinate cut slabs,
   those of the next cut each slab. The cuts come from FIT_ROWS rows at most (the smallest hashes of
   their ids) and are fitted in one task, every row is indexed. A crowded cell, such as many equal vectors,
   is several blocks.
2. Inside a block the same packing orders the rows into leaves of LEAF rows and nodes of FAN leaves, each
   with its bounding box over all coordinates and the label.
3. A box and an anchor bound their inner product from both sides, coordinate by coordinate. Each anchor
   searches a block by a best-first queue. Boxes outside all score windows, or strictly below the k-th
   score that is known, are not opened.
4. Anchors go in batches to groups of blocks. Blocks are searched in rounds, each with eight times as many
   as all before; a later round knows the k-th scores of the earlier ones, so a task sends on little more
   than what may still count. Windows with a limit merge what is found.
5. The driver gets the cuts and a count for each cell, no vectors, and broadcasts no table: Spark would
   choose by the size of the files, which hold vectors and windows in a small part of the memory they take.

Anchors: rows whose vec_id a modulus divides. Positives: the first few other rows of the same label.
Negatives: rows of other labels whose score lies in a window that the positive's score sets.

Odd rows: those without vec_id or label, or whose vector is null or has a component that is null, not
finite, or not finite times the scale, take no part. Shorter vectors count as filled up with zeros. Repeated
rows are rows of their own (also as anchors, with equal results). Inner products beyond 2**53 are counted
in whole numbers of any length; those beyond a long are ordered rightly but returned, and used for the
windows, as the nearest long. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatstrata.llm.blocks import pack, unpack
from heatstrata.llm.stored import Stored

FIT_ROWS = 20_000
BLOCK_ROWS, LEAF, FAN = 8192, 128, 16
#: Cells that the fitted cuts make, at most; fuller cells are several blocks.
CELLS = 2048
BATCH, FIRST_BLOCKS, GROWTH, GROUP = 1024, 64, 8, 32
EXACT = float(1 << 53)
_LONG = np.iinfo(np.int64)

_WINDOW = pa.struct([("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("known", pa.int64())])
_FOUND = "block long, at int, anchor_id long, slot int, found_id long, score long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _narrow(vectors: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the least width that holds them."""
    top = np.abs(vectors).max(initial=0)
    kind = next((k for k, limit in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if top <= limit), "f8")
    return kind, pack(vectors.astype(kind))


def _wide(kind: str, packed: bytes, width: int) -> np.ndarray:
    return unpack(packed, kind).astype(np.float64).reshape(-1, width)


class Cuts:
    """Sort-tile-recursive slabs: for each level its coordinate and, for each slab so far, where it is cut."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.levels: list[tuple[int, np.ndarray]] = []
        order = np.argsort(-sample.var(axis=0), kind="stable") if len(sample) else []
        members, levels = [np.arange(len(sample))], min(len(order), math.ceil(math.log2(cells) / 2)) if cells > 1 else 0
        for i in range(levels):
            slabs = max(2, math.ceil((cells / len(members)) ** (1 / (levels - i))))
            x, cuts, parts = sample[:, order[i]], [], []
            for m in members:
                s = np.sort(x[m])
                c = s[(np.arange(1, slabs) * len(s)) // slabs] if len(s) else np.zeros(slabs - 1)
                where = (x[m][:, None] >= c).sum(axis=1)
                cuts.append(c)
                parts += [m[where == k] for k in range(slabs)]
            self.levels.append((int(order[i]), np.array(cuts)))
            members = parts
        self.cells = len(members)

    @classmethod
    def of(cls, levels: list[tuple[int, np.ndarray]]) -> Cuts:
        """Cuts that were fitted before."""
        cuts = cls(np.zeros((0, 1)), 1)
        cuts.levels, cuts.cells = levels, math.prod(x.shape[1] + 1 for _, x in levels)
        return cuts

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        for coordinate, cuts in self.levels:
            at = at * (cuts.shape[1] + 1) + (vectors[:, coordinate, None] >= cuts[at]).sum(axis=1)
        return at


def _fit(batches: Iterator[pa.RecordBatch], width: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The cuts for all the vectors of a task, a row for each level."""
    sample = [_matrix(batch.column("vector"), width) for batch in batches]
    levels = Cuts(np.concatenate(sample), cells).levels if sample else []
    yield pa.record_batch(
        {
            "level": pa.array(range(len(levels)), pa.int32()), "coordinate": pa.array([c for c, _ in levels], pa.int32()),
            "slabs": pa.array([len(x) for _, x in levels], pa.int32()), "cuts": pa.array([pack(x) for _, x in levels], pa.binary()),
        }
    )


def _deal(batches: Iterator[pa.RecordBatch], cuts: Cuts, width: int, first: np.ndarray | None, salts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Adds the cell of each row, or its block when cells are known to have several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = cuts.cell(_matrix(batch.column("vector"), width))
        if first is not None:
            cell = first[cell] + batch.column("salt").to_numpy() % salts[cell]
        yield pa.record_batch([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "block"])


def _pack_block(rows: pa.Table, width: int) -> pa.Table:
    """The rows of a block in the order of its leaves."""
    rows = rows.sort_by([("vec_id", "ascending"), ("label", "ascending")])
    vectors = _matrix(rows["vector"], width)
    leaves = math.ceil(len(vectors) / LEAF)
    order = np.argsort(Cuts(vectors, leaves).cell(vectors), kind="stable") if leaves > 1 else np.arange(len(vectors))
    kind, packed = _narrow(vectors[order])
    return pa.table(
        {
            "block": rows["block"].slice(0, 1),
            "ids": pa.array([pack(rows["vec_id"].to_numpy()[order])], pa.binary()),
            "labels": pa.array([pack(rows["label"].to_numpy()[order])], pa.binary()),
            "kind": pa.array([kind]),
            "vectors": pa.array([packed], pa.binary()),
        }
    )


def _anchors(batches: Iterator[pa.RecordBatch], width: int, every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = unpack(row["ids"], np.int64), unpack(row["labels"], np.int64)
            at = np.flatnonzero(ids % every == 0)
            if len(at):
                vectors = _wide(row["kind"], row["vectors"], width)[at]
                yield pa.record_batch(
                    {
                        "block": pa.array(np.full(len(at), row["block"]), pa.int64()), "at": pa.array(at, pa.int32()),
                        "anchor_id": pa.array(ids[at]), "label": pa.array(labels[at]), "vector": pa.array(list(vectors), pa.list_(pa.float64())),
                    }
                )


def _pack_batch(rows: pa.Table, width: int) -> pa.Table:
    kind, packed = _narrow(_matrix(rows["vector"], width))
    numbers = {c: pa.array([pack(rows[c].to_numpy().astype(np.int64))], pa.binary()) for c in ("block", "at", "anchor_id", "label")}
    table = {"batch": rows["batch"].slice(0, 1), **numbers, "kind": pa.array([kind]), "vectors": pa.array([packed], pa.binary())}
    windows = pa.array([rows["windows"].to_pylist()], pa.list_(pa.list_(_WINDOW)))
    return pa.table({**table, "windows": windows})


def _scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products; as Python's whole numbers where doubles would not be exact."""
    if np.abs(rows).max(initial=0) * np.abs(anchor).sum() < EXACT:
        return rows @ anchor
    whole = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(row, whole)) for row in rows], object)


class Tree:
    """A block's rows with the boxes of its leaves and nodes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.first = np.arange(0, len(ids), LEAF)
        self.low, self.high = np.minimum.reduceat(vectors, self.first, axis=0), np.maximum.reduceat(vectors, self.first, axis=0)
        self.label_low, self.label_high = np.minimum.reduceat(labels, self.first), np.maximum.reduceat(labels, self.first)
        nodes = np.arange(0, len(self.first), FAN)
        self.node_low, self.node_high = np.minimum.reduceat(self.low, nodes, axis=0), np.maximum.reduceat(self.high, nodes, axis=0)
        self.top = float(np.abs(vectors).max(initial=0))

    def bounds(self, anchors: np.ndarray, leaves: bool) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with any point of each box; infinite beyond exact numbers."""
        low, high = (self.low, self.high) if leaves else (self.node_low, self.node_high)
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        inexact = self.top * np.abs(anchors).sum(axis=1) >= EXACT
        least[inexact], most[inexact] = -np.inf, np.inf
        return least, most


class Best:
    """The first k of a window so far: higher scores first, ties by smaller id."""

    def __init__(self, k: int, low: float, high: float, known: float):
        self.k, self.low, self.high, self.kth = k, low, high, known
        self.scores: list = []
        self.ids: list[int] = []

    def wants(self, least: float, most: float) -> bool:
        return most >= self.low and least <= self.high and min(most, self.high) >= self.kth

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = np.flatnonzero((scores >= max(self.low, self.kth)) & (scores <= self.high))
        if not len(inside):
            return
        all_ = sorted([*zip(self.scores, self.ids), *zip(scores[inside], (int(i) for i in ids[inside]))], key=lambda e: (-e[0], e[1]))[: self.k]
        self.scores, self.ids = [e[0] for e in all_], [e[1] for e in all_]
        if len(all_) == self.k:
            self.kth = max(self.kth, self.scores[-1])


def _search(tree: Tree, anchor: np.ndarray, label: int, same: bool, own: int, bounds: tuple[np.ndarray, ...], windows: list[Best]) -> None:
    """Best-first over the boxes: nodes, then leaves, those first that may hold the best score of a window."""
    node_least, node_most, leaf_least, leaf_most = bounds

    def entry(least: float, most: float, is_leaf: bool, place: int):
        best = max((min(most, w.high) for w in windows if w.wants(least, most)), default=None)
        return None if best is None else (-best, is_leaf, place, least, most)

    queue = [e for p in range(len(node_most)) if (e := entry(node_least[p], node_most[p], False, p))]
    heapq.heapify(queue)
    while queue:
        _, is_leaf, place, least, most = heapq.heappop(queue)
        if not any(w.wants(least, most) for w in windows):
            continue
        if not is_leaf:
            for leaf in range(place * FAN, min(place * FAN + FAN, len(tree.first))):
                one = tree.label_low[leaf] == tree.label_high[leaf]
                fits = tree.label_low[leaf] <= label <= tree.label_high[leaf] if same else not (one and tree.label_low[leaf] == label)
                if fits and (e := entry(leaf_least[leaf], leaf_most[leaf], True, leaf)):
                    heapq.heappush(queue, e)
            continue
        a, b = tree.first[place], min(tree.first[place] + LEAF, len(tree.ids))
        fits = (tree.labels[a:b] == label) == same
        if a <= own < b:
            fits[own - a] = False
        scores, ids = _scores(tree.vectors[a:b], anchor)[fits], tree.ids[a:b][fits]
        for w in windows:
            w.add(scores, ids)


def _search_pairs(pairs: Iterator[pa.RecordBatch], width: int, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Each row is a batch of anchors and a block."""
    for piece in pairs:
        for i in range(piece.num_rows):
            row = piece.slice(i, 1).to_pylist()[0]
            tree = Tree(unpack(row["t_ids"], np.int64), unpack(row["t_labels"], np.int64), _wide(row["t_kind"], row["t_vectors"], width))
            anchors = _wide(row["kind"], row["vectors"], width)
            block, at, ids, labels = (unpack(row[c], np.int64) for c in ("block", "at", "anchor_id", "label"))
            node, leaf = tree.bounds(anchors, False), tree.bounds(anchors, True)
            out: list[tuple] = []
            for j in range(len(anchors)):
                windows = [Best(k, _or(w["low"], -math.inf), _or(w["high"], math.inf), _or(w["known"], -math.inf)) for w in row["windows"][j]]
                own = int(at[j]) if block[j] == row["t_block"] else -1
                _search(tree, anchors[j], labels[j], same, own, (node[0][j], node[1][j], leaf[0][j], leaf[1][j]), windows)
                for w, best in zip(row["windows"][j], windows):
                    out += [(block[j], at[j], ids[j], w["slot"], f, min(max(int(s), _LONG.min), _LONG.max)) for s, f in zip(best.scores, best.ids)]
            columns = zip(*out) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["block", "at", "anchor_id", "slot", "found_id", "score"])


def _or(value, otherwise):
    return otherwise if value is None else value


class Index:
    """The packed blocks of a vector table."""

    def __init__(self, rows: DataFrame, store: Stored):
        """rows: vec_id, label, vector (whole numbers as array<double>), salt; stored."""
        self.store, self.spark = store, rows.sparkSession
        size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.n, self.width = size[0], max(1, size[1] or 0)
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = max(1, min(max(partitions, math.ceil(self.n / BLOCK_ROWS)), CELLS, self.n // 32))
        sample = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(FIT_ROWS).select("vector").coalesce(1)
        levels = sample.mapInArrow(functools.partial(_fit, width=self.width, cells=wanted), "level int, coordinate int, slabs int, cuts binary").collect()
        cuts = Cuts.of([(r.coordinate, unpack(bytes(r.cuts), np.float64).reshape(r.slabs, -1)) for r in sorted(levels, key=lambda r: r.level)])
        schema = f"{_schema(rows)}, block long"
        dealt = functools.partial(_deal, cuts=cuts, width=self.width)
        counts = dict(rows.mapInArrow(functools.partial(dealt, first=None, salts=None), schema).groupBy("block").count().collect())
        salts = np.array([max(1, math.ceil(counts.get(c, 0) / BLOCK_ROWS)) for c in range(cuts.cells)])
        first = np.cumsum(salts) - salts
        self.count = int(salts.sum())
        blocks = rows.mapInArrow(functools.partial(dealt, first=first, salts=salts), schema).groupBy("block")
        width = self.width
        self.blocks = store(blocks.applyInArrow(lambda t: _pack_block(t, width), "block long, ids binary, labels binary, kind string, vectors binary"))
        self.partitions = partitions

    def anchors(self, every: int) -> DataFrame:
        """Rows of the index whose id is divisible, in batches."""
        found = self.store(
            self.blocks.mapInArrow(functools.partial(_anchors, width=self.width, every=every), "block long, at int, anchor_id long, label long, vector array<double>")
        )
        batches = max(1, math.ceil(found.count() / BATCH))
        return found.withColumn("batch", F.pmod(F.xxhash64("block", "at"), F.lit(batches)))

    def first(self, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """The first k rows of each window (block, at, slot, low, high) of the anchors, among rows of the same label or of others."""
        key = ["block", "at", "slot"]
        best = Window.partitionBy(*key).orderBy(F.desc("score"), "found_id")
        found, lo, hi, width = None, 0, FIRST_BLOCKS, self.width
        while lo == 0 or lo < self.count:
            known = windows.withColumn("known", F.lit(None).cast("long"))
            if found is not None:
                full = found.groupBy(*key).agg(F.when(F.count("*") >= k, F.min("score")).alias("known"))
                known = _joined(windows, full, key, "left")
            listed = known.groupBy("block", "at").agg(F.array_sort(F.collect_list(F.struct("slot", "low", "high", "known"))).alias("windows"))
            kinds = "array<array<struct<slot:int,low:long,high:long,known:long>>>"
            schema = f"batch long, block binary, at binary, anchor_id binary, label binary, kind string, vectors binary, windows {kinds}"
            packed = _joined(anchors, listed, ["block", "at"]).groupBy("batch").applyInArrow(lambda t: _pack_batch(t, width), schema)
            # Which blocks a round takes is a fixed shuffle of their numbers, so early rounds see all regions.
            rank = F.pmod(F.col("block") * _coprime(self.count), F.lit(self.count))
            here = self.blocks.where((rank >= lo) & (rank < hi))
            blocks = min(hi, self.count) - lo
            groups = max(math.ceil(blocks / GROUP), min(self.partitions, blocks))
            trees = here.select((rank % groups).alias("group"), *[F.col(c).alias(f"t_{c}") for c in here.columns])
            grouped = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            pairs = _joined(grouped, trees, ["group"]).drop("group", "batch")
            new = pairs.mapInArrow(functools.partial(_search_pairs, width=self.width, same=same, k=k), _FOUND)
            both = new if found is None else new.unionByName(found)
            found = self.store(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
            lo, hi = hi, hi * GROWTH
        return found.withColumn("rank", F.row_number().over(best))


def _joined(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """A join without a broadcast, whatever the session's threshold and the size of the files."""
    return left.join(right.hint("merge"), key, how)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)


def _coprime(n: int) -> int:
    """A number near 0.618 n without a common divisor."""
    return next(c for c in range(max(1, int(n * 0.618)), 2 * n + 2) if math.gcd(c, n) == 1)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, the first negatives of each anchor and positive.

    vectors has vec_id, embedding and label. Components count as floor(scale * x), x as double. A negative's score lies
    between the two percentages of the positive's: 100 * negative_score from percent[0] to percent[1] times positive_score.
    """
    store = Stored(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: F.coalesce((F.abs(x * scale) < F.lit(math.inf)) & ~F.isnan(x), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    # A double has no floor in Spark that stays a double beyond long, so large whole numbers, which are their own floor, stay as they are.
    whole = F.transform("x", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(1 << 30))
    index = Index(store(rows.select("vec_id", "label", whole.alias("vector")).withColumn("salt", salt)), store)
    anchors = index.anchors(every)
    all_scores = anchors.select("block", "at", F.lit(0).alias("slot"), *[F.lit(None).cast("long").alias(c) for c in ("low", "high")])
    own = index.first(anchors, all_scores, True, positives).select("block", "at", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = store(own)
    low, high = (F.expr(f"CAST({f}(CAST(positive_score AS DECIMAL(24,0)) * {p} / 100) AS LONG)") for f, p in (("ceil", percent[0]), ("floor", percent[1])))
    windows = own.select("block", "at", "slot", low.alias("low"), high.alias("high")).where("low <= high")
    others = index.first(anchors, windows, False, negatives)
    done = _joined(others, own, ["block", "at", "slot"])
    return done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
