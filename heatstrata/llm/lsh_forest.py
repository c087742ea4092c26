"""Near copies among documents by an LSH forest over MinHash signatures, confirmed on the full sets.

1. Documents with equal shingle sets are one class, by a 128-bit digest. Only classes go on.
2. A signature has VALUES minima. A tree is all classes in the order of the signature as read from its
   own first value on; the TREES orders are one distributed sort by (tree, DEEP values). Neighbours
   whose common prefix has SHALLOW values or more are candidates. Such a run is one region; a longer run
   than REGION is cut where neighbours have the shortest common prefix, so crowded regions are as deep
   as they need be and lonely ones shallow, and each class keeps its nearest neighbours.
3. Inside a region, a pair may be similar if its signatures agree in so many values and its sizes are
   near. Two passes propose pairs: one partner per class; then a spanning forest over the components so
   far. The full sets confirm or refuse them.
4. Regions that still hold several components get the full sets of the classes that may link them, and
   every such pair is compared there, by products of the token matrix. No pairs are sent around.
   A region whose classes are all connected is done, so crowds of near copies never meet pair by pair.
5. A run that was cut, by its length or by the end of a task's range, and that still holds several
   components is joined whole and exactly: its sets meet at the rarest tokens that occur under several
   components (two sets of different components that link have one of a few in common), in blocks of BLOCK
   sets by BLOCK, and the pairs that bounds on the intersection leave are confirmed on the full sets. The
   cuts thus lose no link.

Two sets with the lowest similarity that counts (0.8) share SHALLOW values in a tree with probability
0.51, thus no region at all with 3e-8; a pair that agrees in fewer than AGREE values has at most 4e-5.
A component is lost only if all links between its two parts are.

Odd rows: a null or wordless text has an empty set and no links; rows without a doc_id take part and
get the smallest doc_id they reach, null if there is none; repeated doc_ids are documents of their own;
an empty table has no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import blocks, words
from heatstrata.llm.components import components
from heatstrata.llm.ngram_join import rarest_shared
from heatstrata.llm.stored import Stored

VALUES, TREES = 96, 24
#: Signature values that candidates share, and that a sort key holds.
SHALLOW, DEEP = 3, 8
#: Classes in a region at most.
REGION = 256
#: Sets of one token that meet in a task: twice as many at most. Bits of the sketch that bounds an intersection.
BLOCK, BITS = 2048, 1024
#: Bytes of sets, at least, for which the exact join has one more block of the token matrix.
PIECE_BYTES = 1 << 20
#: Equal values of a pair that may be similar: four standard deviations below 77 of 96, and surely similar.
AGREE, SURELY = 61, 84
#: Longest list of set digests that is broadcast (some 40 bytes a row); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
_FACTORS = words.mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_ADDENDS = words.mix(np.arange(1001, VALUES + 1001, dtype=np.uint64))
#: Values of each tree's sort key: trees begin at equal distances.
_PLACES = (np.arange(TREES)[:, None] * (VALUES // TREES) + np.arange(DEEP)) % VALUES


def _sets(column: pa.Array | pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; of a text with fewer words, the whole as one."""
    raw, starts = words.text_bytes(column)
    for _, part, begins in words.chunks(raw, starts):
        found = words.find_words(part, begins)
        hashes = words.hash_words(part, found, lower=True)
        first, shingles = words.hash_windows(hashes, found.text_first, size)
        wholes = words.hash_wholes(hashes, found.text_first)
        cuts = np.searchsorted(first, found.text_first)
        for i, n in enumerate(found.counts()):
            yield np.unique(shingles[cuts[i] : cuts[i + 1]]) if n >= size else wholes[i : i + 1][: min(n, 1)]


def _digest(tokens: np.ndarray) -> bytes | None:
    """128 bits that tell sets apart."""
    if not len(tokens):
        return None
    return b"".join(int(words.mix(tokens ^ np.uint64(seed)).sum(dtype=np.uint64)).to_bytes(8, "big") for seed in (11, 12))


def _signature(tokens: np.ndarray) -> np.ndarray:
    lowest = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 8192):
        lowest = np.minimum(lowest, (tokens[None, i : i + 8192] * _FACTORS[:, None] + _ADDENDS[:, None]).min(axis=1))
    return words.mix(lowest)


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        rows = []
        for tokens in _sets(batch.column("text"), size):
            key = _digest(tokens)
            values = _signature(tokens) if key else None
            rows.append((len(tokens), key, key and (values >> np.uint64(48)).astype(">u2").tobytes(), key and values.astype(np.uint8).tobytes()))
        columns = zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))
        yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in columns]], names=["doc_id", "n", "key", "values", "bytes"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once per tree, with its place in that tree's order."""
    tree = np.arange(TREES, dtype=np.uint8)[:, None]
    for batch in words.slices(batches):
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint16).reshape(-1, VALUES)
        keys = np.ascontiguousarray(values[:, _PLACES]).view(np.uint8).reshape(len(values), TREES, 2 * DEEP)
        rows = np.concatenate([np.broadcast_to(tree, (len(values), TREES, 1)), keys], axis=2).reshape(-1, 2 * DEEP + 1)
        place = pa.array([r.tobytes() for r in rows], pa.binary())
        which = np.repeat(np.arange(len(values)), TREES)
        yield pa.record_batch([place, batch.column("key").take(pa.array(which))], names=["place", "key"])


def _common(places: np.ndarray) -> np.ndarray:
    """Values that each place has in common with the one before it; -1 at the first and where the tree changes."""
    out = np.full(len(places), -1, np.int64)
    same = (places[1:, 1:].reshape(-1, DEEP, 2) == places[:-1, 1:].reshape(-1, DEEP, 2)).all(axis=2)
    out[1:] = np.where(places[1:, 0] == places[:-1, 0], np.cumprod(same, axis=1).sum(axis=1), -1)
    return out


def _cut(common: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of each region of one run."""
    first, n = 0, len(common)
    while n - first > REGION:
        window = common[first + REGION // 2 : first + REGION + 1]
        last = first + REGION // 2 + int(np.flatnonzero(window == window.min())[-1])
        yield first, last
        first = last
    yield first, n


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of two classes or more, of rows sorted by place. Holds a batch and an open run's last REGION rows.

    Rows of a cut run also name the run; there, a region may be one class. The first and the last run of the
    rows count as cut: they may go on in other tasks.
    """
    number, torn = TaskContext.get().partitionId() << 36, True
    places, keys = np.zeros((0, 2 * DEEP + 1), np.uint8), pa.array([], pa.binary())

    def close(end: int, runs: list[int], goes_on: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        ids, at, names = [], [], []
        for a, b in zip(runs, [*runs[1:], end]):
            cut = b - a > REGION or (torn and a == 0) or (goes_on and b == end)
            for first, last in _cut(common[a:b]) if cut or b - a > 1 else ():
                if cut or last - first > 1:
                    number += 1
                    ids.append(np.full(last - first, number, np.int64))
                    at.append(np.arange(a + first, a + last))
                    names += [places[a, : 2 * SHALLOW + 1].tobytes() if cut else None] * (last - first)
        if ids:
            columns = [pa.array(np.concatenate(ids)), keys.take(pa.array(np.concatenate(at))), pa.array(names, pa.binary())]
            yield pa.record_batch(columns, names=["region", "key", "run"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.frombuffer(b"".join(batch.column("place").to_pylist()), np.uint8).reshape(-1, 2 * DEEP + 1)
        places, keys = np.concatenate([places, new]), pa.concat_arrays([keys, batch.column("key")])
        common = _common(places)
        runs = [int(i) for i in np.flatnonzero(common < SHALLOW)]
        keep = runs[-1]
        long = len(places) - keep > 2 * REGION
        if long:  # the open run's first regions can be cut off
            keep += list(_cut(common[keep:]))[-2][0]
            runs = [r for r in runs if r < keep]
        else:
            runs.pop()
        yield from close(keep, runs, long)
        torn = long or (torn and not keep)
        places, keys = places[keep:], keys.slice(keep)
    if len(places):
        common = _common(places)
        yield from close(len(places), [0], True)


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows sorted by a column, in tables that hold all rows of each of their values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        first = int(np.flatnonzero(values == values[-1])[0])
        if first or (held and held[-1].column(column)[-1].as_py() != values[0]):
            ready = held + [batch.slice(0, first)]
            yield pa.Table.from_batches(ready)
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _maybe(signatures: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i > j) under different labels that may be similar, and their equal values."""
    agree = np.zeros((len(sizes), len(sizes)), np.uint8)
    for i in range(1, len(sizes)):
        agree[i, :i] = (signatures[:i] == signatures[i]).sum(axis=1, dtype=np.uint8)
    i, j = np.nonzero(agree >= AGREE)
    near = (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])) & (labels[i] != labels[j])
    return i[near], j[near], agree[i[near], j[near]]


def _star(i: np.ndarray, j: np.ndarray, agree: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each class one partner before it: the first that is surely similar, else the most similar."""
    order = np.lexsort((j, np.where(agree >= SURELY, 0, 256 - agree.astype(np.int64)), i))
    return order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order


def _forest(i: np.ndarray, j: np.ndarray, agree: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The fewest pairs that connect the labels, most similar first."""
    root = list(range(int(labels.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    chosen = []
    for e in np.argsort(-agree.astype(np.int64), kind="stable"):
        a, b = find(labels[i[e]]), find(labels[j[e]])
        if a != b:
            root[a] = b
            chosen.append(e)
    return np.array(chosen, np.int64)


#: How the first passes choose among the pairs that may be similar.
PASSES = (_star, _forest)


def _common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets, by products of blocks of the token matrix."""
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    order = np.argsort(tokens, kind="stable")
    column = np.cumsum(np.concatenate([[0], tokens[order][1:] != tokens[order][:-1]]))
    several = np.bincount(column)[column] > 1  # a token of one set adds nothing
    owner = owner[order][several]
    column = np.unique(column[several], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _labelled_regions(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple]:
    """Of each region with several labels and pairs that may be similar: its table, first and last row, labels, pairs."""
    for table in _whole_groups(batches, "region"):
        region, sizes = table["region"].to_numpy(), table["n"].to_numpy()
        signatures = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(-1, VALUES)
        labels = np.unique(np.frombuffer(b"".join(table["label"].to_pylist()), "V16"), return_inverse=True)[1]
        first = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        for a, b in zip(first, [*first[1:], len(region)]):
            own = np.unique(labels[a:b], return_inverse=True)[1]
            if own.any():
                i, j, agree = _maybe(signatures[a:b], sizes[a:b], own, percent)
                if len(i):
                    yield table.slice(a, b - a), own, i, j, agree


def _propose(batches: Iterator[pa.RecordBatch], choose, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that a pass chooses."""
    for table, own, i, j, agree in _labelled_regions(batches, percent):
        at = choose(i, j, agree, own)
        yield _pairs(table, i[at], j[at])


def _ask(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The classes of a region that have a pair under different labels."""
    for table, _, i, j, _ in _labelled_regions(batches, percent):
        rows = table.select(["region", "key", "n", "bytes", "label"]).take(pa.array(np.unique(np.concatenate([i, j]))))
        yield from rows.combine_chunks().to_batches()


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Compares the full sets of all pairs that may be similar; of those that link, as many as connect the labels."""
    for table, own, i, j, agree in _labelled_regions(batches, percent):
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        tokens = table["tokens"]
        both = _common_tokens([np.frombuffer(tokens[int(r)].as_py(), np.uint64) for r in rows])[at[: len(i)], at[len(i) :]]
        sizes = table["n"].to_numpy()
        linked = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[j] - both))
        if len(linked):
            i, j, agree = i[linked], j[linked], agree[linked]
            chosen = _forest(i, j, agree, own)
            yield _pairs(table, i[chosen], j[chosen])


def _pairs(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    keys = table["key"].to_pylist()
    columns = [pa.array([keys[x] for x in side], pa.binary()) for side in (i, j)]
    return pa.record_batch([*columns, pa.array(table["region"].to_numpy()[i])], names=["a", "b", "region"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, 256):
        linked = []
        for x, y in zip(batch.column("left"), batch.column("right")):
            a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(100 * both >= percent * (len(a) + len(b) - both))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of each set, and BITS parities: no more of them differ between two sets than tokens do."""
    for batch in words.slices(batches, 256):
        sets = [np.frombuffer(t.as_py(), np.uint64) for t in batch.column("tokens")]
        bits = [np.packbits(np.bincount((words.mix(t) % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2 > 0).tobytes() for t in sets]
        others = [c for c in batch.schema.names if c != "tokens"]
        columns = [*(batch.column(c) for c in others), pa.array([len(t) for t in sets], pa.int64()), pa.array(bits, pa.binary())]
        yield pa.record_batch(columns, names=[*others, "n", "bits"])


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs under different labels that meet in a cell and whose intersection may be large enough."""
    for table in _whole_groups(batches, "cell"):
        table = table.combine_chunks()
        cell, n, rest, block = (table[c].to_numpy() for c in ("cell", "n", "rest", "block"))
        labels = np.unique(np.frombuffer(b"".join(table["label"].to_pylist()), "V16"), return_inverse=True)[1]
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        key = table["key"].combine_chunks()
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        found, held = [], 0
        for a, b in zip(first, [*first[1:], len(cell)]):
            one = (block[a:b] == block[a]).all()
            for i in range(a + 1, b):
                both = n[a:i] + n[i]
                may = (labels[a:i] != labels[i]) & ((100 + percent) * np.minimum(rest[a:i], rest[i]) >= percent * both)
                j = a + np.flatnonzero(may if one else may & (block[a:i] != block[i]))
                if len(j):
                    differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    j = j[(100 + percent) * (n[j] + n[i] - differ) >= 2 * percent * (n[j] + n[i])]
                    found.append((np.full(len(j), i), j))
                    held += len(j)
                if held > 100_000:
                    yield _both_keys(key, found)
                    found, held = [], 0
        if held:
            yield _both_keys(key, found)


def _both_keys(key: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([key.take(pa.array(np.concatenate(side))) for side in zip(*found)], names=["a", "b"])


def _prefix_pairs(rest: DataFrame, store: Stored, percent: int) -> DataFrame:
    """All pairs (a, b) of sets under different labels that may link, of stored rest (cls, key, label, tokens).

    Blocks of sets learn from the token-group matrix of the n-gram join which tokens occur under several labels: a token
    is one entry of a block, however many of its sets have it. Only tokens that a set asks are rows: the rarest of those,
    as many as a link can spare. A token that many sets ask deals them to blocks, and each two blocks are a cell.
    Labels are told apart by 64-bit hashes, as tokens are.
    """
    labels = rest.select("cls", F.xxhash64("label")).toDF("cls", "label")
    asked = rarest_shared(rest.select("cls", "tokens"), labels, percent, blocks.count_blocks(rest, "tokens", least=PIECE_BYTES), store)
    sketches = store(rest.select("cls", "key", "label", "tokens").mapInArrow(_sketches, "cls long, key binary, label binary, n long, bits binary"))
    places = asked.select("cls", "label", "bound", F.posexplode("asked").alias("i", "token"))
    met = places.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
    met = store(met.select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    places = places.join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, "token")
    dealt = places.select("cls", "token", "blocks", (F.col("bound") - F.col("i")).alias("rest")).join(sketches, "cls")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    cells = dealt.select(cell, "key", "label", "n", "rest", "block", "bits").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(functools.partial(_meet, percent=percent), "a binary, b binary")


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, 500):
        rows = [(_digest(t), t.tobytes()) for t in _sets(batch.column("text"), size) if len(t)]
        if rows:
            yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*rows)], names=["key", "tokens"])


def near_copies(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest doc_id of its component) for each row of docs.

    docs has doc_id and text. Rows link where 100 * common shingles >= percent * all shingles of the two.
    AGREE is made for 80 percent; a lower percent would need a lower one.
    """
    if percent < 80:
        raise ValueError("candidates are looked for from 80 percent on")
    spark = docs.sparkSession
    store = Stored(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = store(texts.mapInArrow(functools.partial(_describe, size=size), "doc_id long, n long, key binary, values binary, bytes binary"))
    with_words = described.where(F.col("key").isNotNull())
    classes = store(with_words.groupBy("key").agg(F.first("n").alias("n"), F.first("values").alias("values"), F.first("bytes").alias("bytes")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = classes.select("key", "values").mapInArrow(_orders, "place binary, key binary")
    ordered = orders.repartitionByRange(max(ranges, classes.count() * TREES >> 21), "place").sortWithinPartitions("place")
    regions = store(ordered.mapInArrow(_regions, "region long, key binary, run binary"))
    live = store(regions.select("key").distinct())
    few = live.count() <= BROADCAST_ROWS
    sets = texts.mapInArrow(functools.partial(_full_sets, size=size), "key binary, tokens binary")
    sets = store(sets.join(F.broadcast(live) if few else live, "key", "left_semi").groupBy("key").agg(F.first("tokens").alias("tokens")))
    members = classes.select("key", "n", "bytes").join(live, "key", "left_semi")
    labels = live.select("key", F.col("key").alias("label"))
    by_region = ["region", "key", "n", "bytes", "label"]

    def opened() -> DataFrame:
        """Regions that hold several components, each on one task, in order."""
        labelled = regions.join(labels, "key")
        if links is not None:
            several = labelled.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("region")
            labelled = labelled.join(several, "region", "left_semi")
        return labelled.join(members, "key").repartition("region").sortWithinPartitions("region", "key").select(*by_region)

    def labelled_by(links: DataFrame) -> DataFrame:
        named = components(links, store).withColumnRenamed("node", "key").withColumnRenamed("label", "new")
        return store(live.join(named, "key", "left").select("key", F.coalesce("new", "key").alias("label")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        filled = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("left")), "a")
        filled = filled.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("right")), "b")
        return store(filled.select("a", "b", "left", "right").mapInArrow(functools.partial(_confirm, percent=percent), "a binary, b binary, linked boolean"))

    def ordered_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    tested = links = None
    for choose in PASSES:
        proposed = opened().mapInArrow(functools.partial(_propose, choose=choose, percent=percent), "a binary, b binary, region long")
        if choose is _star:
            proposed = proposed.groupBy("a").agg(F.min_by("b", "region").alias("b"))
        pairs = ordered_pairs(proposed)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = confirmed(store(pairs))
        tested = found if tested is None else tested.union(found)
        links = tested.where("linked").select("a", "b")
        labels = labelled_by(links)
    asked = store(opened().mapInArrow(functools.partial(_ask, percent=percent), "region long, key binary, n long, bytes binary, label binary"))
    with_sets = asked.join(sets, "key").repartition("region").sortWithinPartitions("region", "key").select(*by_region, "tokens")
    more = store(with_sets.mapInArrow(functools.partial(_compare, percent=percent), "a binary, b binary, region long").select("a", "b"))
    if more.limit(1).count():
        links = links.union(more)
        labels = labelled_by(links)
    torn = regions.where("run IS NOT NULL").select("run", "key").join(labels, "key")
    mixed = store(torn.groupBy("run").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("run"))
    if runs := mixed.count():
        mixed = F.broadcast(mixed) if runs <= BROADCAST_ROWS else mixed
        apart = torn.join(mixed, "run", "left_semi").select("key", "label").distinct().join(sets, "key")
        apart = store(apart.select(F.monotonically_increasing_id().alias("cls"), "key", "label", "tokens"))
        pairs = store(ordered_pairs(_prefix_pairs(apart, store, percent)))
        found = confirmed(pairs).where("linked").select("a", "b")
        if found.limit(1).count():
            labels = labelled_by(links.union(found))
    keyed = described.select("doc_id", "n", "key").join(labels, "key", "left").select("doc_id", "n", F.coalesce("label", "key").alias("label"))
    smallest = keyed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    done = keyed.join(smallest, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
