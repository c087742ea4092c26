"""Similar documents by the Jaccard similarity of their word shingles, with a token-group matrix.

1. Documents with equal shingle sets are one class, by a digest of the set. Only classes go on.
2. If two sets are similar, any fixed order of shingles puts k common ones among the first fifth and
   k of both. Each class sends its first two fifths. One that meets others there in fewer shingles
   than its smallest possible partner allows (about 16 %) has no link and ends here.
3. Minima of permuted shingles propose a star of pairs per value; the exact similarity of each pair
   decides. The components of these links are the groups of similar documents.
4. Token-group matrix: for each shingle, in how many groups it occurs. A document's overlap with
   all other groups is bounded by its shingles that occur in several, which bounds the sizes that a
   partner can have. Shingles are ordered by the groups that hold them, rarest first, so a document
   asks only groups that hold one of its rarest shared ones.
5. For each group asked, its token union bounds the overlap. Only qualifying groups are opened, and
   each of their members is compared exactly. Large groups are stored in pieces of similar size; small groups around the
   same token share a piece.

The exact copies and near copies of a large group never meet each other pairwise: pairs are asked
only between documents that links do not connect yet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import blocks, words
from heatstrata.llm.components import components
from heatstrata.llm.stored import Stored

HASHES = 8
#: A proposed star pair must agree in so many minima; the others are left to the matrix.
AGREE = 4
#: Members that a piece of a group holds, about.
PIECE = 32
#: Longest table of class ids that is broadcast (some 16 bytes a row); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
_MANY = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(data: pa.Array | pa.ChunkedArray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    raw, starts = words.text_bytes(data)
    for _, part, begins in words.chunks(raw, starts):
        found = words.find_words(part, begins)
        hashes = words.hash_words(part, found, lower=True)
        begin, shingles = words.hash_windows(hashes, found.text_first, size)
        wholes = words.hash_wholes(hashes, found.text_first)
        cuts = np.searchsorted(begin, found.text_first)
        for i, n in enumerate(found.counts()):
            yield np.unique(shingles[cuts[i] : cuts[i + 1]]) if n >= size else wholes[i : i + 1][: min(n, 1)]


def _digest(tokens: np.ndarray, seed: int) -> int:
    return int(words.mix(tokens ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64))


def _first(n: int, percent: int, k: int = 1) -> int:
    """How many first shingles of a set of n have k or more in common with those of any set that links to it."""
    return n - (percent * n + 99) // 100 + k


def _needed(n: int, percent: int) -> int:
    """As many as a linked set may lack, at least one."""
    return max(1, n - (percent * n + 99) // 100)


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        sets = list(_sets(batch.column("text"), size))
        minima = [
            [int(x) for x in (t[:, None] * _MANY).min(axis=0).view(np.int64)] if len(t) else None for t in sets
        ]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n": pa.array([len(t) for t in sets], pa.int64()),
                "cls": pa.array([_digest(t, 1) if len(t) else None for t in sets], pa.int64()),
                "cls2": pa.array([_digest(t, 2) if len(t) else None for t in sets], pa.int64()),
                "minima": pa.array(minima, pa.list_(pa.int64())),
            }
        )


def _send_first(batches: Iterator[pa.RecordBatch], size: int, percent: int, parts: int) -> Iterator[pa.RecordBatch]:
    width = np.uint64(math.ceil((1 << 64) / parts)) if parts > 1 else None
    for batch in words.slices(batches):
        sets = {_digest(t, 1): t for t in _sets(batch.column("text"), size) if len(t)}
        keys = [t[: _first(len(t), percent, _needed(len(t), percent))].copy() for t in sets.values()]
        if not keys:
            continue
        owner = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(k) for k in keys])
        tokens = np.concatenate(keys)
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        rows = []
        part_of = tokens // width if width else np.zeros(len(tokens), np.uint64)
        begin = blocks.runs(part_of)
        for a, b in zip(begin, [*begin[1:], len(tokens)]):
            own, at = np.unique(owner[a:b], return_inverse=True)
            rows.append((int(part_of[a]), blocks.pack_sorted(tokens[a:b]), blocks.pack(at.astype(np.uint32)), own.tobytes()))
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
            names=["part", "keys", "at", "own"],
        )


def _meet(sent: pa.Table, parts: int) -> pa.Table:
    """How many of the tokens that a class sent another class sent as well."""
    keys, owners = [], []
    for k, at, own in zip(*(sent[c].to_pylist() for c in ("keys", "at", "own"))):
        keys.append(blocks.unpack_sorted(k))
        owners.append(np.frombuffer(own, np.int64)[blocks.unpack(at, np.uint32)])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])  # a class may send from several tasks
    key, owner = key[fresh], owner[fresh]
    begin = blocks.runs(key)
    last = np.append(begin[1:], len(key)) - 1
    shared = np.repeat(owner[begin] != owner[last], np.diff(begin, append=len(key)))
    cls, times = np.unique(owner[shared], return_counts=True)
    to = words.mix(cls.view(np.uint64)) % np.uint64(parts)
    order = np.argsort(to, kind="stable")
    cls, times, to = cls[order], times[order], to[order]
    begin = blocks.runs(to)
    rows = [(int(to[a]), blocks.pack(cls[a:b]), blocks.pack(times[a:b])) for a, b in zip(begin, [*begin[1:], len(to)])]
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["part", "cls", "shared"])


def _add_up(sent: pa.Table) -> pa.Table:
    cls = np.concatenate([blocks.unpack(x, np.int64) for x in sent["cls"].to_pylist()])
    shared = np.concatenate([blocks.unpack(x, np.int64) for x in sent["shared"].to_pylist()])
    own, at = np.unique(cls, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, shared)
    return pa.table({"cls": pa.array(own, pa.int64()), "shared": pa.array(total, pa.int64())})


def _tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        sets = list(_sets(batch.column("text"), size))
        yield pa.record_batch(
            {
                "cls": batch.column("cls"),
                "same": pa.array([len(t) > 0 and _digest(t, 1) == c for t, c in zip(sets, batch.column("cls").to_pylist())]),
                "n": pa.array([len(t) for t in sets], pa.int64()),
                "tokens": pa.array([t.tobytes() for t in sets], pa.binary()),
            }
        )


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
            x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
            common = _common(x, y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                links.append((a, b))
        yield pa.record_batch([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


_MATRIX = "part int, block int, keys binary, labels binary"


def _send_tokens(block: int, told: pa.Table, sets: pa.Table, parts: int) -> pa.Table:
    """Each token of the block with the smallest and largest label, and the number of sets."""
    found = [np.frombuffer(t, np.uint64) for t in sets["tokens"].to_pylist()]
    label_of = dict(zip(told["cls"].to_pylist(), told["label"].to_pylist()))
    labels = np.repeat(np.array([label_of[c] for c in sets["cls"].to_pylist()], np.int64), [len(t) for t in found])
    tokens = np.concatenate(found)
    order = np.lexsort((labels, tokens))
    tokens, labels = tokens[order], labels[order]
    begin = blocks.runs(tokens)
    last = np.append(begin[1:], len(tokens))
    keys, low, high, count = tokens[begin], labels[begin], labels[last - 1], last - begin
    width = np.uint64(math.ceil((1 << 64) / parts)) if parts > 1 else None
    part_of = keys // width if width else np.zeros(len(keys), np.uint64)
    cut = blocks.runs(part_of)
    rows = [
        (int(part_of[a]), block, blocks.pack_sorted(keys[a:b]), blocks.pack(np.stack([low[a:b], high[a:b] - low[a:b], count[a:b]])))
        for a, b in zip(cut, [*cut[1:], len(keys)])
    ]
    return _rows(rows)


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "block", "keys", "labels"])


def _spread(sent: pa.Table) -> pa.Table:
    """For each block and token: 0 if one group holds it, else how many sets do, as a power of two."""
    keys, low, high, count, of = [], [], [], [], []
    for block, k, more in zip(*(sent[c].to_pylist() for c in ("block", "keys", "labels"))):
        own = blocks.unpack_sorted(k)
        a, b, c = blocks.unpack(more, np.int64).reshape(3, -1)
        for into, x in ((keys, own), (low, a), (high, a + b), (count, c)):
            into.append(x)
        of.append((block, len(own)))
    key = np.concatenate(keys)
    order = np.argsort(key)
    begin = blocks.runs(key[order])
    low_of = np.minimum.reduceat(np.concatenate(low)[order], begin)
    high_of = np.maximum.reduceat(np.concatenate(high)[order], begin)
    total = np.add.reduceat(np.concatenate(count)[order], begin)
    power = np.where(low_of == high_of, 0, np.ceil(np.log2(total + 1))).astype(np.uint8)
    answer = np.empty(len(key), np.uint8)
    answer[order] = np.repeat(power, np.diff(begin, append=len(key)))
    rows, at = [], 0
    for (block, n), own in zip(of, keys):
        shared = answer[at : at + n]
        at += n
        rows.append((0, block, blocks.pack_sorted(own[shared > 0]), blocks.pack(shared[shared > 0])))
    return _rows(rows)


def _ask(block: int, told: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    """The rarest shared tokens of each set that can have a link outside its group, with the bound of its overlap."""
    pairs = [(blocks.unpack_sorted(k), blocks.unpack(m, np.uint8)) for k, m in zip(told["keys"].to_pylist(), told["labels"].to_pylist()) if k is not None]
    label_of = dict(zip(told["cls"].to_pylist(), told["label"].to_pylist()))
    keys = np.concatenate([k for k, _ in pairs]) if pairs else np.zeros(0, np.uint64)
    powers = np.concatenate([m for _, m in pairs]) if pairs else np.zeros(0, np.uint8)
    order = np.argsort(keys)
    keys, powers = keys[order], powers[order]
    found = [np.frombuffer(t, np.uint64) for t in sets["tokens"].to_pylist()]
    places = blocks.member(np.concatenate(found), keys)
    out, at = [], 0
    for cls, tokens in zip(sets["cls"].to_pylist(), found):
        place = places[at : at + len(tokens)]
        at += len(tokens)
        inside = place >= 0
        bound = int(inside.sum())
        first = _first(len(tokens), percent) - (len(tokens) - bound)
        if first > 0:
            own, power = tokens[inside], powers[place[inside]]
            chosen = own[np.lexsort((own, power))[:first]]
            out.append((cls, label_of[cls], len(tokens), bound, chosen.view(np.int64).tolist()))
    columns = list(zip(*out)) if out else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cls", "label", "n", "bound", "asked"])


def _pack_group(members: pa.Table) -> pa.Table:
    sets = [np.frombuffer(t, np.uint64) for t in members["tokens"].to_pylist()]
    return pa.table(
        {
            "piece": members["piece"].slice(0, 1).combine_chunks(),
            "least": pa.array([min(len(t) for t in sets)], pa.int64()),
            "union_tokens": pa.array([np.unique(np.concatenate(sets)).tobytes()], pa.binary()),
            "members": pa.array([members["cls"].to_pylist()], pa.list_(pa.int64())),
            "labels": pa.array([members["label"].to_pylist()], pa.list_(pa.int64())),
            "member_tokens": pa.array([members["tokens"].to_pylist()], pa.list_(pa.binary())),
        }
    )


def _open(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each query to the members of a group whose token union does not rule them out."""
    for batch in batches:
        links = []
        for a, label, blob, least, union, members, labels, sets in zip(
            *(batch.column(c).to_pylist() for c in ("a", "label", "tokens", "least", "union_tokens", "members", "labels", "member_tokens"))
        ):
            query = np.frombuffer(blob, np.uint64)
            most = _common(query, np.frombuffer(union, np.uint64))
            if 100 * most < percent * max(len(query), len(query) + least - most):
                continue
            for b, group, other in zip(members, labels, sets):
                if group == label:
                    continue
                tokens = np.frombuffer(other, np.uint64)
                if (100 + percent) * min(most, len(tokens)) >= percent * (len(query) + len(tokens)):
                    common = _common(query, tokens)
                    if 100 * common >= percent * (len(query) + len(tokens) - common):
                        links.append((min(a, b), max(a, b)))  # two pieces may ask each other
        yield pa.record_batch([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    A document's set holds its distinct shingles of ``size`` words (A-Z lower-cased), or its whole
    word sequence if it has fewer words. Two documents link if ``100 * intersection >= percent *
    union``. component_id is the smallest id that links reach. Texts without words, and null, have an
    empty set and no link: they are their own component. A null id counts as the largest id of all
    and is returned as null. Rows with the same id are compared like any others. n_links counts the
    links found between classes of equal sets: enough of them to connect each component. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    blocks.bound_batches(spark)
    store = Stored(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = blocks.count_blocks(own, "text")

    described = store(own.mapInArrow(functools.partial(_describe, size=size), "doc_id long, n long, cls long, cls2 long, minima array<long>"))
    largest = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = described.filter("n > 0").groupBy("cls", "cls2", "n").agg(F.min(largest).alias("rep"), F.any_value("minima").alias("minima"))
    sent = own.select("text").mapInArrow(
        functools.partial(_send_first, size=size, percent=percent, parts=parts), "part int, keys binary, at binary, own binary"
    )
    met = blocks.per_part(sent, functools.partial(_meet, parts=parts), "part int, cls binary, shared binary")
    shared = blocks.per_part(met, _add_up, "cls long, shared long")
    # the smallest partner of n shingles has `smallest`; both have as many in common as it sent beyond its own first fifth
    smallest = F.floor((percent * F.col("n") + 99) / 100)
    sure = F.greatest(F.lit(1), smallest - F.floor((percent * smallest + 99) / 100))
    classes = store(classes.join(shared, "cls").filter(F.col("shared") >= sure).drop("shared"))

    wanted = classes.select("cls", F.when(F.col("rep") < (1 << 63) - 1, F.col("rep")).alias("rep"))
    texts = own.join(_small(wanted), own.doc_id.eqNullSafe(F.col("rep"))).select("cls", "text")
    sets = store(texts.mapInArrow(functools.partial(_tokens, size=size), "cls long, same boolean, n long, tokens binary").filter("same").drop("same"))

    links = store(_compared(store(_stars(classes)), sets, percent))
    labels = store(_labels(classes, components(links, store)))
    links = store(links.union(_between(sets, labels, percent, n_blocks=max(1, parts), store=store)).distinct())

    grouped = components(links, store)
    label = _labels(classes, grouped).select("cls", F.col("label").alias("component_id"))
    counts = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count("*").alias("n_links"))
    alone = described.filter("n > 0").groupBy("cls").agg(F.min(largest).alias("alone"))
    found = described.join(alone, "cls", "left").join(label, "cls", "left").join(counts, "cls", "left")
    component = F.coalesce("component_id", "alone", "doc_id")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(component < (1 << 63) - 1, component).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _stars(classes: DataFrame) -> DataFrame:
    """Pairs of each class and the first of those with the same minimum, if enough minima agree."""
    each = classes.select("cls", "rep", F.posexplode("minima").alias("i", "value"))
    first = each.groupBy("i", "value").agg(F.min(F.struct("rep", "cls")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    pairs = each.join(first, ["i", "value"]).select(F.col("first.cls").alias("a"), F.col("cls").alias("b")).filter("a != b").distinct()
    a = classes.select(F.col("cls").alias("a"), F.col("minima").alias("x"), F.col("n").alias("nx"))
    b = classes.select(F.col("cls").alias("b"), F.col("minima").alias("y"), F.col("n").alias("ny"))
    agree = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(a, "a").join(b, "b").filter(agree >= AGREE).select("a", "b")


def _small(stored: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if its rows are not more than BROADCAST_ROWS."""
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs that link. Only the sets of the pairs move."""
    pairs = _small(pairs)
    a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a")
    b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    return a.join(b, ["a", "b"]).mapInArrow(functools.partial(_compare, percent=percent), "a long, b long")


def _labels(classes: DataFrame, grouped: DataFrame) -> DataFrame:
    """(cls, label): the smallest document of the component of each class."""
    of = classes.join(grouped, classes.cls == grouped.node, "left").select("cls", "rep", F.coalesce("label", "cls").alias("part_of"))
    least = of.groupBy("part_of").agg(F.min("rep").alias("label"), F.count("*").alias("members"))
    return of.join(least, "part_of").select("cls", "label", "members")


def rarest_shared(sets: DataFrame, labels: DataFrame, percent: int, n_blocks: int, store: Stored) -> DataFrame:
    """(cls, label, n, bound, asked) of sets (cls, tokens) that can have a link outside their label (cls, label).

    bound is the number of tokens that sets under other labels have too. asked are the first of these, by how many
    sets have them: two sets under different labels that link have one of their asked tokens in common.
    """
    block = F.pmod(F.xxhash64("cls"), F.lit(n_blocks)).cast("int")
    dealt = sets.select(block.alias("block"), "cls", "tokens").repartition(n_blocks, "block")
    told = labels.select(block.alias("block"), "cls", "label")
    sent = blocks.per_block(told, dealt, functools.partial(_send_tokens, parts=n_blocks), _MATRIX)
    shared = blocks.per_part(sent, _spread, _MATRIX)
    told = told.unionByName(shared.select("block", "keys", "labels"), allowMissingColumns=True)
    return store(blocks.per_block(told, dealt, functools.partial(_ask, percent=percent), "cls long, label long, n long, bound long, asked array<long>"))


def _between(sets: DataFrame, labels: DataFrame, percent: int, n_blocks: int, store: Stored) -> DataFrame:
    """Links between sets of different groups."""
    asked = rarest_shared(sets, labels, percent, n_blocks, store)

    # pieces of groups: members of similar size, about PIECE of them. Small groups are gathered by the
    # token of theirs that most sets ask for, so that sets around one passage are few pieces
    step = F.floor(F.log(F.col("n").cast("double")) * 20).cast("long")
    each = asked.select("cls", F.explode("asked").alias("token"))
    askers = each.groupBy("token").agg(F.count("*").alias("askers"))
    lead = each.join(askers, "token").groupBy("cls").agg(F.max(F.struct("askers", "token")).alias("lead"))
    home = F.when(F.col("members") > PIECE, F.concat_ws("/", F.lit("group"), "label")).otherwise(F.concat_ws("/", F.lit("token"), "lead.token"))
    live = asked.join(labels.select("cls", "members"), "cls").join(lead, "cls").withColumn("home", home).drop("lead").withColumn("step", step)
    crowd = live.groupBy("home", "step").agg(F.count("*").alias("crowd"))
    salt = F.pmod(F.xxhash64("cls"), F.ceil(F.col("crowd") / PIECE).cast("long"))
    live = live.join(crowd, ["home", "step"]).withColumn("piece", F.concat_ws("/", "home", "step", salt))
    live = store(live)
    pieces = live.groupBy("piece").agg(
        F.max(F.struct("members", "label")).alias("last"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("bound").alias("most_bound"),
    )
    queries = live.select("cls", "label", "members", "n", "bound", F.explode("asked").alias("token"))
    held = live.select("piece", F.explode("asked").alias("token")).distinct().join(pieces, "piece")
    smaller = F.struct("members", "label") < F.col("last")  # of two sets the one of the smaller group asks
    other = (F.col("low") < F.col("high")) | (F.col("label") != F.col("low"))
    enough = (100 + percent) * F.least("bound", "most_bound") >= percent * (F.col("n") + F.col("least"))
    sizes = 100 * F.col("most") >= percent * F.col("n")
    pairs = store(queries.join(held, "token").filter(other & smaller & enough & sizes).select(F.col("cls").alias("a"), "label", "piece").distinct())
    opened = pairs.select("piece").distinct()
    members = _small(store(live.select("cls", "label", "piece").join(opened, "piece"))).join(sets.select("cls", "tokens"), "cls")

    def packed(table: pa.Table) -> pa.Table:
        return _pack_group(table)

    groups = members.groupBy("piece").applyInArrow(
        packed, "piece string, least long, union_tokens binary, members array<long>, labels array<long>, member_tokens array<binary>"
    )
    asking = _small(pairs).join(sets.select(F.col("cls").alias("a"), "tokens"), "a")
    return asking.join(groups, "piece").mapInArrow(functools.partial(_open, percent=percent), "a long, b long")
