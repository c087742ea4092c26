"""Removal of repeated line runs, by prefix doubling over the line sequences of all documents.

Lines with words are numbered by content. Level k gives each place the name of the 2**k lines that
start there; the next level names pairs of names. As in a suffix array built by doubling, places of
equal name are an interval of suffixes whose common prefix is at least 2**k lines. Only intervals
of two places or more go on, so a level holds only what still repeats, and the doubling ends when
no interval is left.

Names are 64-bit hashes, so naming needs no exchange; an exchange per level finds the intervals and
their first place. Equality of names is all that the intervals need: they are not put in order.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import blocks, words
from heatstrata.llm.stored import Stored

_STATE = "block long, n_active long, state binary"
_SENT = "part int, block long, keys binary, more binary"
_LATER = "level int"


def _pack(*arrays: np.ndarray) -> bytes:
    return blocks.pack(np.stack([np.asarray(a).astype(np.int64, copy=False) if a.dtype != np.uint64 else a.view(np.int64) for a in arrays]))


def _unpack(packed: bytes, n: int) -> list[np.ndarray]:
    return list(blocks.unpack(packed, np.int64).reshape(n, -1))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of some batches: documents, and of each line with words the place, number, words and name."""
    block = TaskContext.get().partitionId() << 32
    for table in blocks.gathered(batches):
        data, starts = words.text_bytes(table["text"])
        firsts, numbers, sizes, names, at = [np.zeros(1, np.int64)], [], [], [], 0
        for _, part, begins in words.chunks(data, starts):
            found = words.find_words(part, begins)
            hashes = words.hash_words(part, found)
            breaks = np.flatnonzero(part == 10)
            line = np.searchsorted(breaks, found.begin)
            text = found.text_of()
            new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])) if len(line) else np.zeros(0, np.int64)
            names.append(words.hash_wholes(hashes, np.append(new, len(line))))
            sizes.append(np.diff(new, append=len(line)))
            numbers.append(line[new] - np.searchsorted(breaks, begins)[text[new]])
            ends = np.searchsorted(text[new], np.arange(len(begins) - 1), "right") + at
            firsts.append(ends)
            at = int(ends[-1]) if len(ends) else at
        first = np.concatenate(firsts)
        name = np.concatenate(names) if names else np.zeros(0, np.uint64)
        doc = words.ids(table["doc_id"])
        counts = np.diff(first)
        index = np.arange(len(name))
        state = _pack(index, np.repeat(first[1:], counts), np.repeat(doc, counts), index - np.repeat(first[:-1], counts), name)
        yield pa.record_batch(
            {
                "block": pa.array([block], pa.int64()),
                "n_active": pa.array([len(name)], pa.int64()),
                "state": pa.array([state], pa.binary()),
                "docs": pa.array([_pack(doc, table["text_key"].to_numpy().astype(np.int64, copy=False), counts)], pa.binary()),
                "lines": pa.array([_pack(np.concatenate(numbers), np.concatenate(sizes)) if numbers else _pack(index, index)], pa.binary()),
            }
        )
        block += 1


def _send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The names of each block, with the first place of each and whether the block holds it twice."""
    width = np.uint64(math.ceil((1 << 64) / parts)) if parts > 1 else None
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("state").to_pylist()):
            _, _, doc, place, name = _unpack(packed, 5)
            name = name.view(np.uint64)
            order = np.lexsort((place, doc, name))
            name, doc, place = name[order], doc[order], place[order]
            begin = blocks.runs(name)
            twice = np.diff(begin, append=len(name)) > 1
            name, doc, place = name[begin], doc[begin], place[begin]
            part_of = name // width if width else np.zeros(len(name), np.uint64)
            cut = blocks.runs(part_of)
            rows = [
                (int(part_of[a]), block, blocks.pack_sorted(name[a:b]), _pack(doc[a:b], place[a:b], twice[a:b])) for a, b in zip(cut, [*cut[1:], len(name)])
            ]
            yield pa.RecordBatch.from_arrays(_columns(rows), names=["part", "block", "keys", "more"])


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)]


def _intervals(sent: pa.Table) -> pa.Table:
    """For each block its names that occur twice or more, and their first place."""
    own, docs, places, twices, of = [], [], [], [], []
    for block, keys, more in zip(*(sent[c].to_pylist() for c in ("block", "keys", "more"))):
        own.append(blocks.unpack_sorted(keys))
        for into, x in zip((docs, places, twices), _unpack(more, 3)):
            into.append(x)
        of.append(block)
    name, doc, place, twice = (np.concatenate(x) for x in (own, docs, places, twices))
    order = np.lexsort((place, doc, name))
    begin = blocks.runs(name[order])
    counts = np.diff(begin, append=len(name))
    many = (counts > 1) | (np.add.reduceat(twice[order], begin) > 0)
    back = [np.empty(len(name), np.int64) for _ in range(3)]
    for into, values in zip(back, (doc[order][begin], place[order][begin], many)):
        into[order] = np.repeat(values, counts)
    rows, at = [], 0
    for block, keys in zip(of, own):
        first_doc, first_place, again = (x[at : at + len(keys)] for x in back)
        at += len(keys)
        keep = again > 0
        rows.append((0, block, blocks.pack_sorted(keys[keep]), _pack(first_doc[keep], first_place[keep])))
    return pa.Table.from_arrays(_columns(rows), names=["part", "block", "keys", "more"])


def _next(told: pa.Table, state: pa.Table, level: int) -> pa.Table:
    """Places that are later copies at this level, and the names of the next level."""
    pairs = [(blocks.unpack_sorted(k), _unpack(m, 2)) for k, m in zip(told["keys"].to_pylist(), told["more"].to_pylist())]
    keys = np.concatenate([k for k, _ in pairs]) if pairs else np.zeros(0, np.uint64)
    first = [np.concatenate([m[i] for _, m in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1)]
    order = np.argsort(keys)
    keys, first = keys[order], [f[order] for f in first]
    at, end, doc, place, name = _unpack(state["state"][0].as_py(), 5)
    found = blocks.member(name.view(np.uint64), keys)
    stay = found >= 0
    at, end, doc, place, name, found = (x[stay] for x in (at, end, doc, place, name, found))
    later = (first[0][found] < doc) | ((first[0][found] == doc) & (first[1][found] < place))
    # pairs of places 2**level apart in one document, both of which repeat
    step = 1 << level
    partner = np.searchsorted(at, at + step)
    partner[partner == len(at)] = 0
    both = (at + step < end) & (at[partner] == at + step) if len(at) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        longer = words.mix(name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + name[partner].view(np.uint64) + np.uint64(level + 1))
    return pa.table(
        {
            "block": state["block"].slice(0, 1).combine_chunks(),
            "n_active": pa.array([int(both.sum())], pa.int64()),
            "state": pa.array([_pack(at[both], end[both], doc[both], place[both], longer[both])], pa.binary()),
            "later": pa.array([_pack(at[later])], pa.binary()),
        }
    )


def _removed(told: pa.Table, block: pa.Table, min_lines: int, min_words: int) -> pa.Table:
    """Of each document the numbers of the lines that go."""
    doc, text_key, counts = _unpack(block["docs"][0].as_py(), 3)
    number, size = _unpack(block["lines"][0].as_py(), 2)
    copied, gone = np.zeros(len(number), bool), np.zeros(len(number), bool)
    for level, packed in zip(told["level"].to_pylist(), told["later"].to_pylist()):
        (at,) = _unpack(packed, 1)
        change = np.zeros(len(number) + 1, np.int64)
        change[at] += 1
        np.add.at(change, at + (1 << level), -1)
        covered = np.cumsum(change[:-1]) > 0
        copied |= covered
        if (1 << level) >= min_lines:
            gone |= covered
        elif level == 0:
            gone |= covered & (size >= min_words)
    first = np.concatenate([[0], np.cumsum(counts)])
    rows = []
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        lost = np.flatnonzero(gone[a:b])
        if len(lost):
            edges = np.flatnonzero(np.diff(copied[a:b], prepend=False, append=False))
            rows.append((int(doc[i]), int(text_key[i]), number[a:b][lost].tolist(), int(np.diff(edges.reshape(-1, 2)).max())))
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "text_key", "removed", "longest_run"])


def _grouped(told: DataFrame, state: DataFrame, fn, schema: str) -> DataFrame:
    def call(_, left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    return told.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(call, schema)


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """The documents that lose lines: doc, text_key (hash of the text), removed (line numbers from 0), longest_run.

    min_lines is a power of two. See ``without_repeated_lines`` for what goes. A null id stands as the
    largest number.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    blocks.bound_batches(docs.sparkSession)
    store = Stored(docs.sparkSession)
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("text_key"),
    )
    base = store(own.mapInArrow(_lines, _STATE + ", docs binary, lines binary"))
    parts = max(1, math.ceil(blocks.count_blocks(own, "text") / 2))
    state, laters, level = base.select("block", "n_active", "state"), [], 0
    while state.filter("n_active > 0").limit(1).count():
        state = state.filter("n_active > 0")
        sent = state.mapInArrow(functools.partial(_send, parts=parts), _SENT)
        told = blocks.per_part(sent, _intervals, _SENT)
        after = store(_grouped(told, state, functools.partial(_next, level=level), _STATE + ", later binary"))
        laters.append(after.select("block", F.lit(level).alias("level"), "later"))
        state, level = after.select("block", "n_active", "state"), level + 1
    if not laters:
        return docs.sparkSession.createDataFrame([], "doc long, text_key long, removed array<int>, longest_run long")
    told = functools.reduce(DataFrame.union, laters)
    fn = functools.partial(_removed, min_lines=min_lines, min_words=min_words)
    return _grouped(told, base, fn, "doc long, text_key long, removed array<int>, longest_run long")


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """All documents and columns, with ``text`` without later copies of repeated line runs, n_lines, n_removed and longest_run.

    The lines of a text are what stands between line breaks; two are equal if they have the same
    words. Lines without words are not looked at: they neither go nor interrupt a run. A line goes if
    it is part of a run of ``min_lines`` lines that also starts earlier, or has ``min_words`` words or
    more and also occurs earlier; earlier is a smaller document, or the same document further up.
    All is judged on the input. A null id counts as the largest; rows with the same id do not make
    each other go, and equal rows have equal results. longest_run is the longest stretch of copied
    lines. A null text stays null. A document that loses all its lines stays, with an empty text (or
    what blank lines it had). Added columns replace columns of the same name.
    """
    found = repeated_lines(docs, doc_id, text, min_lines, min_words).dropDuplicates(["doc", "text_key"])
    keyed = docs.drop("n_lines", "n_removed", "longest_run", "__doc", "__key").withColumns(
        {"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), "__key": F.xxhash64(F.col(text).cast("string"))}
    )
    found = found.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key"), F.col("removed").alias("__removed"), "longest_run")
    joined = keyed.join(found, ["__doc", "__key"], "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__removed", i))
    return joined.select(
        *[F.when(F.col("__removed").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed", "longest_run")],
        F.coalesce(F.size(F.filter(lines, lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
    )
