"""Benchmark decontamination with spaced seeds.

Benchmark items and documents are hashed at every word by two short masks. Of a stretch with at least
MIN_WORDS equal words and at most a quarter unequal ones, three equal words stand in a row, or it is
two, two and two of eight words: so one of the masks hits each stretch that can decide. Equal words
are counted along the offset of each hit, and where they suffice the best stretch decides.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import blocks, words

MASKS = ("111", "11011")
#: Items of fewer words than this are no evidence.
MIN_WORDS = 6
#: A stretch must match in this share of its words (the masks and the steps of _best are made for it), and of its item (or in LONG words).
SAME, OF_ITEM, LONG = 0.75, 0.5, 16
#: Seeds and words compared at a time.
AT_ONCE = 4_000_000
#: Benchmark text that is handed to the tasks at a time; a longer benchmark takes several passes.
PASS_BYTES = 16 << 20
_RESULT = "doc_id long, item_id long, doc_begin long, doc_end long, n_matched long, n_aligned long, item_words long, coverage double"


@dataclass
class Seeds:
    """Hashes of a benchmark: for each mask sorted hash, item and place."""

    ids: list
    items: list[np.ndarray]
    tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _spaced(hashes: np.ndarray, begin: np.ndarray, mask: str) -> np.ndarray:
    total = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for i, on in enumerate(mask):
            if on == "1":
                total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[begin + i]
        return words.mix(total)


def _places(text_first: np.ndarray, size: int) -> np.ndarray:
    counts = np.diff(text_first)
    left = np.repeat(text_first[1:], counts) - np.arange(text_first[-1])
    return np.flatnonzero(left >= size)


def build_seeds(ids: list, texts: list[str | None]) -> Seeds:
    items = [words.hash_text(t or "", lower=True, plain=True) for t in texts]
    found: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, item in enumerate(items):
        if len(item) < MIN_WORDS:
            continue
        for mask in MASKS:
            at = np.arange(len(item) - len(mask) + 1)
            found.setdefault(mask, []).append((_spaced(item, at, mask), np.full(len(at), i), at))
    tables = {}
    for mask, rows in found.items():
        hashes, item, at = (np.concatenate(c) for c in zip(*rows))
        order = np.argsort(hashes, kind="stable")
        tables[mask] = (hashes[order], item[order], at[order])
    return Seeds(ids, items, tables)


def _needed(size: int) -> int:
    """Equal words that an overlap with an item of so many words must have."""
    return max(MIN_WORDS, min(LONG, math.ceil(OF_ITEM * size)))


def _best(same: np.ndarray) -> tuple[int, int]:
    """Of the stretches with SAME equal words, the one with most of them, then the shortest and first."""
    places = np.flatnonzero(same)
    if not len(places):
        return 0, 0
    # a match counts 1 and a difference -3, so that 75 % match where the sum is not negative
    steps = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    highest = np.maximum.accumulate(steps[::-1])[::-1]
    end = np.searchsorted(-highest, -steps[places], "right") - 1
    last = np.searchsorted(places, end) - 1
    matched = last - np.arange(len(places)) + 1
    first = int(np.lexsort((places[last] - places, -matched))[0])
    return int(places[first]), int(places[last[first]]) + 1


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sizes that add up to AT_ONCE at most, or are one larger."""
    sums, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + AT_ONCE, "right")))
        yield first, last
        first = last


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _distinct(lines: np.ndarray) -> np.ndarray:
    lines = lines[:, np.lexsort(lines)]
    new = np.ones(lines.shape[1], bool)
    new[1:] = (lines[:, 1:] != lines[:, :-1]).any(axis=0)
    return lines[:, new]


def _enough(lines: np.ndarray, item_first: np.ndarray, item_words: np.ndarray, needed: np.ndarray, found: words.Words, hashes: np.ndarray) -> np.ndarray:
    """The lines (text, item, offset) along which enough words are equal."""
    text, item, offset = lines
    a = np.maximum(0, found.text_first[text] - offset)
    length = np.minimum(np.diff(item_first)[item], found.text_first[text + 1] - offset) - a
    kept = []
    for x, y in _pieces(length):
        sizes = length[x:y]
        same = hashes[_ragged((offset + a)[x:y], sizes)] == item_words[_ragged((item_first[item] + a)[x:y], sizes)]
        equal = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
        kept.append(equal >= needed[item[x:y]])
    return lines[:, np.concatenate(kept)] if kept else lines


def _search(batches: Iterator[pa.RecordBatch], seeds: Seeds) -> Iterator[pa.RecordBatch]:
    tables = {m: (blocks.runs(h), h, item, at) for m, (h, item, at) in seeds.tables.items()}
    item_first = np.concatenate([[0], np.cumsum([len(i) for i in seeds.items])]).astype(np.int64)
    item_words, needed = np.concatenate(seeds.items), np.array([_needed(len(i)) for i in seeds.items])
    for batch in batches:
        rows = []
        numbers = batch.column("doc_id").to_pylist()
        data, starts = words.text_bytes(batch.column("text"))
        for first, part, begins in words.chunks(data, starts):
            found = words.find_words(part, begins, plain=True)
            hashes = words.hash_words(part, found, lower=True)
            lines = [np.zeros((3, 0), np.int64)]
            for mask, (run, table, item, at) in tables.items():
                begin = _places(found.text_first, len(mask))
                place = blocks.member(_spaced(hashes, begin, mask), table[run])
                hit = np.flatnonzero(place >= 0)
                counts = (np.append(run[1:], len(table)) - run)[place[hit]]
                for x, y in _pieces(counts):
                    times = counts[x:y]
                    word = np.repeat(begin[hit[x:y]], times)
                    entry = _ragged(run[place[hit[x:y]]], times)
                    text = np.searchsorted(found.text_first, word, "right") - 1
                    some = _distinct(np.stack([text, item[entry], word - at[entry]]))
                    lines.append(_enough(some, item_first, item_words, needed, found, hashes))
            rows += _verify(_distinct(np.concatenate(lines, axis=1)), seeds, numbers, first, found, hashes)
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int64()] * 7 + [pa.float64()]
        names = [x.split()[0] for x in _RESULT.split(", ")]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _verify(lines: np.ndarray, seeds: Seeds, numbers: list, first: int, found: words.Words, hashes: np.ndarray) -> list[tuple]:
    """The best overlap of each document and item over the lines hit."""
    best: dict[tuple, tuple] = {}
    for text, item, offset in zip(*lines.tolist()):
        own = seeds.items[item]
        low, high = int(found.text_first[text]), int(found.text_first[text + 1])
        a, b = max(0, low - offset), min(len(own), high - offset)
        same = hashes[offset + a : offset + b] == own[a:b]
        x, y = _best(same)
        matched = int(same[x:y].sum())
        if matched >= _needed(len(own)):
            row = (matched, -(y - x), -(offset + a + x - low), y - x, len(own))
            if row > best.get((text, item), ()):
                best[text, item] = row
    return [
        (numbers[first + text], seeds.ids[item], -begin, aligned - begin, matched, aligned, size, matched / size)
        for (text, item), (matched, _, begin, aligned, size) in sorted(best.items())
    ]


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item that overlap.

    Columns doc_id, item_id, doc_begin and doc_end (words of the document), n_matched of n_aligned
    words, item_words, coverage (matched share of the item). Words are runs of letters and digits,
    A-Z lower-cased. An overlap is the stretch of one document and item at one offset with most equal
    words of those with at least 75 % of them; it has as many equal words as half the item or 16, and
    at least 6. All such stretches are found. Items of fewer than six words, empty or null never match.
    Null and empty documents have no overlap. Rows with the same id give rows each; null ids
    are kept. An empty benchmark or table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    blocks.bound_batches(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    passes = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PASS_BYTES))
    result = spark.createDataFrame([], _RESULT)
    for i in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        seeds = build_seeds([r.item_id for r in part], [r.text for r in part])
        if seeds.tables:
            result = result.union(own.mapInArrow(functools.partial(_search, seeds=seeds), _RESULT))
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns. Rows with a null id stay."""
    bad = leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(bad, doc_id, "left_anti")
