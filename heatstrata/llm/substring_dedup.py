"""Removal of word sequences that occur in an earlier document, with a count-min sketch as prefilter.

1. Each block counts its windows in the cells of a count-min sketch of two rows and sends the cells
   it touched. Parts of the cell range add them up and answer which cells hold two windows or more.
2. A block sends only windows both of whose cells do. The estimate is never too low, so none that
   repeats is lost. Parts group them exactly and answer the smallest document of each.
3. A block removes the words covered by a window that starts in a smaller document as well.

The sketch has two to four cells per window at any input size. It is never held whole: each part
adds up one range of cells. Windows are compared by 64-bit hash and 32 more bits.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import blocks, words

#: Cells that one part adds up.
PART_CELLS = 1 << 23
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SENT = "part int, block int, keys binary, more binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document
    with a smaller id. A null text has no words. Null ids count as larger than all others; rows with
    the same id never remove each other's words. Texts shorter than a window are kept. Other columns
    are ignored.
    """
    n_blocks = blocks.count_blocks(docs, text)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    cell_bits = max(16, min(56, math.ceil(math.log2(max(2, total / 2)))))  # a word takes 4 to 8 bytes
    dealt = blocks.in_blocks(docs, doc_id, text, n_blocks)
    none = dealt.sparkSession.createDataFrame([], "block int")
    cells = blocks.per_block(none, dealt, functools.partial(_send_cells, window=window, cell_bits=cell_bits), _SENT)
    hot = blocks.per_part(cells, functools.partial(_hot_cells, cell_bits=cell_bits), _SENT)
    parts = max(1, math.ceil(n_blocks / 2))
    sent = blocks.per_block(hot, dealt, functools.partial(_send_windows, window=window, cell_bits=cell_bits, parts=parts), _SENT)
    first = blocks.per_part(sent, _first_documents, _SENT)
    return blocks.per_block(first, dealt, functools.partial(_remove, window=window), _RESULT)


def _windows(docs: pa.Table, window: int):
    """For runs of texts: their place, their words, and first word and hash of each window."""
    data, starts = words.text_bytes(docs["text"])
    for first, part, begins in words.chunks(data, starts):
        found = words.find_words(part, begins)
        begin, hashes = words.hash_windows(words.hash_words(part, found), found.text_first, window)
        yield first, part, found, begin, hashes


def _all_windows(docs: pa.Table, window: int) -> np.ndarray:
    found = [hashes for *_, hashes in _windows(docs, window)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _cells(hashes: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return words.mix(hashes * np.uint64(ROWS[row])) >> np.uint64(64 - cell_bits)


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"part": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "more": pa.binary()}
    fields = names.split()
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(values, kinds[name]) for name, values in zip(fields, columns)})


def _split(keys: np.ndarray, part_of: np.ndarray):
    """Ranges of equal part of sorted keys."""
    begin = blocks.runs(part_of)
    for a, b in zip(begin, [*begin[1:], len(part_of)]):
        yield int(part_of[a]), slice(a, b)


def _send_cells(block: int, _: pa.Table, docs: pa.Table, window: int, cell_bits: int) -> pa.Table:
    hashes = _all_windows(docs, window)
    rows = []
    for row in range(len(ROWS)):
        cells = np.sort(_cells(hashes, row, cell_bits))
        begin = blocks.runs(cells)
        twice = np.diff(begin, append=len(cells)) > 1
        cells = cells[begin]
        for part, piece in _split(cells, cells // np.uint64(PART_CELLS)):
            rows.append(
                (part * len(ROWS) + row, block, blocks.pack_sorted(cells[piece] - np.uint64(part * PART_CELLS)), blocks.pack(np.packbits(twice[piece])))
            )
    return _table(rows, "part block keys more")


def _hot_cells(table: pa.Table, cell_bits: int) -> pa.Table:
    """For each block the cells it sent that hold two windows or more."""
    counts = np.zeros(min(PART_CELLS, 1 << cell_bits), np.uint8)
    part, sent = None, []
    for part, block, keys, more in zip(*(table[c].to_pylist() for c in ("part", "block", "keys", "more"))):
        cells = blocks.unpack_sorted(keys)
        twice = np.unpackbits(blocks.unpack(more, np.uint8), count=len(cells))
        counts[cells] = np.minimum(2, counts[cells] + 1 + twice)
        sent.append((part, block, cells))
    rows = [(part, block, blocks.pack_sorted(cells[counts[cells] > 1]), None) for part, block, cells in sent]
    return _table(rows, "part block keys more")


def _send_windows(block: int, hot: pa.Table, docs: pa.Table, window: int, cell_bits: int, parts: int) -> pa.Table:
    cells: list[list[np.ndarray]] = [[] for _ in ROWS]
    for part, keys in sorted(zip(hot["part"].to_pylist(), hot["keys"].to_pylist())):
        cells[part % len(ROWS)].append(blocks.unpack_sorted(keys) + np.uint64(part // len(ROWS) * PART_CELLS))
    tables = [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in cells]
    numbers = words.ids(docs["doc_id"])
    found, owners = [], []
    for first, _, texts, begin, hashes in _windows(docs, window):
        keep = np.arange(len(hashes))
        for row, table in enumerate(tables):
            keep = keep[blocks.member(_cells(hashes[keep], row, cell_bits), table) >= 0]
        found.append(hashes[keep])
        owners.append(numbers[first + texts.text_of()[begin[keep]]])
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    begin = blocks.runs(hashes)
    last = np.append(begin[1:], len(hashes)) - 1
    keys, smallest, largest = hashes[begin], owner[begin], owner[last] if len(begin) else owner
    rows = []
    width = np.uint64(math.ceil((1 << 64) / parts)) if parts > 1 else None
    for part, piece in _split(keys, keys // width if width else np.zeros(len(keys), np.uint64)):
        rows.append((part, block, blocks.pack_sorted(keys[piece]), blocks.pack(np.stack([smallest[piece], largest[piece]]))))
    return _table(rows, "part block keys more")


def _first_documents(table: pa.Table) -> pa.Table:
    """For each block the windows that one of its documents shares with a smaller one, and the smallest."""
    sent = []
    for block, keys, more in zip(*(table[c].to_pylist() for c in ("block", "keys", "more"))):
        sent.append((block, blocks.unpack_sorted(keys), *blocks.unpack(more, np.int64).reshape(2, -1)))
    keys = np.concatenate([s[1] for s in sent])
    smallest = np.concatenate([s[2] for s in sent])
    order = np.lexsort((smallest, keys))
    begin = blocks.runs(keys[order])
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(smallest[order][begin], np.diff(begin, append=len(keys)))
    rows, at = [], 0
    for block, own, _, largest in sent:
        first = least[at : at + len(own)]
        at += len(own)
        take = first < largest
        rows.append((0, block, blocks.pack_sorted(own[take]), blocks.pack(first[take])))
    return _table(rows, "part block keys more")


def _remove(block: int, first: pa.Table, docs: pa.Table, window: int) -> pa.Table:
    pairs = [(blocks.unpack_sorted(k), blocks.unpack(m, np.int64)) for k, m in zip(first["keys"].to_pylist(), first["more"].to_pylist())]
    keys = np.concatenate([k for k, _ in pairs]) if pairs else np.zeros(0, np.uint64)
    least = np.concatenate([m for _, m in pairs]) if pairs else np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys, least = keys[order], least[order]
    numbers = words.ids(docs["doc_id"])
    n_words, n_removed, kept = [], [], []
    for at, data, texts, begin, hashes in _windows(docs, window):
        place = blocks.member(hashes, keys)
        hit = np.flatnonzero(place >= 0)
        owner = numbers[at + texts.text_of()[begin[hit]]]
        hit = hit[least[place[hit]] < owner]
        change = np.zeros(len(texts.begin) + 1, np.int64)
        change[begin[hit]] += 1
        np.add.at(change, begin[hit] + window, -1)
        removed = np.cumsum(change[:-1]) > 0
        raw = data.tobytes()
        counts = texts.counts()
        gone = np.add.reduceat(np.append(removed, False).astype(np.int64), texts.text_first[:-1]) * (counts > 0)
        n_words.append(counts)
        n_removed.append(gone)
        for a, b in zip(texts.text_first[:-1], texts.text_first[1:]):
            keep = np.flatnonzero(~removed[a:b]) + a
            kept.append(b" ".join([raw[x:y] for x, y in zip(texts.begin[keep].tolist(), texts.end[keep].tolist())]))
    return pa.table(
        {
            "doc_id": docs["doc_id"].combine_chunks(),
            "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
            "n_removed": pa.array(np.concatenate(n_removed) if n_removed else [], pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )
