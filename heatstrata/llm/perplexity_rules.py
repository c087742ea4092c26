"""Quality rules: counts of a text, and bands for the perplexity under an n-gram model of the corpus.

The model is a modified Kneser-Ney model over the bytes of a text (A-Z lower-cased, spaces as one),
one per language, trained on all documents. Spark counts the n-grams and derives every probability
by windows over contexts and joins with the shorter order, neither of which has a group of more than
256 rows. The model is dealt by hash to parts, each a sorted array, however large it is: a block of
documents asks each part once for its distinct n-grams. n-grams seen once are discounted wholly, so
that a text does not vouch for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatstrata.llm import blocks, words
from heatstrata.llm.stored import Stored

ORDER = 5
#: Documents with a log perplexity further than this many quartile distances from the median go;
#: a text of n bytes may be 1 + SHORT / n times as far, as short texts vary more.
UPPER, LOWER, SHORT = 16.0, 12.0, 300
#: Texts that the quartiles are taken from, in bytes.
MIN_CHARS = 200
#: n-grams that a task lets wait, at least, until it adds them up.
FOLD = 300_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[0x09:0x0E] = 0x20


def _ngrams(data: np.ndarray, starts: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER bytes at each byte as one number, below the language's number; and the text.

    Runs of spaces count once. Each text starts as after spaces.
    """
    folded = _FOLD[data]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    space = folded == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep &= ~(first[:-1] & space)
    folded, text = folded[keep], text[keep]
    starts = np.searchsorted(text, np.arange(len(starts)))
    place = np.arange(len(folded)) - starts[text]
    key = language[text].astype(np.uint64)
    for back in range(ORDER - 1, -1, -1):
        byte = np.full(len(folded), 0x20, np.uint8)
        if back:
            byte[back:] = folded[:-back] if back < len(folded) else folded[:0]
            byte[place < back] = 0x20
        else:
            byte = folded
        key = (key << np.uint64(8)) | byte
    return key, text


def _count(batches: Iterator[pa.RecordBatch], languages: dict) -> Iterator[pa.RecordBatch]:
    """n-grams and their counts, added up over a task."""
    keys, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def fold():
        nonlocal keys, counts, waiting
        all_keys = np.concatenate([keys, *(k for k, _ in waiting)])
        all_counts = np.concatenate([counts, *(c for _, c in waiting)])
        order = np.argsort(all_keys, kind="stable")
        all_keys = all_keys[order]
        begin = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, np.int64)
        keys, counts, waiting = all_keys[begin], np.add.reduceat(all_counts[order], begin) if len(begin) else counts, []

    for batch in batches:
        number = np.array([languages[x] for x in batch.column("lang").to_pylist()], np.int64)
        data, starts = words.text_bytes(batch.column("text"))
        for first, part, begins in words.chunks(data, starts):
            key, _ = _ngrams(part, begins, number[first : first + len(begins) - 1])
            waiting.append(np.unique(key, return_counts=True))
            if sum(len(k) for k, _ in waiting) > max(FOLD, len(keys)):
                fold()
    fold()
    for a in range(0, len(keys), 100_000):
        yield pa.record_batch([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], names=["ngram", "n"])


def _discounts(counted: DataFrame, order: int) -> dict[int, list[float]]:
    """By language what is taken off n-grams of adjusted count 1, 2, and 3 or more."""
    language = F.shiftright("ngram", 8 * order)
    rows = counted.groupBy(language.alias("language")).agg(*(F.count_if(F.col("n") == k).alias(f"t{k}") for k in (1, 2, 3, 4)))
    found = {}
    for one, *t in rows.collect():
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        # what was seen once may be the scored text's own, and is no evidence for it
        less = [1.0 if order > 1 else 0.5]
        for k in (2, 3):
            d = k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.5 * k
            less.append(min(max(d, 0.1), k - 0.05))
        found[one] = less
    return found


def _suffix(ngram: Column, order: int) -> Column:
    """The last order - 1 bytes, below the language."""
    low = F.lit((1 << (8 * (order - 1))) - 1)
    return F.shiftleft(F.shiftright(ngram, 8 * order), 8 * (order - 1)).bitwiseOR(ngram.bitwiseAND(low))


def _kneser_ney(counted: list[DataFrame]) -> list[DataFrame]:
    """counted: by order, 1 first: ngram (language above the bytes) and n, adjusted counts below the highest order."""
    orders: list[DataFrame] = []
    for order, table in enumerate(counted, 1):
        less = _discounts(table, order)
        if not less:
            return [table.select("ngram", F.lit(0.0).alias("p"), F.lit(0.0).alias("left"))] * len(counted)
        by_language = F.create_map(*(x for one, d in less.items() for x in (F.lit(one), F.array(*map(F.lit, d)))))
        own = by_language[F.shiftright("ngram", 8 * order)][F.least("n", F.lit(3)).cast("int") - 1]
        same_context = Window.partitionBy(F.shiftright("ngram", 8))  # 256 rows at most
        table = table.withColumn("less", own)
        table = table.withColumn("total", F.sum("n").over(same_context)).withColumn("left", F.sum("less").over(same_context) / F.col("total"))
        if orders:
            shorter = orders[-1].select(F.col("ngram").alias("suffix"), F.col("p").alias("shorter"))
            table = table.withColumn("suffix", _suffix(F.col("ngram"), order)).join(shorter, "suffix")
        else:
            table = table.withColumn("shorter", F.lit(1 / 256))
        p = (F.col("n") - F.col("less")) / F.col("total") + F.col("left") * F.col("shorter")
        orders.append(table.select("ngram", p.alias("p"), "left"))
    return orders


def train(docs: DataFrame, languages: dict, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """The model of all documents, by order, 1 first: each n-gram that occurs, with the interpolated
    probability p of its last byte and the share left that its context leaves to the shorter one.

    An n-gram seen once has what its context leaves times its suffix's probability, just as an unseen one.
    """
    store = Stored(docs.sparkSession)
    own = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = own.mapInArrow(lambda batches: _count(batches, languages), "ngram long, n long")
    orders = [store(counted.groupBy("ngram").agg(F.sum("n").alias("n")))]
    for order in range(ORDER, 1, -1):
        orders.append(store(orders[-1].groupBy(_suffix(F.col("ngram"), order).alias("ngram")).agg(F.count("*").alias("n"))))
    return _kneser_ney(orders[::-1])


def _languages(docs: DataFrame) -> dict:
    names = sorted((r[0] for r in docs.select("lang").distinct().collect()), key=lambda x: (x is None, x or ""))
    return {x: i for i, x in enumerate(names)}


def _pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block in some batches as one compressed value."""
    for table in blocks.gathered(batches):
        table = table.sort_by("block")
        number = table["block"].to_numpy()
        begin = blocks.runs(number)
        packed = []
        for a, b in zip(begin, [*begin[1:], len(number)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.slice(a, b - a).combine_chunks())
            packed.append(blocks.pack(np.frombuffer(sink.getvalue(), np.uint8)))
        yield pa.record_batch([pa.array(number[begin], pa.int32()), pa.array(packed, pa.binary())], names=["block", "docs"])


def _documents(packed: pa.Table) -> Iterator[pa.RecordBatch]:
    for value in packed["docs"]:
        yield from pa.ipc.open_stream(pa.py_buffer(blocks.unpack(value.as_py(), np.uint8)))


def _parts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of sorted keys by part, in order. n-grams with equal first bytes share a part, which keeps differences small."""
    part = (words.mix(keys >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    begin = blocks.runs(part[order])
    for a, b in zip(begin, [*begin[1:], len(keys)]):
        yield int(part[order[a]]), order[a:b]


_SENT = "part int, block int, keys binary, more binary"


def _sent(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "block", "keys", "more"])


def _send_model(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The model's arrays sorted by n-gram, dealt to the parts; as from a block of no number."""

    def send(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting)
        keys, p = table["ngram"].to_numpy().view(np.uint64), table["p"].to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], np.log2(p[order]).astype(np.float32)
        yield from _sent([(part, -1, blocks.pack_sorted(keys[at]), blocks.pack(logs[at])) for part, at in _parts(keys, parts)]).to_batches()

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= 1 << 20:
            yield from send(waiting)
            waiting = []
    if waiting:
        yield from send(waiting)


def _ask(block: int, packed: pa.Table, languages: dict, parts: int) -> pa.Table:
    """The block's distinct n-grams, once for each part."""
    keys = np.zeros(0, np.uint64)
    waiting: list[np.ndarray] = []
    for batch in _documents(packed):
        number = np.array([languages[x] for x in batch.column("lang").to_pylist()], np.int64)
        data, starts = words.text_bytes(batch.column("text"))
        for first, part, begins in words.chunks(data, starts):
            waiting.append(np.unique(_ngrams(part, begins, number[first : first + len(begins) - 1])[0]))
            if sum(map(len, waiting)) > max(FOLD, len(keys)):
                keys, waiting = np.unique(np.concatenate([keys, *waiting])), []
    keys = np.unique(np.concatenate([keys, *waiting]))
    return _sent([(part, block, blocks.pack_sorted(keys[at]), None) for part, at in _parts(keys, parts)])


def _answer(sent: pa.Table) -> pa.Table:
    """For each block the log2 probabilities of the n-grams that it asked for."""
    own, asked = sent.filter(pc.less(sent["block"], 0)), sent.filter(pc.greater_equal(sent["block"], 0))
    keys, logs = _lookup(own)
    rows = []
    for part, block, packed in zip(*(asked[c].to_pylist() for c in ("part", "block", "keys"))):
        rows.append((part, block, packed, blocks.pack(logs[np.searchsorted(keys, blocks.unpack_sorted(packed))])))
    return _sent(rows)


def _lookup(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and their values."""
    pairs = [(blocks.unpack_sorted(k), blocks.unpack(m, np.float32)) for k, m in zip(table["keys"].to_pylist(), table["more"].to_pylist())]
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in pairs)])
    logs = np.concatenate([np.zeros(0, np.float32), *(m for _, m in pairs)])
    order = np.argsort(keys)
    return keys[order], logs[order]


def _repeats(hashes: np.ndarray, found: words.Words, size: int) -> np.ndarray:
    """Words of each text inside windows that the text holds twice or more."""
    begin, windows = words.hash_windows(hashes, found.text_first, size)
    text = found.text_of()[begin] if len(begin) else np.zeros(0, np.int64)
    keyed = windows ^ words.mix(text.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keyed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    change = np.zeros(len(hashes) + 1, np.int64)
    if len(twice):
        hit = begin[blocks.member(keyed, twice) >= 0]
        change[hit] += 1
        np.add.at(change, hit + size, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return inside[found.text_first[1:]] - inside[found.text_first[:-1]]


def _sum_by_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[starts[1:]] - total[starts[:-1]]


def _dup_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


_SCORES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, log_perplexity double"
)
_SCORED = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in _SCORES.split(", ")])


def _score(answers: pa.Table, packed: pa.Table, languages: dict) -> pa.Table:
    """A row per document of a block."""
    known, known_logs = _lookup(answers)
    scored = [_score_batch(batch, known, known_logs, languages) for batch in _documents(packed)]
    return pa.Table.from_batches(scored, _SCORED) if scored else _SCORED.empty_table()


def _score_batch(batch: pa.RecordBatch, known: np.ndarray, known_logs: np.ndarray, languages: dict) -> pa.RecordBatch:
    number = np.array([languages[x] for x in batch.column("lang").to_pylist()], np.int64)
    data, starts = words.text_bytes(batch.column("text"))
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for first, part, begins in words.chunks(data, starts):
        found = words.find_words(part, begins)
        hashes = words.hash_words(part, found)
        inside = np.zeros(len(part) + 1, np.int8)
        np.add.at(inside, found.begin, 1)
        np.add.at(inside, found.end, -1)
        letters = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((part & 0xC0) != 0x80)
        keys, text = _ngrams(part, begins, number[first : first + len(begins) - 1])
        own, where = np.unique(keys, return_inverse=True)
        place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        if len(own) and not (len(known) and np.array_equal(known[place], own)):
            raise RuntimeError("a block got no answer for some of its n-grams")
        logs = np.bincount(text, known_logs[place][where], len(begins) - 1)
        chars = np.bincount(text, minlength=len(begins) - 1)
        columns = (found.counts(), _sum_by_text(letters, begins), _sum_by_text(_SYMBOLS[part], begins), _repeats(hashes, found, 5), chars, logs)
        for into, values in zip(parts, columns):
            into.append(values)
    n_words, word_chars, symbols, repeats, chars, logs = (np.concatenate(p) if p else np.zeros(0) for p in parts)
    bits = [-float(a) / int(b) if b else None for a, b in zip(logs, chars)]
    lines = [_dup_lines(t) for t in batch.column("text").to_pylist()]
    return pa.record_batch(
        [
            batch.column("doc_id"), batch.column("lang"),
            *(pa.array(np.asarray(x, np.int64)) for x in (n_words, word_chars, symbols)), pa.array(lines, pa.int64()),
            *(pa.array(np.asarray(x, np.int64)) for x in (repeats, chars)), pa.array(bits, pa.float64()),
        ],
        schema=_SCORED,
    )


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document with its counts, log_perplexity (bits per byte), the band, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows that the text repeats.
    kept: not base_failed, and the log perplexity is inside its language's band: UPPER and LOWER
    quartile distances around the median of its texts of MIN_CHARS or more, wider for short texts (a
    distance is at least 2 % of the median; a language without such texts has no band). A null text is empty: no words, null perplexity, base_failed.
    A null language is a language of its own. Repeated rows are scored alike; null ids are kept; other
    columns are ignored; an empty table gives no rows.
    """
    blocks.bound_batches(docs.sparkSession)
    store = Stored(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    languages, n = _languages(own), blocks.count_blocks(own, "text")
    model = train(own, languages)[-1].mapInArrow(lambda batches: _send_model(batches, n), _SENT)
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int"))
    packed = dealt.mapInArrow(_pack_documents, "block int, docs binary").repartition(n, "block")
    asked = packed.groupBy("block").applyInArrow(lambda key, table: _ask(key[0].as_py(), table, languages, n), _SENT)
    answers = blocks.per_part(model.unionByName(asked), _answer, _SENT)
    scores = store(blocks.per_block(answers, packed, lambda _, found, table: _score(found, table, languages), _SCORES))
    long_enough = F.when(F.col("n_chars") >= MIN_CHARS, F.col("log_perplexity"))
    bands = scores.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx(long_enough, [0.25, 0.5, 0.75], 10_000).alias("q"))
    q = [F.col("q")[i] for i in range(3)]
    bands = bands.select("of", q[1].alias("middle"), F.greatest(q[1] - q[0], 0.02 * q[1]).alias("below"), F.greatest(q[2] - q[1], 0.02 * q[1]).alias("above"))
    wider = 1 + SHORT / F.greatest("n_chars", F.lit(1))
    judged = (
        scores.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
        .withColumn("band_low", F.col("middle") - LOWER * F.col("below") * wider)
        .withColumn("band_high", F.col("middle") + UPPER * F.col("above") * wider)
        .drop("of", "middle", "below", "above")
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    outside = (F.col("log_perplexity") < F.col("band_low")) | (F.col("log_perplexity") > F.col("band_high"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(outside, F.lit(False)))
