"""The stages of the pipeline against plain Python, each on what its predecessor kept."""

import collections
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from heatstrata.llm import mixing
from heatstrata.llm.rows import with_row_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def base_failed(text):
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(w) < 10 or 100 * len(repeated) > 20 * len(w)


def without_later_lines(texts):
    seen: set = set()
    out = {}
    for i, t in sorted(texts.items()):
        keys = [tuple(WORD.findall(x)) for x in t.split("\n")]
        later = []
        for key in keys:
            later.append(bool(key) and key in seen)
            seen.add(key)
        if not any(later) or any(key and not gone for key, gone in zip(keys, later)):
            out[i] = "\n".join(x for x, gone in zip(t.split("\n"), later) if not gone)
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def first_of_similar(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    sharers = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            sharers[x].append(i)
    common = collections.Counter((a, b) for ids in sharers.values() for a in ids for b in ids if a < b)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def leaks(text, item):
    doc, item = PLAIN.findall(lower(text)), PLAIN.findall(lower(item))
    need = max(6, min(16, -(-len(item) // 2)))
    places = collections.defaultdict(list)
    for j, x in enumerate(item):
        places[x].append(j)
    offsets = collections.Counter(k - j for k, x in enumerate(doc) for j in places.get(x, ()))
    for offset, n in offsets.items():
        if n >= need:
            same = [0 <= offset + j < len(doc) and doc[offset + j] == x for j, x in enumerate(item)]
            for a in range(len(item)):
                for b in range(a + need, len(item) + 1):
                    if sum(same[a:b]) >= need and 4 * sum(same[a:b]) >= 3 * (b - a):
                        return True
    return False


def test_stages_equal_plain_python(spark, sf_dir, small, tmp_path, monkeypatch):
    docs, by_id = small
    rng = random.Random(9)
    good = [i for i, r in by_id.items() if r.lang == "en" and r.text and not base_failed(r.text) and 80 < len(r.text.split()) < 400]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    longest = max(items.values(), key=lambda t: len(t.split())).split()
    added = [(10_000 + i, " ".join("".join(chr(rng.randrange(33, 123)) for _ in range(7)) for _ in range(60))) for i in range(3)]
    added += [(10_010, by_id[good[0]].text), (10_011, by_id[good[1]].text.replace("\n", " ") + " more")]
    words = lambda n: " ".join(rng.choice(by_id[good[n]].text.split()) for _ in range(40))
    added += [(10_020 + i, f"{words(i)}\nshort line here\n{words(i + 1)}") for i in range(3)]
    added += [(10_030, words(5) + " " + " ".join("other" if j % 5 == 4 else x for j, x in enumerate(longest)) + " " + words(6))]
    first = docs.limit(1).collect()[0]
    rows = [tuple({"doc_id": i, "text": t, "lang": by_id[good[0]].lang, "source": "planted", "n_chars": len(t)}.get(c, first[c]) for c in docs.columns) for i, t in added]
    docs.union(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    inputs = []

    def recorded(stage):
        def call(session, frame, folder):
            inputs.append({r.doc_id: r for r in frame.collect()})
            return stage(session, frame, folder)

        return call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, recorded(s)) for n, s in corpus_pipeline.STAGES])
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [{i: r.text or "" for i, r in rows.items()} for rows in inputs]
    assert len(texts) == 5 and set(by_id) < set(texts[0])
    junk = {10_000, 10_001, 10_002}
    assert texts[1] == {i: t for i, t in texts[0].items() if not base_failed(t) and i not in junk}
    assert texts[2] == without_later_lines(texts[1]) and 10_010 not in texts[2]
    assert all(r.n_chars == len(r.text) for i, r in inputs[2].items() if r.text != texts[1][i])
    assert sum("short line here" in t for t in texts[2].values()) == 1
    assert texts[3] == {i: texts[2][i] for i in first_of_similar(texts[2])}
    assert texts[4] == {i: t for i, t in texts[3].items() if not any(leaks(t, x) for x in items.values())}
    assert 10_030 in texts[3] and 10_030 not in texts[4] and {10_020, 10_021, 10_022} <= set(texts[4])
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mixing.mix_sources(spark.createDataFrame(list(inputs[4].values()), docs.schema)).collect()))
    size = {i: len(WORD.findall(t)) for i, t in texts[4].items()}
    assert {r.doc_id for r in mixed} == set(size) and all(r.taken in (0, r.size, 2 * r.size) and r.size == size[r.doc_id] for r in mixed)


def good_text(rng, n=60):
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randrange(1000)}" for _ in range(n))


def test_stages_judge_rows_not_ids(spark, docs_of, tmp_path):
    """Rows without an id, and rows that share one, go or stay for their own text, in every stage."""
    rng = random.Random(2)
    a, b, c, item = (good_text(rng) for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaking = good_text(rng, 20) + " " + item
    rows = [(1, a), (2, a), (2, b), (None, a), (3, leaking), (3, c), (None, leaking), (None, b + " x"), (4, "x"), (4, None), (None, None), (5, c), (5, c)]
    docs = docs_of(*rows).withColumn("n_chars", F.length("text").cast("long"))
    texts = lambda frame: collections.Counter((r.doc_id, r.text) for r in frame.collect())
    short = {(4, "x"), (4, None), (None, None)}
    kept = texts(corpus_pipeline.quality_rules(spark, docs, str(tmp_path)))
    assert kept == collections.Counter(r for r in rows if r not in short)
    similar = texts(corpus_pipeline.ngram_join(spark, docs, str(tmp_path)))
    assert similar == collections.Counter([(1, a), (2, b), (3, leaking), (3, c), (4, "x"), (4, None), (None, None)])
    clean = texts(corpus_pipeline.decontamination(spark, docs, str(tmp_path)))
    assert clean == collections.Counter(r for r in rows if r[1] != leaking)
    lines = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert (2, b) in texts(lines) and (1, a) in texts(lines) and (None, a) not in texts(lines)
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter(r[0] for r in rows)


def test_stages_of_an_empty_table(spark, docs_of, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = docs_of().withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name


def test_row_ids(spark, docs_of):
    rows = [(1, "a"), (1, "a"), (1, None), (None, "a"), (1, "b"), (None, None), (11, ""), (1, "1")]
    got = [r["__row"] for r in with_row_ids(docs_of(*rows)).collect()]
    assert got[0] == got[1] and len(set(got)) == len(rows) - 1
    plain = [(7, "a"), (3, None), (3, None), (5, "a")]
    assert [r["__row"] for r in with_row_ids(docs_of(*plain)).collect()] == [7, 3, 3, 5]
