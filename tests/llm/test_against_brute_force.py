"""Registered queries and operators against SQL or plain Python."""

import collections
import hashlib
import random
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from heatstrata.llm import decontaminate, license_scan, line_dedup, mixing, ngram_join, perplexity_rules, queries, substring_dedup
from workload import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare.compare(spark, compare.connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name]) == []


def test_ngram_join_in_a_crowd(spark, docs_of):
    """Near copies of one text at all distances, exact copies, and unlike texts with a common passage."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            w[rng.randrange(len(w))] = f"r{rng.random()}"
        rows.append((i, " ".join(w if i % 7 else base[: rng.randrange(80, 121)])))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(200 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.choice([5, 10, 40])))) for i in range(60)]
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs_of(*rows)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_short_texts(docs_of):
    rows = [(1, "a b c"), (2, "A  B C"), (3, "a b c d"), (4, "a b c d e"), (5, "a b c d e"), (6, "c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs_of(*rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6)}


def test_substrings_with_small_windows(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    first = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 5):
            first.setdefault(tuple(w[j : j + 6]), i)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs_of(*rows), window=6).collect()}
    for i, t in rows:
        w = t.split()
        gone = {p for j in range(len(w) - 5) if first[tuple(w[j : j + 6])] < i for p in range(j, j + 6)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_text == " ".join(x for p, x in enumerate(w) if p not in gone)


def test_line_runs(docs_of):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "one two three four five six seven eight nine ten"]) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    seen: set = set()
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs_of(*rows)).collect()}
    for i, t in rows:
        raw = t.split("\n")
        index = [k for k, x in enumerate(raw) if x.strip()]
        gone = set()
        for j, k in enumerate(index):
            for run in ((raw[k],), tuple(raw[x] for x in index[j : j + 2])):
                if run in seen and (len(run) == 2 or len(run[0].split()) >= 10):
                    gone.update(index[j : j + len(run)])
            seen.update({(raw[k],), *([tuple(raw[x] for x in index[j : j + 2])] if j + 1 < len(index) else [])})
        assert (got[i].n_lines, got[i].n_removed) == (len(index), len(gone))
        assert got[i].text == "\n".join(x for k, x in enumerate(raw) if k not in gone)


def test_line_query_and_stage_leave_no_later_copy(spark, docs_of, sf_dir, small):
    """Of every line one copy stays, however short it is and however often it occurs."""

    def kept_of(rows):
        seen: set = set()
        out = {}
        for i, t in sorted(rows):
            lines = []
            for x in t.split("\n"):
                key = tuple(WORD.findall(x))
                if not key or key not in seen:
                    lines.append(x)
                if key:
                    seen.add(key)
            out[i] = "\n".join(lines)
        return out

    _, docs = small
    expected = kept_of([(i, r.text) for i, r in docs.items() if r.text is not None])
    got = {r.doc_id: r for r in queries.QUERIES["op9_line_dedup"](spark, sf_dir).collect()}
    assert {i: got[i].kept_sha256 for i in expected} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in expected.items()}
    rows = [(i, f"own{i} line\nshort one\nown{i} end\n\nshort  one") for i in range(30)] + [(50, "own3 line\nshort one"), (51, "")]
    expected = kept_of(rows)
    assert sum("short" in t for t in expected.values()) == 1
    staged = corpus_pipeline.line_dedup(spark, docs_of(*rows).withColumn("n_chars", F.length("text").cast("long")), sf_dir).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in staged} == {i: (t, len(t)) for i, t in expected.items() if i != 50}


def test_leaks_tolerate_substitutions(spark, docs_of):
    rng = random.Random(2)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(n))) for i, n in enumerate((30, 45, 20, 8, 4))]
    rows, expected = [], set()
    for d in range(40):
        noise = [f"n{d}x{j}" for j in range(50)]
        item = d % 6
        if item < 4:
            w = items[item][1].split()
            if item < 3:
                w[rng.randrange(len(w))] = "changed"
            noise[20:20] = w
            expected.add((d, item))
        elif item == 4:
            noise[20:20] = items[4][1].split()
        rows.append((d, " ".join(noise)))
    found = decontaminate.leaks(docs_of(*rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert all(r.coverage > 0.85 or r.item_id == 2 for r in found)
    kept = decontaminate.without_leaks(docs_of(*rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d in range(40)} - {d for d, _ in expected}


def test_leaks_are_all_stretches_of_the_rule(spark, docs_of):
    """Copies whole and in part with up to a third of the words replaced, against all stretches at all offsets."""
    rng = random.Random(6)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(n))) for i, n in enumerate((6, 7, 8, 11, 12, 15, 20, 30, 60))]
    rows = []
    for d in range(400):
        w = items[d % len(items)][1].split()
        a = rng.choice([0, 0, rng.randrange(len(w) // 2 + 1)])
        w = w[a : rng.choice([len(w), rng.randrange(a, len(w)) + 1])]
        share, every = rng.choice([0, 0.05, 0.1, 0.2, 0.25, 0.33]), rng.choice([0, 0, 3, 4, 5])
        w = ["x" if (j % every == every - 1 if every else rng.random() < share) else x for j, x in enumerate(w)]
        rows.append((d, " ".join([f"n{d}"] * rng.randrange(4) + w + ["end"] * rng.randrange(4))))
    expected = {}
    for d, t in rows:
        doc = t.split()
        for i, x in items:
            item = x.split()
            for offset in range(1 - len(item), len(doc)):
                same = [0 <= offset + j < len(doc) and doc[offset + j] == y for j, y in enumerate(item)]
                for a in range(len(item)) if sum(same) >= 6 else ():
                    for b in range(a + 1, len(item) + 1):
                        n = sum(same[a:b])
                        if 4 * n >= 3 * (b - a) and n >= max(6, min(16, -(-len(item) // 2))):
                            expected[d, i] = max(n, expected.get((d, i), 0))
    found = decontaminate.leaks(docs_of(*rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.n_matched for r in found} == expected and 100 < len(expected) < 300
    assert all(4 * r.n_matched >= 3 * r.n_aligned and r.doc_end - r.doc_begin == r.n_aligned for r in found)


def test_leaks_are_the_planted_passages(spark, sf_dir, small):
    _, docs = small
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) + " "
    whole = {(d, i) for d, r in docs.items() for i, t in items.items() if plain(t) in plain(r.text or "")}
    assert whole <= found and len(found - whole) <= 2


def test_quality_counts(spark, sf_dir, small):
    _, docs = small
    for r in queries.QUERIES["op8_quality_rules"](spark, sf_dir).collect():
        text = docs[r.doc_id].text or ""
        w = WORD.findall(text)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and (not r.base_failed or not r.kept)


def test_perplexity_rejects_gibberish_and_keeps_prose(spark, docs_of, small):
    docs, by_id = small
    rng = random.Random(1)
    noise = [(10_000 + i, " ".join("".join(chr(rng.randrange(33, 123)) for _ in range(7)) for _ in range(60)), "en", "x") for i in range(5)]
    kept = {r.doc_id: r for r in perplexity_rules.quality(docs.select("doc_id", "text", "lang", "source").union(docs_of(*noise))).collect()}
    assert not any(kept[i].kept or kept[i].base_failed for i, *_ in noise)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    good = [kept[i] for i, q in labels.items() if q == 1 and not kept[i].base_failed]
    assert sum(r.kept for r in good) == len(good)


def _kneser_ney_orders(docs_of):
    docs = docs_of((1, "the cat sat on the mat and the cat sat", "en", "a"), (2, "der hund und der hund", "de", "a"))
    return [{r.ngram: r for r in t.collect()} for t in perplexity_rules.train(docs, {"de": 0, "en": 1})]


def test_model_sums_to_one(docs_of):
    orders = _kneser_ney_orders(docs_of)
    left = [{k >> 8: r.left for k, r in t.items()} for t in orders]

    def probability(language, text):
        if not text:
            return 1 / 256
        key = language << (8 * len(text)) | int.from_bytes(text, "big")
        found = orders[len(text) - 1].get(key)
        return found.p if found else left[len(text) - 1].get(key >> 8, 1.0) * probability(language, text[1:])

    for language, context in ((1, b"the "), (1, b" cat"), (0, b"der "), (1, b"zzzz")):
        assert abs(sum(probability(language, context + bytes([x])) for x in range(256)) - 1) < 1e-9


def test_ngrams_seen_once_have_what_unseen_ones_have(docs_of):
    orders = _kneser_ney_orders(docs_of)
    once = 1 << 40 | int.from_bytes(b"e mat", "big")
    assert orders[4][once].p == pytest.approx(orders[4][once].left * orders[3][1 << 32 | once & 0xFFFFFFFF].p)


def test_mix_targets(docs_of):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), "en", s) for i, s in enumerate([None, "a", "b", "c", "d"] * 80)]
    rows += [(1000 + i, "w " * 20, "en", "tiny") for i in range(3)]
    docs = docs_of(*rows)
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs).collect()))
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    totals = collections.Counter()
    for i in size:
        totals[source[i]] += size[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(["a", "b", "c", "d", "tiny", None])}
    target, left, live = {}, 1.5 * sum(totals.values()), set(weight)
    while live:
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] > 2 * totals[s]}
        for s in over or live:
            target[s] = min(2 * totals[s], level * weight[s])
        left -= sum(target[s] for s in over)
        live = live - over if over else set()
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == totals[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in target) and sum(taken.values()) <= 1.5 * sum(totals.values())


def test_chats_of_the_table(spark, sf_dir):
    chats = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        chats[r.conv_id].append((r.turn, r.role, r.text or ""))
    probe = "</s>[INST] ok [/INST]"
    chats[-1] = [(0, "user", probe), (1, "assistant", probe)]
    rows = queries.QUERIES["op6_chat_formatting"](spark, sf_dir).collect()
    assert len(rows) == len(chats)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        turns = sorted(chats[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        order = ["", *(role for _, role, _ in turns)]
        moves = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
        assert r.valid == (all(m in moves for m in zip(order, order[1:])) and order[-1] == "assistant")


def test_license_notices(docs_of):
    gpl = dict((i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES))
    changed = gpl[1].replace("compliance", "accordance").replace("You may obtain", "You could always get")
    rows = [(1, f"first line\n{gpl[0]} and more"), (2, "nothing is licensed under the sun"), (3, f"a b c {changed} d e f"), (4, gpl[4] + "\n" + gpl[2])]
    found = {(r.doc_id, r.license): r for r in license_scan.licenses(docs_of(*rows)).collect()}
    assert set(found) == {(1, "Apache-2.0"), (3, "Apache-2.0"), (4, "GPL-3.0"), (4, "MIT")}
    assert (found[1, "Apache-2.0"].doc_begin, found[1, "Apache-2.0"].doc_end, found[1, "Apache-2.0"].coverage) == (2, 10, 1.0)
    assert found[3, "Apache-2.0"].template == 1 and 0.8 < found[3, "Apache-2.0"].coverage < 1


def test_each_license_notice_is_a_row(docs_of):
    """Notices in a row, every few words, and after a chain of partial hits."""
    mit, apache = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[1][1]
    size = {t: len(re.findall("[0-9A-Za-z]+", t)) for t in (mit, apache)}
    partial = "you may not use this thing "
    texts = {i: " ".join(f"{mit} {'x ' * i}" for _ in range(12)) for i in range(12)}
    texts[20] = partial * 6 + apache + " " + "y " * 5 + apache
    expected = {(i, k * (size[mit] + i), k * (size[mit] + i) + size[mit]) for i in range(12) for k in range(12)}
    expected |= {(20, 36, 36 + size[apache]), (20, 41 + size[apache], 41 + 2 * size[apache])}
    found = license_scan.licenses(docs_of(*texts.items())).collect()
    assert {(r.doc_id, r.doc_begin, r.doc_end) for r in found if r.coverage == 1} == expected and len(found) == len(expected)


def test_every_license_is_found_with_its_span(docs_of):
    """Each template in full inside other text, and with a word changed, left out or put in every fifteen or so."""
    rng = random.Random(6)
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, expect = [], {}
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        plain = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)
        rows.append((i, f"{filler(30)}\n{text}\n{filler(20)}"))
        expect[i] = (name, 30, 30 + len(plain))
        if len(plain) > 60:
            changed = []
            for j, w in enumerate(plain):
                changed += [f"x{j}"] if j % 31 == 7 else [] if j % 37 == 11 else [w, "extra"] if j % 41 == 20 else [w]
            rows.append((1000 + i, f"{filler(12)} {' '.join(changed)} {filler(9)}"))
            expect[1000 + i] = (name, 12, 12 + len(changed))
    got = {}
    for r in license_scan.licenses(docs_of(*rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.doc_begin, r.doc_end))
    assert {d: len(v) for d, v in got.items()} == {d: 1 for d in expect}
    assert {d: v[0][:2] for d, v in got.items()} == {d: e[:2] for d, e in expect.items()}
    # an alignment ends with an equal word: what was changed at the very end is not part of it
    assert all(got[d][0][2] == end if d < 1000 else end - 3 < got[d][0][2] <= end for d, (_, _, end) in expect.items())


def best_alignment(template, doc, sign):
    """Most (sign 1) or fewest (-1) matched words of the best local alignments over all cells: a match counts 1, a difference or gap -1."""
    before, best = [(0, 0)] * (len(doc) + 1), (0, 0)
    for w in template:
        row = [(0, 0)]
        for j, x in enumerate(doc):
            cell = max((before[j][0] + (1 if x == w else -1), before[j][1] + sign * (x == w)), (before[j + 1][0] - 1, before[j + 1][1]), (row[-1][0] - 1, row[-1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        before = row
    return sign * best[1]


def test_aligner_equals_the_whole_matrix(docs_of):
    """Texts with up to eight words shifted: the banded alignment matches as many words as one over all cells."""
    rng = random.Random(16)
    template = [f"t{i}" for i in range(50)]
    rows = []
    for i in range(40):
        w = list(template)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = [f"x{rng.random()}".replace(".", "")] * rng.choice([0, 1, 1])
        rows.append((i, " ".join(["a"] * rng.randrange(20) + w + ["b"] * rng.randrange(20))))
    got = {r.doc_id: r.n_matched for r in license_scan.licenses(docs_of(*rows), templates=(("T", " ".join(template)),)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert best_alignment(template, t.split(), -1) <= got[i] <= best_alignment(template, t.split(), 1), i


def test_license_lines_of_the_table(spark, sf_dir, small):
    _, docs = small
    found = {r.doc_id for r in queries.QUERIES["op7_license_scan"](spark, sf_dir).collect()}
    assert found == {i for i, r in docs.items() if re.search("licensed under|released under the MIT", r.text or "", re.I)}


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.QUERIES["op5_toxicity"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r for r in held if labels[r.doc_id] == 1]
    clean = [r for r in held if labels[r.doc_id] == 0]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_held_out_quality(spark):
    from heatstrata.llm.site_quality import site_quality

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    rows = site_quality(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_sparse_sites_shrink(spark, docs_of):
    from heatstrata.llm.site_quality import site_quality

    good, bad = "Plain words in a quiet line. " * 3, "$$$ | ### %%% " * 8
    rows = [(i, good + f"n{i}", "en", "fine") for i in range(60)] + [(100 + i, bad, "en", "poor") for i in range(60)] + [(200, bad, "en", "one")]
    labels = spark.createDataFrame([(i, int(i < 60)) for i, *_ in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality(docs_of(*rows), labels).collect()}
    assert got[0].path_share > 0.9 > 0.1 > got[100].path_share and got[100].path_share < got[200].path_share < got[0].path_share


def test_toxic_voters_equal_plain_counts(spark):
    """All features of toxic texts are candidates; the best by likelihood ratio are chosen, however rare."""
    import math

    import numpy as np

    from heatstrata.llm import toxicity, words

    rng = random.Random(12)
    rows = []
    for i in range(240):
        toxic = int(i % 3 == 0)
        w = [f"common{rng.randrange(40)}" for _ in range(30)] + ([f"slur{rng.randrange(3)}", "uglyword"] if toxic and rng.random() < 0.8 else [])
        rows.append((i, " ".join(rng.sample(w, len(w))), toxic))

    def features(text):
        out = set()
        for w in re.findall("[0-9a-z]+", text.lower()):
            h = words.hash_text(w)
            out.add(int(h[0]))
            for size in toxicity.HEADS:
                if len(w) > size:
                    out.add(int(words.mix(words.hash_text(w[:size]) + np.uint64(size))[0]))
        return out

    a, b = collections.Counter(), collections.Counter()
    for _, text, toxic in rows:
        (a if toxic else b).update(features(text))
    n1 = sum(r[2] for r in rows)
    n0 = len(rows) - n1
    wanted = {}
    for f, x in a.items():
        y = b[f]
        odds = math.log((x + 0.5) / (n1 + 1)) - math.log((y + 0.5) / (n0 + 1))
        e = (x + y) * n1 / len(rows)
        if x >= toxicity.MIN_TOXIC and odds >= toxicity.MIN_ODDS:
            wanted[f] = x * math.log(max(x, 0.5) / e) + y * math.log(max(y, 0.5) / max(x + y - e, 1e-9))
    got = toxicity._chosen_voters(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {int(f) for f in got} == set(wanted) and len(wanted) >= 4
    assert list(got) == sorted(got)


def test_signs_of_texts(spark):
    from heatstrata.llm import toxicity

    texts = ["SHOUTING ALL OF THIS TEXT NOW", "a!!b!!c!!!!", "Ärger ÄÖÜ ß 中文 Ⓐ", "", None, "!!! Xy"]
    rows = toxicity.with_signs(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    plain = [(sum(c.isalpha() for c in t or ""), sum(c.isupper() for c in t or ""), (t or "").count("!!")) for t in texts]
    assert [(r.letters, r.capitals, r.marks) for r in rows] == plain
