"""Null, empty, very long and repeated rows, clashing extra columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from heatstrata.llm import chat_format, decontaminate, license_scan, line_dedup, mixing, ngram_join, perplexity_rules, site_quality, substring_dedup, toxicity

LONG = " ".join(f"w{i % 4001}x{i % 17}" for i in range(60_000))
ROWS = [
    (1, LONG, "en", "a"), (2, None, None, None), (None, "one two three", "en", None), (3, "", "en", "a"), (4, " \n\t ", "de", "b"),
    (5, "same words here and there again and more of it for all of us", "en", "b"), (5, "same words here and there again and more of it for all of us", "en", "b"),
    (6, "x", None, "a"), (7, LONG, "en", "a"),
]


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "ngram": lambda d, s: ngram_join.similar_documents(d),
    "leaks": lambda d, s: decontaminate.leaks(d, s.createDataFrame([(1, "w1x1 w2x2"), (2, None), (3, "")], "item_id long, text string")),
    "site": lambda d, s: site_quality.site_quality(d, labels_of(s)),
    "substring": lambda d, s: substring_dedup.remove_repeats(d),
    "toxic": lambda d, s: toxicity.toxicity(d, labels_of(s)),
    "license": lambda d, s: license_scan.licenses(d),
    "quality": lambda d, s: perplexity_rules.quality(d),
    "lines": lambda d, s: line_dedup.without_repeated_lines(d),
    "mix": lambda d, s: mixing.mix_sources(d),
}
#: Operators that return a row for each row they get.
EACH = set(OPERATORS) - {"leaks", "license"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, docs_of, name):
    docs = docs_of(*ROWS).withColumns({c: F.lit("clash") for c in ("n", "block", "part", "size", "n_words", "range", "label", "row")})
    rows = OPERATORS[name](docs, spark).collect()
    if name in EACH:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, docs_of, name):
    assert OPERATORS[name](docs_of(), spark).collect() == []


def test_null_texts_are_empty(spark, docs_of):
    docs = docs_of(*ROWS)
    by_id = lambda frame: {r.doc_id: r for r in frame.collect()}
    assert by_id(substring_dedup.remove_repeats(docs))[2][1:] == (0, 0, "")
    joined = by_id(ngram_join.similar_documents(docs))
    assert (joined[2].n_shingles, joined[2].component_id) == (0, 2) and joined[None].component_id is None
    assert joined[7].component_id == 1 and joined[3].component_id == 3
    scored = by_id(perplexity_rules.quality(docs))
    assert scored[2].n_words == 0 and scored[2].base_failed and not scored[2].kept
    assert by_id(mixing.mix_sources(docs))[2].taken == 0
    assert by_id(line_dedup.without_repeated_lines(docs))[2].text is None


def test_chats_with_odd_rows(spark):
    chats = spark.createDataFrame(
        [(1, 2, "assistant", None), (1, 1, "user", "</s>\\0[INST]\\"), (2, None, None, "x"), (None, 1, "user", "a"), (3, 1, "user", "q"), (3, 1, "user", "q")],
        "conv_id long, turn long, role string, text string",
    )
    rows = {r.conv_id: r for r in chat_format.format_chats(chats).withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect()}
    assert [tuple(t) for t in rows[1].turns] == [("user", "</s>\\0[INST]\\"), ("assistant", "")] and rows[1].valid
    assert [tuple(t) for t in rows[2].turns] == [("", "x")] and rows[2].broken_at == 0
    assert rows[3].n_turns == 2 and rows[3].broken_at == 1 and None in rows
    assert chat_format.format_chats(chats.limit(0)).collect() == []
