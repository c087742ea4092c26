"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatstrata.llm.chat_format import format_chats, read_loss, read_turns
from heatstrata.llm.decontaminate import leaks
from heatstrata.llm.hard_negatives import hard_negatives
from heatstrata.llm.license_scan import licenses
from heatstrata.llm.line_dedup import without_repeated_lines
from heatstrata.llm.lsh_forest import near_copies
from heatstrata.llm.merkle_manifest import merkle_manifest
from heatstrata.llm.mixing import mix_sources
from heatstrata.llm.ngram_join import similar_documents
from heatstrata.llm.perplexity_rules import quality
from heatstrata.llm.site_quality import site_quality
from heatstrata.llm.substring_dedup import remove_repeats
from heatstrata.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("n_links")


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    done = format_chats(chats.unionByName(probe)).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("segments")))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "broken_at",
    )


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(table(spark, sf_dir, "documents"), min_words=1)
    return kept.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@_query
def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


#: Words of DuckDB: runs of anything but the six ASCII spaces.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op4_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM wins GROUP BY h),
hits AS (SELECT doc_id, s FROM wins JOIN firsts USING (h) WHERE first_doc < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM hits),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM pos ANTI JOIN covered USING (doc_id, p) GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def _jaccard_sql(size: int, more: str = "") -> str:
    """Components of documents whose sets of word shingles have a Jaccard similarity of 80 percent."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + {size - 1}], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [1] ELSE range(1, len(w) - {size - 2}) END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = to_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id{more}
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


ORACLES["op1_ngram_jaccard_join"] = _jaccard_sql(5)
ORACLES["op12_lsh_forest"] = _jaccard_sql(4, ", d.doc_id = component_id AS kept")


def _merkle_sql(levels: int = 6) -> str:
    """Levels of all trees one after another, enough for 16**levels documents a source and as many sources.

    t holds the trees of the sources and u the tree above them; ts and us hold the siblings of each node.
    """
    field = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ops = "list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda x: list_concat([CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(x AS BIGINT), 1)) AS BIGINT)], repeat([-1::BIGINT], 8)))"
    step = "CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten({ops})), lambda c, b: {step}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS g FROM documents)",
        "a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ti FROM d)",
        "t0 AS (SELECT source AS k, ti AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM a)",
    ]
    for t in "tu":
        if t == "u":
            steps.append(f"u0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, k AS source FROM t{levels})")
        for x in range(levels):
            run = "CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END"
            steps.append(f"{t}{x + 1} AS (SELECT k, i // 16 AS i, {run} AS h, (n + 15) // 16 AS n FROM {t}{x} GROUP BY k, i // 16, n)")
            side = "coalesce(string_agg(h, '') OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
            before, after = side.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), side.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            steps.append(f"{t}s{x} AS (SELECT k, i, {before} AS l, {after} AS r FROM {t}{x} WHERE n > 1)")
    places = [(t, x) for t in "tu" for x in range(levels)]
    on = {"t": "{0}.k IS NOT DISTINCT FROM a.source AND {0}.i = a.ti // {1}", "u": "{0}.i = u0.i // {1}"}
    joins = " ".join(f"LEFT JOIN {t}s{x} ON " + on[t].format(f"{t}s{x}", 16**x) for t, x in places)
    proof = " || ".join(f"coalesce({t}s{x}.l || {t}s{x}.r, '')" for t, x in places)
    sides = ", ".join(f"{t}s{x}.l AS l{t}{x}, {t}s{x}.r AS r{t}{x}" for t, x in places)
    steps.append(
        f"f AS (SELECT doc_id, leaf, u0.h AS subroot, (SELECT h FROM u{levels}) AS root, sha256({proof}) AS proof_sha256, g, {sides} "
        f"FROM a JOIN u0 ON u0.source IS NOT DISTINCT FROM a.source {joins})"
    )
    last = "f"
    for t, x in places:
        steps.append(f"f{t}{x} AS (SELECT * REPLACE (CASE WHEN l{t}{x} IS NULL THEN g ELSE sha256(l{t}{x} || g || r{t}{x}) END AS g) FROM {last})")
        last = f"f{t}{x}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, g AS folded_root, g = root AS verified FROM {last}"


ORACLES["op13_merkle_manifest"] = _merkle_sql()

ORACLES["op11_hard_negatives"] = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pos AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY rid ORDER BY positive_score DESC, positive_id) AS slot
    FROM (SELECT a.rid, a.vec_id AS anchor_id, a.label, a.v, b.vec_id AS positive_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS positive_score
          FROM r a JOIN r b ON a.label = b.label AND a.rid <> b.rid WHERE a.vec_id % 100 = 0))
  WHERE slot <= 5),
neg AS (
  SELECT *, row_number() OVER (PARTITION BY rid, slot ORDER BY negative_score DESC, negative_id) AS rank
  FROM (SELECT p.rid, p.slot, p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, CAST(list_inner_product(p.v, n.v) AS BIGINT) AS negative_score
        FROM pos p JOIN r n ON n.label <> p.label)
  WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""
