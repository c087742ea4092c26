"""Document quality by hierarchical empirical Bayes over sites and their paths.

A classifier gives each document evidence from its text. Grouped sums give each site, and each path
of a site, its share of good documents, shrunk towards the level above: a path to its site, a site to
all sites. How strongly is estimated from how much the shares of sites (paths) really differ. The
posterior of a document is its path's share, without the document itself, times its own evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import linear, words
from heatstrata.llm.stored import Stored

#: Labelled documents that the classifier is fitted on, at most (the first by hash).
MAX_TRAINING = 20_000
#: A document is kept if its posterior is at least this.
KEEP = 0.3
_CLASSES = {
    "upper": list(range(65, 91)), "digit": list(range(48, 58)), "stop": list(b".!?"), "sign": list(b"#*$%&<>@=_~^{}[]\\/+"),
    "bar": list(b"|"), "comma": list(b",;:"), "shout": list(b"!"), "line": [10],
}
_N_FEATURES = 2 * len(_CLASSES) + 8


def _features(column: pa.Array) -> np.ndarray:
    data, starts = words.text_bytes(column)
    out = np.zeros((len(starts) - 1, _N_FEATURES))
    for first, part, begins in words.chunks(data, starts):
        found = words.find_words(part, begins)
        hashes = words.hash_words(part, found, lower=True)
        n, size = found.counts().astype(float), np.maximum(1, np.diff(begins))
        rows = slice(first, first + len(n))
        for i, signs in enumerate(_CLASSES.values()):
            flag = np.zeros(256, np.int64)
            flag[signs] = 1
            total = np.concatenate([[0], np.cumsum(flag[part])])
            share = (total[begins[1:]] - total[begins[:-1]]) / size
            out[rows, 2 * i], out[rows, 2 * i + 1] = share, np.sqrt(share)
        text = found.text_of()
        same = _repeated(hashes, text, len(n))
        lengths = (found.end - found.begin).astype(float)
        mean = np.bincount(text, lengths, len(n)) / np.maximum(1, n)
        spread = np.sqrt(np.maximum(0, np.bincount(text, lengths**2, len(n)) / np.maximum(1, n) - mean**2))
        more = [np.log1p(n), n < 10, n < 20, mean, spread, same, same**2, same > 0.2]
        for j, values in enumerate(more):
            out[rows, 2 * len(_CLASSES) + j] = values
    return out


def _repeated(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Share of the words of each text that equal the word before, or the one three before."""
    hit = np.zeros(len(hashes), bool)
    for back in (1, 3):
        if len(hashes) > back:
            hit[back:] |= (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back])
    return np.bincount(text, hit, n) / np.maximum(1, np.bincount(text, minlength=n))


def train(labelled: DataFrame) -> linear.Logistic:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("good"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    rows = labelled.mapInArrow(describe, "doc_id long, good int, x array<double>").orderBy("doc_id").collect()
    x = np.array([r.x for r in rows]).reshape(-1, _N_FEATURES)
    return linear.fit(x, np.array([r.good for r in rows], float))


def _strength(total: Column, n: Column, center: Column) -> Column:
    """Prior weight in documents, from the spread of the groups' shares beyond chance: m(1-m)/variance - 1."""
    chance = F.sum(center * (1 - center)) / F.sum(n)
    spread = F.sum(n * (total / n - center) ** 2) / F.sum(n)
    beyond = F.greatest(spread - chance, F.lit(1e-4))
    return F.least(F.greatest(F.avg(center * (1 - center)) / beyond - 1, F.lit(2.0)), F.lit(1000.0))


def site_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", path: str = "lang", label: str = "quality",
) -> DataFrame:
    """One row per document: doc_id, site, path, evidence, site_share, path_share, posterior, kept.

    ``labels`` has doc_id and the label 0 or 1; others are left out. evidence is the probability that
    the text alone gives. Null sites and paths are groups of their own; a null or empty text has the
    evidence of such a text. Repeated rows count each; null ids are kept; without labels the evidence
    is even. An empty table gives no rows. Other columns are ignored.
    """
    store = Stored(docs.sparkSession)
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.col(site).cast("string").alias("site"), F.col(path).cast("string").alias("path"),
    )
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("good"))
    known = known.filter(F.col("good").isin(0, 1)).groupBy("doc_id").agg(F.max("good").alias("good"))
    sample = known.filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING)
    model = train(own.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.clip(model.probability(_features(batch.column("text"))), 1e-6, 1 - 1e-6)
            yield pa.record_batch([batch.column("doc_id"), batch.column("site"), batch.column("path"), pa.array(p)], names=["doc_id", "site", "path", "evidence"])

    judged = store(own.mapInArrow(judge, "doc_id long, site string, path string, evidence double"))
    paths = judged.groupBy("site", "path").agg(F.sum("evidence").alias("path_sum"), F.count("*").alias("path_n"))
    paths = store(paths)
    sites = paths.groupBy("site").agg(F.sum("path_sum").alias("site_sum"), F.sum("path_n").alias("site_n"))
    world = sites.agg(F.sum("site_sum") / F.sum("site_n")).first()[0] or 0.5
    strong = sites.agg(_strength(F.col("site_sum"), F.col("site_n"), F.lit(world))).first()[0] or 2.0
    sites = store(sites.withColumn("site_share", (F.col("site_sum") + strong * world) / (F.col("site_n") + strong)))
    joined = store(paths.withColumnRenamed("site", "of").join(sites, F.col("of").eqNullSafe(F.col("site"))).drop("of"))
    strong = joined.agg(_strength(F.col("path_sum"), F.col("path_n"), F.col("site_share"))).first()[0] or 2.0
    levels = joined.select(F.col("site").alias("of_site"), F.col("path").alias("of_path"), "path_sum", "path_n", "site_share")
    found = judged.join(levels, judged.site.eqNullSafe(F.col("of_site")) & judged.path.eqNullSafe(F.col("of_path")))
    # the document itself is left out of its path's share
    share = (F.col("path_sum") - F.col("evidence") + strong * F.col("site_share")) / (F.col("path_n") - 1 + strong)
    odds = lambda p: p / (1 - p)
    safe = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = odds(safe(F.col("path_share"))) * odds(F.col("evidence")) / (world / (1 - world))
    return (
        found.withColumn("path_share", share)
        .withColumn("posterior", posterior / (1 + posterior))
        .select("doc_id", "site", "path", "evidence", "site_share", "path_share", "posterior", (F.col("posterior") >= KEEP).alias("kept"))
    )
