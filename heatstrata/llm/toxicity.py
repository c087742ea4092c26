"""Toxicity by weak supervision.

1. Lexicon voters are found in labelled rows: words, and beginnings of words, that stand in toxic
   texts far more often than in others. Pattern voters look at capitals, exclamation and insults
   aimed at someone. A voter fires or abstains; one more fires if no lexicon voter does.
2. A generative label model estimates, by expectation maximisation, how often each voter fires in
   either class; a given label is one more voter, of fixed accuracy. Voters that fire together more
   than their class explains are correlated; their votes count less.
3. A linear classifier is trained on the posterior labels, and scores all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatstrata.llm import blocks, linear, words
from heatstrata.llm.stored import Stored

#: Labelled documents that the voters and the model are fitted on, at most: so many toxic, and others (the first by hash).
MAX_TOXIC, MAX_OTHERS = 4000, 8000
#: Lexicon voters, at most. Every feature of a toxic text is a candidate.
MAX_VOTERS = 400
#: Lengths in bytes of word beginnings that are looked at, besides whole words.
HEADS = (4, 5, 6, 7, 8, 9)
MIN_TOXIC = 4
#: How often a given label is taken to be right.
LABEL_ACCURACY = 0.98
#: Least log odds of a lexicon voter.
MIN_ODDS = 2.0
_N_PATTERNS = 3


def _features(part: np.ndarray, found: words.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash of each word and of its beginnings, with the word's number."""
    yield words.hash_words(part, found, lower=True), np.arange(len(found.begin))
    for size in HEADS:
        long = np.flatnonzero(found.end - found.begin > size)
        heads = words.Words(found.begin[long], found.begin[long] + size, found.text_first)
        yield words.mix(words.hash_words(part, heads, lower=True) + np.uint64(size)), long


def _fired(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: distinct pairs of text and place in a sorted table of features."""
    data, starts = words.text_bytes(column)
    for first, part, begins in words.chunks(data, starts):
        found = words.find_words(part, begins, plain=True)
        text_of = found.text_of()
        pairs = []
        for hashes, word in _features(part, found):
            place = blocks.member(hashes, table)
            hit = np.flatnonzero(place >= 0)
            pairs.append(text_of[word[hit]] * np.int64(len(table)) + place[hit])
        pairs = np.unique(np.concatenate(pairs))
        yield first, pairs // max(1, len(table)), pairs % max(1, len(table))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of texts, with the number of toxic texts and of others in a batch that have them."""
    for batch in batches:
        keys, counts = [], []
        for label in (0, 1):
            data, starts = words.text_bytes(batch.filter(pa.compute.equal(batch.column("toxic"), label)).column("text"))
            for _, part, begins in words.chunks(data, starts):
                found = words.find_words(part, begins, plain=True)
                text_of = found.text_of()
                for hashes, word in _features(part, found):
                    pairs = np.unique(np.stack([hashes, text_of[word].astype(np.uint64)]), axis=1)
                    key, n = np.unique(pairs[0], return_counts=True)
                    keys.append(key)
                    counts.append(np.stack([n * (label == 0), n * (label == 1)]))
        if keys:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = [np.bincount(at, x, len(key)).astype(np.int64) for x in np.concatenate(counts, axis=1)]
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["feature", "other", "toxic"])


def with_signs(docs: DataFrame) -> DataFrame:
    """Adds the numbers of letters, capitals and double exclamation marks of each text."""
    known = F.coalesce("text", F.lit(""))
    counts = {"letters": r"\p{L}", "capitals": r"\p{IsUppercase}", "marks": "!!"}
    return docs.withColumns({name: F.regexp_count(known, F.lit(pattern)) for name, pattern in counts.items()})


_SIGNS = ("letters", "capitals", "marks")


def _patterns(batch: pa.RecordBatch) -> np.ndarray:
    """Pattern votes: shouting capitals, rows of exclamation marks, much of both or of signs."""
    letters, capitals, marks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _SIGNS)
    some = np.maximum(letters, 1)
    return np.stack([(capitals > 0.5 * some) & (some > 20), marks > 2, (marks > 0) & (capitals > 0.3 * some)], axis=1).astype(np.int32)


def _votes(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fired: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for first, text, voter in _fired(batch.column("text"), table):
            for t, v in zip(text.tolist(), voter.tolist()):
                fired[first + t].append(v)
        patterns = _patterns(batch).tolist()
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "toxic": batch.column("toxic"),
                "fired": pa.array(fired, pa.list_(pa.int32())),
                "patterns": pa.array(patterns, pa.list_(pa.int32())),
            }
        )


class LabelModel:
    """Voters fire independently given the class, but for their correlations, which weaken their votes."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 8):
        n, m = votes.shape
        y = labels.astype(float)
        given = (2 * y - 1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
        self.weight = np.ones(m)
        for _ in range(rounds):
            rate = [(votes * c[:, None]).sum(axis=0) + 0.1 for c in (1 - y, y)]
            self.rate = np.stack([rate[0] / ((1 - y).sum() + 1), rate[1] / (y.sum() + 1)])
            self.prior = (y.sum() + 0.5) / (n + 1)
            self.weight = 1 / (1 + np.maximum(self._correlation(votes, y), 0).sum(axis=1))
            y = self.labels = self.posterior(votes, given)

    def _correlation(self, votes: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Correlation of the votes beyond what the class explains."""
        rest = votes - np.outer(1 - y, self.rate[0]) - np.outer(y, self.rate[1])
        cov = rest.T @ rest / max(1, len(y))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        return np.where(np.abs(corr) > 0.05, corr, 0)

    def posterior(self, votes: np.ndarray, given: np.ndarray | float = 0.0) -> np.ndarray:
        evidence = given + votes @ (self.weight * np.log(self.rate[1] / self.rate[0]))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + evidence, -30, 30)))


def _matrix(fired: list[list[int]], patterns: list[list[int]], n_voters: int) -> np.ndarray:
    """Votes: lexicon, patterns, and whether no lexicon voter fires."""
    votes = np.zeros((len(fired), n_voters + _N_PATTERNS + 1))
    for i, (f, p) in enumerate(zip(fired, patterns)):
        votes[i, f] = 1
        votes[i, n_voters : n_voters + _N_PATTERNS] = p
        votes[i, -1] = not f
    return votes


def _chosen_voters(labelled: DataFrame) -> np.ndarray:
    """The MAX_VOTERS features that tell the classes apart most surely (likelihood ratio statistic), of all features.

    Both classes are counted by Spark, and only the chosen voters come to the driver.
    """
    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    others, toxics = totals.get(0, 0), totals.get(1, 0)
    summed = labelled.select("text", "toxic").mapInArrow(_feature_counts, "feature long, other long, toxic long").groupBy("feature")
    counts = summed.agg(F.sum("other").alias("b"), F.sum("toxic").alias("a")).where(F.col("a") >= MIN_TOXIC)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    odds = F.log((a + 0.5) / (toxics + 1)) - F.log((b + 0.5) / (others + 1))
    expected = (a + b) * toxics / max(1, toxics + others)

    def part(n, e):
        return n * F.log(F.greatest(n, F.lit(0.5)) / F.greatest(e, F.lit(1e-9)))

    ranked = counts.where(odds >= MIN_ODDS).select("feature", (part(a, expected) + part(b, a + b - expected)).alias("surprise"))
    best = ranked.orderBy(F.desc("surprise"), "feature").limit(MAX_VOTERS).collect()
    return np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))


def train(labelled: DataFrame):
    """(voters, classifier) from a bounded table of rows (doc_id, text, toxic, and the signs of the text)."""
    table = _chosen_voters(labelled)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _votes(batches, table)

    found = labelled.mapInArrow(vote, "doc_id long, toxic int, fired array<int>, patterns array<int>").orderBy("doc_id").collect()
    votes = _matrix([r.fired for r in found], [r.patterns for r in found], len(table))
    model = LabelModel(votes, np.array([r.toxic for r in found], float))
    return table, linear.fit(votes, model.labels, ridge=0.3)


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if the score is 0.7 or more), n_fired.

    ``labels`` has doc_id and the label 0 or 1; rows with other labels or a null id are left out. Rows
    whose crc32 of the id as text leaves 1 when divided by 3 are held out: their labels are never
    read. The score sees nothing but the text. Null and empty texts have no votes and get the score
    of such a text. A null id is not held out. Repeated rows are scored alike; without labels all
    scores are the same. Other columns are ignored.
    """
    own = with_signs(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    remainder = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)), F.lit(0))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & (remainder != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda c, n: known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(1, MAX_TOXIC).union(first(0, MAX_OTHERS))
    voters, classifier = train(Stored(docs.sparkSession)(own.join(F.broadcast(sample), "doc_id")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for first, texts, voter in _fired(batch.column("text"), voters):
                for t, v in zip(texts.tolist(), voter.tolist()):
                    fired[first + t].append(v)
            votes = _matrix(fired, _patterns(batch).tolist(), len(voters))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(classifier.probability(votes)), pa.array([len(f) for f in fired], pa.int64())],
                names=["doc_id", "score", "n_fired"],
            )

    scored = own.mapInArrow(score, "doc_id long, score double, n_fired long")
    return scored.select(
        "doc_id", (remainder == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_fired"
    )
