"""Toxicity grades: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import batched, pieces, texts_of, words_of
from lodestar.llm.near_text import SEEDS, shingles, signed, sketches
from lodestar.session import settle

#: Labelled documents of each class that the fit reads, about; all if there are fewer.
SAMPLE = 4000
#: Features of the model, and how far (in deviations) a feature's shares in toxic and clean texts differ.
FEATURES, DEVIATIONS = 1024, 5.0
#: Severity grades of toxic documents; grade 0 is clean.
GRADES = 3
#: Probability of a grade above 0 from which a document is rejected.
REJECT = 0.25
#: Descent: rounds, step and weight decay.
ROUNDS, STEP, DECAY = 1500, 0.1, 3e-5
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
CELLS = 1 << 30
#: Min-hashes by which copies are taken out of the sample, lest their words count as many texts'.
COPY_KEYS = 4


def features_of(text: str, known: Container[str] | None = None) -> dict[str, int]:
    """Counts of the words of ``text`` and of how they begin (a prefix ends in ``*``), or of those ``known``."""
    found: dict[str, int] = {}
    for word, n in Counter(WORD.findall(text.lower())).items():
        for feature in (word, *(word[:length] + "*" for length in PREFIXES if len(word) >= length)):
            if known is None or feature in known:
                found[feature] = found.get(feature, 0) + n
    return found


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of about ``SAMPLE`` labelled documents of each class, chosen by a hash of the id.

    A document with several labels counts as toxic if one says so. The chosen ids are few
    enough to be broadcast, so no text is shuffled.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = known.groupBy("toxic").agg((F.least(F.lit(1.0), SAMPLE / F.count("*")) * CELLS).cast("long").alias("cells"))
    chosen = known.join(F.broadcast(sizes), "toxic").filter(F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)) < F.col("cells"))  # two rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("toxic", "text")


def without_copies(sample: DataFrame) -> DataFrame:
    """``sample`` with one text of those that share the least of their hashed runs of five words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                words = words_of(texts_of(part.column("text")))
                runs = [shingles(words.hash[a:b]) for a, b in zip(words.first, words.first[1:], strict=False)]
                keys = [signed(sketches(r, SEEDS[:COPY_KEYS], 1)) for r in runs]
                yield part.append_column("keys", pa.array(keys, pa.list_(pa.int64())))

    rows = sample.mapInArrow(run, "toxic int, text string, keys array<long>")
    for k in range(COPY_KEYS):
        rows = rows.groupBy(F.col("keys")[k]).agg(F.min_by(F.struct("toxic", "text", "keys"), F.struct(F.xxhash64("text"), "toxic")).alias("row")).select("row.*")
    return rows.select("toxic", "text")


def telling_features(sample: DataFrame) -> pa.Table:
    """(feature, toxic, clean): the features whose document shares differ most, with document counts."""

    def run(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        sizes = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch.column("text")), strict=True):
                seen[toxic].update(features_of(text.as_py()).keys())
                sizes[toxic] += 1
        for toxic, counts in seen.items():
            counts = counts | Counter({"": sizes[toxic]})  # the number of documents
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["feature", "toxic", "n"])

    counted = sample.mapInArrow(run, "feature string, toxic int, n long")
    both = settle(counted.groupBy("feature").agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == side, F.col("n"))), F.lit(0)).alias(name) for name, side in (("toxic", 1), ("clean", 0)))), "toxic-features")
    of = both.filter("feature = ''").select(F.col("toxic").alias("n1"), F.col("clean").alias("n0"))
    share = (F.col("toxic") + F.col("clean")) / (F.col("n1") + F.col("n0"))
    apart = (F.col("toxic") / F.col("n1") - F.col("clean") / F.col("n0")) / F.sqrt(share * (1 - share) * (1 / F.col("n1") + 1 / F.col("n0")))
    ranked = both.filter("feature <> ''").join(F.broadcast(of)).filter("n1 > 0 AND n0 > 0").withColumn("apart", F.abs(apart)).filter(F.col("apart") >= DEVIATIONS)
    return ranked.orderBy(F.desc("apart"), "feature").limit(FEATURES).select("feature", "toxic", "clean", "n1", "n0").toArrow()


class Model(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray  #: one for each feature, shared by all thresholds
    thresholds: np.ndarray  #: ascending; P(grade >= k) = logistic(score - thresholds[k - 1])

    def severities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) by text and k; its sum over k is the expected grade."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -500, 500)))

    def score(self, text: str) -> float:
        total = 0.0
        if self.index:
            for feature, n in sorted(features_of(text, self.index).items()):
                total += self.weights[self.index[feature]] * (1 + np.log(n))
        return total


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest likelihood, by Adam over all rows.

    ``rows``, ``columns``, ``values``: the entries of the sparse feature matrix. The
    thresholds are a first one and positive gaps, so they stay in order.
    """
    n, top = len(grades), int(grades.max())
    theta = np.zeros(width + top)
    theta[width + 1 :] = np.log(0.5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, ROUNDS + 1):
        gaps = np.exp(theta[width + 1 :])
        cuts = theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=theta[columns] * values, minlength=n)
        above = np.ones((n, top + 2))
        above[:, 1:-1] = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -500, 500)))
        above[:, -1] = 0
        a, b = above[np.arange(n), grades], above[np.arange(n), grades + 1]
        p = np.maximum(a - b, 1e-12)
        slope = 1 - a - b
        grad = np.zeros_like(theta)
        grad[:width] = np.bincount(columns, weights=slope[rows] * values, minlength=width) / n - DECAY * theta[:width]
        cut = np.bincount(grades, weights=-a * (1 - a) / p, minlength=top + 2)[1 : top + 1] + np.bincount(grades + 1, weights=b * (1 - b) / p, minlength=top + 2)[1 : top + 1]
        cut /= n
        grad[width] = cut.sum()
        grad[width + 1 :] = gaps * (cut[::-1].cumsum()[::-1][1:])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cuts = theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1 :]))])
    return theta[:width], cuts


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the sample. Labels say toxic or not; how severe a toxic text is, the amount of
    marks of toxic texts that it holds, in ``GRADES`` equal parts of the toxic sample.

    Without toxic or without clean labels the model grades everything 0.
    """
    sample = settle(without_copies(sample_of(docs, labels)), "toxic-sample")
    found = telling_features(sample).to_pydict()
    index = {f: i for i, f in enumerate(found["feature"])}
    if not index:
        return Model({}, np.zeros(0), np.full(GRADES, 50.0))
    toxic_only = {i for i, (t, c, n1, n0) in enumerate(zip(found["toxic"], found["clean"], found["n1"], found["n0"], strict=True)) if t / n1 > 8 * c / n0}

    def run(batches):
        for batch in batches:
            at, counts = [], []
            for text in texts_of(batch.column("text")):
                own = sorted((index[f], c) for f, c in features_of(text.as_py(), index).items())
                at.append([i for i, _ in own]), counts.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["toxic", "at", "counts"])

    drawn = sample.mapInArrow(run, "toxic int, at array<int>, counts array<int>").toArrow()  # a few numbers for each of the sample
    ordered = sorted(zip(*(drawn.column(c).to_pylist() for c in ("toxic", "at", "counts")), strict=True))  # so that sums come out alike
    toxic, at, counts = np.array([r[0] for r in ordered]), [r[1] for r in ordered], [r[2] for r in ordered]
    rows = np.repeat(np.arange(len(toxic)), [len(a) for a in at])
    columns, counts = (np.array([x for row in lists for x in row], int) for lists in (at, counts))
    values = 1 + np.log(counts)
    marks = np.bincount(rows, weights=values * np.isin(columns, sorted(toxic_only)), minlength=len(toxic))
    edges = np.quantile(marks[toxic == 1], np.arange(1, GRADES) / GRADES)
    grades = np.where(toxic == 1, 1 + np.searchsorted(edges, marks, side="right"), 0)
    weights, cuts = fit_ordinal(rows, columns, values, grades, len(index))
    return Model(index, weights, cuts)


def graded(docs: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of ``docs`` with severity, p_toxic and rejected."""

    def run(batches):
        for batch in batches:
            chance = model.severities(np.array([model.score(t.as_py()) for t in texts_of(batch.column("text"))], np.float64))
            own = [batch.column(c) for c in kept]
            severity, toxic = chance.sum(axis=1).round(6), chance[:, 0].round(6)
            yield pa.RecordBatch.from_arrays([*own, pa.array(severity), pa.array(toxic), pa.array(toxic >= REJECT)], names=[*kept, "severity", "p_toxic", "rejected"])

    schema = docs.select(*kept).schema.add("severity", "double").add("p_toxic", "double").add("rejected", "boolean")
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade, 0 to ``GRADES``), p_toxic and rejected of every whole text.

    Null and empty texts have no features and are graded as such; labels with a null id or
    value, and labels of documents that are not there, say nothing; rows stand for themselves,
    so repeated ones give repeated results; columns other than doc_id, text and toxic are not read.
    """
    given = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return graded(given, fit(given, labels), ["doc_id"])


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns they had."""
    model = fit(batched(docs), labels)

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                chance = model.severities(np.array([model.score(t.as_py()) for t in texts_of(part.column("text"))], np.float64))
                yield part.filter(pa.array(chance[:, 0].round(6) < REJECT))

    return batched(docs).mapInArrow(run, docs.schema)
