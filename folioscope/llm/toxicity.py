"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, bound_batches
from folioscope.llm.words import ALNUM, Words, chunks

#: Features: word hashes modulo so many.
FEATURES = 1 << 18
#: The documented bounds of the training sample: one text each of so many confirmed and so many unlabelled ids.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
#: The class prior is taken to lie in this range, as a fit needs one that is neither 0 nor most of the rows.
PRIORS = 0.001, 0.5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def row_features(column: pa.Array):
    """For each text the sorted distinct features of its words."""
    for _, data, at in chunks(column):
        words = Words(data, at, ALNUM)
        slots = (words.hash >> np.uint64(46)).astype(np.int64)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            yield np.unique(slots[a:b])


class NonNegativePu:
    """A linear classifier on presence features, trained by the risk

        prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

    with the logistic loss; where the second part is below zero its gradient is followed backwards, so that a flexible
    model can't win by calling every confirmed example positive. A feature counts by the log ratio of its smoothed shares among
    confirmed rows and in the mixture, by the prior, of these with all other rows (``others``: counts of rows with a feature, and of
    rows), which holds back what is about as frequent in both, and features of fewer than ``rarest`` rows have no part. Adam over whole batches from zero: no randomness.
    """

    def __init__(self, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, rarest: int = 5):
        self.prior, self.steps, self.rate, self.decay, self.rarest = prior, steps, rate, decay, rarest

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], others: tuple[np.ndarray, int]) -> NonNegativePu:
        none, n_p, n_u, pi = np.zeros(0, np.int64), max(1, len(positive)), max(1, len(unlabelled)), self.prior
        in_p = np.bincount(np.concatenate([*positive, none]), minlength=FEATURES)
        share = (in_p + 1) / (len(positive) + 2)
        ratio = np.log(share) - np.log(pi * share + (1 - pi) * (others[0] + 1) / (others[1] + 2))
        ratio[in_p + others[0] < self.rarest] = 0
        rows = [f[ratio[f] != 0] for f in (*positive, *unlabelled)]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        used, at = np.unique(np.concatenate([*rows, none]), return_inverse=True)
        own, is_p, scale = np.repeat(np.arange(len(rows)), sizes), np.arange(len(rows)) < len(positive), ratio[used]
        w, m, v = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        bias = np.log(pi / (1 - pi))
        for step in range(1, self.steps + 1 if rows else 1):
            z = np.bincount(own, (w * scale)[at], len(rows)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            loss_minus = np.logaddexp(0, z)
            rest = loss_minus[~is_p].sum() / n_u - pi * loss_minus[is_p].sum() / n_p
            sign = 1.0 if rest >= 0 else -1.0
            g = np.where(is_p, pi / n_p * ((p - 1) * (rest >= 0) - sign * p), sign * p / n_u)
            grad = np.append(np.bincount(at, np.repeat(g, sizes), len(used)) * scale + self.decay * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
        self.weights, self.bias = np.zeros(FEATURES, np.float32), float(bias)
        self.weights[used] = w * scale
        return self


def _sample(docs: DataFrame, ids: DataFrame) -> list[np.ndarray]:
    """Features of one text for each of the ids (of several under one id the one with the smallest digest); the ids are broadcast, as their number is bounded."""
    own = docs.where("text is not null").join(F.broadcast(ids), "doc_id", "left_semi")
    texts = own.groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).orderBy("doc_id")

    def made(batches):
        for batch in batches:
            rows = list(row_features(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], names=["f"])

    return [np.asarray(x.values) for x in texts.select("text").mapInArrow(made, "f array<long>").toArrow()["f"]]


def _others(docs: DataFrame, confirmed: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of the rows with each feature, and of rows, among all rows outside the held-out fold that are not confirmed.

    Each partition adds up its rows, so what reaches the driver are FEATURES numbers at most. The confirmed ids meet the
    documents without their texts' being moved while they are few, and by a shuffle beyond that.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).join(confirmed, "doc_id", "left_anti").select("text")

    def counted(batches):
        sums, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            rows = list(row_features(batch.column(0)))
            sums += np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=FEATURES)
            n += len(rows)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], n))], names=["slot", "n"])

    got = rows.mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(FEATURES + 1)
    sums[got["slot"].to_numpy()] = got["n"].to_numpy()
    return sums[:FEATURES], int(sums[-1])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> NonNegativePu:
    """A classifier from confirmed toxic rows and unlabelled text, of rows outside the held-out fold alone.

    The class prior is the toxic share among the labelled ids there, held within PRIORS. Which features count, and how much, comes from
    the confirmed sample and all other rows; the weights are fitted on a sample of ids in the order of a hash of the id: at most
    ``most_positive`` confirmed ones and ``most_unlabelled`` others, whose labels are not looked at. An id labelled both ways counts as toxic.
    """
    scratch = Scratch(docs.sparkSession, "toxic")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = scratch.keep(known)
    total, toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(PRIORS[1], max(PRIORS[0], toxic / total)) if total else 0.1
    order = F.xxhash64("doc_id")
    confirmed = scratch.keep(known.where("toxic = 1").select("doc_id"))
    sample = confirmed.orderBy(order, "doc_id").limit(most_positive)
    others = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id").distinct().orderBy(order, "doc_id").limit(most_unlabelled)
    model = NonNegativePu(prior).fit(_sample(docs, sample), _sample(docs, others), _others(docs, scratch.hinted(confirmed)))
    scratch.drop_all_but()
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text; further columns are ignored).

    score is the model's probability of the label 1 from the whole text's words alone, so equal texts tie; an empty or null text has that of no
    words. Without labels the weights stay near zero and every score is that of the prior. Rows may repeat; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, labels)
    weights, bias = spark.sparkContext.broadcast(model.weights), model.bias  # FEATURES numbers, whatever the input

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        z = np.array([weights.value[f].sum(dtype=np.float64) for f in row_features(text)]) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    out = docs.withColumn("score", score("text"))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out_quality(scored: pd.DataFrame, labels: pd.DataFrame) -> dict[str, float]:
    """Area under the ROC curve and accuracy on the held-out labelled rows."""
    x = scored[scored.held_out].merge(labels, on="doc_id")
    ranks, pos = x.score.rank(), x.toxic == 1
    n = pos.sum() * (~pos).sum()
    return {"auc": (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / n, "accuracy": (x.predicted == x.toxic).mean(), "rows": len(x)}
