"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text gives a few rates (capitals, symbols, repeated words and so on), smoothed
towards their mean over the good training rows so that a short text needs evidence to be
rejected, and transformed to steady their variance. Each class has a mean and a covariance that is
shrunk towards the pooled one and its diagonal; a text's score is the difference of the
two log-densities, from squared Mahalanobis lengths through the Cholesky factors, which
are computed once on the driver from sums over all training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, materialise, pieces, small_batches, tidied, word_spans, writers

CAPITAL, SMALL, DIGIT, SPACE, STOP, BANG, BAR, SYMBOL = range(8)
KINDS = np.full(256, SYMBOL)
KINDS[65:91], KINDS[97:123], KINDS[128:256], KINDS[48:58] = CAPITAL, SMALL, SMALL, DIGIT
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[ord(c) for c in ".,;:?'\"-()"]] = STOP
KINDS[ord("!")], KINDS[ord("|")] = BANG, BAR

COUNTS = ["capitals", "smalls", "digits", "spaces", "stops", "bangs", "bars", "symbols", "words", "repeats", "copies"]
#: Rate: count, what it is of. A rate is smoothed as if SMOOTH units of the mean rate were seen too.
RATES = {"capitals": "letters", "digits": "letters", "stops": "words", "bangs": "words", "bars": "words", "symbols": "words", "repeats": "words", "copies": "words", "letters": "words"}
SMOOTH = {"letters": 100.0, "words": 20.0}
FEATURES = list(RATES)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Counts of each whole text; a null text is empty. ``repeats`` are words equal to the one
    before, ``copies`` words equal to the one three before."""
    small_batches(docs)
    carry = carry or []

    def work(batches):
        for batch in batches:
            col = batch.column(0)
            buf, offsets = buffers(col)
            out = np.zeros((len(col), len(COUNTS)), np.int64)
            for lo, hi in pieces(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                part = buf[offsets[lo] : offsets[hi]]
                rows = hi - lo
                row = np.repeat(np.arange(rows), np.diff(at))
                out[lo:hi, :8] = np.bincount(row * 8 + KINDS[part], minlength=rows * 8).reshape(rows, 8)
                word_row, _, _, h = word_spans(part, at, lower=True)
                out[lo:hi, 8] = np.bincount(word_row, minlength=rows)
                for k, back in ((9, 1), (10, 3)):
                    same = (h[back:] == h[:-back]) & (word_row[back:] == word_row[:-back])
                    out[lo:hi, k] = np.bincount(word_row[back:][same], minlength=rows)
            yield pa.record_batch([*batch.columns[1:], *(pa.array(out[:, k]) for k in range(len(COUNTS)))], [*names, *COUNTS])

    names = ["doc_id", *carry]
    chosen = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("long").alias("doc_id"), *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(tidied(work), kinds + "".join(f", {c} long" for c in COUNTS))


def parts(name: str) -> tuple[Column, Column]:
    letters = F.col("capitals") + F.col("smalls")
    of = {"letters": letters, "words": F.col("words")}
    return (letters if name == "letters" else F.col(name)).cast("double"), of[RATES[name]].cast("double")


@dataclass
class Model:
    """``rates``: mean rates; for each class mean, inverse Cholesky factor and log-determinant."""

    rates: dict[str, float]
    means: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]
    log_prior: float

    def features(self) -> list[Column]:
        out = []
        for name in FEATURES:
            top, under = parts(name)
            more = SMOOTH[RATES[name]]
            rate = (top + F.lit(more * self.rates[name])) / (under + F.lit(more))
            out.append(F.log(rate + 1e-3) if name == "letters" else F.sqrt(rate))
        return out

    def score(self, x: list[str]) -> Column:
        """From 0 to 1; the log-density difference is tempered by the number of features."""
        diff = F.lit(self.log_prior)
        for sign, mean, inverse, log_det in ((1, self.means[1], self.inverse[1], self.log_det[1]), (-1, self.means[0], self.inverse[0], self.log_det[0])):
            length = F.lit(log_det)
            for i in range(len(x)):
                z = F.lit(0.0)
                for j in range(i + 1):
                    z = z + (F.col(x[j]) - float(mean[j])) * float(inverse[i, j])
                length = length + z * z
            diff = diff - length * (0.5 * sign)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), diff / len(x)))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null id is not one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.3, ridge: float = 0.5, floor: float = 1e-4) -> Model:
    """Learn from the rows of ``stats`` (a stored table) that have a label and are not held out.

    ``shrink`` mixes a class's covariance with the pooled one, whose off-diagonal part
    counts by ``1 - ridge``. All training rows count; only sums reach the driver. Labels
    other than 0 and 1 and null ids are left out; a doc_id with both labels counts as 0.
    A class without rows has the pooled shape around the pooled mean.
    """
    label = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("__label"))
    train = stats.where(~held_out()).join(label, "doc_id")
    sums = train.where("__label = 1").agg(*(F.sum(p).alias(f"{n}_{k}") for n in FEATURES for k, p in enumerate(parts(n)))).first()
    rates = {n: (sums[f"{n}_0"] or 0.0) / (sums[f"{n}_1"] or 1.0) for n in FEATURES}
    model = Model(rates, [], [], [], 0.0)
    d = len(FEATURES)
    xs = [f"x{i}" for i in range(d)]
    train = train.select("__label", *(c.alias(x) for c, x in zip(model.features(), xs, strict=True)))
    moments = [F.count("*").alias("n"), *(F.sum(x).alias(f"s_{x}") for x in xs), *(F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s_{i}_{j}") for i in range(d) for j in range(i + 1))]
    found = {r["__label"]: r for r in train.groupBy("__label").agg(*moments).collect()}  # two rows

    count, mean, scatter = [0, 0], [np.zeros(d), np.zeros(d)], [np.zeros((d, d)), np.zeros((d, d))]
    for c, r in found.items():
        n = count[c] = r["n"]
        mean[c] = np.array([r[f"s_{x}"] for x in xs]) / n
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                second[i, j] = second[j, i] = r[f"s_{i}_{j}"] / n
        scatter[c] = n * (second - np.outer(mean[c], mean[c]))
    total = sum(count)
    pooled = (scatter[0] + scatter[1]) / max(total, 1)
    pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + floor * np.eye(d)
    centre = (count[0] * mean[0] + count[1] * mean[1]) / max(total, 1)
    for c in (0, 1):
        own = scatter[c] / count[c] if count[c] > d else pooled
        factor = np.linalg.cholesky((1 - shrink) * own + shrink * pooled + floor * np.eye(d))
        model.means.append(mean[c] if count[c] else centre)
        model.inverse.append(np.linalg.inv(factor))
        model.log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    model.log_prior = float(np.log((count[1] + 1) / (count[0] + 1)))
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Score each document: doc_id, the ``carry`` columns, held_out, score, predicted.

    A null or empty text has the mean rates of good texts and gets their score. Each row is scored for
    itself: repeated rows, ties and null ids need no rule; an empty table gives an empty
    result. The counts are stored once in the shared folder and read for both passes.
    """
    carry = carry or []
    # carried columns travel as one struct, so that they may be called as counts are
    rows = docs.withColumn("__carry", F.struct(*(F.col(f"`{c}`").alias(c) for c in carry))) if carry else docs
    extra = ["__carry"] if carry else []
    stats = materialise(statistics(rows, id_col, text_col, extra), "quality", writers(docs.sparkSession, rows=docs.count()))
    model = fit(stats, labels)
    xs = [f"__x{i}" for i in range(len(FEATURES))]
    with_x = stats.select("doc_id", *extra, *(c.alias(x) for c, x in zip(model.features(), xs, strict=True)))
    scored = with_x.withColumn("score", model.score(xs))
    more = [F.col("__carry")[c].alias(c) for c in carry]
    return scored.select("doc_id", *more, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all its columns) that are not rejected.

    The model is fitted on stored counts; texts are counted again where they are filtered,
    so that they go through no shuffle.
    """
    model = fit(materialise(statistics(docs), "quality", writers(docs.sparkSession, rows=docs.count())), labels)
    xs = [f"__x{i}" for i in range(len(FEATURES))]
    rows = docs.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    scored = statistics(rows, carry=["__row"]).select("__row", *(c.alias(x) for c, x in zip(model.features(), xs, strict=True)))
    return scored.where(model.score(xs) >= threshold).select("__row.*")
