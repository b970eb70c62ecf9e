"""Toxicity scores by a factorization machine over hashed terms.

A text's features are the distinct hashes of its words and of their beginnings (4 and 5 bytes, so inflected insults share
a feature). The machine scores bias + sum of weights + pairwise products of factor vectors, so a pair of terms can weigh
more or less than both alone. It is trained on a bounded sample of labelled rows and sent to the tasks as a table of at
most FEATURES rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textkit import U, Words

#: Labelled texts that the machine is trained on at most; hash buckets; features kept; factors; passes over the sample.
TRAIN_ROWS, BUCKETS, FEATURES, FACTORS, EPOCHS = 12_000, 1 << 20, 2048, 4, 12

PREFIXES = (4, 5)


def term_ids(words: np.ndarray, prefixes: list[np.ndarray]) -> np.ndarray:
    """Bucket of each word and of each of its prefixes."""
    parts = [words, *[p ^ U(0xA5A5A5A5 + i) for i, p in enumerate(prefixes)]]
    return np.stack([(p >> U(44)).astype(np.int64) for p in parts], axis=1)


@dataclass
class Machine:
    """bucket: index of each hash bucket's feature, or -1; weights and factors by feature."""

    bucket: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """For `n` texts with distinct (row, feature) pairs."""
        out = np.full(n, self.bias) + np.bincount(rows, self.weight[features], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[features, f]
            out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for first, words, prefixes, bounds in Words(True, PREFIXES).of(column):
            n = len(bounds) - 1
            known = self.bucket[term_ids(words, prefixes)]
            at, _ = hit = np.nonzero(known >= 0)
            rows = np.searchsorted(bounds, at, side="right") - 1
            pairs = np.unique(rows * len(self.weight) + known[hit])
            out[first : first + n] = self.logits(pairs // len(self.weight), pairs % len(self.weight), n)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for b in batches:
        first = []
        for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if key not in seen:  # a copy within this task adds nothing
                seen.add(key), first.append(i)
        b, terms = b.take(pa.array(first, pa.int64())), []
        for _, words, prefixes, bounds in Words(True, PREFIXES).of(b.column(0)):
            ids = term_ids(words, prefixes)
            terms += [np.unique(ids[a:z]).astype(np.int32) for a, z in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(terms, pa.list_(pa.int32()))], names=["digest", "label", "terms"])


def sample(labelled: DataFrame) -> DataFrame:
    """(digest, label, terms) for TRAIN_ROWS distinct pairs of text and label at most, drawn by a hash; copies are one."""
    labelled = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "label").withColumn("digest", F.xxhash64("text"))
    drawn = labelled.select("digest", "label").distinct().orderBy(F.xxhash64("digest"), "digest", "label").limit(TRAIN_ROWS)
    taken = labelled.join(F.broadcast(drawn), ["digest", "label"]).select("text", "digest", "label")
    return taken.mapInArrow(_terms, "digest long, label int, terms array<int>").dropDuplicates(["digest", "label"])


def train(labelled: DataFrame, seed: int = 7) -> Machine:
    """A machine from `labelled` (text, label 0 or 1). Rows with a null label are left out; a null text counts as empty.

    It learns from a `sample`. Without rows of both labels the machine scores every text alike, by the share of label 1
    (0.5 without rows). Of terms that tell equally much the lower bucket comes first.
    """
    labelled = labelled.dropna(subset=["label"]).select("text", F.col("label").cast("int").alias("label"))
    got = sample(labelled).toArrow().sort_by([("digest", "ascending"), ("label", "ascending")])
    y = got["label"].to_numpy().astype(np.float64)
    lists = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.asarray(lists.value_lengths(), dtype=np.int64)) if len(y) else np.zeros(0, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    machine = Machine(np.full(BUCKETS, -1, dtype=np.int32), float(np.log(prior / (1 - prior))), np.zeros(1), np.zeros((1, FACTORS)))
    if not len(y) or y.min() == y.max():
        return machine

    # features: buckets whose presence tells most of the label, by the likelihood-ratio statistic
    n, n1 = np.bincount(flat, minlength=BUCKETS).astype(float), np.bincount(flat, y[row], minlength=BUCKETS)
    term = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    total, ones = len(y), y.sum()
    gain = 2 * (term(n1, n * ones / total) + term(n - n1, n * (total - ones) / total) + term(ones - n1, (total - n) * ones / total) + term(total - ones - n + n1, (total - n) * (total - ones) / total))
    kept = np.argsort(-np.where(n >= 4, gain, 0), kind="stable")[:FEATURES]
    kept = np.sort(kept[(gain[kept] > 12) & (n[kept] >= 4)])
    if not len(kept):
        return machine
    machine.bucket[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    machine.weight, machine.factor = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS))
    feature = machine.bucket[flat]
    row, feature = row[feature >= 0], feature[feature >= 0].astype(np.int64)
    start = np.searchsorted(row, np.arange(total + 1))
    sums = [np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6)]
    bias_sum, rate, decay = 1e-6, 0.3, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(total)
        for at in range(0, total, 64):
            rows = np.sort(order[at : at + 64])
            size = start[rows + 1] - start[rows]
            local = np.repeat(np.arange(len(rows)), size)
            f = feature[np.repeat(start[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            error = 1 / (1 + np.exp(-np.clip(machine.logits(local, f, len(rows)), -30, 30))) - y[rows]
            g = error.mean()
            bias_sum += g * g
            machine.bias -= rate * g / bias_sum**0.5
            grad = np.bincount(f, error[local], len(kept)) / len(rows) + decay * machine.weight
            sums[0] += grad * grad
            machine.weight -= rate * grad / np.sqrt(sums[0])
            for k in range(FACTORS):
                v = machine.factor[:, k]
                whole = np.bincount(local, v[f], len(rows))
                grad = np.bincount(f, error[local] * (whole[local] - v[f]), len(kept)) / len(rows) + decay * v
                sums[1][:, k] += grad * grad
                machine.factor[:, k] -= 0.1 * rate * grad / np.sqrt(sums[1][:, k])
    return machine


def score_texts(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """`docs` with columns score (0 to 1) and predicted (1 if score >= 0.5).

    A null text scores as an empty one, by the machine's bias. Columns with those names are replaced; rows and the other
    columns stay, repeated rows too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.score(b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and labels of the rows that may be learned from: crc32 of doc_id as text, modulo 5, is not 0."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    labels = labels.where(learn).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    taken = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * TRAIN_ROWS)
    return docs.join(F.broadcast(taken), "doc_id").select("text", "label")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with held_out, score and predicted; learns from `labels` (doc_id, toxic) as _labelled says.

    Empty tables of labels give a machine without features, empty `docs` an empty table.
    """
    machine = train(_labelled(docs.select("doc_id", "text"), labels))
    return score_texts(docs, machine).withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with their columns; null and empty texts are judged as empty ones."""
    machine = train(_labelled(docs.select("doc_id", "text"), labels))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    return score_texts(kept, machine).where("predicted = 0").select("doc.*")
