"""Quality scores from weak labels.

Overlapping heuristics vote good, bad or abstain on each text. Expectation-maximisation over the counts of all vote
patterns in the corpus estimates each heuristic's accuracy on good and on bad texts (as in the Dawid-Skene model), which
gives every pattern a posterior probability. A hashed linear scorer is then trained on a bounded sample of texts with
these posteriors as soft labels, and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .textkit import U, Words, column_bytes

#: Distinct texts that the scorer is trained on at most; hash buckets; passes; EM steps; share of good texts EM starts from.
TRAIN_ROWS, BUCKETS, EPOCHS, STEPS, PRIOR = 8_000, 1 << 18, 8, 200, 0.7

#: Heuristics: name, statistic, good below or above, bad beyond; a value between abstains.
RULES = [
    ("length", "words", (20, 40_000), (8, 100_000)),
    ("variety", "distinct", (0.35, 1.01), (0.2, 1.01)),
    ("word_length", "letters", (3.0, 9.0), (2.0, 12.0)),
    ("shouting", "upper", (-1, 0.15), (-1, 0.4)),
    ("marks", "marks", (-1, 0.08), (-1, 0.2)),
    ("digits", "digits", (-1, 0.05), (-1, 0.2)),
    ("repeats", "repeats", (-1, 0.05), (-1, 0.2)),
]
STATS = ["words", "distinct", "letters", "upper", "marks", "digits", "repeats"]


def statistics(words: np.ndarray, raw: np.ndarray) -> list[float]:
    """STATS of one text: words, share of distinct words, bytes a word, and shares of capitals, marks, digits, repeats."""
    n = max(1, len(words))
    kinds = np.bincount(_kind[raw], minlength=5)
    seen = max(1, kinds[1] + kinds[2])
    inked = max(1, kinds[1:].sum())
    repeats = float(np.count_nonzero(words[1:] == words[:-1])) / n
    return [float(len(words)), len(np.unique(words)) / n, float(kinds[1:].sum()) / n, kinds[2] / seen, kinds[4] / inked, kinds[3] / inked, repeats]


_b = np.arange(256)
#: By byte: 0 space, 1 letter, 2 capital, 3 digit, 4 other.
_kind = np.where((_b >= 97) & (_b < 123) | (_b >= 128), 1, np.where((_b >= 65) & (_b < 91), 2, np.where((_b >= 48) & (_b < 58), 3, np.where((_b == 32) | ((_b >= 9) & (_b <= 13)), 0, 4)))).astype(np.int64)


def votes(stats: np.ndarray) -> np.ndarray:
    """Rows by rules: 1 good, 0 bad, 2 abstain."""
    out = np.full((len(stats), len(RULES)), 2, dtype=np.int64)
    for i, (_, stat, good, bad) in enumerate(RULES):
        x = stats[:, STATS.index(stat)]
        out[(x >= good[0]) & (x <= good[1]), i] = 1
        out[(x < bad[0]) | (x > bad[1]), i] = 0
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(RULES)))


def em(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good by pattern, accuracies: rules by [bad, good]) from distinct patterns and their counts."""
    v = (patterns[:, None] // 3 ** np.arange(len(RULES))) % 3
    accuracy, prior = np.full((len(RULES), 2), 0.8), PRIOR
    post = np.full(len(v), prior)
    for _ in range(STEPS):
        good, bad = np.where(v == 1, accuracy[:, 1], 1 - accuracy[:, 1]), np.where(v == 0, accuracy[:, 0], 1 - accuracy[:, 0])
        said = v != 2
        up = np.log(prior) + np.where(said, np.log(good), 0).sum(axis=1)
        down = np.log(1 - prior) + np.where(said, np.log(bad), 0).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(down - up, -60, 60)))
        w1, w0 = counts * new, counts * (1 - new)
        prior = float(np.clip(w1.sum() / counts.sum(), 0.02, 0.98))
        right = lambda w, k: (((v == k) * w[:, None]).sum(axis=0) + 2) / ((said * w[:, None]).sum(axis=0) + 2.5)
        accuracy = np.clip(np.stack([right(w0, 0), right(w1, 1)], axis=1), 0.05, 0.99)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, accuracy


def term_ids(words: np.ndarray, stats: list[float]) -> np.ndarray:
    """Buckets of a text's distinct words and of its statistics in steps."""
    steps = [int(np.log2(stats[0] + 1)), *[int(20 * min(x, 1.5)) for x in (stats[1], stats[2] / 12, *stats[3:])]]
    own = np.array([(i * 1_000_003 + s * 7919 + 12345) % BUCKETS for i, s in enumerate(steps)], dtype=np.int64)
    return np.unique(np.concatenate((own, (words >> U(46)).astype(np.int64))))


def measured(column: pa.Array) -> Iterator[tuple[np.ndarray, list[float]]]:
    data, offsets = column_bytes(column)
    for first, words, _, bounds in Words().of(column):
        for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
            yield words[a:z], statistics(words[a:z], data[offsets[first + i] : offsets[first + i + 1]])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = pattern_of(votes(np.array([s for _, s in measured(b.column(0))]).reshape(-1, len(STATS))))
        yield pa.RecordBatch.from_arrays([pa.array(got)], names=["pattern"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for b in batches:
        first = []
        for i, h in enumerate(b.column(1).to_pylist()):
            if h not in seen:  # a copy within this task adds nothing
                seen.add(h), first.append(i)
        b = b.take(pa.array(first, pa.int64()))
        rows = list(measured(b.column(0)))
        got = pattern_of(votes(np.array([s for _, s in rows]).reshape(-1, len(STATS))))
        terms = pa.array([term_ids(w, s).astype(np.int32) for w, s in rows], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(got), terms], names=["digest", "copies", "pattern", "terms"])


def sample(docs: DataFrame) -> DataFrame:
    """(digest, copies, pattern, terms) for TRAIN_ROWS distinct texts of `docs` (text) at most, drawn by their digests."""
    docs = docs.select("text", F.xxhash64("text").alias("digest"))
    drawn = docs.groupBy("digest").agg(F.count("*").alias("copies")).orderBy(F.xxhash64("digest"), "digest").limit(TRAIN_ROWS)
    taken = docs.join(F.broadcast(drawn), "digest").select("text", "digest", "copies")
    return taken.mapInArrow(_features, "digest long, copies long, pattern long, terms array<int>").dropDuplicates(["digest"])


def train(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, float, dict[int, float]]:
    """(weights, bias, posterior by pattern). Patterns are counted over all rows of `docs`; there are 3 ** 7 at most.

    The scorer learns from distinct texts, each weighted by its copies; a null text counts as empty.
    """
    docs = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = docs.mapInArrow(_patterns, "pattern long").groupBy("pattern").count().toArrow()
    weight = np.zeros(BUCKETS)
    if not found.num_rows:
        return weight, 0.0, {}
    patterns, counts = found["pattern"].to_numpy(), found["count"].to_numpy()
    post, _ = em(patterns, counts)
    by = dict(zip(patterns.tolist(), post.tolist()))
    got = sample(docs).toArrow().sort_by("digest")
    y, copies = np.array([by[p] for p in got["pattern"].to_pylist()]), got["copies"].to_numpy().astype(np.float64)
    lists = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, size = lists.flatten().to_numpy().astype(np.int64), np.asarray(lists.value_lengths(), dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    rng, sums, bias = np.random.default_rng(5), np.full(BUCKETS, 1e-4), 0.0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            f = np.concatenate([flat[start[i] : start[i + 1]] for i in at]) if len(at) else flat[:0]
            local, scale = np.repeat(np.arange(len(at)), size[at]), 1 / np.sqrt(np.maximum(1, size[at]))
            share = copies[at] / max(1, copies[at].sum())
            error = (1 / (1 + np.exp(-np.clip(bias + np.bincount(local, weight[f], len(at)) * scale, -30, 30))) - y[at]) * share
            ids, back = np.unique(f, return_inverse=True)
            grad = np.bincount(back, (error * scale)[local], len(ids))
            sums[ids] += grad**2
            weight[ids] -= 0.3 * grad / np.sqrt(sums[ids])
            bias -= 0.1 * error.sum()
    return weight, float(bias), by


def score_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with weak_label (the posterior that its votes give) and quality_score, both 0 to 1.

    A null text counts as empty; empty texts are scored like the rest. An empty table gives an empty one. Columns with
    those names are replaced; rows and the other columns stay, repeated rows too.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text))
    docs = docs.drop("weak_label", "quality_score")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, by = model.value
        for b in batches:
            score, stats = [], []
            for words, s in measured(b.column(1)):
                ids = term_ids(words, s)
                score.append(1 / (1 + np.exp(-np.clip(bias + weight[ids].sum() / np.sqrt(len(ids)), -30, 30))))
                stats.append(s)
            weak = [by.get(p, PRIOR) for p in pattern_of(votes(np.array(stats).reshape(-1, len(STATS)))).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak, pa.float64()), pa.array(score, pa.float64())], names=["doc", "weak_label", "quality_score"])

    schema = T.StructType([rows.schema["doc"], T.StructField("weak_label", T.DoubleType()), T.StructField("quality_score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("doc.*", "weak_label", "quality_score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "weak_label", "quality_score")
