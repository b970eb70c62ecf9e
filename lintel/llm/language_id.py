"""Language identification by bit-sliced Bloom filters of n-grams.

All languages share one filter: a slot holds one bit for each language, in as many words as they need, so a look-up of an n-gram (the AND of its slots)
gives the set of languages that have it. A text's score for a language is the share of its n-grams that the filter gives
to the language, corrected for the language's false-positive rate. N-grams are four bytes of lower-cased text; what is
not a letter counts as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized_broadcast, table
from .textkit import CHUNK, column_bytes

#: Distinct texts of each language that the filter is built from, at most; slots; look-ups of an n-gram; languages of a mask word.
TRAIN_ROWS, SLOTS, PROBES, WORD = 1500, 1 << 20, 3, 64

#: An n-gram belongs to a language if its rate there is at least this share of its highest rate, over LEAST rows.
SHARE, LEAST = 0.2, 3

_multiplier = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)[:PROBES]
_letter = np.arange(256)
_byte = np.where((_letter >= 97) & (_letter < 123) | (_letter >= 128), _letter, np.where((_letter >= 65) & (_letter < 91), _letter + 32, 32)).astype(np.uint8)


def grams(text: np.ndarray) -> np.ndarray:
    """Four-byte n-grams of one text's bytes, as 32-bit numbers; those of spaces alone are left out."""
    b = np.concatenate(([32], _byte[text], [32])).astype(np.uint32)
    if len(b) < 4:
        b = np.concatenate((b, [32] * (4 - len(b)))).astype(np.uint32)
    g = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    return g[g != 0x20202020]


def pieces(text: np.ndarray) -> Iterator[np.ndarray]:
    """N-grams of the whole text in parts of bounded size; parts share three bytes, so each n-gram comes once."""
    for at in range(0, max(1, len(text)), CHUNK):
        part = text[max(0, at - 3) : at + CHUNK]
        g = grams(part)
        yield g[1:] if at and len(g) else g


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # word by slot: bit masks of WORD languages each
    false: np.ndarray  # false-positive rate of each language

    def shares(self, text: np.ndarray) -> np.ndarray:
        """Corrected share of the text's n-grams by language."""
        found, total, n = np.zeros(len(self.languages)), 0, len(self.languages)
        for g in pieces(text):
            wide = g.astype(np.uint64)
            at = [((wide * m) >> np.uint64(13)) & np.uint64(SLOTS - 1) for m in _multiplier]
            total += len(g)
            for k, word in enumerate(self.slots):
                mask = word[at[0]]
                for x in at[1:]:
                    mask = mask & word[x]
                low, high = k * WORD, min(n, (k + 1) * WORD)
                if n <= 8:
                    count = np.bincount(mask, minlength=1 << n)
                    found += [count[(np.arange(len(count)) >> i & 1) > 0].sum() for i in range(n)]
                elif mask.any():
                    found[low:high] += [np.count_nonzero(mask >> np.uint64(i) & np.uint64(1)) for i in range(high - low)]
        return np.clip((found / max(1, total) - self.false) / (1 - self.false), 0, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = column_bytes(b.column(0))
        langs, ids = [], []
        for i, lang in enumerate(b.column(1).to_pylist()):
            g = np.unique(np.concatenate(list(pieces(data[offsets[i] : offsets[i + 1]]))))
            langs.append(np.full(len(g), lang, dtype=object)), ids.append(g.astype(np.int64))
        if langs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(ids))], names=["lang", "gram"])


def drawn(labelled: DataFrame, languages: int) -> DataFrame:
    """(text, lang) for TRAIN_ROWS distinct texts of each language at most."""
    labelled = labelled.select("text", "lang", F.xxhash64("text").alias("digest"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("digest"), "digest")
    kept = labelled.select("lang", "digest").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= TRAIN_ROWS).select("lang", "digest")
    taken = labelled.join(sized_broadcast(kept, languages * TRAIN_ROWS, 64), ["lang", "digest"])
    return taken.dropDuplicates(["lang", "digest"]).select("text", "lang")


def build(labelled: DataFrame) -> Filter | None:
    """A filter from `labelled` (text, lang; neither null), or None without rows.

    At most TRAIN_ROWS distinct texts of each language are taken, by a hash. Every language counts.
    """
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return None
    languages = sorted(rows, key=lambda x: (-rows[x], x))
    sample = drawn(labelled, len(languages))
    taken = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    least = F.create_map(*[F.lit(x) for name in languages for x in (name, min(LEAST, 1 + taken.get(name, 0) // 20))])
    got = sample.mapInArrow(_counts, "lang string, gram long").groupBy("gram", "lang").count().where(F.col("count") >= least[F.col("lang")]).toArrow()
    index = {lang: i for i, lang in enumerate(languages)}
    gram, at = np.unique(got["gram"].to_numpy().astype(np.uint64), return_inverse=True)
    lang = np.array([index[x] for x in got["lang"].to_pylist()], dtype=np.int64)
    rate = got["count"].to_numpy() / np.array([max(1, taken.get(x, 0)) for x in languages])[lang]
    highest = np.zeros(len(gram))
    np.maximum.at(highest, at, rate)
    member = rate >= np.maximum(SHARE * highest[at], 1e-12)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((-(-len(languages) // WORD), SLOTS), dtype=kind)
    fill = np.zeros(len(languages))
    for i in range(len(languages)):
        g, bit = gram[at[member & (lang == i)]], kind(1 << i % WORD)
        for m in _multiplier:
            place = ((g * m) >> np.uint64(13)) & np.uint64(SLOTS - 1)
            slots[i // WORD, place] |= bit
        fill[i] = np.count_nonzero(slots[i // WORD] & bit) / SLOTS
    return Filter(languages, slots, fill**PROBES)


def identify(docs: DataFrame, model: Filter | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (the share of the best language among all, 0 to 1).

    `und` with score 0 where the text is null or has no letter, or without a model. Where no n-gram is known, or at a
    tie, the language with more learned rows comes first (of as many, the lesser name). Columns with those names are
    replaced; rows and the others stay. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).alias("text"), lettered.alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, offsets = column_bytes(b.column(1))
            best, score = [], []
            for i, letters in enumerate(b.column(2).to_pylist()):
                if model is None or not letters:
                    best.append("und"), score.append(0.0)
                    continue
                s = model.shares(data[offsets[i] : offsets[i + 1]])
                best.append(model.languages[int(s.argmax())])
                score.append(float(s.max() / s.sum()) if s.sum() > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc", "lang_pred", "score"])

    schema = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("doc.*", "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = build(docs.where(~held).select("text", "lang").dropna())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
