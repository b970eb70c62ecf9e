"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the distinct shingles of its words. Two documents link when
``100 * intersection >= percent * union``. For sets of sizes r <= s that is a bound on their symmetric difference:
``diff <= (100 - percent) * (r + s) / (100 + percent)``.

Sets are dealt to size bands; a set goes to the band of its size and to that of the smallest size it can link with, so
two sets that can link meet in the band of the smaller. A band's feature domain is partitioned in two levels (a fixed
function of a shingle's hash): n1 parts, each cut into n2 pieces. In each part all subsets of n2 - k2 pieces are
enumerated, and the content of such a subset is a signature. A part in which two sets differ by d elements has at least
k2 + 1 - d signatures of theirs in common, so sets that differ by k in all share at least (k2 + 1) * n1 - k signatures.
n1 exceeds what one shared signature needs, and each set leaves out as many of its signatures as it can spare for its own
largest k: those with the fewest shingles that are not common in the corpus. The order is a function of a signature's
content, so the best of the shared signatures is left out by neither set, and no link is lost.

Sets that are equal are one class from the start. Classes with a signature in common are its bucket. Within a task one
row of a signature goes to the shuffle under it, the other rows of the task under a salted key, and these get the
bucket's centre by a join; so a bucket with a third of all rows does not fall to one task. Each class is tried against
the centre first. Pairs that may link although the centre does not bring them together are looked for only in buckets
that still mix components: pair by pair where a bucket has at most SMALL classes, by prefixes of the differences to the
centre where it has more (see apart_pairs), so a large bucket never spells out its pairs. Candidates are first held
against parity sketches, whose difference is a lower bound of the sets' own; what passes is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, sized_broadcast, table
from .textkit import U, Words, mix, shingle_hashes

#: A band holds sizes from L to below WIDTH * L.
WIDTH = 1.4

#: (n2, k2) that a band may choose from; signatures for each of the k + 1 that no scheme can do without, and besides.
SCHEMES, PER_DIFFERENCE, BESIDES = [(2, 1), (3, 1), (4, 1), (4, 2), (5, 2)], 1.6, 12

#: Rows sampled to find common shingles, the share of them that makes a shingle common, and how many are kept.
#: They only choose which signatures are left out; the result does not depend on them.
SAMPLE_ROWS, COMMON_SHARE, COMMON_MOST = 8_000, 0.001, 200_000

#: Signature rows that a task combines at a time; classes of a bucket that are tried pair by pair; least sketch bits.
FLUSH, SMALL, SKETCH = 1 << 20, 256, 128


def bands(percent: int, most: int = 2**31) -> np.ndarray:
    """Lower bounds of the size bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * WIDTH)))
    return np.array(out, dtype=np.int64)


def largest_difference(r: int, s: int, percent: int) -> int:
    """Of two sets of sizes r and s that link."""
    return (100 - percent) * (r + s) // (100 + percent)


@dataclass
class Plan:
    """Two-level partition of a band: n1 parts of n2 pieces; subsets: pieces of each subset that is enumerated."""

    n1: int
    n2: int
    k2: int
    subsets: np.ndarray

    def spare(self, k: int) -> int:
        """Signatures that a set can leave out which differs from those it links with by k at most."""
        return (self.k2 + 1) * self.n1 - k - 1


def band_plan(band: int, lows: np.ndarray, percent: int) -> Plan | None:
    """The scheme with the largest signatures that stays within the bound on their number; None if only equal sets link."""
    smallest, largest = int(lows[band]), int(lows[band + 1]) - 1
    k = largest_difference(largest, largest * 100 // percent, percent)
    if not k:
        return None
    best = None
    for n2, k2 in SCHEMES:
        n1 = k // (k2 + 1) + 1
        enough = lambda n1: (k2 + 1) * n1 - k - 1 >= ceil(0.1 * k) + 1.3 * n1 * comb(n2, k2) * exp(-smallest * (n2 - k2) / (n1 * n2))  # noqa: B023, E731
        while not enough(n1) and n1 < 2 * (k // (k2 + 1) + 1):
            n1 += 1
        kept = n1 * comb(n2, k2) - ((k2 + 1) * n1 - k - 1)
        if best is not None and kept > PER_DIFFERENCE * (k + 1) + BESIDES:
            continue
        share = (n2 - k2) / (n1 * n2)  # of the domain, in a signature
        if best is None or share > best[0]:
            best = share, n1, n2, k2
    _, n1, n2, k2 = best
    return Plan(n1, n2, k2, np.array(list(combinations(range(n2), n2 - k2)), dtype=np.int64))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


class Sets:
    """Per text the sorted distinct shingle hashes; runs in a task."""

    def __init__(self, k: int):
        self.k, self.words = k, Words()

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, words, _, bounds in self.words.of(column):
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield np.unique(shingle_hashes(words[a:b], self.k))


def digests(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s * U(3) + U(1)).sum(dtype=np.uint64)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def sketch_of(s: np.ndarray) -> bytes:
    """Parities of the counts of elements in as many bins as a power of two says, twice the size or more."""
    bits = max(SKETCH, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ U(0x2545F4914F6CDD1D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of `size` bytes from a larger one, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype="<u8").reshape(-1, size // 8), axis=0)


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(k)
        for b in batches:
            n, one, two, sketch = [], [], [], []
            for s in sets.of(b.column(1)):
                d = digests(s)
                n.append(len(s)), one.append(d[0]), two.append(d[1]), sketch.append(sketch_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64()), signed(np.array(one, dtype=np.uint64)), signed(np.array(two, dtype=np.uint64)), pa.array(sketch, pa.binary())],
                names=["doc_id", "digest", "length", "n_shingles", "one", "two", "sketch"],
            )

    return run


class Signer:
    """Signatures of sets; runs in a task."""

    def __init__(self, percent: int, common: np.ndarray):
        self.percent, self.common, self.lows, self.plans = percent, common, bands(percent), {}

    def band_of(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def of(self, s: np.ndarray) -> np.ndarray:
        n, percent = len(s), self.percent
        own, least = self.band_of(n), self.band_of(max(1, -(-percent * n // 100)))
        high, content = s >> U(32), mix(s + U(0x632BE59BD9B4E019))
        rare = np.ones(n, dtype=np.int64)
        if len(self.common):
            at = np.searchsorted(self.common, s)
            rare = (self.common[np.minimum(at, len(self.common) - 1)] != s).astype(np.int64)
        out = []
        for band in range(least, own + 1):
            if band not in self.plans:
                self.plans[band] = band_plan(band, self.lows, percent)
            if (plan := self.plans[band]) is None:
                continue
            pieces = plan.n1 * plan.n2
            piece = ((high * U(pieces)) >> U(32)).astype(np.int64)  # rises with s, so each piece is one run
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            total, novel = np.zeros(pieces, dtype=np.uint64), np.zeros(pieces, dtype=np.int64)
            total[piece[first]] = np.add.reduceat(content, first)
            novel[piece[first]] = np.add.reduceat(rare, first)
            total, novel = (sum(x.reshape(plan.n1, plan.n2)[:, column] for column in plan.subsets.T).ravel() for x in (total, novel))
            code = mix(total + mix(np.arange(len(total), dtype=np.uint64) + U(band << 40)))
            # the partners in this band: in its own, larger ones too; in a lower one, sets of that band
            partner = n * 100 // percent if band == own else int(self.lows[band + 1]) - 1
            keep = len(code) - max(0, plan.spare(largest_difference(n, partner, percent)))
            order = np.argsort((U(255) - np.minimum(novel, 255).astype(np.uint64)) << U(56) | code >> U(8), kind="stable")
            out.append(code[order[:keep]])
        return np.concatenate(out) if out else s[:0]


def combined(sig: np.ndarray, one: np.ndarray, salt: int) -> pa.RecordBatch:
    """Rows (key, sig, one, kind): of each signature one row under itself (kind 0, or 1 if others follow), the others
    under a salted key (kind 2)."""
    order = np.argsort(sig, kind="stable")
    again = np.concatenate(([False], sig[order[1:]] == sig[order[:-1]]))
    kind = np.empty(len(sig), dtype=np.int8)  # in the order of the sets, so that a set's rows stay together
    kind[order] = np.where(again, 2, np.concatenate((again[1:], [False])))
    again = kind == 2
    key = np.where(again, mix(sig + U(salt)), sig)
    bare = pa.array(sig.view(np.int64), mask=~again)  # elsewhere it is the key
    return pa.RecordBatch.from_arrays([signed(key), bare, signed(one), pa.array(kind)], names=["key", "sig", "one", "kind"])


def _signatures(k: int, percent: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, signer, seen, sig, one, held = Sets(k), Signer(percent, common), set(), [], [], 0
        salt = TaskContext.get().partitionId() + 1
        for b in batches:
            for s in sets.of(b.column(1)):
                if not len(s) or (d := digests(s)) in seen:  # a copy within this task adds nothing
                    continue
                seen.add(d)
                sig.append(signer.of(s)), one.append(np.full(len(sig[-1]), d[0], dtype=np.uint64))
                held += len(sig[-1])
                if held >= FLUSH:
                    yield combined(np.concatenate(sig), np.concatenate(one), salt)
                    sig, one, held = [], [], 0
        if held:
            yield combined(np.concatenate(sig), np.concatenate(one), salt)

    return run


def _arrays(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(k)
        for b in batches:
            rows = list(sets.of(b.column(1)))
            d = [digests(s) for s in rows]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in rows]))).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [signed(np.array([x[0] for x in d], dtype=np.uint64)), signed(np.array([x[1] for x in d], dtype=np.uint64)), pa.ListArray.from_arrays(pa.array(ends), signed(flat))],
                names=["one", "two", "items"],
            )

    return run


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that many of about SAMPLE_ROWS rows have, sorted; COMMON_MOST at most."""
    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sampled = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).dropDuplicates(["text"])
    need = max(8, int(COMMON_SHARE * min(rows, SAMPLE_ROWS)))
    found = (
        sampled.mapInArrow(_arrays(k), "one long, two long, items array<long>")
        .select(F.explode("items").alias("item")).groupBy("item").count()
        .where(F.col("count") >= need).orderBy(F.desc("count")).limit(COMMON_MOST)
    )
    return np.sort(found.select("item").toPandas()["item"].to_numpy(dtype=np.int64).view(np.uint64))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b: long): the smallest node that each reaches.

    Alternates large-star and small-star steps, each an aggregate and a join, until nothing changes; each pair of steps
    is written to the shared folder, and the result to `scratch`.
    """
    own = Scratch(edges.sparkSession)
    edges = own.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = own.keep(small.select("e.*").where("u <> v").distinct(), "edges")
        own.clear(but_last=1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    found = roots.select(F.col("u").alias("node"), "component").union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    found = scratch.keep(found, "groups")
    own.clear()
    return found


def _near(percent: int):
    """Of pairs (a, b, n, m, x, y) with sizes and sketches, those that the sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = [largest_difference(n, m, percent) for n, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            ok = []
            for k, x, y in zip(most, b.column(4), b.column(5)):
                x, y = x.as_buffer(), y.as_buffer()
                size = min(x.size, y.size)
                ok.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near_within(percent: int):
    """Of buckets (a list of at most SMALL of class_id, part, n, sketch), the pairs of unlike parts that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for bucket in b.column(0).to_pylist():
                ids, part, n = (np.array([m[f] for m in bucket]) for f in ("class_id", "part", "n_shingles"))
                size = min(len(m["sketch"]) for m in bucket)
                bits = np.stack([folded(m["sketch"], size) for m in bucket])
                i, j = np.triu_indices(len(bucket), 1)
                some = np.flatnonzero(part[i] != part[j])
                i, j = i[some], j[some]
                far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(far * (100 + percent) <= (100 - percent) * (n[i] + n[j]))
                a.append(np.minimum(ids[i[near]], ids[j[near]])), z.append(np.maximum(ids[i[near]], ids[j[near]]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(z), pa.int64())], names=["a", "b"])

    return run


def apart_pairs(opened: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of classes around one centre that may link although the centre does not bring them together.

    `opened`: centre, class_id, part (the class's component so far), x and y (the sets of centre and class).
    Say D(x) is what a class x and the centre c do not share. Then diff(x, y) = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so a
    link of x and y asks for an overlap of at least (|D(x)| + |D(y)| - k) / 2, where k is the most that a link's sizes
    allow. Say |D(x)| <= |D(y)|. That bounds the overlap from below for each side alone: for y by |D(y)| - k, for x by
    |D(x)| - k / 2, and where x links to c by half of |D(x)| plus the difference of sizes' share, as y does not link then
    (else both are together already). Two sets with such an overlap share one of their first elements in any fixed order
    (a prefix), and from the place of the first shared element enough must follow. Elements that c lacks come first:
    edits are seldom shared.
    """
    share = F.lit((100 - percent) / (100 + percent))
    sized = opened.withColumns({"n": F.size("x"), "m": F.size("y"), "same": F.size(F.array_intersect("x", "y"))})
    linked = 100 * F.col("same") >= percent * (F.col("n") + F.col("m") - F.col("same"))
    size = F.col("n") + F.col("m") - 2 * F.col("same")
    k = F.floor(share * (F.col("m") + F.col("m") * 100 / percent) + 1e-9)
    alone = F.greatest(F.lit(1), size - k)
    half = F.when(linked, F.ceil((size + share * (F.col("n") - F.col("m"))) / 2 - 1e-9)).otherwise(0)
    second = ~linked | (size > share * (F.col("n") + F.col("m") * percent / 100) - 1e-9)  # else those it may link with are farther from c
    apart = sized.withColumns({"linked": linked, "size": size, "second": second, "short": size - F.greatest(half, alone, size - F.floor(k / 2)) + 1, "long": size - alone + 1})
    first = F.concat(F.array_sort(F.array_except("y", "x")), F.array_sort(F.array_except("x", "y")))
    needed = F.when(F.col("second"), F.greatest("short", "long")).otherwise(F.col("short"))
    rows = apart.select("centre", "class_id", "part", "linked", "second", "m", "size", "short", "long", F.posexplode(F.slice(first, F.lit(1), needed.cast("int"))).alias("at", "item"))
    rows = scratch.keep(rows, "apart")
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("class_id", "part", "m", "size", "at")]
    x, y = rows.where("at < short").select("centre", "item", *named("x")), rows.where("second and at < long").select("centre", "item", *named("y"))
    most = F.floor(share * (F.col("x_m") + F.col("y_m")) + 1e-9)
    follow = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    may = (F.col("x_part") != F.col("y_part")) & (2 * follow >= F.col("x_size") + F.col("y_size") - most)
    sides = F.struct("x_size", "x_class_id") < F.struct("y_size", "y_class_id")
    met = x.join(y, (x["centre"] == y["centre"]) & (x["item"] == y["item"]) & may & sides)
    return met.select(F.least("x_class_id", "y_class_id").alias("a"), F.greatest("x_class_id", "y_class_id").alias("b")).distinct()


def row_key(prefix: str = "") -> list[Column]:
    """What tells rows apart: doc_id, and digest and length of the text. Rows that agree in all are copies of one row."""
    return [F.col("doc_id").cast("long").alias(f"{prefix}doc_id"), F.xxhash64("text").alias(f"{prefix}digest"), F.length("text").alias(f"{prefix}length")]


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, links) for each row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, null if all their doc_ids are; class_id names the rows with
    equal sets; links counts the class's links found to other classes on the way to the components. A text that is null
    or without words has an empty set, links with nothing and is its own component. Rows that repeat a doc_id are judged
    by their own texts. Other columns are ignored; an empty table gives an empty one.
    """
    return keyed_components(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", "class_id", "links")


def keyed_components(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """jaccard_components with digest and length of each row's text, and keep: the key of the component's row to keep.

    That is the smallest (no doc_id, doc_id, digest, length) of the component; null for a row with an empty set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select("doc_id", "text", *row_key()[1:])
    sized = materialise(keyed.mapInArrow(_sizes(shingle), "doc_id long, digest long, length int, n_shingles long, one long, two long, sketch binary"), "sizes")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "length")
    classes = materialise(
        sized.where("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min(key).alias("key"), F.first("sketch").alias("sketch"))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    buckets = buckets_of(docs.mapInArrow(_signatures(shingle, percent, common_shingles(docs, shingle)), "key long, sig long, one long, kind byte"), classes, scratch)
    sketches = classes.select("class_id", "n_shingles", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        """Of `pairs` (a, b), those that sizes and sketches do not rule out."""
        both = pairs
        for name, n, sketch in (("a", "n", "x"), ("b", "m", "y")):
            both = both.join(sketches.select(F.col("class_id").alias(name), F.col("n_shingles").alias(n), F.col("sketch").alias(sketch)), name)
        both = both.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b", "n", "m", "x", "y")
        return both.mapInArrow(_near(percent), "a long, b long")

    def with_sets(pairs: DataFrame, a: str, b: str) -> DataFrame:
        """`pairs` with x and y, the sets of classes `a` and `b`."""
        ids = pairs.select(F.explode(F.array(a, b)).alias("class_id")).distinct()
        needed = scratch.keep(ids.join(classes, "class_id").select("class_id", "rep", "one", "two"), "needed")
        texts = docs.join(sized_broadcast(needed.select("rep").distinct(), needed.count(), 40), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        held = texts.mapInArrow(_arrays(shingle), "one long, two long, items array<long>").join(needed, ["one", "two"]).select("class_id", "items").dropDuplicates(["class_id"])
        held = scratch.keep(held, "sets")
        left, right = held.select(F.col("class_id").alias(a), F.col("items").alias("x")), held.select(F.col("class_id").alias(b), F.col("items").alias("y"))
        return pairs.join(right, b).join(left, a)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        pairs, same = scratch.keep(near(pairs), "near"), F.size(F.array_intersect("x", "y"))
        return scratch.keep(with_sets(pairs, "a", "b").where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b"), name)

    around = buckets.where("centre <> class_id")
    first = linked(around.select(F.col("centre").alias("a"), F.col("class_id").alias("b")).distinct(), "links")
    group = components(first, scratch)
    parts = group.select(F.col("node").alias("class_id"), F.col("component").alias("part"))
    around = around.join(parts, "class_id", "left").withColumn("part", F.coalesce("part", "class_id"))
    # only a bucket that holds, its centre aside, more than one component
    mixed = around.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("sig")
    around = scratch.keep(around.join(mixed, "sig"), "mixed")
    few = around.where(F.col("n") <= SMALL + 1).join(sketches, "class_id")
    few = few.groupBy("sig").agg(F.collect_list(F.struct("class_id", "part", "n_shingles", "sketch")).alias("bucket")).select("bucket")
    rest = few.mapInArrow(_near_within(percent), "a long, b long")
    many = around.where(F.col("n") > SMALL + 1).select("centre", "class_id", "part").distinct()
    if not many.isEmpty():
        rest = rest.union(apart_pairs(with_sets(many, "centre", "class_id"), percent, scratch))
    second = linked(rest.distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "links")
    links, final = (first, group) if second.isEmpty() else (first.union(second), None)
    final = components(links, scratch) if final is None else final

    counted = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    placed = classes.join(final, classes["class_id"] == final["node"], "left").select("one", "two", "rep", "key", "class_id", F.coalesce("component", "class_id").alias("part"))
    smallest = placed.groupBy("part").agg(F.min("rep").alias("component_id"), F.min("key").alias("keep"))
    placed = placed.join(smallest, "part").join(counted, "class_id", "left").select("one", "two", "class_id", "component_id", "keep", F.coalesce("links", F.lit(0)).alias("links"))
    placed = materialise(placed, "placed")
    scratch.clear()
    return sized.drop("sketch").join(placed, ["one", "two"], "left").select(
        "doc_id", "digest", "length", "keep", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links")
    )


def buckets_of(signatures: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, n, class_id, centre): the classes of each signature that n > 1 have; of signatures with equal classes one stays.

    The centre is the class that shares most with others: the text that near copies were made from, rather than one of them.
    """
    at = Window.partitionBy("key")
    rows = signatures.withColumns({"low": F.min("one").over(at), "high": F.max("one").over(at), "last": F.max("kind").over(at)})
    rows = rows.where("kind = 2 or low < high or last > 0").select(F.coalesce("sig", "key").alias("sig"), "one")
    members = scratch.keep(rows.join(classes.select("one", "class_id"), "one").select("sig", "class_id").distinct(), "members")
    tag = lambda seed: F.bit_xor(F.xxhash64("class_id", F.lit(seed)))
    kept = members.groupBy("sig").agg(F.count("*").alias("n"), tag(1).alias("tag"), tag(2).alias("tag2")).where("n > 1").groupBy("n", "tag", "tag2").agg(F.min("sig").alias("sig"))
    buckets = scratch.keep(members.join(kept.select("sig", "n"), "sig"), "kept")
    degree = buckets.groupBy("class_id").agg(F.sum("n").alias("degree"))
    centre = buckets.join(degree, "class_id").groupBy("sig").agg(F.max(F.struct("degree", "class_id"))["class_id"].alias("centre"))
    return scratch.keep(buckets.join(centre, "sig"), "buckets")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, percent=90).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near copies: of each component exactly one row stays, one with the smallest doc_id.

    Rows are told apart by row_key, so a row goes for its own text only, also where doc_id is null (such a row stays only
    if no row of its component has one) or repeated. Rows without a shingle link with nothing and stay.
    """
    found = keyed_components(docs, shingle, percent).where("n_shingles > 0").groupBy("doc_id", "digest", "length", "keep").agg(F.count("*").alias("rows"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("digest") == F.col("keep.digest")) & (F.col("length") == F.col("keep.length"))
    judged = materialise(found.select("doc_id", "digest", "length", "rows", kept.alias("kept")).where("not kept or rows > 1"), "gone")
    counts = judged.agg(F.count_if(~F.col("kept")), F.count_if("kept")).first()
    gone = judged.where("not kept").select(F.col("doc_id").alias("g_doc_id"), F.col("digest").alias("g_digest"), F.col("length").alias("g_length"))
    same = _same_row()
    left = docs.join(sized_broadcast(gone, counts[0], 48), same, "left_anti").select(docs.columns)
    if not counts[1]:
        return left
    again = judged.where("kept").select(F.col("doc_id").alias("g_doc_id"), F.col("digest").alias("g_digest"), F.col("length").alias("g_length"))
    again = sized_broadcast(again, counts[1], 48)
    names = [f"g_{x}" for x in ("doc_id", "digest", "length")]
    once = left.join(again, same, "left_semi").select("*", *row_key("g_")).dropDuplicates(names).drop(*names)
    return left.join(again, same, "left_anti").unionByName(once).select(docs.columns)


def _same_row() -> Column:
    own = [F.col("doc_id").cast("long"), F.xxhash64("text"), F.length("text")]
    return own[0].eqNullSafe(F.col("g_doc_id")) & own[1].eqNullSafe(F.col("g_digest")) & own[2].eqNullSafe(F.col("g_length"))
