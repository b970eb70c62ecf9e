"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into full sequences and a shorter first piece. Pieces are dealt at random to
shards of about SHARD_ITEMS. Each shard is packed on several islands at once. An island's first packings are best fits of
the pieces in random orders; then it breeds: crossover injects well-filled bins of one parent whole into another, removes
bins that hold duplicates of the injected pieces, lets displaced pieces replace shorter ones of the bins that stay, and
puts the rest back by best fit, the longest first. Between epochs an island's best packings move to the next island. An
epoch ends early only where a packing is proven best: as few bins as the pieces' total length asks for. The best packing
of a shard stands, except that the pieces of its loosely filled bins go on to a later level with fewer shards, until one
shard is left; so the loss of cutting into shards is made good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Tokens of a sequence; the token after each document.
CAPACITY, END_OF_DOCUMENT = 2048, 0

#: Pieces of a shard; islands; epochs; packings on an island; children of an epoch; packings that move to the next
#: island; a bin is loose below this fill.
SHARD_ITEMS, ISLANDS, EPOCHS, PACKINGS, CHILDREN, ELITE, LOOSE = 3000, 2, 2, 6, 24, 2, 0.98


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenisers(vocabulary: str, ranks: str):
    """(fast, exact, marks): the ranks file gives the same ids as the vocabulary, several times as fast, for ordinary text.

    A text with one of the marks, the vocabulary's added tokens, is not ordinary.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
    exact = Tokenizer.from_file(vocabulary)
    return fast, exact, [t.content for t in exact.get_added_tokens_decoder().values()]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, piece, start, length, ids) for each piece of each document; ids: little-endian unsigned 32-bit numbers.

    A document is its text's token ids and END_OF_DOCUMENT; a null text counts as empty. Only documents longer than
    `capacity` are cut: all pieces but the first have that length. Texts with characters above U+2FFF, where Unicode
    versions may class letters differently, and texts with an added token of the vocabulary take the slower of the two
    tokenisers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, exact, marks = _tokenisers(public_tokenizer(f"{vocabulary}.json"), public_tokenizer(f"{vocabulary}.tiktoken"))
        for b in batches:
            ids_of, rows = b.column(0).to_pylist(), b.column(1)
            for at in range(0, b.num_rows, 256):
                doc, piece, start, length, ids = [], [], [], [], []
                for doc_id, text in zip(ids_of[at : at + 256], rows.slice(at, 256).to_pylist()):
                    text = text or ""
                    ordinary = (text.isascii() or max(text) < "　") and not any(m in text for m in marks)
                    x = np.array((fast.encode_ordinary(text) if ordinary else exact.encode(text, add_special_tokens=False).ids) + [END_OF_DOCUMENT], dtype="<u4")
                    first = len(x) if len(x) <= capacity else len(x) % capacity or capacity
                    cuts = [0, *range(first, len(x) + 1, capacity)]
                    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                        doc.append(doc_id), piece.append(k), start.append(lo), length.append(hi - lo), ids.append(x[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class Packing:
    """A packing of pieces, known by their lengths, into bins: a list of lists of pieces."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]]):
        self.lengths, self.capacity, self.bins = lengths, capacity, bins
        self.fills = [sum([lengths[i] for i in b]) for b in bins]

    def fitness(self) -> float:
        """Mean squared fill: fewer bins, and of as many, unevenly filled ones, are better."""
        return sum([f * f for f in self.fills]) / self.capacity**2 / max(1, len(self.fills))

    def rank(self) -> tuple[int, float]:
        return len(self.bins), -self.fitness()

    def best_fit(self, pieces: list[int]) -> None:
        """Adds pieces in their order, each to the fullest bin that has room."""
        bins, fills, lengths = self.bins, self.fills, self.lengths
        by_room, rooms = [[] for _ in range(self.capacity + 1)], 0  # bit r of rooms: some bin has room r
        for i, f in enumerate(fills):
            by_room[self.capacity - f].append(i)
            rooms |= 1 << (self.capacity - f)
        for p in pieces:
            n = lengths[p]
            if fit := rooms >> n:
                left = n + (fit & -fit).bit_length() - 1
                i = by_room[left].pop()
                if not by_room[left]:
                    rooms ^= 1 << left
                bins[i].append(p)
                fills[i] += n
            else:
                left, i = self.capacity, len(bins)
                bins.append([p]), fills.append(n)
            by_room[left - n].append(i)
            rooms |= 1 << (left - n)

    def replace(self, pieces: list[int]) -> list[int]:
        """Lets pieces take the places of shorter ones where they fill a bin better; gives what is left, shorter in sum."""
        by_length, some = [[] for _ in range(self.capacity + 1)], 0
        for p in pieces:
            by_length[self.lengths[p]].append(p)
            some |= 1 << self.lengths[p]
        for i, b in enumerate(self.bins):
            for j, p in enumerate(b):
                room, n = self.capacity - self.fills[i], self.lengths[p]
                if not room:
                    break
                longest = (some & ((1 << (n + room + 1)) - 1)).bit_length() - 1
                if longest > n:
                    b[j] = by_length[longest].pop()
                    if not by_length[longest]:
                        some ^= 1 << longest
                    by_length[n].append(p)
                    some |= 1 << n
                    self.fills[i] += longest - n
        return [p for same in reversed(by_length) for p in same]


def crossover(mother: Packing, father: Packing, rng: np.random.Generator) -> Packing:
    """A child: a random half of the father's well-filled bins, what of the mother's does not clash, the rest by best fit."""
    half, some = rng.random(len(father.bins)) < 0.5, rng.random(len(mother.bins)) < 0.3
    injected = [b for b, f, x in zip(father.bins, father.fills, half) if x and f >= LOOSE * father.capacity]
    taken = set().union(*injected)
    kept, displaced = [], []
    for b, fill, x in zip(mother.bins, mother.fills, some):
        if (fill >= LOOSE * mother.capacity or x) and taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [p for p in b if p not in taken]
    child = Packing(mother.lengths, mother.capacity, [list(b) for b in injected + kept])
    child.best_fit(child.replace(displaced))
    return child


def evolve(lengths: list[int], capacity: int, start: list[list[list[int]]], seed: int) -> tuple[list[Packing], int]:
    """(packings, best first; crossovers) after an epoch on one island that begins with the packings `start`."""
    rng = np.random.default_rng(seed)
    herd = [Packing(lengths, capacity, [list(b) for b in bins]) for bins in start[:PACKINGS]]
    least, children = -(-sum(lengths) // capacity), 0
    while len(herd) < PACKINGS and not any(len(p.bins) == least for p in herd):
        herd.append(Packing(lengths, capacity, []))
        herd[-1].best_fit(rng.permutation(len(lengths)).tolist())
    herd.sort(key=Packing.rank)
    while len(herd) > 1 and children < CHILDREN and len(herd[0].bins) > least:
        pick = rng.permutation(len(herd))[:2]
        herd[-1] = crossover(herd[pick[0]], herd[pick[1]], rng)
        herd.sort(key=Packing.rank)
        children += 1
    return herd, children


def _epoch(capacity: int, epoch: int):
    """An epoch of one island, whose rows are its pieces, once for each packing that it begins with (origin >= 0)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf.drop_duplicates("item").sort_values("item")
        place = {x: i for i, x in enumerate(items["item"].tolist())}
        starts = []
        for _, elite in pdf[pdf["origin"] >= 0].sort_values("item").groupby(["origin", "elite"]):
            bins = {}
            for x, b in zip(elite["item"].tolist(), elite["bin"].tolist()):
                bins.setdefault(b, []).append(place[x])
            starts.append(list(bins.values()))
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        lengths = items["length"].tolist()
        herd, children = evolve(lengths, capacity, starts, seed=(epoch * 1_000_003 + shard) * 64 + island)
        out = []
        for elite, packing in enumerate(herd[:ELITE]):
            number, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i, (b, f) in enumerate(zip(packing.bins, packing.fills)):
                number[b], fill[b] = i, f
            one = {"shard": shard, "island": island, "item": items["item"].to_numpy(), "length": lengths, "origin": island, "elite": elite}
            out.append(pd.DataFrame(one | {"bin": number, "fill": fill, "bins": len(packing.bins), "crossovers": children + int(pdf["crossovers"].max())}))
        return pd.concat(out)

    return run


SHARDED = "shard long, island int, item long, length long, origin int, elite int, bin long, fill long, bins long, crossovers long"


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence_id, offset) for `items` (item: unique long, length: 1 to capacity).

    A sequence's number is that of its smallest item; offsets in it are gapless from 0, by item. An item as long as a
    sequence fills one alone.
    """
    done = items.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), "length")
    open_ = materialise(items.where(F.col("length") < capacity).select("item", "length"), "open")
    rows, level = open_.count(), 0
    while rows:
        shards = max(1, -(-rows // SHARD_ITEMS))
        dealt = open_.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
        island = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
        herd = dealt.select("shard", island, "item", "length", F.lit(-1).alias("origin"), F.lit(0).alias("elite"), *[F.lit(0).cast("long").alias(x) for x in ("bin", "fill", "bins", "crossovers")])
        for epoch in range(EPOCHS):
            if epoch:  # the elite of each island also goes to the next
                herd = herd.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
            herd = herd.groupBy("shard", "island").applyInPandas(_epoch(capacity, level * EPOCHS + epoch), SHARDED)
        herd = materialise(herd.where("elite = 0"), f"packed{level}")
        best = herd.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best")).select("shard", "best.island")
        best = herd.join(best, ["shard", "island"])
        last = shards == 1
        stays = best if last else best.where(F.col("fill") >= LOOSE * capacity)
        number = stays.groupBy("shard", "bin").agg(F.min("item").alias("sequence_id"))
        done = done.union(stays.join(number, ["shard", "bin"]).select("item", "sequence_id", "length"))
        if last:
            break
        loose = materialise(best.where(F.col("fill") < LOOSE * capacity).select("item", "length"), "open")
        left = loose.count()
        if left == rows:  # nothing was well filled: such pieces do not pair up better in other company
            number = best.groupBy("shard", "bin").agg(F.min("item").alias("sequence_id"))
            done = done.union(best.join(number, ["shard", "bin"]).select("item", "sequence_id", "length"))
            break
        open_, rows, level = loose, left, level + 1
    inside = done.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<item:long,offset:long>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.concat(a["out"], F.array(F.struct(x["item"].alias("item"), a["at"].alias("offset")))).alias("out"))
    return inside.select("sequence_id", F.explode(F.aggregate("items", zero, step)["out"]).alias("i")).select("i.item", "sequence_id", "i.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of `docs` (doc_id, text).

    Every row is a document of its own, also where doc_id is null or repeated; null and empty texts are one token. Of
    packings that are equally good the first one bred stands. Other columns are ignored, whatever their names; an empty
    table gives an empty one.
    """
    pieces = token_pieces(docs, capacity, vocabulary).withColumn("ids_crc32", F.crc32("ids"))
    pieces = materialise((pieces if with_ids else pieces.drop("ids")).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack_items(pieces.select("item", "length"), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return pieces.join(placed, "item").select(columns)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
