"""Benchmark decontamination: which benchmark items stand inside which documents.

An item is inside a document if the document holds at least `percent` of the item's distinct shingles of words. The search
is a size-partitioned MinHash containment index over documents, queried by items, with exact verification:

1. A document's domain is its shingles that occur in any item at all: containment in the whole text and in that domain
   are the same number, and the domain of a long document with one leaked item is about as small as the item.
2. Domains are partitioned by size. A partition's largest size turns the containment threshold of an item into a Jaccard
   threshold, and with that the number of MinHash rows in a band; MinHash bands that agree give candidates.
3. Where even bands of one row could miss more than MISS of the pairs (domains far larger than the item), candidates
   are all documents that share one of as many of the item's shingles as a contained item cannot all lack, those that
   the fewest domains hold, so a passage that many documents share brings no item to all of them.
4. Each candidate is verified on the exact shingles.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, ascii_lower, materialise, sized_broadcast, table

#: MinHash values of a set, and the accepted chance that bands miss a pair.
HASHES, MISS = 64, 1e-6

#: Partition of the largest possible array.
LAST_PART = 62

#: Rows in a band that a partition may use.
BAND_ROWS = (2, 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingles(df: DataFrame, keep: list[Column], text: str, k: int) -> DataFrame:
    """`keep` and shingle (64-bit hash) for each run of `k` words; of fewer words, the whole sequence."""
    words = df.select(*keep, words_of(F.col(text)).alias("words"))
    n = F.size("words")
    runs = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(n - (k - 1), F.lit(1))).alias(f"w{i}") for i in range(k)])
    inner = words.where(n > 0).select(*words.columns[:-1], F.inline(runs).alias(*[f"w{i}" for i in range(k)]))
    return inner.select(*words.columns[:-1], F.xxhash64(*[f"w{i}" for i in range(k)]).alias("shingle"))


def part_of(size: Column) -> Column:
    """Size partition: two for each power of two."""
    return F.floor(2 * F.log2(size.cast("double"))).cast("int")


def minhash(values: Column) -> Column:
    """HASHES values; the seed is hashed with each element."""

    def one(seed: int) -> Column:
        return F.array_min(F.transform(values, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*[one(seed) for seed in range(HASHES)])


def band_keys(part: Column, sketch: str, rows: int) -> Column:
    bands = [F.xxhash64(part, F.lit(rows), F.lit(b), *[F.element_at(sketch, b * rows + i + 1) for i in range(rows)]) for b in range(HASHES // rows)]
    return F.array(*bands)


def find_contained(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) for each pair with ``100 * n_shared >= percent * n_item``.

    `docs`: doc_id, text; `items`: item_id, text. Null texts and texts without words hold no shingle and are in no
    pair, as document or item. Rows that repeat an id are judged by their own texts, and equal results of theirs are one
    row. Ids may be null. Other columns are ignored; an empty table gives an empty one. The whole text counts. An item of
    fewer words than a shingle is one shingle, its whole sequence, and so is only in documents of just these words.
    """
    targets = materialise(
        shingles(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), [F.col("item"), F.col("item_id")], "text", shingle)
        .groupBy("item", "item_id").agg(F.collect_set("shingle").alias("asked")).withColumn("n_item", F.size("asked")).where("n_item > 0"),
        "items",
    )
    n_items, n_asked = targets.agg(F.count("*"), F.coalesce(F.sum("n_item"), F.lit(0))).first()
    universe = targets.select(F.explode("asked").alias("shingle")).distinct()
    rows = shingles(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), [F.col("row"), F.col("doc_id")], "text", shingle)
    hits = rows.join(sized_broadcast(universe, n_asked, 40), "shingle", "left_semi")
    size = F.size("held")
    domains = materialise(
        hits.groupBy("row", "doc_id").agg(F.collect_set("shingle").alias("held"))
        .withColumns({"part": part_of(size), "sketch": minhash(F.col("held"))}),
        "domains",
    )

    held_by = domains.select(F.explode("held").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = targets.select("item", F.explode("asked").alias("shingle")).join(held_by, "shingle", "left").groupBy("item")
    ranked = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle"))), lambda x: x["shingle"]).alias("rarest"))
    parts = domains.groupBy("part").agg(F.max(size).alias("largest"))
    least = F.ceil(F.col("n_item") * percent / 100)  # of a domain that holds the item
    asked = targets.join(ranked, "item").withColumn("sketch", minhash(F.col("asked"))).withColumn("part", F.explode(F.sequence(part_of(least), F.lit(LAST_PART))))
    asked = asked.join(F.broadcast(parts), "part")
    t = percent / 100
    jaccard = t * F.col("n_item") / (F.col("n_item") + F.col("largest") - t * F.col("n_item"))
    miss = {r: F.pow(1 - F.pow(jaccard, r), HASHES // r) for r in BAND_ROWS}
    plan = F.lit(0)
    for r in reversed(BAND_ROWS):
        plan = F.when(miss[r] <= MISS, r).otherwise(plan)
    asked = asked.withColumn("plan", plan)
    spare = (F.col("n_item") * (100 - percent) / 100).cast("int") + 1  # of so many shingles a contained item has one
    every = lambda values, part: F.transform(values, lambda x: F.xxhash64(part, F.lit(0), x))
    keys = F.when(F.col("plan") == 0, every(F.slice("rarest", 1, spare), F.col("part")))
    for r in BAND_ROWS:
        keys = keys.when(F.col("plan") == r, band_keys(F.col("part"), "sketch", r))
    asked = materialise(asked.select("item", "part", "plan", F.explode(keys).alias("key")), "asked")
    used = asked.select("part", "plan").distinct().groupBy("part").agg(F.collect_set("plan").alias("plans"))
    offered = domains.join(F.broadcast(used), "part")
    pick = lambda r, made: F.when(F.array_contains("plans", r), made).otherwise(F.array().cast("array<bigint>"))
    keys = F.concat(pick(0, every(F.col("held"), F.col("part"))), *[pick(r, band_keys(F.col("part"), "sketch", r)) for r in BAND_ROWS])
    offered = offered.select("row", F.explode(keys).alias("key"))
    candidates = offered.join(sized_broadcast(asked.select("item", "key"), asked.count(), 40), "key").select("row", "item").distinct()

    shared = F.size(F.array_intersect("held", "asked"))
    small = sized_broadcast(targets, 8 * n_items + n_asked, 8)
    found = candidates.join(domains.select("row", "doc_id", "held"), "row").join(small, "item").withColumn("n_shared", shared)
    return found.where(100 * F.col("n_shared") >= percent * F.col("n_item")).select("doc_id", "item_id", "n_item", "n_shared").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that hold no item; rows with a null doc_id are judged by their own text like the rest.

    Rows that repeat the doc_id of a row that holds an item go only if their own text holds one.
    """
    row = F.struct("doc_id", F.xxhash64("text").alias("digest"), F.length("text").alias("length"))
    found = materialise(find_contained(docs.select(row.alias("doc_id"), "text"), items, shingle, percent).select("doc_id").distinct(), "leaks")
    gone = sized_broadcast(found.select(F.col("doc_id.doc_id").alias("g0"), F.col("doc_id.digest").alias("g1"), F.col("doc_id.length").alias("g2")), found.count(), 48)
    same = F.col("doc_id").eqNullSafe(F.col("g0")) & F.xxhash64("text").eqNullSafe(F.col("g1")) & F.length("text").eqNullSafe(F.col("g2"))
    return docs.join(gone, same, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_shingles(source: str, key: str, k: int = 5) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {k - 1}], ' ') AS shingle FROM (
      SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - {k - 1}, 1))) AS i FROM (
        SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}'), lambda x: x <> '') AS w
        FROM {source}) WHERE len(w) > 0)"""


OP8_SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}), b AS ({_sql_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared
FROM d JOIN b USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
