"""Document, search and key-value constructs on DataFrames, where plain SQL is not the natural form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.sources.tables import load


def mongo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$lookup: each region with its nations' keys; no match gives an empty array."""
    nations = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    found = load(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return found.select("r_regionkey", F.array_join(F.coalesce(F.col("keys").cast("array<string>"), F.array().cast("array<string>")), ",").alias("keys"))


def mongo_unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$unwind of an array made of a name's words."""
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


def mongo_addfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id").withColumns({"even": F.col("event_id") % 2 == 0, "next": F.col("event_id") + 1})


def mongo_bucketauto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$bucketAuto: four buckets of equal count by key, from the count of each key rather than a sort of all rows."""
    sizes = load(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    placed = sizes.withColumns({"upto": F.sum("n").over(Window.orderBy("p_size")), "total": F.sum("n").over(Window.partitionBy())})
    bucket = F.least(F.lit(3), F.floor((F.col("upto") - 1) * 4 / F.col("total"))).cast("int")
    return placed.groupBy(bucket.alias("bucket")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.sum("n").alias("n"))


def mongo_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$facet: two groupings of one pass over the events, by grouping sets."""
    events = load(spark, sf_dir, "events").withColumn("parity", (F.col("user_id") % 2).cast("string"))
    sides = F.explode(F.array(F.struct(F.lit("type").alias("facet"), F.col("event_type").alias("value")), F.struct(F.lit("parity").alias("facet"), F.col("parity").alias("value"))))
    return events.select(sides.alias("s")).groupBy("s.facet", "s.value").agg(F.count("*").alias("n"))


def mongo_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$map, $filter and $reduce over the numbers up to a part's size."""
    n = F.sequence(F.lit(1), F.col("p_size"))
    odd = F.filter(n, lambda x: x % 2 == 1)
    return load(spark, sf_dir, "part").select("p_partkey", F.aggregate(F.transform(odd, lambda x: x * x), F.lit(0), lambda a, x: a + x).cast("long").alias("s"))


def mongo_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array(F.col("n_nationkey") % 3, F.lit(1)), F.array(F.col("n_nationkey") % 5, F.lit(2))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.size(F.array_union(a, b)).alias("u"), F.size(F.array_intersect(a, b)).alias("i"), F.size(F.array_except(a, b)).alias("d"))


def mongo_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$project of a field of a JSON document."""
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def redis_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HGETALL: each user's latest value of each field, as rows."""
    events = load(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("field")).agg(F.max_by("value", "event_id").alias("value"))


def es_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to vector 0 by squared distance: partial top-k in each task, then one merge."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    target = vectors.where("vec_id = 0").select(F.col("v").alias("q"))
    distance = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = vectors.join(F.broadcast(target), F.lit(True)).select("vec_id", F.round(distance, 6).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(10)


def es_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match query: any of the words, on lower-cased tokens."""
    words = F.split(F.lower("p_name"), " ")
    return load(spark, sf_dir, "part").where(F.arrays_overlap(words, F.array(F.lit("red"), F.lit("blue")))).select("p_partkey")


QUERIES = {f.__name__: f for f in (mongo_lookup, mongo_unwind, mongo_addfields, mongo_bucketauto, mongo_facet, mongo_hof, mongo_sets, mongo_project, redis_hash, es_knn, es_fulltext)}

ORACLE = {
    "mongo_lookup": "SELECT r_regionkey, coalesce(string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey), '') AS keys FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey",
    "mongo_unwind": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    "mongo_addfields": "SELECT event_id, event_id % 2 = 0 AS even, event_id + 1 AS next FROM events",
    "mongo_bucketauto": "WITH s AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size), p AS (SELECT *, sum(n) OVER (ORDER BY p_size) AS upto, sum(n) OVER () AS total FROM s) SELECT CAST(least(3, floor((upto - 1) * 4 / total)) AS INTEGER) AS bucket, min(p_size) AS low, max(p_size) AS high, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1",
    "mongo_facet": "SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'parity', CAST(user_id % 2 AS VARCHAR), count(*) FROM events GROUP BY 2",
    "mongo_hof": "SELECT p_partkey, CAST(coalesce(list_sum(list_transform(list_filter(generate_series(1, p_size), lambda x: x % 2 = 1), lambda x: x * x)), 0) AS BIGINT) AS s FROM part",
    "mongo_sets": "SELECT n_nationkey, CAST(len(list_distinct(list_concat([n_nationkey % 3, 1], [n_nationkey % 5, 2]))) AS INTEGER) AS u, CAST(len(list_intersect([n_nationkey % 3, 1], [n_nationkey % 5, 2])) AS INTEGER) AS i, CAST(len(list_distinct(list_filter([n_nationkey % 3, 1], lambda x: NOT list_contains([n_nationkey % 5, 2], x)))) AS INTEGER) AS d FROM nation",
    "mongo_project": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "redis_hash": "SELECT user_id AS key, event_type AS field, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "es_knn": "SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 10",
    "es_fulltext": "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['red', 'blue'])",
}
