"""Ratings tables: delimited files with fixed schemas, and the views over star-schema tables.

A ratings table is (u BIGINT, i BIGINT, r DOUBLE) with one row a pair; a missing pair is unknown, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = T.StructType([T.StructField("user_id", T.IntegerType()), T.StructField("item_id", T.IntegerType()), T.StructField("rating", T.DoubleType()), T.StructField("ts", T.LongType())])
USERS = "user_id INT, age INT, gender STRING, occupation STRING, zip STRING"
GENRES = 19


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, item, rating, epoch seconds, without a header."""
    return spark.read.schema(RATINGS).option("sep", "\t").csv(path)


def read_items(spark: SparkSession, path: str, genres: int = GENRES) -> DataFrame:
    """Bar-separated Latin-1 items; the video date is dropped, the genre flags become one array."""
    names = ["item_id INT", "title STRING", "release_date STRING", "video_release_date STRING", "imdb_url STRING", *(f"g{k} DOUBLE" for k in range(genres))]
    raw = spark.read.schema(", ".join(names)).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    return raw.select("item_id", "title", "release_date", "imdb_url", F.array(*(f"g{k}" for k in range(genres))).alias("genres"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USERS).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)


def file_md5(spark: SparkSession, path: str) -> DataFrame:
    """path and MD5 of every file, to hold against a published list."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def checked(spark: SparkSession, path: str, md5: str) -> str:
    """``path`` if all its files have that MD5, else an error."""
    wrong = file_md5(spark, path).where(F.col("md5") != md5).take(1)
    if wrong:
        raise ValueError(f"{wrong[0]['path']} has MD5 {wrong[0]['md5']}, not {md5}")
    return path


def to_matrix(ratings: DataFrame, user: str = "user_id", item: str = "item_id", rating: str | Column = "rating") -> DataFrame:
    """One row a pair: where a pair is repeated, its largest rating, so none leaves the scale.

    Rows are dealt by user, which serves the grouping and what splits a user's rows after it: they are shuffled once.
    """
    r = F.col(rating) if isinstance(rating, str) else rating
    rows = ratings.select(F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i"), r.cast("double").alias("r"))
    return rows.repartition("u").groupBy("u", "i").agg(F.max("r").alias("r"))


def star_ratings(spark: SparkSession, sf_dir: str, item: str = "l_suppkey") -> DataFrame:
    """Customers rate suppliers (or parts: ``l_partkey``) by quantity in five steps."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", item, "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return to_matrix(both, "o_custkey", item, F.floor((F.col("l_quantity") - 1) / 10) + 1)


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users rate the key of an event's JSON properties by their largest value there, in five steps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "value")
    return to_matrix(events.where("item_id is not null"), rating=F.floor(F.least("value", F.lit(199.0)) / 40) + 1)


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of suppliers, long: i, feature (nation and region), each of weight 1."""
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey)
    both = F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return rows.select(F.col("s_suppkey").alias("i"), F.explode(both).alias("feature"), F.lit(1.0).alias("w"))


def totals_check(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """How many ratings have no user or no item row; both are 0 in sound data."""
    lost_u = ratings.join(users.select("u"), "u", "left_anti").agg(F.count(F.lit(1)).alias("without_user"))
    return lost_u.crossJoin(ratings.join(items.select("i"), "i", "left_anti").agg(F.count(F.lit(1)).alias("without_item")))  # one row each
