"""Views of the given tables in the roles of an evaluation's tables: scored sets, manifests, event streams, profiles, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, subject, label, attack_type, score) from lineitem; scores have many ties."""
    label = (F.col("l_linestatus") == "O").cast("int")
    score = ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 7 + 200 * label) % 1000) / F.lit(1000.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("subject"), label.alias("label"), F.when(label == 1, F.col("l_returnflag")).alias("attack_type"), score.alias("score"), "l_returnflag", "l_shipdate")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, attack_type, identity, split, source struct) from documents and labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    place = F.expr("pmod(doc_id * 7 + doc_id div 20, 10)")
    split = F.when(F.pmod(F.col("doc_id"), F.lit(50)) == 49, F.lit(None)).when(place < 7, "train").when(place < 9, "dev").otherwise("test")
    return d.join(one, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"), F.when(toxic, "attack").otherwise("bonafide").alias("label"), F.when(toxic, F.col("lang")).alias("attack_type"),
        F.col("source").alias("identity"), split.alias("split"), F.struct(F.col("lang").alias("dataset"), F.col("source").alias("id")).alias("bonafide_source"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), us.alias("us"), "event_type", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session")).distinct()


def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter(F.col("event_type") == "click").select("session", "pos", "us", "x", "y")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup is a key's down, purchase its up; the key is the tenth of y."""
    e = _events(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase"))
    return e.select("session", "pos", "us", F.when(F.col("event_type") == "signup", "down").otherwise("up").alias("phase"), F.floor(F.col("y") / 25).cast("int").alias("code"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter(F.col("event_type").isin("view", "error"))
    return e.select("session", "pos", "us", F.col("x").alias("ax"), (F.col("y") / 10).alias("ay"), F.lit(1.0).alias("az"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, subject, vector) from embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("subject"), F.col("embedding").cast("array<double>").alias("vector"))


def sweep_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, capacity, data_level, seed, file, eer, n_train, n_val) from orders and customer: orders before the middle of 1996 are the baseline."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.when(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1996-07-01 00:00:00")).cast(o.schema["o_orderdate"].dataType), "baseline").otherwise("commercial").alias("side"),
        F.col("c_mktsegment").alias("capacity"), F.col("o_orderpriority").alias("data_level"), (F.col("o_orderkey") % 3).alias("seed"), F.col("o_orderkey").alias("file"),
        ((F.col("o_orderkey") * 37 + F.col("o_custkey") * 11) % 500 / F.lit(1000.0)).alias("eer"), (F.col("o_orderkey") % 97).alias("n_train"), (F.col("o_custkey") % 89).alias("n_val"),
    )
