"""Networks within the star-schema tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
STATUSES = ("F", "O", "P")
KEYS = ("user_id",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A cohort: each user's events in order, consecutive ones linked."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("node_id"), "event_type", "value", "ts")
    next_ = F.lead("node_id").over(Window.partitionBy("user_id").orderBy("ts", "node_id"))
    edges = events.select("user_id", F.col("node_id").alias("source"), next_.alias("target")).where("target is not null")
    return events.drop("ts"), edges


def order_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One network: orders linked to the customer's next one."""
    orders = table(spark, sf_dir, "orders").select(F.lit(1).alias("net"), F.col("o_orderkey").alias("node_id"), "o_orderstatus", "o_totalprice", "o_custkey", "o_orderdate")
    next_ = F.lead("node_id").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "node_id"))
    edges = orders.select("net", F.col("node_id").alias("source"), next_.alias("target")).where("target is not null")
    return orders.select("net", "node_id", "o_orderstatus", "o_totalprice"), edges


def customer_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c_acctbal, duration, event): days from first to last order, and whether the last
    is finished."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    each = orders.groupBy("o_custkey").agg(F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("duration"), (last == "F").cast("int").alias("event"))
    return customer.select("c_custkey", "c_acctbal").join(each, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


def documents_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality, toxic, n_chars, n_words, n_lines) of labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("n_spaces"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("double").alias("n_lines"))
    return table(spark, sf_dir, "labels").join(d, "doc_id")
