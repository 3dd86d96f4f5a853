"""Graphs made from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, durable, edge_frame, from_edges, node_frame
from .streaming.edges import transitions


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought together in at least two orders; an edge from the smaller to the larger key.

    The pairs are written once: nodes, edges and every further use read that small table, not the self-join.
    """
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = line.toDF("o", "s").join(line.toDF("o", "t"), "o").where("s < t").groupBy("s", "t").agg(F.count("*").cast("double").alias("weight")).where("weight >= 2")
    pairs = durable(pairs)
    edges = pairs.select((F.col("s") * F.lit(1 << 31) + F.col("t")).alias("seq"), F.col("s").cast("string").alias("source"), F.col("t").cast("string").alias("target"), "weight")
    ends = pairs.select(F.explode(F.array("s", "t")).alias("p_partkey")).distinct()
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    nodes = ends.join(part, "p_partkey", "left").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("seq"), "p_brand", "p_type", "p_retailprice")
    return Graph(node_frame(nodes), edge_frame(edges))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations of customers to nations of suppliers, weighted by lines."""
    orders, line = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    customer, supplier = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s")), _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("t"))
    flows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = flows.groupBy("s", "t").agg(F.count("*").cast("double").alias("weight")).select((F.col("s").cast("long") * 1000 + F.col("t")).alias("seq"), F.concat(F.lit("N"), "s").alias("source"), F.concat(F.lit("N"), "t").alias("target"), "weight")
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    nodes = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("label"), "r_name")
    return Graph(node_frame(nodes), edge_frame(edges))


def membership(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and their regions, a star around each region."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    nodes = nation.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("label"))
    nodes = nodes.unionByName(region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), (F.col("r_regionkey") + 1000).cast("long").alias("seq"), F.col("r_name").alias("label")))
    edges = nation.select(F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit("N"), "n_nationkey").alias("source"), F.concat(F.lit("R"), "n_regionkey").alias("target"))
    return Graph(node_frame(nodes), edge_frame(edges))


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(_read(spark, sf_dir, "events"))


def day_steps(spark: SparkSession, sf_dir: str) -> Graph:
    """A directed graph with cycles: from each event of a user to the next one on the same day; a node is a kind of event with its value to one decimal."""
    events = _read(spark, sf_dir, "events").where("event_type IS NOT NULL AND value IS NOT NULL")
    state = F.concat("event_type", F.lit(":"), F.floor(F.col("value") * 10).cast("string"))
    steps = events.withColumn("kind", state).withColumn("day", F.to_date("ts")).withColumn("key", F.struct("user_id", "day"))
    return from_edges(transitions(steps, user="key", kind="kind"), None)
