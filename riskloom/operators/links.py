"""Links between customers: shared keys, simultaneous bursts and rings.

Groups are kept in long form - one row per group, one row per group member - instead of
one array per group, so an address shared by millions of customers is millions of small
rows and not one huge one.  Every aggregation combines on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.cleaning import filter_key
from riskloom.session import new_folder, remove_folder

GROUP = ("relationship_type", "group_key", "customer_count", "txn_count", "total_amount", "risk_level")


def _members_by_key(txn: DataFrame, column: str, customer: str) -> DataFrame:
    return (filter_key(txn, column).groupBy(F.col(column).alias("group_key"), F.col(customer).alias("customer_id"))
            .agg(F.count("*").alias("txn_count"), F.sum("amount").alias("total_amount")))


def _members_by_burst(txn: DataFrame, ts: str, customer: str, unit: str, min_txn: int) -> DataFrame:
    period = F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd HH:mm")
    return (txn.groupBy(period.alias("group_key"), F.col(customer).alias("customer_id"))
            .agg(F.count("*").alias("txn_count"), F.sum("amount").alias("total_amount"))
            .filter(F.col("txn_count") >= min_txn))


def _groups(members: DataFrame, kind: str, level: Column) -> DataFrame:
    return (members.groupBy("group_key").agg(
        F.count("customer_id").alias("customer_count"), F.sum("txn_count").alias("txn_count"),
        F.sum("total_amount").alias("total_amount"))
        .filter(F.col("customer_count") > 1)
        .select(F.lit(kind).alias("relationship_type"), "group_key", "customer_count", "txn_count",
                "total_amount", level.alias("risk_level")))


def _level(high: int) -> Column:
    return F.when(F.col("customer_count") >= high, "HIGH").otherwise("MEDIUM")


def link_by_key(txn: DataFrame, column: str, kind: str, high: int, customer: str = "customer_id") -> DataFrame:
    """Values of ``column`` used by more than one customer."""
    return _groups(_members_by_key(txn, column, customer), kind, _level(high))


def link_burst(txn: DataFrame, ts: str = "trans_time", unit: str = "minute", min_txn: int = 5,
               customer: str = "customer_id") -> DataFrame:
    """Periods in which more than one customer made at least ``min_txn`` transactions."""
    return _groups(_members_by_burst(txn, ts, customer, unit, min_txn), "BURST_TXN", F.lit("HIGH"))


def _specs(txn, ip, device, ts, customer, unit, min_txn):
    return (
        ("SAME_IP", _members_by_key(txn, ip, customer), _level(5)),
        ("SAME_DEVICE", _members_by_key(txn, device, customer), _level(3)),
        ("BURST_TXN", _members_by_burst(txn, ts, customer, unit, min_txn), F.lit("HIGH")),
    )


def relationship_groups(txn: DataFrame, batch_date: str, ip: str = "ip_address", device: str = "device_id",
                        ts: str = "trans_time", customer: str = "customer_id", unit: str = "minute",
                        min_txn: int = 5) -> DataFrame:
    """The three kinds of groups in one schema."""
    parts = [_groups(m, kind, level) for kind, m, level in _specs(txn, ip, device, ts, customer, unit, min_txn)]
    return reduce(DataFrame.unionByName, parts).withColumn("batch_date", F.lit(batch_date))


def relationship_edges(txn: DataFrame, ip: str = "ip_address", device: str = "device_id", ts: str = "trans_time",
                       customer: str = "customer_id", unit: str = "minute", min_txn: int = 5) -> DataFrame:
    """Members of every group: star edges customer - group, weighted by transactions."""
    parts = []
    for kind, members, level in _specs(txn, ip, device, ts, customer, unit, min_txn):
        shared = _groups(members, kind, level).select("relationship_type", "group_key")
        parts.append(members.join(shared, "group_key").select(
            "relationship_type", "group_key", "customer_id", F.col("txn_count").alias("weight")))
    return reduce(DataFrame.unionByName, parts)


def star_edges(edges: DataFrame) -> DataFrame:
    """Each member of a group joined to the group's smallest member: n-1 edges, not n(n-1)/2."""
    hub = edges.groupBy("relationship_type", "group_key").agg(F.min("customer_id").alias("v"))
    return (edges.join(hub, ["relationship_type", "group_key"])
            .select(F.col("customer_id").alias("u"), "v").filter(F.col("u") != F.col("v")).distinct())


def connected_components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for undirected pairs ``(u, v)``.

    Alternating large-star and small-star steps: each is an aggregation and a join on the
    node, the number of rounds grows with the logarithm of the graph, and rounds are run
    until nothing changes.  Each round is written to the shared folder and the one before is
    deleted.
    """
    def signature(edges):
        return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    spark = pairs.sparkSession

    def write(df):
        path = new_folder(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    edges, path = write(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .filter(F.col("u") != F.col("v")).distinct())
    before = signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(smallest, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(parent.select("u", F.col("m").alias("v")))
                 .filter(F.col("u") != F.col("v")).distinct())
        older = path
        edges, path = write(small)
        remove_folder(spark, older)
        after = signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
