"""Reference-data joins: watch lists, countries and rule metadata.

None of them forces a broadcast.  The planner broadcasts a list whose measured size is
under ``spark.sql.autoBroadcastJoinThreshold``; a larger one is shuffled, and a hot key
on the transaction side is then split by the adaptive skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.columns import truthy


def _in_force(txn: DataFrame, listing: DataFrame, key: str, ts: str):
    return ((txn[key] == listing["entity_hash"])
            & (listing["effective_time"] <= txn[ts])
            & (listing["expire_time"].isNull() | (txn[ts] < listing["expire_time"])))


def blacklist_hits(txn: DataFrame, listing: DataFrame, key: str = "counterparty_hash",
                   ts: str = "transaction_time") -> DataFrame:
    """Transactions whose counterparty was listed at that time (each at most once)."""
    active = listing.filter("enabled").select("entity_hash", "effective_time", "expire_time")
    return txn.join(active, _in_force(txn, active, key, ts), "left_semi")


def blacklist_clean(txn: DataFrame, listing: DataFrame, key: str = "counterparty_hash",
                    ts: str = "transaction_time") -> DataFrame:
    active = listing.filter("enabled").select("entity_hash", "effective_time", "expire_time")
    return txn.join(active, _in_force(txn, active, key, ts), "left_anti")


def _listed_periods(listing: DataFrame) -> DataFrame:
    """Disjoint periods per entity, so that a transaction meets at most one of them."""
    forever = F.lit("9999-12-31").cast(listing.schema["effective_time"].dataType)
    rows = (listing.filter("enabled")
            .select("entity_hash", "effective_time", F.coalesce("expire_time", forever).alias("end"))
            .groupBy("entity_hash", "effective_time").agg(F.max("end").alias("end")))
    order = Window.partitionBy("entity_hash").orderBy("effective_time")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = rows.withColumn("opens", F.when(reached.isNull() | (reached < F.col("effective_time")), 1).otherwise(0))
    numbered = opens.withColumn("period", F.sum("opens").over(order))
    return (numbered.groupBy("entity_hash", "period")
            .agg(F.min("effective_time").alias("listed_from"), F.max("end").alias("listed_to"))
            .drop("period"))


def match_blacklist(txn: DataFrame, listing: DataFrame, key: str = "counterparty_hash",
                    ts: str = "transaction_time") -> DataFrame:
    """Adds ``sanction_matched`` and its detail text; every transaction stays, once."""
    periods = _listed_periods(listing)
    joined = txn.join(periods, (txn[key] == periods["entity_hash"])
                      & (periods["listed_from"] <= txn[ts]) & (txn[ts] < periods["listed_to"]), "left")
    matched = F.col("entity_hash").isNotNull()
    return joined.select(*txn.columns, matched.alias("sanction_matched"),
                         F.when(matched, fv.SANCTION_DETAIL).otherwise("").alias("sanction_detail"))


def flag_country(txn: DataFrame, country: str = "counterparty_country") -> DataFrame:
    """Membership of the two fixed country lists (nine and four codes) as plain predicates."""
    return txn.withColumns({
        "is_fatf_country": truthy(F.col(country).isin(*fv.FATF_COUNTRIES)),
        "is_war_country": truthy(F.col(country).isin(*fv.WAR_COUNTRIES)),
    })


def attach_rule_meta(hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rule hits with the weight, level and version of the enabled definitions."""
    meta = definitions.filter("enabled").select(
        "rule_id", F.col("risk_weight").alias("weight"), F.col("risk_level").alias("level"), "version")
    return hits.join(meta, "rule_id")
