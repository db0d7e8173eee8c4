"""Validation, filtering and standardisation of transactions (all narrow, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions.columns import half_up, ip_class, is_night, is_weekend, masked, sha256_hex, truthy


def filter_valid_amount(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Keep 0.01 <= amount <= 10 000 000, tested before any rounding; NULL goes."""
    bounds = F.col(amount).between(F.lit(fv.MIN_AMOUNT).cast("decimal(18,2)"),
                                   F.lit(fv.MAX_AMOUNT).cast("decimal(18,2)"))
    return df.filter(bounds)


def filter_key(df: DataFrame, column: str) -> DataFrame:
    """Keep rows whose key is neither NULL nor empty."""
    return df.filter(F.col(column).isNotNull() & (F.length(column) > 0))


def violations(df: DataFrame) -> Column:
    """Array of reason codes, empty for a valid record."""
    def blank(name):
        return F.when(F.coalesce(F.trim(F.col(name)), F.lit("")) == "", F.lit(f"{name}_blank"))

    amount = F.col("amount")
    checks = [blank(c) for c in ("transaction_id", "account_id", "transaction_type", "channel_code")]
    checks += [
        F.when(amount.isNull(), F.lit("amount_null")),
        F.when(amount < F.lit(fv.MIN_AMOUNT).cast("decimal(18,2)"), F.lit("amount_too_small")),
        F.when(amount > F.lit(fv.MAX_AMOUNT).cast("decimal(18,2)"), F.lit("amount_too_large")),
        F.when(~F.col("ip_address").rlike(fv.IPV4_OR_EMPTY), F.lit("ip_address_invalid")),
    ]
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid records and rejects; rejects carry their reason codes."""
    checked = df.withColumn("violations", violations(df))
    good = checked.filter(F.size("violations") == 0).drop("violations")
    return good, checked.filter(F.size("violations") > 0)


def validation_report(df: DataFrame) -> DataFrame:
    """Rejected records per reason code."""
    reasons = df.select(F.explode(violations(df)).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("rejected"))


def standardise(df: DataFrame) -> DataFrame:
    """Amount to two places, default currency, upper-case channel, extreme-amount flag."""
    amount = half_up(F.col("amount"), 2)
    return df.withColumns({
        "amount": amount,
        "currency": F.when(F.coalesce(F.col("currency"), F.lit("")) == "", fv.DEFAULT_CURRENCY)
                     .otherwise(F.col("currency")),
        "channel_code": F.upper("channel_code"),
        "is_extreme_amount": truthy(amount >= F.lit(fv.MAX_AMOUNT).cast("decimal(18,2)")),
    })


def hash_pii(df: DataFrame) -> DataFrame:
    """SHA-256 of account and counterparty where the feed did not bring a hash."""
    return df.withColumns({
        "account_id_hash": F.coalesce("account_id_hash", sha256_hex(F.col("account_id"))),
        "counterparty_hash": F.coalesce("counterparty_hash", sha256_hex(F.col("counterparty_account"))),
    })


def coarsen_gps(df: DataFrame) -> DataFrame:
    return df.withColumns({c: half_up(F.col(c), 2) for c in ("gps_lat", "gps_lng")})


def classify_ip(df: DataFrame, keep_stronger: bool = False) -> DataFrame:
    """Class from the address prefix; a NULL address keeps the level that came in.

    ``keep_stronger`` keeps an incoming VPN / PROXY / TOR label instead of overwriting it.
    """
    current = F.col("ip_risk_level")
    new = F.when(F.col("ip_address").isNull(), current).otherwise(ip_class(F.col("ip_address")))
    if keep_stronger:
        new = F.when(current.isin("VPN", "PROXY", "TOR"), current).otherwise(new)
    return df.withColumn("ip_risk_level", new)


def mask_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Mask each column of ``spec`` (column -> phone | id_card | bank_card)."""
    return df.withColumns({c: masked(F.col(c), kind) for c, kind in spec.items()})


def time_flags(df: DataFrame, ts: str = "transaction_time") -> DataFrame:
    return df.withColumns({"is_night_time": is_night(F.col(ts)), "is_weekend": is_weekend(F.col(ts))})


def clean(df: DataFrame) -> DataFrame:
    """The cleaning step of the ingest pipeline, in order."""
    out = hash_pii(standardise(filter_valid_amount(df)))
    if {"gps_lat", "gps_lng"} <= set(out.columns):
        out = coarsen_gps(out)
    return classify_ip(out)


def account_age(df: DataFrame, open_date: str = "open_date", ts: str = "transaction_time",
                output: str = "account_age_days") -> DataFrame:
    """Whole days from the opening of the account to the transaction, 0 where it is not known or later."""
    days = F.datediff(F.col(ts), F.col(open_date))
    return df.withColumn(output, F.greatest(F.lit(0), F.coalesce(days, F.lit(0))))


def apply_defaults(df: DataFrame) -> DataFrame:
    """Fill the request defaults in every column that is present."""
    kinds = dict(df.dtypes)
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fv.DEFAULT_TEXT.items() if c in kinds}
    fills |= {c: F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) for c in fv.DEFAULT_NUMBERS if c in kinds}
    fills |= {c: truthy(F.col(c)) for c in fv.DEFAULT_FLAGS if c in kinds}
    return df.withColumns(fills)
