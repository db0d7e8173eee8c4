"""Small Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import fixed_values as fv


def banded(value: Column, bands: Sequence[tuple], otherwise, inclusive: bool = False) -> Column:
    """Label of the first band whose lower bound ``value`` passes; NULL falls through."""
    out = None
    for bound, label in bands:
        test = value >= bound if inclusive else value > bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def mapped(value: Column, pairs: Sequence[tuple], otherwise) -> Column:
    """Constant lookup ``value -> label`` as one CASE expression."""
    out = None
    for key, label in pairs:
        out = F.when(value == key, F.lit(label)) if out is None else out.when(value == key, F.lit(label))
    return out.otherwise(otherwise)


def truthy(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def half_up(value: Column, places: int) -> Column:
    """Round half up; the input keeps its type (exact for decimals)."""
    return F.round(value, places)


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def masked(value: Column, kind: str) -> Column:
    """Hide the middle of a phone (11), id card (18) or bank card (8+) number."""
    if kind == "phone":
        return F.when(F.length(value) == 11,
                      F.concat(F.substring(value, 1, 3), F.lit("****"), F.substring(value, 8, 4))).otherwise(value)
    if kind == "id_card":
        return F.when(F.length(value) == 18,
                      F.concat(F.substring(value, 1, 6), F.lit("********"), F.substring(value, 15, 4))).otherwise(value)
    if kind == "bank_card":
        return F.when(F.length(value) >= 8,
                      F.concat(F.substring(value, 1, 4), F.lit("****"), F.right(value, F.lit(4)))).otherwise(value)
    raise ValueError(f"unknown kind: {kind}")


def is_night(ts: Column) -> Column:
    return truthy(F.hour(ts) < 6)


def is_weekend(ts: Column) -> Column:
    return truthy(F.dayofweek(ts).isin(1, 7))


def ip_class(ip: Column) -> Column:
    """HIGH_RISK, MEDIUM_RISK or NORMAL by the first octets of the address."""
    def starts(prefixes):
        return reduce(or_, [ip.startswith(p) for p in prefixes])

    return (F.when(starts(fv.HIGH_RISK_IP_PREFIXES), "HIGH_RISK")
            .when(starts(fv.MEDIUM_RISK_IP_PREFIXES), "MEDIUM_RISK").otherwise("NORMAL"))


def ratio(num: Column, den: Column) -> Column:
    """num / den in double, NULL on a zero or NULL denominator (ANSI mode raises otherwise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))
