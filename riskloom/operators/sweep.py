"""Running totals over time for every key, exact and safe for hot keys.

A sliding window is turned into signed changes on a time line: a transaction adds to
a total at its own time and takes it away again when it leaves the window.  The state
seen by a transaction is then the sum of all changes up to its time, so the cost per row
does not depend on the length of the window or on how full it is.

An ordinary key is summed in one ordered group.  A key with very many rows is cut into
time buckets: the totals of its earlier buckets are aggregated apart (with map-side
combine) and added to the sums inside each bucket, so no task ever orders a whole hot key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # rows of one key that one task may order

ARRIVE, LEAVE = 0, 1  # at the same instant, rows are read before anything leaves


def _change(at: str, phase: int, row: str, values: dict[str, str], measures: dict[str, str]) -> str:
    fields = "".join(f", cast({values.get(m, 'null')} as {kind}) as {m}" for m, kind in measures.items())
    return f"struct({at} as at, {phase} as phase, {row} as row{fields})"


def trailing_changes(df: DataFrame, key: str, ts: str, measures: dict[str, str],
                     windows: dict[str, dict[str, str]], forever: dict[str, str], payload: bool) -> DataFrame:
    """The rows' own arrivals and departures.

    ``windows`` maps an interval (``"1 hour"``) to the measures it feeds, as SQL expressions;
    ``forever`` holds measures that never leave.  With ``payload`` the arrivals carry their
    row; departures never do, so they stay narrow in the shuffle.
    """
    inputs = [key, ts, *_inputs(df, key, ts, windows, forever)]
    packed = df.select(*inputs, *([F.struct(*df.columns).alias("_row")] if payload else []))
    nothing = f"cast(null as {packed.schema['_row'].dataType.simpleString()})" if payload else "null"
    arriving = {**forever, **{m: v for fed in windows.values() for m, v in fed.items()}}
    changes = [_change(ts, ARRIVE, "_row" if payload else "null", arriving, measures)]
    for span, fed in windows.items():
        leaving = {m: f"-({v})" for m, v in fed.items()}
        changes.append(_change(f"{ts} + interval {span}", LEAVE, nothing, leaving, measures))
    return packed.selectExpr(f"{key} as key", f"inline(array({', '.join(changes)}))")


def _inputs(df: DataFrame, key: str, ts: str, windows, forever) -> list[str]:
    """Columns the measures are computed from, besides key and time."""
    text = " ".join([*forever.values(), *[v for fed in windows.values() for v in fed.values()]])
    words = set(re.findall(r"\w+", text))
    return [c for c in df.columns if c in words and c not in (key, ts)]


def presence_changes(df: DataFrame, key: str, ts: str, attributes: dict[str, str],
                     measures: dict[str, str], span: str = "30 days") -> DataFrame:
    """Changes in the number of distinct attribute values seen within ``span``.

    ``attributes`` maps a column to its measure.  A value counts from its first sighting
    until ``span`` after its last one; sightings are first reduced to one row per value
    and day, then runs without a gap longer than ``span`` are found.
    """
    pairs = ", ".join(f"struct('{m}' as measure, cast({c} as string) as value)" for c, m in attributes.items())
    seen = df.selectExpr(f"{key} as key", f"{ts} as ts", f"inline(array({pairs}))").filter("value is not null")
    daily = (seen.groupBy("key", "measure", "value", F.expr("date_trunc('day', ts) as day"))
             .agg(F.expr("min(ts) as first_ts"), F.expr("max(ts) as last_ts")))
    order = "over (partition by key, measure, value order by day)"
    runs = daily.selectExpr("key", "measure", "first_ts", "last_ts",
                            f"lag(last_ts) {order} as before", f"lead(first_ts) {order} as after")
    edges = runs.selectExpr("key", "measure", f"""inline(filter(array(
        struct(if(before is null or first_ts > before + interval {span}, first_ts, null) as at, {ARRIVE} as phase, 1 as delta),
        struct(if(after is null or after > last_ts + interval {span}, last_ts + interval {span}, null) as at,
               {LEAVE} as phase, -1 as delta)), e -> e.at is not null))""")
    mine = set(attributes.values())
    return edges.selectExpr("key", "at", "phase", *[
        f"cast({f'if(measure = {chr(39)}{m}{chr(39)}, delta, null)' if m in mine else 'null'} as {kind}) as {m}"
        for m, kind in measures.items()])


def later_changes(df: DataFrame, key: str, ts: str, measure: str, span: str,
                  measures: dict[str, str]) -> DataFrame:
    """+1 just after ``ts`` and -1 after ``ts + span``: counts strictly earlier events."""
    edges = df.selectExpr(f"{key} as key", f"""inline(array(
        struct({ts} as at, {LEAVE} as phase, 1 as delta),
        struct({ts} + interval {span} as at, {LEAVE} as phase, -1 as delta)))""")
    return edges.selectExpr("key", "at", "phase", *[
        f"cast({'delta' if m == measure else 'null'} as {kind}) as {m}" for m, kind in measures.items()])


def running_state(df: DataFrame, key: str, ts: str, measures: dict[str, str],
                  windows: dict[str, dict[str, str]], forever: dict[str, str], changes: Sequence[DataFrame],
                  hot_rows: int = HOT_ROWS, hot_bucket: str = "minute") -> DataFrame:
    """Every row of ``df`` with the value of each measure at its time.

    ``changes`` are further changes (``presence_changes``, ``later_changes``).  Keys with
    at least ``hot_rows`` rows are cut into ``hot_bucket`` (a ``date_trunc`` unit) pieces.
    """
    names = list(measures)
    # at most rows / hot_rows keys: small enough to broadcast by construction
    hot = F.broadcast(df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
                      .filter(F.col("n") >= hot_rows).selectExpr("key", "true as hot"))

    def line(payload: bool) -> DataFrame:
        own = trailing_changes(df, key, ts, measures, windows, forever, payload)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes, own)

    inside = "over (partition by key, bucket order by at, phase range between unbounded preceding and current row)"
    detail = (line(True).join(hot, "key", "left")
              .withColumn("bucket", F.expr(f"if(hot, date_trunc('{hot_bucket}', at), null)"))
              .selectExpr("key", "bucket", "row", *[f"sum({m}) {inside} as {m}" for m in names]).filter("row is not null"))

    earlier = "over (partition by key order by bucket rows between unbounded preceding and 1 preceding)"
    carried = (line(False).drop("row").join(hot, "key")
               .groupBy("key", F.date_trunc(hot_bucket, "at").alias("bucket"))
               .agg(*[F.expr(f"sum({m}) as {m}") for m in names])
               .selectExpr("key", "bucket", *[f"sum({m}) {earlier} as before_{m}" for m in names]))
    return detail.join(carried, ["key", "bucket"], "left").selectExpr(
        "row.*", *[f"coalesce({m}, 0) + coalesce(before_{m}, 0) as {m}" for m in names])


def with_next_time(df: DataFrame, key: str, ts: str, order: Sequence[str], bucket: str = "day",
                   output: str = "next_ts") -> DataFrame:
    """Adds the time of the key's next row (by ``order``, which starts with ``ts``).

    The successor is looked for inside the bucket, then in the key's next bucket that has
    rows, so a hot key is spread over as many groups as it has buckets.
    """
    cut = df.withColumn("_bucket", F.date_trunc(bucket, ts))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    over_buckets = Window.partitionBy(key).orderBy("_bucket")
    first = (cut.groupBy(key, "_bucket").agg(F.min(ts).alias("_first"))
             .select(key, "_bucket", F.lead("_first").over(over_buckets).alias("_next_first")))
    return (cut.withColumn(output, F.lead(ts).over(inside)).join(first, [key, "_bucket"])
            .withColumn(output, F.coalesce(output, "_next_first"))
            .select(*df.columns, output))
