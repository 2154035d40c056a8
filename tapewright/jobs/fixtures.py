"""Bar-panel tables derived from the general test tables, one SQL text for Spark and for the oracle.

{ntz} is the zone-less timestamp type, {shift} moves a date by SHIFT days so that daily history reaches the month of the
bars. Aggregates are minima, maxima and counts, so both engines have the same numbers to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHIFT = 8215
PROXY = "S0"

VIEWS = {
    "raw_bars": (
        "events",
        """SELECT 'S' || CAST(user_id % 8 AS STRING) AS sym, CAST(date_trunc('minute', ts) AS {ntz}) AS ts, value + 1 AS open,
  CASE WHEN event_id % 97 = 0 THEN value ELSE value + 1 + CAST(event_id % 5 AS DOUBLE) / 100 END AS high,
  value + 1 - CAST(event_id % 3 AS DOUBLE) / 100 AS low, value + 1 + CAST(event_id % 3 - 1 AS DOUBLE) / 100 AS close,
  CAST(1 + event_id % 997 AS BIGINT) AS volume, CAST(1 + event_id % 7 AS BIGINT) AS ntrades, value + 1 AS vwap, CAST(event_id AS BIGINT) AS seq
FROM {events}""",
    ),
    "daily": (
        "lineitem",
        """SELECT 'S' || CAST(l_suppkey % 8 AS STRING) AS sym, {shift_ship} AS date, min(l_extendedprice) AS open,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low, max(l_extendedprice) AS close, CAST(count(*) AS BIGINT) AS volume
FROM {lineitem} GROUP BY 1, 2""",
    ),
    "factors": (
        "orders",
        """SELECT {shift_order} AS date, max(o_totalprice) / 5000000 - CAST(0.09 AS DOUBLE) AS mkt_rf,
  min(o_totalprice) / 5000000 - CAST(0.01 AS DOUBLE) AS smb, CAST(max(o_custkey) % 101 - 50 AS DOUBLE) / 5000 AS hml,
  CAST(min(o_custkey) % 89 - 44 AS DOUBLE) / 5000 AS wml, CAST(0.0001 AS DOUBLE) AS rf
FROM {orders} GROUP BY 1""",
    ),
    "model_rows": (
        "lineitem",
        """SELECT CAST(l_shipdate AS DATE) AS date, 'S' || CAST(l_suppkey % 100 AS STRING) AS sym, CAST(570 + 30 * l_linenumber AS INT) AS bkt,
  l_discount - CAST(0.05 AS DOUBLE) AS cumres30, l_tax - CAST(0.04 AS DOUBLE) AS cumres60, l_quantity / 1000 AS rv60,
  l_extendedprice / 50000 AS vsurp, CAST(l_partkey % 41 - 20 AS DOUBLE) / 100 AS gap,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST((l_orderkey * 31 + l_partkey) % 2001 - 1000 AS DOUBLE) / 100000
    - (l_discount - CAST(0.05 AS DOUBLE)) / 100 END AS fwdres10
FROM {lineitem}""",
    ),
    "preds": (
        "events",
        """SELECT DISTINCT CAST(ts AS DATE) AS date, 'S' || CAST(user_id % 8 AS STRING) AS sym, CAST(60 * hour(ts) AS INT) AS bkt,
  CAST((dayofmonth(ts) * 7919 + hour(ts) * 1861 + (user_id % 8) * 101) % 1009 AS DOUBLE) / 1009 - CAST(0.5 AS DOUBLE) AS pred
FROM {events}""",
    ),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = VIEWS[name]
    filled = text.format(ntz="TIMESTAMP_NTZ", shift_ship=f"date_add(CAST(l_shipdate AS DATE), {SHIFT})", shift_order=f"date_add(CAST(o_orderdate AS DATE), {SHIFT})", **{source: "{" + source + "}"})
    return spark.sql(filled, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def oracle(select: str, *names: str, also: dict[str, str] | None = None) -> str:
    """The SQL of a query over the named views and further common tables."""
    parts = [f"{n} AS ({VIEWS[n][1].format(ntz='TIMESTAMP', shift_ship=f'CAST(l_shipdate AS DATE) + {SHIFT}', shift_order=f'CAST(o_orderdate AS DATE) + {SHIFT}', **{VIEWS[n][0]: VIEWS[n][0]})})" for n in names]
    parts += [f"{n} AS ({s})" for n, s in (also or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
