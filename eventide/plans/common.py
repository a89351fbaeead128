"""Registration of queries with their oracles, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def query(sql: str | None = None):
    """Register a query under its function's name; sql is what DuckDB must answer alike (None: held against brute force in the tests)."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """``(event_id, user_id, event_type, value, props, t)`` with t in microseconds; of some event types only, if any are named."""
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")  # of any session's time zone
    rows = table(spark, sf_dir, "events").withColumn("t", since).drop("ts")
    return rows.where(F.col("event_type").isin(*kinds)) if kinds else rows


#: The same in DuckDB: a CTE named e.
E = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t FROM events)"


def of_type(name: str, kind: str) -> str:
    return f"{name} AS (SELECT * FROM e WHERE event_type = '{kind}')"


def runs_sql(source: str, gap: int, name: str = "runs") -> str:
    """CTEs that number the runs of a source's users: <name>_fresh, <name>."""
    return f"""{name}_fresh AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {source}),
{name} AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM {name}_fresh)"""


def scores_sql(prefix: str = "") -> str:
    """precision, recall and f1 columns from tp, fp, fn."""
    p = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fn = 0 THEN 1e0 ELSE 0e0 END"
    r = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN tp + fp = 0 THEN 1e0 ELSE 0e0 END"
    return f"{p} AS {prefix}precision, {r} AS {prefix}recall, CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0e0 END AS {prefix}f1"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
