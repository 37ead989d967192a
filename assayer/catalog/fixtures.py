"""Derived input views: the same deterministic expression for Spark and for the SQL check.

The test tables have no null, no duplicate row and no malformed text, so the cleaning operators get views
of the whole tables in which such values are planted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.session import settled


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles of a result, so that summation order does not show in a value hash."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, digits) + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name))
    return df.select(*out)


def r(sql: str, cols: str, digits: int = 6) -> str:
    """The same rounding for a SQL text: ``cols`` are the double columns, blank separated."""
    rep = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols.split())
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS res"


def per_column(cols: str, template: str) -> str:
    """``template`` with {c} replaced by every column, UNION ALL-ed."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in cols.split())


# Views as SQL; Spark runs a dialect-adjusted copy of exactly this text.
VIEWS = {
    "orders_dirty": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 5 = 0 THEN concat(' ', lower(o_orderpriority), '  ') ELSE o_orderpriority END AS o_orderpriority,
               CASE WHEN o_orderkey % 50 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS o_orderdate
        FROM orders""",
    "orders_dup": """
        SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "customer_text": """
        SELECT c_custkey, c_name, c_mktsegment,
               concat(CASE WHEN c_custkey % 3 = 0 THEN '$' ELSE '' END, CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR)) AS balance,
               CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS balance_number,
               CASE WHEN c_custkey % 20 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR)) ELSE concat('user', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
               CASE WHEN c_custkey % 25 = 0 THEN 'n/a' ELSE concat('1', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) END AS phone,
               concat(lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST(c_custkey AS VARCHAR), 4, '0')) AS ssn,
               lpad(CAST(c_custkey * 7 % 100000 AS VARCHAR), 5, '0') AS zip,
               concat(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '-0000-4000-8000-', lpad(CAST(c_custkey * 31 AS VARCHAR), 12, 'a')) AS uuid,
               concat(CAST(c_custkey % 101 AS VARCHAR), '%') AS percent_text,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('20', lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0'), '-0', CAST(1 + c_custkey % 9 AS VARCHAR), '-1', CAST(c_custkey % 10 AS VARCHAR)) END AS signup_date,
               CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ' padded ' WHEN c_custkey % 2 = 0 THEN 'UPPER' ELSE 'lower' END AS note,
               CASE WHEN c_custkey % 13 = 0 THEN 'null' WHEN c_custkey % 17 = 0 THEN '' ELSE 'ok' END AS status
        FROM customer""",
    "events_gaps": """
        SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events""",
    "events_ref": "SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'",
    "events_cur": """
        SELECT event_id, ts, user_id,
               CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'crash' ELSE event_type END AS event_type,
               CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_type = 'purchase' THEN value + 5 ELSE value END AS value
        FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'""",
    "pred_binary": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus AS grp,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
               least(greatest(round(5 * l_discount + 0.01 * (l_partkey % 50), 4), 0.0), 1.0) AS p,
               CASE WHEN least(greatest(round(5 * l_discount + 0.01 * (l_partkey % 50), 4), 0.0), 1.0) >= 0.5 THEN 1 ELSE 0 END AS yhat
        FROM lineitem""",
    "pred_multi": """
        SELECT o_orderkey, o_orderstatus AS y,
               CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END ELSE o_orderstatus END AS yhat
        FROM orders""",
    "pred_reg": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice AS y, l_quantity * 1500.0 AS yhat
        FROM lineitem""",
    "const_cols": """
        SELECT p_partkey, p_brand, p_size, p_retailprice, 'same' AS constant_text, 1.5 AS constant_number,
               CAST(NULL AS VARCHAR) AS empty_text, concat('K', CAST(p_partkey AS VARCHAR)) AS part_id
        FROM part""",
}


def _spark_text(sql: str) -> str:
    sql = re.sub(r"\bVARCHAR\b", "STRING", sql)
    return sql.replace("1.5 AS constant_number", "CAST(1.5 AS DOUBLE) AS constant_number") \
        .replace("0.01 *", "0.01D *").replace("0.0), 1.0)", "0.0D), 1.0D)").replace("1500.0", "1500.0D")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables of ``sf``."""
    sql = _spark_text(VIEWS[name])
    frames = {}
    for t in ("orders", "customer", "events", "lineitem", "part"):
        if re.search(rf"\bFROM {t}\b", sql):
            sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
            frames[t] = load(spark, sf, t)
    return spark.sql(sql, **frames)


def settled_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The view cut once per session and folder, its rows dealt evenly to tasks, for queries that scan it many times."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _settled:
        _settled[key] = settled(view(spark, sf, name))
    return _settled[key]


_settled: dict[tuple, DataFrame] = {}


def with_views(names: str, sql: str) -> str:
    """``sql`` with the named views as CTEs."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].replace('1.5 AS constant_number', 'CAST(1.5 AS DOUBLE) AS constant_number')})" for n in names.split())
    return f"WITH {ctes}\n{sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes}, {sql.lstrip()[5:]}"
