"""Graphs, orderings, projections, histories and runs that Spark derives from the given tables.

Each is one SQL text; {table} stands for a table, so that Spark and the checking engine read the same definition.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Parts bought one after the other in an order, before duplicates are summed.
STEPS = """SELECT l_partkey AS src, nxt AS tgt, q AS weight
FROM (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q,
             LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS nxt
      FROM {lineitem}) t WHERE nxt IS NOT NULL"""
PART_FLOW = f"SELECT src, tgt, CAST(SUM(weight) AS BIGINT) AS weight FROM ({STEPS}) s GROUP BY src, tgt"
UP_FLOW = f"SELECT src, tgt, weight FROM ({PART_FLOW}) p WHERE src % 7 < tgt % 7"
NATION_FLOW = """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS tgt, CAST(SUM(l_quantity) AS BIGINT) AS weight
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
GROUP BY c_nationkey, s_nationkey"""
#: A graph for each customer, of the parts bought one after the other.
CUSTOMER_FLOW = """SELECT o_custkey AS graph_id, src, tgt, CAST(SUM(q) AS BIGINT) AS weight
FROM (SELECT l_orderkey, l_partkey AS src, CAST(l_quantity AS BIGINT) AS q,
             LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS tgt
      FROM {lineitem}) s JOIN {orders} ON l_orderkey = o_orderkey WHERE tgt IS NOT NULL AND src <> tgt GROUP BY o_custkey, src, tgt"""
#: Mostly upward, with some cycles within a remainder.
MIXED_FLOW = UP_FLOW.replace("src % 7 < tgt % 7", "src % 7 < tgt % 7 OR (src % 7 = tgt % 7 AND (src + tgt) % 3 = 0)")
USER_FLOW = """SELECT user_id AS src, nxt AS tgt, ROUND(SUM(value), 4) AS weight
FROM (SELECT user_id, value, LEAD(user_id) OVER (PARTITION BY event_type, FLOOR(UNIX_SECONDS(CAST(ts AS TIMESTAMP)) / 86400) ORDER BY ts, event_id) AS nxt FROM {events}) t
WHERE nxt IS NOT NULL GROUP BY user_id, nxt"""
POSITIONS = "SELECT p_partkey AS node, p_retailprice AS pos FROM {part}"
POSITIONS_BY_RUN = """SELECT 'price' AS run, p_partkey AS node, p_retailprice AS pos FROM {part}
UNION ALL SELECT 'scatter' AS run, p_partkey AS node, CAST((p_partkey * 7919) % 100003 AS DOUBLE) AS pos FROM {part}
UNION ALL SELECT 'size' AS run, p_partkey AS node, p_size + p_partkey / 1000000.0D AS pos FROM {part}"""
PROJECTIONS = """SELECT l_orderkey AS exp_id, CAST(c_nationkey AS BIGINT) AS src_region, CAST(s_nationkey AS BIGINT) AS tgt_region, SUM(l_quantity - 5) AS value
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
GROUP BY l_orderkey, c_nationkey, s_nationkey"""
HISTORY = """SELECT user_id AS run, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter, value AS score,
       CAST(UNIX_SECONDS(CAST(ts AS TIMESTAMP)) - MIN(UNIX_SECONDS(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id) AS DOUBLE) AS elapsed
FROM {events}"""
RUNS = """SELECT o_orderpriority AS algo, o_orderstatus AS dataset, SUBSTRING(MD5(CONCAT(o_orderpriority, '-', CAST(CAST(FLOOR(o_custkey / 50) AS BIGINT) AS STRING))), 1, 12) AS config_hash, o_custkey AS seed, o_totalprice AS score,
       o_totalprice / 10000 AS pct, CAST(o_orderkey % 1000 AS DOUBLE) AS wall_clock_s,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE MD5(CAST(o_custkey % 5 AS STRING)) END AS git_commit, o_orderdate AS stamp, o_orderkey AS run_no
FROM {orders}"""
FEATURES = "SELECT vec_id AS id, label, embedding AS e FROM {embeddings}"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(sql: str) -> str:
    """The same text for the checking engine."""
    sql = re.sub(r"\{(\w+)\}", r"\1", sql)
    return sql.replace("UNIX_SECONDS(CAST(ts AS TIMESTAMP))", "CAST(FLOOR(EPOCH(ts)) AS BIGINT)").replace("1000000.0D", "CAST(1000000 AS DOUBLE)").replace("AS STRING)", "AS VARCHAR)")
