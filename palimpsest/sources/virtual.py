"""A versioned repository derived from the plain tables, as views in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "va_version": """SELECT o_custkey AS artifact_id, o_orderkey AS version_id, seq, parent_id,
  CASE WHEN o_orderstatus = 'O' THEN 'staging' ELSE 'committed' END AS status,
  CASE WHEN seq = 1 OR o_orderkey % 5 = 0 THEN 'state' WHEN o_orderkey % 5 = 1 THEN 'cumulative_delta' ELSE 'delta' END AS representation
  FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id FROM {orders}) o""",
    "va_hunk": """SELECT artifact_id, version_id, seq, partition_id,
  CASE WHEN row_number() OVER (PARTITION BY artifact_id, partition_id ORDER BY seq) = 1 THEN 'state' ELSE representation END AS representation
  FROM (SELECT DISTINCT v.artifact_id, v.version_id, v.seq, CAST(l.l_linenumber % 4 AS INT) AS partition_id, v.representation
    FROM {lineitem} l JOIN {va_version} v ON l.l_orderkey = v.version_id) h""",
    "va_payload": """SELECT l_orderkey AS version_id, CAST(l_linenumber % 4 AS INT) AS partition_id, l_suppkey AS key,
  CAST(sum(l_quantity) AS BIGINT) AS value FROM {lineitem} GROUP BY l_orderkey, CAST(l_linenumber % 4 AS INT), l_suppkey""",
    "vd_edge": """SELECT DISTINCT source, dependent FROM (
  SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS source, p_partkey AS dependent FROM {part} WHERE p_partkey >= 1
  UNION ALL SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM {part} WHERE p_partkey >= 1) e WHERE source <> dependent""",
    "vb_blob": """SELECT p_partkey AS artifact_id, p_name AS state_text, CAST(p_size % length(p_name) AS BIGINT) AS idx FROM {part}""",
    "vr_branch": """SELECT n_nationkey AS ref_artifact, n_name AS branch, 'HEAD' AS path, max(o_orderkey) AS version_id
  FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey GROUP BY n_nationkey, n_name""",
    # All updates of a branch, newest last; two paths.
    "vr_log": """SELECT n_nationkey AS ref_artifact, n_name AS branch, path, o_orderkey AS version_id, o_orderkey AS txn
  FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, o_orderkey, 'HEAD' AS path FROM {orders}
    UNION ALL SELECT o_custkey, o_orderkey, 'squash' FROM {orders} WHERE o_orderkey % 2 = 1) u ON o_custkey = c_custkey""",
    # Hunks as their versions declare them, so some partitions have no state.
    "va_raw": """SELECT DISTINCT v.artifact_id, v.version_id, v.seq, CAST(l.l_linenumber % 4 AS INT) AS partition_id, v.representation
  FROM {lineitem} l JOIN {va_version} v ON l.l_orderkey = v.version_id""",
    # Producers of three parts each; some parts have further versions, and some producers have been run.
    "vl_dep": """SELECT CAST(-1 - floor(p_partkey / 3) AS BIGINT) AS producer, p_partkey AS dependency FROM {part}""",
    "vl_version": """SELECT p_partkey AS artifact_id FROM {part} UNION ALL SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 50
  UNION ALL SELECT DISTINCT CAST(-1 - p_partkey AS BIGINT) FROM {part} WHERE p_partkey % 5 = 0""",
    # Descriptions of graphs: some name nodes that exist already, some lack an id.
    "vg_node": """SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS graph, p_partkey AS node, p_size % 10 = 0 AS existing,
  CASE WHEN p_size % 10 <> 1 THEN p_name END AS id FROM {part}""",
    "vg_edge": """SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS graph, p_partkey - 1 AS source, p_partkey AS dependent FROM {part} WHERE p_partkey % 4 > 0""",
    "vp_dep": """SELECT CAST(-1 - c_nationkey AS BIGINT) AS producer, c_custkey AS dependency, 'input' AS relation FROM {customer}""",
    "ve_log": """SELECT user_id AS key, event_id AS seq, event_type AS value FROM {events}""",
    # Producer versions: one for every version of an artifact and the version before it, of the same or the next artifact.
    "vp_used": """SELECT version_id AS producer_version, version_id AS dependency, 'input' AS relation FROM {va_version}
  UNION ALL SELECT version_id, parent_id, 'base' FROM {va_version} WHERE parent_id IS NOT NULL""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view_sql(name: str, dialect: str = "duckdb", sf_dir: str = "") -> str:
    """SELECT of a view with all it needs put in place; in Spark, tables are the Parquet files themselves."""
    names = {t: t if dialect == "duckdb" else f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    text = VIEWS[name]
    while "{" in text:
        used = {v: f"({VIEWS[v]})" for v in VIEWS if f"{{{v}}}" in text}
        text = text.format(**(names | used))
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(view_sql(name, "spark", sf_dir))
