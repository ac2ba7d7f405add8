"""Registered queries of the versioned-data engine and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import specifiers
from .operators import compose, lineage, partitioning, production
from .registry import cardinality_check
from .sources.store import keep
from .sources.virtual import VIEWS, view, view_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql
            for name in sorted(VIEWS, key=len, reverse=True):
                text = text.replace(f"${name}", f"({view_sql(name)})")
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def _parents(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "va_version").where("parent_id is not null").select("version_id", "parent_id", "artifact_id")


# Versions


@query("SELECT artifact_id, version_id, seq FROM $va_version v WHERE NOT EXISTS (SELECT 1 FROM $va_version c WHERE c.parent_id = v.version_id)")
def tips(s, d):
    v = view(s, d, "va_version")
    return lineage.tips(v.select("artifact_id", "version_id", "seq"), v.where("parent_id is not null").select("parent_id"))


@query("SELECT DISTINCT source AS node FROM $vd_edge WHERE source NOT IN (SELECT dependent FROM $vd_edge)")
def source_artifacts(s, d):
    e = view(s, d, "vd_edge")
    return lineage.sources(e.select(F.col("source").alias("node")).distinct(), e)


@query("SELECT DISTINCT dependent AS node FROM $vd_edge WHERE dependent NOT IN (SELECT source FROM $vd_edge)")
def sink_artifacts(s, d):
    e = view(s, d, "vd_edge")
    return lineage.sinks(e.select(F.col("dependent").alias("node")).distinct(), e)


@query("SELECT version_id, parent_id FROM $va_version WHERE parent_id IS NOT NULL")
def parents(s, d):
    return lineage.parents(_parents(s, d), view(s, d, "va_version"))


@query("SELECT artifact_id, count(*) AS versions, count(*) FILTER (WHERE status = 'committed') AS committed FROM $va_version GROUP BY artifact_id")
def artifact_versions(s, d):
    return view(s, d, "va_version").groupBy("artifact_id").agg(F.count("*").alias("versions"), F.count(F.when(F.col("status") == "committed", 1)).alias("committed"))


@query("SELECT producer_version AS node, dependency AS neighbor FROM $vp_used WHERE relation = 'base' UNION SELECT dependency, producer_version FROM $vp_used WHERE relation = 'base'")
def related_versions(s, d):
    e = view(s, d, "vp_used").select(F.col("producer_version").alias("dependent"), F.col("dependency").alias("source"), "relation")
    nodes = e.select(F.explode(F.array("source", "dependent")).alias("node")).distinct()
    return lineage.neighbors(e, nodes, relation="base")


@query("SELECT v.version_id, coalesce(p.version_id, v.version_id) AS partitioning FROM $va_version v LEFT JOIN $va_version p ON p.artifact_id = v.artifact_id AND p.seq = 1 AND v.seq > 1")
def version_partitioning(s, d):
    v = view(s, d, "va_version").select("artifact_id", "version_id", "seq", (F.col("seq") == 1).alias("self_partitioning"))
    first = v.where("seq = 1").select("artifact_id", F.col("version_id").alias("source"))
    relations = v.where("seq > 1").join(first, "artifact_id").select("source", F.col("version_id").alias("dependent"), F.lit("Partitioning").alias("name"))
    return lineage.partitioning(v, relations)


@query("SELECT dependent AS node, count(*) AS n FROM $vd_edge GROUP BY dependent HAVING count(*) > 1")
def merge_nodes(s, d):
    return view(s, d, "vd_edge").groupBy(F.col("dependent").alias("node")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT DISTINCT producer_version AS version_id FROM $vp_used WHERE dependency IN (SELECT parent_id FROM $va_version WHERE parent_id IS NOT NULL)")
def stale_versions(s, d):
    return production.stale_versions(view(s, d, "vp_used"), _parents(s, d))


# Artifact graphs


def _closure(s, d, upward):
    e = view(s, d, "vd_edge")
    seeds = e.select(F.explode(F.array("source", "dependent")).alias("node")).distinct()
    return lineage.closure(e, seeds, upward, keep)


@query("WITH RECURSIVE r(node, reached) AS (SELECT dependent, source FROM $vd_edge UNION SELECT r.node, e.source FROM r JOIN $vd_edge e ON e.dependent = r.reached) SELECT node, reached FROM r")
def artifact_ancestors(s, d):
    return _closure(s, d, True)


@query("WITH RECURSIVE r(node, reached) AS (SELECT source, dependent FROM $vd_edge UNION SELECT r.node, e.dependent FROM r JOIN $vd_edge e ON e.source = r.reached) SELECT node, reached FROM r")
def artifact_descendants(s, d):
    return _closure(s, d, False)


@query("WITH RECURSIVE n AS (SELECT source AS node FROM $vd_edge UNION SELECT dependent FROM $vd_edge), r(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.dependent, r.level + 1 FROM r JOIN $vd_edge e ON e.source = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def toposort_levels(s, d):
    e = view(s, d, "vd_edge")
    return lineage.topo_levels(e.select(F.explode(F.array("source", "dependent")).alias("node")), e, keep)


@query("SELECT source AS node, dependent AS neighbor FROM $vd_edge UNION SELECT dependent, source FROM $vd_edge")
def neighbors(s, d):
    e = view(s, d, "vd_edge")
    return lineage.neighbors(e, e.select(F.explode(F.array("source", "dependent")).alias("node")).distinct())


@query("SELECT CAST(-1 AS BIGINT) AS source, node AS dependent, 'dtype' AS edge_type, 'Partitioning' AS name FROM (SELECT source AS node FROM $vd_edge UNION SELECT dependent FROM $vd_edge) WHERE node % 4 <> 0")
def uniform_partitioning_edges(s, d):
    e = view(s, d, "vd_edge")
    nodes = e.select(F.explode(F.array("source", "dependent")).alias("node")).distinct()
    have = nodes.where("node % 4 = 0").select(F.lit(-2).cast("long").alias("source"), F.col("node").alias("dependent"), F.lit("Partitioning").alias("name"))
    return lineage.uniform_partitioning(nodes, have, F.lit(-1).cast("long"))


@query("SELECT source, dependent FROM $vd_edge WHERE dependent % 5 <> 0 UNION SELECT dependent + 1000000, dependent FROM $vd_edge")
def graph_delta_apply(s, d):
    e = view(s, d, "vd_edge")
    return lineage.apply_graph_delta(e, e.select((F.col("dependent") + 1000000).alias("source"), "dependent").distinct(), e.where("dependent % 5 = 0"), ["source", "dependent"])


@query("SELECT source, dependent, 'left' AS side FROM $vd_edge WHERE dependent % 5 = 0 UNION ALL SELECT dependent + 1000000, dependent, 'right' FROM (SELECT DISTINCT dependent FROM $vd_edge WHERE dependent % 5 <> 0)")
def graph_diff(s, d):
    e = view(s, d, "vd_edge")
    kept = e.where("dependent % 5 <> 0")
    return lineage.graph_diff(e, kept.union(kept.select(F.col("dependent") + 1000000, "dependent").distinct()))


@query("""WITH RECURSIVE e AS (SELECT * FROM $vd_edge), need AS (SELECT dependent, count(*) AS n FROM e GROUP BY dependent),
h(node, hash) USING KEY (node) AS (SELECT DISTINCT source, md5('|' || CAST(source AS VARCHAR)) FROM e WHERE source NOT IN (SELECT dependent FROM e)
  UNION SELECT e.dependent, md5(string_agg(r.hash, ',' ORDER BY r.hash) || '|' || CAST(e.dependent AS VARCHAR)) FROM e JOIN recurring.h r ON r.node = e.source JOIN need ON need.dependent = e.dependent
    WHERE e.dependent NOT IN (SELECT node FROM recurring.h) GROUP BY e.dependent, need.n HAVING count(*) = need.n)
SELECT node, hash FROM h""")
def artifact_hash_levels(s, d):
    e = view(s, d, "vd_edge")
    nodes = e.select(F.explode(F.array("source", "dependent")).alias("node")).distinct().withColumn("content", F.col("node").cast("string"))
    return lineage.hashes(nodes, e, keep)


@query("SELECT version_id AS node, min(version_id) OVER (PARTITION BY artifact_id) AS component FROM $va_version")
def version_components(s, d):
    v, p = view(s, d, "va_version"), _parents(s, d)
    return lineage.components(v.select(F.col("version_id").alias("node")), p.select(F.col("parent_id").alias("source"), F.col("version_id").alias("dependent")), keep)


@query("""WITH RECURSIVE n AS (SELECT source AS node FROM $vd_edge UNION SELECT dependent FROM $vd_edge), r(node, reached) AS (SELECT node, node FROM n UNION SELECT r.node, e.source FROM r JOIN $vd_edge e ON e.dependent = r.reached),
p AS (SELECT node AS a, node + 1 AS b FROM n WHERE node + 1 IN (SELECT node FROM n)),
c AS (SELECT p.a, p.b, x.reached AS ancestor FROM p JOIN r x ON x.node = p.a JOIN r y ON y.node = p.b AND y.reached = x.reached)
SELECT a, b, ancestor FROM c WHERE NOT EXISTS (SELECT 1 FROM c k JOIN r ON r.node = k.ancestor AND r.node <> r.reached WHERE k.a = c.a AND k.b = c.b AND r.reached = c.ancestor)""")
def common_ancestors(s, d):
    """Lowest common ancestors of each node and the next."""
    e = view(s, d, "vd_edge")
    nodes = e.select(F.explode(F.array("source", "dependent")).alias("node")).distinct()
    pairs = nodes.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    return lineage.common_ancestors(pairs, e, keep)


@query("""SELECT graph, bool_and(NOT existing) AS independent, bool_and(existing OR id IS NOT NULL) AND NOT coalesce(any_value(hit), FALSE) AS valid_payload,
bool_and(NOT existing) AND bool_and(existing OR id IS NOT NULL) AND NOT coalesce(any_value(hit), FALSE) AS valid_state
FROM $vg_node n LEFT JOIN (SELECT e.graph, bool_or(t.existing) AS hit FROM $vg_edge e JOIN $vg_node t ON t.graph = e.graph AND t.node = e.dependent GROUP BY e.graph) h USING (graph) GROUP BY graph""")
def description_validity(s, d):
    return lineage.description_validity(view(s, d, "vg_node"), view(s, d, "vg_edge"))


_AT = """WITH h AS (SELECT artifact_id AS graph, partition_id, version_id AS hunk, ord FROM ({c}) c), m AS (
  SELECT version_id AS hunk, partition_id, key AS node, value % 3 = 0 AS gone FROM $va_payload)
SELECT graph, node FROM (SELECT graph, node, min_by(gone, ord * 2 + gone::INT) AS gone FROM h JOIN m ON m.hunk = h.hunk AND m.partition_id = h.partition_id GROUP BY graph, node) WHERE NOT gone"""


def _graph_hunks(s, d, where):
    """The hunks of a graph artifact's newest version, one partition each; a hunk takes out every key whose value is
    divisible by 3 and puts in the others."""
    c = _map(s, d, where).where("partition_id = 0").select(F.col("artifact_id").alias("graph"), F.col("version_id").alias("hunk"), "ord", "representation")
    p = view(s, d, "va_payload").where("partition_id = 0").select(F.col("version_id").alias("hunk"), F.col("key").alias("node"), (F.col("value") % 3 == 0).alias("gone"))
    return c, p.where("not gone").drop("gone"), p.where("gone").drop("gone")


# Composition


@query("SELECT h.version_id, h.partition_id, v.representation AS version_representation, h.representation, CASE v.representation WHEN 'state' THEN h.representation = 'state' WHEN 'cumulative_delta' THEN h.representation <> 'delta' ELSE TRUE END AS valid FROM $va_hunk h JOIN $va_version v ON v.version_id = h.version_id")
def hunk_validity(s, d):
    v = view(s, d, "va_version").select("version_id", F.col("representation").alias("version_representation"))
    h = view(s, d, "va_hunk").join(v, "version_id")
    return h.select("version_id", "partition_id", "version_representation", "representation", compose.hunk_is_valid(F.col("version_representation"), F.col("representation"), F.lit(None)).alias("valid"))


_C1 = """SELECT artifact_id, partition_id, version_id, ord, representation FROM (SELECT *, row_number() OVER w - 1 AS ord,
  count(*) FILTER (WHERE representation = 'state') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS states,
  count(*) FILTER (WHERE representation = 'cumulative_delta') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum
  FROM $va_hunk WHERE %s WINDOW w AS (PARTITION BY artifact_id, partition_id ORDER BY seq DESC)) WHERE states = 0%s"""
_CUMULATIVE = " AND (cum = 0 OR representation = 'state')"


def _map(s, d, where="true", cumulative=True):
    return compose.composition_map(view(s, d, "va_hunk").where(where), ["artifact_id", "partition_id"], "seq", cumulative).select("artifact_id", "partition_id", "version_id", "ord", "representation")


@query(_C1 % ("TRUE", ""))
def composition_map(s, d):
    return _map(s, d, cumulative=False)


@query(_C1 % ("TRUE", _CUMULATIVE))
def composition_cumulative(s, d):
    return _map(s, d)


@query(_AT.format(c=(_C1 % ("partition_id = 0", _CUMULATIVE)).replace("%", "%")))
def graph_at_version(s, d):
    return lineage.graph_at(*_graph_hunks(s, d, "true"), ["node"])


@query(_AT.format(c=(_C1 % ("partition_id = 0 AND seq <= 4", _CUMULATIVE))))
def graph_at_earlier_version(s, d):
    return lineage.graph_at(*_graph_hunks(s, d, "seq <= 4"), ["node"])


def _with_locks(s, d):
    """Every hunk whose version is divisible by 7 locks its partition until two hunks below it."""
    w = "row_number() over (partition by artifact_id, partition_id order by seq desc) - 1"
    return view(s, d, "va_hunk").select("artifact_id", "partition_id", F.expr(w).cast("long").alias("ord"), "representation", "version_id").withColumn("prec", F.when((F.col("version_id") % 7 == 0) & (F.col("representation") != "state"), F.col("ord") + 2))


@query("""WITH RECURSIVE h AS (SELECT artifact_id, partition_id, version_id, representation, row_number() OVER (PARTITION BY artifact_id, partition_id ORDER BY seq DESC) - 1 AS ord FROM $va_hunk),
r AS (SELECT artifact_id AS a, partition_id AS p, ord, representation, CASE WHEN version_id % 7 = 0 THEN ord + 2 ELSE ord + 1 END AS next, [CAST(ord AS BIGINT)] AS kept FROM h WHERE ord = 0
  UNION ALL SELECT a, p, h.ord, h.representation, CASE WHEN version_id % 7 = 0 THEN h.ord + 2 ELSE h.ord + 1 END, list_append(kept, CAST(h.ord AS BIGINT)) FROM r JOIN h ON h.artifact_id = a AND h.partition_id = p AND h.ord = r.next WHERE r.representation <> 'state')
SELECT a AS artifact_id, p AS partition_id, array_to_string(max_by(kept, ord), ',') AS kept, bool_or(representation = 'state') AS done FROM r GROUP BY a, p""")
def composition_precedence(s, d):
    return compose.composition_with_precedence(_with_locks(s, d), ["artifact_id", "partition_id"]).withColumn("kept", F.array_join("kept", ","))


_C2 = f"SELECT artifact_id, c.partition_id, key, min_by(value, ord) AS value FROM ({_C1 + _CUMULATIVE}) c JOIN $va_payload p ON p.version_id = c.version_id AND p.partition_id = c.partition_id GROUP BY artifact_id, c.partition_id, key"


def _C2_AT(where: str) -> str:  # noqa: N802
    """SQL of the composite state over the hunks of the versions that ``where`` names."""
    return _C2.replace("%s", where, 1).replace("%s", "")


@query("SELECT artifact_id, partition_id FROM $va_raw GROUP BY artifact_id, partition_id HAVING count(*) FILTER (WHERE representation = 'state') = 0")
def unfulfilled_partitions(s, d):
    made = compose.composition_map(view(s, d, "va_raw"), ["artifact_id", "partition_id"], "seq")
    return compose.unfulfilled(made, ["artifact_id", "partition_id"])


@query("""WITH base AS ({b}), a AS ({a}), c AS ({c}), one AS (SELECT artifact_id, partition_id, key, a.value AS value FROM a FULL JOIN base USING (artifact_id, partition_id, key) WHERE a.value IS DISTINCT FROM base.value),
two AS (SELECT artifact_id, partition_id, key, c.value AS value FROM c FULL JOIN base USING (artifact_id, partition_id, key) WHERE c.value IS DISTINCT FROM base.value)
SELECT artifact_id, partition_id, key, one.value AS ours, two.value AS theirs, one.value IS NOT DISTINCT FROM two.value AS same FROM one JOIN two USING (artifact_id, partition_id, key)""".format(b=_C2_AT("seq <= 2"), a=_C2_AT("seq <= 4"), c=_C2_AT("seq <= 2 OR seq = 5")))
def merge_conflicts(s, d):
    """Keys that two lines of versions, from the second version on, have both changed."""
    return compose.merge_conflicts(_state(s, d, "seq <= 2"), _state(s, d, "seq <= 4"), _state(s, d, "seq <= 2 or seq = 5"), ["artifact_id", "partition_id", "key"])


def _state(s, d, where="true"):
    return compose.composite_state(_map(s, d, where), view(s, d, "va_payload"), ["version_id", "partition_id"], ["artifact_id", "partition_id"])


@query(_C2.replace("%s", "TRUE", 1).replace("%s", ""))
def composite_state(s, d):
    return _state(s, d)


@query(_C2.replace("%s", "seq <= 3", 1).replace("%s", ""))
def state_at_version(s, d):
    return _state(s, d, "seq <= 3")


@query("""WITH a AS ({a}), b AS ({b}) SELECT artifact_id, partition_id, key, a.value AS old, b.value AS new, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (artifact_id, partition_id, key) WHERE a.value IS DISTINCT FROM b.value""".format(a=_C2.replace("%s", "seq <= 3", 1).replace("%s", ""), b=_C2.replace("%s", "seq <= 6", 1).replace("%s", "")))
def version_diff(s, d):
    return compose.version_diff(_state(s, d, "seq <= 3"), _state(s, d, "seq <= 6"), ["artifact_id", "partition_id", "key"])


@query(_C2.replace("%s", "TRUE", 1).replace("%s", ""))
def compaction(s, d):
    """The composite state written as one state hunk at the newest version, and composed again."""
    state = _state(s, d)
    hunks = state.select("artifact_id", "partition_id").distinct().select("artifact_id", "partition_id", F.lit(0).alias("seq"), F.lit("state").alias("representation"), F.col("artifact_id").alias("version_id"))
    again = compose.composition_map(hunks, ["artifact_id", "partition_id"], "seq")
    return compose.composite_state(again, state.select(F.col("artifact_id").alias("version_id"), "partition_id", "key", "value"), ["version_id", "partition_id"], ["artifact_id", "partition_id"])


@query("SELECT artifact_id, substr(state_text, 1, CAST(idx AS INTEGER)) || 'X' || substr(state_text, CAST(idx AS INTEGER) + 2) AS state FROM $vb_blob")
def blob_compose(s, d):
    b = view(s, d, "vb_blob")
    return b.select("artifact_id", compose.blob_compose(F.encode("state_text", "UTF-8"), F.array("idx"), F.encode(F.lit("X"), "UTF-8")).cast("string").alias("state"))


@query("SELECT artifact_id, translate(hex(encode(state_text)), '0123456789ABCDEF', 'FEDCBA9876543210') AS negated FROM $vb_blob")
def blob_negate(s, d):
    return view(s, d, "vb_blob").select("artifact_id", F.hex(compose.blob_negate(F.encode("state_text", "UTF-8"))).alias("negated"))


@query("SELECT artifact_id, state_text AS state FROM $vb_blob")
def double_negate_identity(s, d):
    return view(s, d, "vb_blob").select("artifact_id", compose.blob_negate(compose.blob_negate(F.encode("state_text", "UTF-8"))).cast("string").alias("state"))


@query("SELECT DISTINCT artifact_id, partition_id FROM $va_hunk")
def partition_ids(s, d):
    sets = view(s, d, "va_hunk").groupBy("artifact_id").agg(F.array_sort(F.collect_set("partition_id")).alias("partition_ids"))
    return sets.select("artifact_id", F.explode("partition_ids").alias("partition_id"))


@query("""SELECT partition_id, count(*) AS n FROM (SELECT greatest(0, least(9, CAST(floor((l_quantity - 1) * (10 / 49.0)) AS BIGINT))) * 8 + greatest(0, least(7, CAST(floor((l_discount - 0.01) * (8 / 0.08)) AS BIGINT))) AS partition_id FROM lineitem) GROUP BY partition_id""")
def grid_partitions(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", "l_discount")
    return partitioning.grid_partitions(rows, {"l_quantity": (1.0, 50.0, 10), "l_discount": (0.01, 0.09, 8)}).groupBy("partition_id").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT p_size - 1 AS id FROM part), x AS (SELECT id, id // 10 AS a, id % 10 AS b FROM c)
SELECT CAST(id AS BIGINT) AS partition_id, CAST((a + da) * 10 + b + db AS BIGINT) AS neighbor FROM x, (VALUES (-1), (0), (1)) t(da), (VALUES (-1), (0), (1)) u(db)
WHERE a + da BETWEEN 0 AND 4 AND b + db BETWEEN 0 AND 9 AND (da <> 0 OR db <> 0)""")
def grid_neighbors(s, d):
    cells = s.read.parquet(f"{d}/part.parquet").select((F.col("p_size") - 1).cast("long").alias("partition_id")).distinct()
    return partitioning.grid_neighbors(cells, [5, 10])


@query("SELECT h.version_id, h.partition_id, h.representation, coalesce(sum(value), 0) AS total FROM $va_hunk h LEFT JOIN $va_payload p ON p.version_id = h.version_id AND p.partition_id = h.partition_id WHERE h.partition_id IN (1, 3) GROUP BY ALL")
def hunks_of_partitions(s, d):
    p = view(s, d, "va_payload").where("partition_id in (1, 3)").groupBy("version_id", "partition_id").agg(F.sum("value").alias("v"))
    return view(s, d, "va_hunk").where("partition_id in (1, 3)").join(p, ["version_id", "partition_id"], "left").select("version_id", "partition_id", "representation", F.coalesce("v", F.lit(0)).alias("total"))


# Production


@query("""WITH hit AS (SELECT DISTINCT u.producer_version, v.version_id AS new_version, v.parent_id AS parent FROM $vp_used u JOIN $va_version v ON v.parent_id = u.dependency)
SELECT hit.new_version, hit.producer_version, string_agg(DISTINCT u.relation || ':' || CAST(CASE WHEN u.dependency = hit.parent THEN hit.new_version ELSE u.dependency END AS VARCHAR), ',' ORDER BY u.relation || ':' || CAST(CASE WHEN u.dependency = hit.parent THEN hit.new_version ELSE u.dependency END AS VARCHAR)) AS deps
FROM hit JOIN $vp_used u ON u.producer_version = hit.producer_version GROUP BY 1, 2""")
def extant_specs(s, d):
    new = _parents(s, d).select(F.col("version_id").alias("new_version"), F.col("parent_id").alias("parent"))
    out = production.extant_specs(new, view(s, d, "vp_used"))
    return out.withColumn("deps", F.array_join(F.array_sort(F.transform("deps", lambda x: F.concat(x["relation"], F.lit(":"), x["dependency"].cast("string")))), ","))


@query("SELECT producer FROM (SELECT producer, bool_and(coalesce(n, 0) = 1) AS ok FROM $vl_dep p LEFT JOIN (SELECT artifact_id, count(*) AS n FROM $vl_version GROUP BY 1) c ON c.artifact_id = p.dependency GROUP BY producer) WHERE ok AND producer NOT IN (SELECT artifact_id FROM $vl_version)")
def leaf_bootstrap_specs(s, d):
    return production.leaf_bootstrap(view(s, d, "vl_dep"), view(s, d, "vl_version"))


@query("SELECT u.producer_version, u.dependency, u.relation FROM $vp_used u WHERE producer_version IN (SELECT version_id FROM $vr_branch)")
def tracking_specs(s, d):
    return production.tracking_specs(view(s, d, "vp_used"), view(s, d, "vr_branch").select(F.col("version_id").alias("producer_version")))


@query("SELECT deps, string_agg(DISTINCT CAST(parent AS VARCHAR), ',' ORDER BY CAST(parent AS VARCHAR)) AS parents FROM (SELECT 'd' || CAST(parent_id % 100 AS VARCHAR) AS deps, version_id AS parent FROM $va_version WHERE parent_id IS NOT NULL) GROUP BY deps")
def spec_merge(s, d):
    specs = _parents(s, d).select(F.concat(F.lit("d"), (F.col("parent_id") % 100).cast("string")).alias("deps"), F.col("version_id").cast("string").alias("parent"))
    return production.merge_specs(specs).withColumn("parents", F.array_join("parents", ","))


@query("""WITH o AS (SELECT v.artifact_id AS case_id, h.partition_id % 2 AS strategy, h.partition_id AS output, h.representation FROM $va_hunk h JOIN $va_version v ON v.version_id = h.version_id),
l AS (SELECT case_id, strategy, output, min(CASE representation WHEN 'state' THEN 3 WHEN 'cumulative_delta' THEN 2 ELSE 1 END) AS w FROM o GROUP BY ALL), c AS (SELECT case_id, strategy, sum(w) AS cost FROM l GROUP BY ALL)
SELECT case_id, strategy, CAST(cost AS BIGINT) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY cost, strategy) AS r FROM c) WHERE r = 1""")
def select_strategy(s, d):
    h = view(s, d, "va_hunk")
    return production.select_strategy(h.select(F.col("artifact_id").alias("case_id"), (F.col("partition_id") % 2).alias("strategy"), F.col("partition_id").alias("output"), "representation"))


@query("""SELECT artifact_id AS case_id, strategy, bool_and(CASE strategy WHEN 'any' THEN TRUE ELSE representation = 'state' END) AS ok FROM $va_hunk, (VALUES ('any'), ('state')) t(strategy) WHERE partition_id < 2 GROUP BY ALL""")
def capability_match(s, d):
    inputs = view(s, d, "va_hunk").select(F.col("artifact_id").alias("case_id"), F.concat(F.lit("p"), F.col("partition_id").cast("string")).alias("name"), "representation")
    rows = [(k, p, r) for k, r in (("any", ["state", "delta", "cumulative_delta"]), ("state", ["state"])) for p in ("p0", "p1")]
    return production.capability_match(inputs, s.createDataFrame(rows, "strategy string, name string, representations array<string>"))


@query("SELECT producer AS dependent, relation AS name, count(*) AS n, count(*) BETWEEN 1 AND 60 AS ok FROM $vp_dep GROUP BY ALL")
def dependency_cardinality(s, d):
    edges = view(s, d, "vp_dep").select(F.col("producer").alias("dependent"), F.col("relation").alias("name"))
    return cardinality_check(edges, s.createDataFrame([("input", 1, 60)], "name string, least int, most int"))


# References and logs


@query("SELECT ref_artifact, branch, path, version_id FROM $vr_branch")
def branch_tips(s, d):
    """The last version that the log of each branch has for HEAD."""
    return lineage.latest(view(s, d, "vr_log"), ["ref_artifact", "branch", "path"], ["txn"]).where("path = 'HEAD'").drop("txn")


@query("SELECT ref_artifact, branch, path, coalesce(v.version_id, b.version_id) AS version_id FROM $vr_branch b LEFT JOIN $va_version v ON v.parent_id = b.version_id AND b.ref_artifact % 2 = 0")
def upsert_tips(s, d):
    b, v = view(s, d, "vr_branch"), view(s, d, "va_version").select(F.col("version_id").alias("new"), "parent_id")
    new = b.where("ref_artifact % 2 = 0").join(v, b["version_id"] == v["parent_id"]).select("ref_artifact", "branch", "path", F.col("new").alias("version_id"))
    log = b.withColumn("txn", F.lit(0)).unionByName(new.withColumn("txn", F.lit(1)))
    return lineage.latest(log, ["ref_artifact", "branch", "path"], ["txn"]).drop("txn")


@query("""WITH RECURSIVE w(spec, version_id, steps) AS (SELECT branch || '~' || CAST(ref_artifact % 7 AS VARCHAR), version_id, ref_artifact % 7 FROM $vr_branch
  UNION ALL SELECT w.spec, v.parent_id, w.steps - 1 FROM w JOIN $va_version v ON v.version_id = w.version_id WHERE w.steps > 0)
SELECT spec, version_id FROM w WHERE steps = 0 AND version_id IS NOT NULL""")
def resolve_branch(s, d):
    """Every branch with an offset of up to six versions before its tip, parsed and resolved."""
    tips = lineage.latest(view(s, d, "vr_log"), ["ref_artifact", "branch", "path"], ["txn"])
    spec = F.concat("branch", F.lit("~"), (F.col("ref_artifact") % 7).cast("string"))
    asked = tips.where("path = 'HEAD'").select(spec.alias("spec"), F.concat(F.lit("all/"), F.regexp_replace(spec, "~", ":HEAD~"), F.lit("/data")).alias("text"))
    parsed = asked.select("spec", *(c.alias(n) for n, c in specifiers.parse_columns(F.col("text")).items()))
    return lineage.resolve(parsed, tips.select("branch", "path", "version_id"), _parents(s, d), keep)


@query("SELECT version_id, md5(CAST(version_id AS VARCHAR)) AS uuid FROM $va_version WHERE md5(CAST(version_id AS VARCHAR)) ILIKE 'AB%'")
def uuid_prefix(s, d):
    return lineage.with_prefix(view(s, d, "va_version").select("version_id", F.md5(F.col("version_id").cast("string")).alias("uuid")), "AB")


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'uuid' WHEN 3 THEN 'error' ELSE 'branch' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN n_name END AS uuid_prefix,
CASE WHEN n_nationkey % 4 IN (1, 2) THEN 'all' END AS ref, CASE WHEN n_nationkey % 4 IN (1, 2) THEN n_name END AS branch, CASE n_nationkey % 4 WHEN 1 THEN 'HEAD' WHEN 2 THEN 'squash' END AS path,
CASE n_nationkey % 4 WHEN 1 THEN 0 WHEN 2 THEN -n_regionkey END AS revision_offset, CASE WHEN n_nationkey % 4 IN (1, 2) THEN 'data' END AS artifact FROM nation""")
def parse_specifier(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey") % 4
    spec = F.when(k == 0, F.concat(F.lit("#"), "n_name")).when(k == 1, F.concat(F.lit("all/"), "n_name", F.lit(":head/data"))).when(k == 2, F.concat(F.lit("all/"), "n_name", F.lit(":squash~"), F.col("n_regionkey").cast("string"), F.lit("/data"))).otherwise(F.concat(F.lit("a/"), "n_name"))
    return n.select("n_nationkey", spec.alias("spec")).select("n_nationkey", *(c.alias(name) for name, c in specifiers.parse_columns(F.col("spec")).items()))


@query("SELECT key, max(seq) AS seq, max_by(value, seq) AS value FROM $ve_log GROUP BY key")
def latest_policies(s, d):
    return lineage.latest(view(s, d, "ve_log"), ["key"], ["seq"])


@query("SELECT p_partkey AS uuid, p_name AS name, p_type AS dtype, md5(p_type) AS dtype_uuid FROM part")
def list_artifacts(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.col("p_type").alias("dtype"))
    return p.join(p.select("dtype").distinct().withColumn("dtype_uuid", F.md5("dtype")), "dtype")


@query("""SELECT blob, version, partition_id, state FROM (VALUES (1, 1, '00010203040506'), (1, 2, '00070203040508'), (2, 1, 'FFFEFDFCFBFAF9'), (2, 2, 'FFF8FDFCFBFAF7'), (3, 1, '00010203040506'), (3, 2, '00070203040508')) t(blob, version, state),
(VALUES (CAST(0 AS BIGINT)), (1)) p(partition_id)""")
def cascade_blob_chain(s, d):
    """A blob, its negation and the negation of that, in a new repository: states after a state and a delta commit."""
    from .plans.demo import blob_chain

    return blob_chain(s)
