"""Queries of the property graph made of the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators import graph


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of five kinds; sequence numbers keep the kinds apart."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def edges(rows: DataFrame, seq, source, target, relation: str, confidence: float) -> DataFrame:
        return rows.select(seq.cast("long").alias("seq"), source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))

    out = edges(t("nation"), F.col("n_nationkey"), node("nation", "n_nationkey"), node("region", "n_regionkey"), "in_region", 1.0)
    out = out.unionByName(edges(t("customer"), F.col("c_custkey") + 1_000, node("customer", "c_custkey"), node("nation", "c_nationkey"), "of_nation", 0.95))
    out = out.unionByName(edges(t("supplier"), F.col("s_suppkey") + 1_000_000_000, node("supplier", "s_suppkey"), node("nation", "s_nationkey"), "of_nation", 0.9))
    out = out.unionByName(edges(t("lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber") + 10_000_000_000, node("supplier", "l_suppkey"), node("part", "l_partkey"), "supplies", 0.7))
    return graph.upserted(out)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def graph_degree_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("name", F.upper("id"))
    return graph.overview(nodes, edges, 60).select("id", "degree")


def graph_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    ids = spark.createDataFrame([(f"nation:{i}",) for i in range(25)] + [(f"region:{i}",) for i in range(3)] + [("customer:7",)], "id string")
    return graph.induced(edges, ids, 100).select("edge_id", "source", "target", "relation")


NAMES = ["nation:3", "region:1", "supplier:2", "nobody"]


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir), NAMES).select(F.col("place").cast("int").alias("place"), "other")


def graph_subgraph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes and edges within two steps of a region, up to 40 nodes."""
    nodes, edges = graph.subgraph(_edges(spark, sf_dir), "region:1", 2, 40)
    none = lambda kind: F.lit(None).cast(kind)
    return nodes.select(F.lit("node").alias("what"), "id", "depth", none("long").alias("edge_id")).unionByName(edges.select(F.lit("edge").alias("what"), F.concat_ws(">", "source", "target").alias("id"), none("int").alias("depth"), "edge_id"))


def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(_edges(spark, sf_dir), "customer:1", "part:5")


_EDGES = """
raw AS (SELECT n_nationkey::BIGINT AS seq, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'in_region' AS relation, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT c_custkey + 1000, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'of_nation', 0.95 FROM customer UNION ALL SELECT s_suppkey + 1000000000, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'of_nation', 0.9 FROM supplier
  UNION ALL SELECT l_orderkey * 10 + l_linenumber + 10000000000, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 0.7 FROM lineitem),
edges AS (SELECT source, target, relation, min(seq) AS edge_id, arg_max(confidence, seq) AS confidence FROM raw GROUP BY ALL)"""
_IDS = ", ".join(f"('nation:{i}')" for i in range(25)) + ", ('region:0'), ('region:1'), ('region:2'), ('customer:7')"
ORACLE = {
    "graph_edges": f"WITH {_EDGES} FROM edges",
    "graph_degree_overview": f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY degree DESC, upper(id), id LIMIT 60",
    "graph_induced_edges": f"WITH {_EDGES}, ids AS (SELECT * FROM (VALUES {_IDS}) v(id)) SELECT edge_id, source, target, relation FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) ORDER BY edge_id LIMIT 100",
    "graph_neighbors": f"""
WITH {_EDGES}, names AS (SELECT * FROM (VALUES (0, 'nation:3'), (1, 'region:1'), (2, 'supplier:2'), (3, 'nobody')) v(pos, node)),
h AS (SELECT pos, other, min(edge_id) AS edge_id FROM (SELECT source AS node, target AS other, edge_id FROM edges UNION ALL SELECT target, source, edge_id FROM edges WHERE source <> target) JOIN names USING (node) GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY edge_id, other) AS n FROM h) WHERE n <= 12),
f AS (SELECT other, min(pos * 100000000000 + edge_id) AS spot FROM p GROUP BY other)
SELECT CAST(row_number() OVER (ORDER BY spot, other) AS INT) AS place, other FROM f ORDER BY spot, other LIMIT 24""",
}
# Two levels from region:1, 30 edges of a node, 40 nodes: a node of the first level is opened while fewer are known.
ORACLE["graph_subgraph_bfs"] = f"""
WITH {_EDGES}, links AS (SELECT source AS node, target AS other, edge_id, source, target FROM edges UNION ALL SELECT target, source, edge_id, source, target FROM edges WHERE source <> target),
e1 AS (SELECT * FROM links WHERE node = 'region:1' ORDER BY edge_id LIMIT 30),
n1 AS (SELECT * FROM (SELECT other AS id, row_number() OVER (ORDER BY min(edge_id)) AS pos FROM e1 WHERE other <> 'region:1' GROUP BY other) WHERE pos <= 39),
e2 AS (SELECT * FROM (SELECT l.*, n1.pos, row_number() OVER (PARTITION BY l.node ORDER BY edge_id) AS n FROM links l JOIN n1 ON l.node = n1.id) WHERE n <= 30),
f2 AS (SELECT other AS id, min(pos) AS pos, min(pos * 1000000000000 + edge_id) AS spot FROM e2 WHERE other <> 'region:1' AND other NOT IN (SELECT id FROM n1) GROUP BY other),
n2 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY spot) AS place FROM f2) WHERE place <= 39 - (SELECT count(*) FROM n1)),
open AS (SELECT id FROM n1 WHERE 1 + (SELECT count(*) FROM n1) + (SELECT count(*) FROM n2 WHERE n2.pos < n1.pos) < 40),
kept AS (SELECT DISTINCT edge_id, source, target FROM (SELECT edge_id, source, target FROM e1 UNION ALL SELECT edge_id, source, target FROM e2 WHERE node IN (SELECT id FROM open)))
SELECT 'node' AS what, id, CAST(depth AS INT) AS depth, NULL::BIGINT AS edge_id FROM (SELECT 'region:1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM n1 UNION ALL SELECT id, 2 FROM n2)
UNION ALL SELECT 'edge', source || '>' || target, NULL, edge_id FROM kept"""
# Levels of a search from customer:1, each node with the least list of edge ids that leads to it.
_LEVEL = """l{n} AS (SELECT other AS id, min(list_append(path, edge_id)) AS path FROM l{p} JOIN links ON node = id
  WHERE other NOT IN (SELECT id FROM l{p}) {old} GROUP BY other)"""
_LEVELS = ", ".join(_LEVEL.format(n=n, p=n - 1, old=f"AND other NOT IN (SELECT id FROM l{n - 2})" if n > 1 else "") for n in range(1, 6))
ORACLE["graph_shortest_path"] = f"""
WITH {_EDGES}, links AS (SELECT source AS node, target AS other, edge_id FROM edges UNION ALL SELECT target, source, edge_id FROM edges WHERE source <> target),
l0 AS (SELECT 'customer:1' AS id, []::BIGINT[] AS path), {_LEVELS},
found AS (SELECT path FROM ({' UNION ALL '.join(f"SELECT {n} AS n, path FROM l{n} WHERE id = 'part:5'" for n in range(1, 6))}) ORDER BY n LIMIT 1),
steps AS (SELECT unnest(path) AS edge_id, unnest(range(1, len(path) + 1)) AS step FROM found)
SELECT CAST(step AS INT) AS step, edge_id, source, target, relation FROM steps JOIN edges USING (edge_id)"""
QUERIES = {f.__name__: f for f in (graph_edges, graph_degree_overview, graph_induced_edges, graph_neighbors, graph_subgraph_bfs, graph_shortest_path)}
