"""A property graph as two DataFrames: nodes (id, ...) and stored edges (edge_id, source, target, relation, confidence)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import tables
from loomwell.functions.tables import written
from loomwell.functions.text import contains_any


def upserted(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, relation): the last attributes by ``seq``, the first ``seq`` as id."""
    return edges.groupBy("source", "target", "relation").agg(F.min("seq").alias("edge_id"), F.max_by("confidence", "seq").alias("confidence"))


def node_type(categories: Column) -> Column:
    """A node's type by its page's categories: location, then skill, then organization; else character."""
    has = lambda *words: F.exists(categories, lambda c: contains_any(F.lower(c), words))
    return F.when(has("location"), "location").when(has("skill", "magic"), "skill").when(has("organization", "group"), "organization").otherwise("character")


def with_sources(edges: DataFrame, base: str) -> DataFrame:
    """Edges (source, source_chunk_id, ...) with the address of their page and what kind of evidence there is."""
    name = F.replace(F.replace(F.url_encode(F.replace("source", F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    known = F.coalesce("source_chunk_id", F.lit("")) != ""
    return edges.withColumn("source_url", F.concat(F.lit(base.rstrip("/") + "/"), name)).withColumn("evidence", F.when(known, "source_chunk").otherwise("entity_page"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends (node, other, ...), a loop once; edges are read once for that."""
    end = lambda node, other: F.struct(F.col(node).alias("node"), F.col(other).alias("other"))
    ends = F.when(F.col("source") != F.col("target"), F.array(end("source", "target"), end("target", "source"))).otherwise(F.array(end("source", "target")))
    cols = ["edge_id", "source", "target", "relation"]
    return edges.select(F.explode(ends).alias("_end"), *cols).select("_end.node", "_end.other", *cols)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree); a loop counts twice. Counted in the tasks before the shuffle."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def overview(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` nodes of highest degree (500 at most), by degree, then name in any case, then id."""
    most = max(1, min(500, most))
    found = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return found.orderBy(F.desc("degree"), F.lower("name"), "id").limit(most)


def overview_graph(nodes: DataFrame, edges: DataFrame, most: int, kind: str | None = None, relation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``most`` best-connected nodes (of one type), and the edges (of one relation) between them.

    Degrees count all relations.
    """
    top = written(overview(nodes if kind is None else nodes.where(F.col("entity_type") == kind), edges, most))
    return top, induced(edges if relation is None else edges.where(F.col("relation") == relation), top)


def induced(edges: DataFrame, ids: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` edges, by id, with both ends in ``ids``."""
    end = lambda name: ids.select(F.col("id").alias(name))
    return edges.join(end("source"), "source", "left_semi").join(end("target"), "target", "left_semi").orderBy("edge_id").limit(most)


def neighbours_of(edges: DataFrame, named: DataFrame, each: int = 12, most: int = 24) -> DataFrame:
    """(q_id, place, other) for (q_id, pos, node): up to ``each`` distinct neighbours of a question's nodes, by edge, and
    ``most`` in all, in the order of the nodes, each once."""
    hits = both_ways(edges).join(named, "node").groupBy("q_id", "pos", "other").agg(F.min("edge_id").alias("edge_id"))
    per = hits.withColumn("n", F.row_number().over(Window.partitionBy("q_id", "pos").orderBy("edge_id", "other"))).where(F.col("n") <= each)
    first = per.groupBy("q_id", "other").agg(F.min(F.struct("pos", "edge_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("at", "other"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("q_id", "place", "other")


def neighbours(edges: DataFrame, names: list[str], each: int = 12, most: int = 24) -> DataFrame:
    """(place, other): up to ``each`` distinct neighbours of the first eight names, in order, each once."""
    given = edges.sparkSession.createDataFrame([(0, i, n) for i, n in enumerate(names[:8])], "q_id int, pos int, node string")
    return neighbours_of(edges, F.broadcast(given), each, most).select("place", "other")


#: Buckets of nodes, edge ids that share a block of a node, frontier nodes up to which only their buckets are read, and
#: those up to which edges are read without an index.
BUCKETS, BLOCK_IDS, PUSHED, SENT = 16, 4096, 1000, 300_000
_LINKS = "array<struct<edge_id:bigint,other:string,source:string,target:string,relation:string>>"


@dataclass(frozen=True)
class Adjacency:
    """Edges by node, written once and searched often: rows (bucket, node, block, links), a node's links in blocks by edge
    id, files in buckets by the node's hash and sorted by node."""

    edges: DataFrame
    path: str

    def of(self, frontier: DataFrame) -> DataFrame:
        """(..., edge_id, other, source, target, relation) of the frontier's nodes (node, ...); a small frontier reads its buckets only."""
        spark = self.edges.sparkSession
        blocks = spark.read.schema(f"node string, block long, links {_LINKS}, bucket int").parquet(self.path)
        nodes = [r[0] for r in frontier.select("node").distinct().limit(PUSHED + 1).collect()]
        if len(nodes) <= PUSHED:
            buckets = [r[0] for r in frontier.select(_bucket()).distinct().collect()]
            blocks = blocks.where(F.col("bucket").isin(buckets) & F.col("node").isin(nodes))
        return blocks.join(frontier, "node").select(*frontier.columns, F.explode("links").alias("x")).select(*frontier.columns, "x.*")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).cast("int").alias("bucket")


def adjacency(edges: DataFrame, path: str | None = None) -> Adjacency:
    path = path or f"{tables.shared_folder(edges.sparkSession)}/loomwell-edges-{uuid.uuid4().hex}"
    links = F.array_sort(F.collect_list(F.struct("edge_id", "other", "source", "target", "relation")))
    rows = both_ways(edges).groupBy("node", F.floor(F.col("edge_id") / BLOCK_IDS).cast("long").alias("block")).agg(links.alias("links")).select("node", "block", "links", _bucket())
    rows.repartition("bucket").sortWithinPartitions("bucket", "node", "block").write.partitionBy("bucket").parquet(path)
    return Adjacency(edges, path)


class Unindexed:
    """Edges that are searched once: a frontier reads the edges at its nodes straight from them, which moves these edges
    only, as the choice of ends goes below a grouping by them. A frontier of more than ``SENT`` nodes makes an index."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges, self.index = edges, None

    def of(self, frontier: DataFrame) -> DataFrame:
        few = frontier.select("node").distinct().limit(SENT + 1)
        nodes = [r[0] for r in few.limit(PUSHED + 1).collect()]
        if len(nodes) > PUSHED and (self.index is not None or few.count() > SENT):
            self.index = self.index or adjacency(self.edges)
            return self.index.of(frontier)
        if len(nodes) <= PUSHED:
            hit = both_ways(self.edges.where(F.col("source").isin(nodes) | F.col("target").isin(nodes)))
        else:
            cols = ["edge_id", "source", "target", "relation"]
            at = lambda end: self.edges.join(F.broadcast(few.select(F.col("node").alias(end))), end, "left_semi").select(*cols)
            hit = both_ways(at("source").unionByName(at("target"))).distinct()
        return hit.join(F.broadcast(frontier), "node").select(*frontier.columns, "edge_id", "other", "source", "target", "relation")


def _searched(edges: DataFrame | Adjacency) -> Adjacency | Unindexed:
    return edges if isinstance(edges, Adjacency) else Unindexed(edges)


def subgraph(
    edges: DataFrame | Adjacency, start: str, depth: int = 2, most: int = 40, per_node: int = 30, relation: str | None = None, nodes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, depth, pos), edges) reached from ``start`` without regard to direction.

    Level by level; nodes keep the order in which they are found; a node gives its first ``per_node`` edges by id and
    is opened only while fewer than ``most`` nodes are known. A level has at most ``most`` nodes, so the frontier is
    small enough to send, only its nodes' buckets are read, and what comes back is ``most * per_node`` edges at most.
    """
    links, (known, frontier, kept) = _searched(edges), ([(start, 0, 0)], [(start, 0)], [])
    spark = links.edges.sparkSession
    for level in range(1, max(1, min(3, depth)) + 1):
        if not frontier:
            break
        rows = links.of(F.broadcast(spark.createDataFrame(frontier, "node string, pos int")))
        rows = rows if relation is None else rows.where(F.col("relation") == relation)
        first = F.row_number().over(Window.partitionBy("pos").orderBy("edge_id"))
        rows = rows.withColumn("n", first).where(F.col("n") <= per_node).orderBy("pos", "edge_id").collect()
        seen, frontier, by_pos = {n for n, _, _ in known}, [], {}
        for r in rows:
            by_pos.setdefault(r["pos"], []).append(r)
        for pos in sorted(by_pos):
            if len(known) >= most:
                break
            for r in by_pos[pos]:
                kept.append((r["edge_id"], r["source"], r["target"], r["relation"]))
                if r["other"] not in seen and len(known) < most:
                    seen.add(r["other"])
                    known.append((r["other"], level, len(known)))
                    frontier.append((r["other"], len(frontier)))
    found = spark.createDataFrame(known, "id string, depth int, pos int")
    return (
        found if nodes is None else nodes.join(F.broadcast(found), "id"),  # ids that no node row has are left out, their edges are not
        spark.createDataFrame(list(dict.fromkeys(kept)), "edge_id long, source string, target string, relation string"),
    )


def shortest_path(edges: DataFrame | Adjacency, start: str, end: str) -> DataFrame:
    """(step, edge_id, source, target, relation) of a shortest path without regard to direction; no rows if there is none.

    Of equally short paths it is the one whose edge ids are least, one after the other. Two searches, one from each end,
    take turns, the smaller frontier first, until they meet; so each goes half of the way. A node keeps the least list of
    edge ids between it and its end. Levels are written out, as a frontier may be as large as the graph; a neighbour of a
    level lies in it, the one before or the next one, so these two are all that is kept in sight.
    """
    links = _searched(edges)
    spark = links.edges.sparkSession
    none = spark.createDataFrame([], "step int, edge_id long, source string, target string, relation string")
    if start == end:
        return none
    sides = [{"now": tables.written(spark.createDataFrame([(node, [])], "id string, path array<struct<edge_id:bigint,id:string>>")), "before": None, "n": 1} for node in (start, end)]
    while True:
        near = 0 if sides[0]["n"] <= sides[1]["n"] else 1
        side, other = sides[near], sides[1 - near]
        now, before = side["now"], side["before"]
        seen = now.select("id") if before is None else now.select("id").unionByName(before.select("id"))
        edge = F.array(F.struct("edge_id", F.col("other").alias("id")))
        step = links.of(now.select(F.col("id").alias("node"), "path")).select(F.col("other").alias("id"), (F.concat("path", edge) if near == 0 else F.concat(edge, "path")).alias("path"))
        side["before"], side["now"] = now, tables.written(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        side["n"] = side["now"].count()
        if not side["n"]:
            return none
        first, last = (s["now"].select("id", F.col("path").alias(f"path{k}")) for k, s in enumerate(sides))
        path = first.join(last, "id").agg(F.min(F.concat("path0", "path1")).alias("path")).first()["path"]
        if path is not None:
            break
    # The ends of the path's edges are known, so that edges are chosen by them before they are grouped.
    steps, on = spark.createDataFrame([(n, p["edge_id"]) for n, p in enumerate(path, 1)], "step int, edge_id long"), [start, end, *(p["id"] for p in path)]  # one row a level
    near = links.edges.where(F.col("source").isin(on) & F.col("target").isin(on))
    return near.join(F.broadcast(steps), "edge_id").select("step", "edge_id", "source", "target", "relation")
