"""A property graph as tables: nodes (id, type, properties), edges (id, source_id, target_id, relationship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, written


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, relationship: str | None, max_depth: int = 3, reverse: bool = False) -> DataFrame:
    """Breadth first from ``starts`` (id): node_id, depth (the least number of hops, 0 for a start).

    One join a hop, each with the nodes found in the hop before alone; a node is expanded once, and edges and
    hops are written once. Edges to missing nodes lead nowhere. The frontier is deduplicated before it is joined, so a
    hub costs one partial aggregate and not one task.
    """
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    hops = edges.filter(F.col("relationship") == relationship) if relationship is not None else edges
    hops = hops.select(F.col(a).alias("node_id"), F.col(b).alias("next_id")).join(nodes.select(F.col("id").alias("next_id")), "next_id", "left_semi")
    seen = starts.select(F.col("id").cast("long").alias("node_id"), F.lit(0).alias("depth")).distinct()
    if max_depth < 1:
        return seen
    hops = written(hops) if max_depth > 1 else hops
    frontier = seen = written(seen) if max_depth > 1 else seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(hops, "node_id").select(F.col("next_id").alias("node_id")).distinct()
        frontier = reached.join(seen.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(depth).alias("depth"))
        if depth < max_depth:
            frontier = written(frontier)
        seen = seen.unionByName(frontier)
    return seen


def paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, relationship: str, max_depth: int = 3, reverse: bool = False) -> DataFrame:
    """For each node expanded within ``max_depth`` hops: node_id, relationship, depth, targets (its neighbours, sorted)."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    expanded = traverse(nodes, edges, starts, relationship, max_depth - 1, reverse)
    hops = edges.filter(F.col("relationship") == relationship).select(F.col(a).alias("node_id"), F.col(b).alias("id"))
    hops = hops.join(nodes, "id").select("node_id", F.struct("id", "type", "properties").alias("t"))
    return expanded.join(hops, "node_id").groupBy("node_id", "depth").agg(F.sort_array(F.collect_list("t")).alias("targets")).withColumn("relationship", F.lit(relationship))


def resolve_path(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """The value of ``Type->rel->...->lastRel.prop``: fact (the dotted name), value (of the end node with the largest id), end_id.

    Missing properties are skipped.
    """
    parts = path.split("->")
    if len(parts) < 2 or "." not in parts[-1]:
        raise ValueError(f"a path has two parts at least and ends in relationship.property: {path!r}")
    last, prop = parts[-1].rsplit(".", 1)
    at = nodes.filter(F.col("type") == parts[0]).select("id")
    for rel in [*parts[1:-1], last]:
        hop = edges.filter(F.col("relationship") == rel).select(F.col("source_id").alias("id"), F.col("target_id").alias("next_id"))
        at = at.join(hop, "id").select(F.col("next_id").alias("id")).distinct()
    value = at.join(nodes, "id").select("id", F.get_json_object("properties", f"$.{prop}").alias("value")).filter("value is not null")
    name = "graph." + ".".join([*parts[:-1], last, prop])
    return value.agg(F.max_by("value", "id").alias("value"), F.max("id").alias("end_id")).filter("end_id is not null").select(F.lit(name).alias("fact"), "value", "end_id")


def versioned(changes: DataFrame) -> DataFrame:
    """A change log (entity_type, entity_id, op, ts, entry_id, ...) with ``version``, from 1 in each entity."""
    w = Window.partitionBy("entity_type", "entity_id").orderBy("ts", "entry_id")
    return changes.withColumn("version", F.row_number().over(w))


def history(log: DataFrame, entity_type: str, entity_id: int) -> DataFrame:
    return log.filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)).orderBy("version")


def changes_since(log: DataFrame, ts) -> DataFrame:
    return log.filter(F.col("ts") > F.lit(ts).cast("timestamp")).orderBy("ts", "entry_id")


def as_of(log: DataFrame, ts) -> DataFrame:
    """The last change of each entity up to ``ts`` that doesn't delete it."""
    last = log.filter(F.col("ts") <= F.lit(ts).cast("timestamp")).groupBy("entity_type", "entity_id").agg(F.max_by(F.struct(*log.columns), F.struct("ts", "entry_id")).alias("r"))
    return last.select("r.*").filter("op <> 'Delete'")


def link_embeddings(links: DataFrame) -> DataFrame:
    """Upserts (vec_index, node_id, seq): the last of each vec_index."""
    return links.groupBy("vec_index").agg(F.max_by("node_id", "seq").alias("node_id"))


class GraphStore:
    """Nodes, edges and a change log of one graph; every change makes new DataFrames.

    Snapshots are folders on storage, so a name can be used again after a restore, and they outlive the session.
    """

    NODES = "id long, type string, properties string"
    EDGES = "id long, source_id long, target_id long, relationship string, properties string"
    LOG = "entry_id long, entity_type string, entity_id long, op string, version int, changed_by string, before string"

    def __init__(self, spark: SparkSession, audit: bool = True):
        self.spark, self.audit = spark, audit
        self.nodes, self.edges = spark.createDataFrame([], self.NODES), spark.createDataFrame([], self.EDGES)
        self.log = spark.createDataFrame([], self.LOG)
        self.snapshots: dict[str, str] = {}

    def _next(self, df: DataFrame) -> int:
        return (df.agg(F.max("id")).first()[0] or 0) + 1

    def _append(self, kind: str, rows: DataFrame, op: str, by: str) -> None:
        """``rows``: id, before."""
        if not self.audit:
            return
        first = (self.log.agg(F.max("entry_id")).first()[0] or 0) + 1
        known = self.log.filter(F.col("entity_type") == kind).groupBy("entity_id").agg(F.max("version").alias("v"))
        new = rows.join(known, rows.id == known.entity_id, "left").select((F.row_number().over(Window.orderBy("id")) + first - 1).cast("long").alias("entry_id"), F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.lit(op).alias("op"), (F.coalesce("v", F.lit(0)) + 1).alias("version"), F.lit(by).alias("changed_by"), "before")
        self.log = self.log.unionByName(new)

    def insert_nodes(self, rows: list[tuple[str, str]], by: str = "system") -> list[int]:
        first = self._next(self.nodes)
        new = self.spark.createDataFrame([(first + i, t, p) for i, (t, p) in enumerate(rows)], self.NODES)
        self.nodes = self.nodes.unionByName(new)
        self._append("node", new.select("id", F.lit("").alias("before")), "Insert", by)
        return list(range(first, first + len(rows)))

    def insert_edge(self, source: int, target: int, relationship: str, properties: str = "{}", by: str = "system") -> int:
        if not relationship:
            raise ValueError("an edge has a relationship")
        new = self.spark.createDataFrame([(self._next(self.edges), source, target, relationship, properties)], self.EDGES)
        self.edges = self.edges.unionByName(new)
        self._append("edge", new.select("id", F.lit("").alias("before")), "Insert", by)
        return new.first().id

    def update_node(self, node_id: int, properties: str, by: str = "system") -> None:
        old = self.nodes.filter(F.col("id") == node_id)
        if not old.count():
            raise KeyError(node_id)
        self._append("node", old.select("id", F.col("properties").alias("before")), "Update", by)
        self.nodes = self.nodes.withColumn("properties", F.when(F.col("id") == node_id, F.lit(properties)).otherwise(F.col("properties")))

    def set_field(self, node_id: int, key: str, value, by: str | None = None) -> None:
        """One property; logged only if ``by`` is given."""
        import json

        row = self.get_node(node_id)
        if by is not None:
            self._append("node", self.nodes.filter(F.col("id") == node_id).select("id", F.col("properties").alias("before")), "Update", by)
        self.nodes = self.nodes.withColumn("properties", F.when(F.col("id") == node_id, F.lit(json.dumps(json.loads(row.properties) | {key: value}))).otherwise(F.col("properties")))

    def delete_node(self, node_id: int, by: str = "system") -> None:
        """A missing node is no error; edges to it stay, and lead nowhere."""
        old = self.nodes.filter(F.col("id") == node_id)
        self._append("node", old.select("id", F.col("properties").alias("before")), "Delete", by)
        self.nodes = self.nodes.filter(F.col("id") != node_id)

    def delete_edge(self, edge_id: int, by: str = "system") -> None:
        self._append("edge", self.edges.filter(F.col("id") == edge_id).select("id", F.col("properties").alias("before")), "Delete", by)
        self.edges = self.edges.filter(F.col("id") != edge_id)

    def get_node(self, node_id: int):
        row = self.nodes.filter(F.col("id") == node_id).first()
        if row is None:
            raise KeyError(node_id)
        return row

    def get_edge(self, edge_id: int):
        row = self.edges.filter(F.col("id") == edge_id).first()
        if row is None:
            raise KeyError(edge_id)
        return row

    def find_by_type(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("type") == kind)

    def snapshot(self, name: str) -> tuple[int, int]:
        """Writes nodes and edges to storage under a name; the store goes on from what was written."""
        at = shared_folder(self.spark, "snapshot")
        self.nodes.write.parquet(f"{at}/nodes")
        self.edges.write.parquet(f"{at}/edges")
        self.snapshots[name] = at
        self.restore(name)
        return self.nodes.count(), self.edges.count()

    def restore(self, name: str) -> None:
        at = self.snapshots[name]
        self.nodes, self.edges = self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges")

    def list_snapshots(self) -> DataFrame:
        """name, folder, node_count, edge_count, in order of their making."""
        rows = [(n, at, self.spark.read.parquet(f"{at}/nodes").count(), self.spark.read.parquet(f"{at}/edges").count()) for n, at in self.snapshots.items()]
        return self.spark.createDataFrame(rows, "name string, folder string, node_count long, edge_count long")

    def delete_snapshot(self, name: str) -> None:
        """A missing one is an error. Its files stay for readers that still have them."""
        del self.snapshots[name]
