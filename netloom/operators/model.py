"""A road graph to work with: built from links and zones, contracted, set up for searches, loaded, saved and read again."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import assignment as A
from netloom.operators import graph as G
from netloom.operators import kernels as K

KEYS = ("link_id", "direction", "tail", "head")


def check_zones(zones: DataFrame) -> None:
    """Zone ids are integers, there, positive and unique."""
    if dict(zones.dtypes)["zone"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("zone ids must be integers")
    s = zones.agg(F.count("*").alias("rows"), F.count("zone").alias("n"), F.count_distinct("zone").alias("d"), F.min("zone").alias("least")).first()
    if not s.rows:
        raise ValueError("there are no zones")
    if s.n < s.rows or s.d < s.n or s.least <= 0:
        raise ValueError("zone ids must be positive and unique")


@dataclass
class RoadGraph:
    """Directed edges of links, and the zones that demand has. What is set up gives a new graph; the tables stay as they are.

    Searches run on contracted edges where that is asked for (contract): chains of links between zones and junctions as one edge, dead ends left out.
    Flows on them go back to all links of a chain.
    """

    spark: SparkSession
    links: DataFrame
    zones: DataFrame
    cost: str | None = None
    skimmed: tuple[str, ...] = ()
    blocked: bool = False
    contract: bool = False
    excluded: tuple[int, ...] = field(default=())

    @classmethod
    def build(cls, links: DataFrame, zones: DataFrame, contract: bool = True) -> RoadGraph:
        check_zones(zones)
        return cls(links.sparkSession, G.validate_links(links), zones.select(F.col("zone").cast("long").alias("zone")), contract=contract)

    @cached_property
    def used_links(self) -> DataFrame:
        gone = self.spark.createDataFrame([(k,) for k in self.excluded], "link_id long") if self.excluded else None
        return self.links if gone is None else G.exclude_links(self.links, gone)

    @cached_property
    def edges(self) -> DataFrame:
        return G.directed(self.used_links)

    def available_skims(self) -> list[str]:
        """Fields that can be costs or be skimmed."""
        return G.skimmable_fields(self.links)

    def _field(self, name: str) -> str:
        if name not in self.available_skims():
            raise ValueError(f"no numeric field {name}; there are {', '.join(self.available_skims())}")
        return name

    def with_cost(self, name: str) -> RoadGraph:
        return replace(self, cost=self._field(name))

    def with_skims(self, *names: str) -> RoadGraph:
        return replace(self, skimmed=tuple(self._field(n) for n in names))

    def with_blocked(self, blocked: bool = True) -> RoadGraph:
        """Whether paths keep off zones that are neither their origin nor their destination."""
        if blocked and self.zones.count() == self.nodes.count():
            raise ValueError("every node is a zone: no path of two links is left")
        return replace(self, blocked=blocked)

    def without(self, ids: list[int]) -> RoadGraph:
        """Links left out besides those that were before."""
        return replace(self, excluded=tuple(sorted({*self.excluded, *ids})))

    @property
    def nodes(self) -> DataFrame:
        return self.edges.select(F.col("tail").alias("node")).union(self.edges.select("head")).distinct()

    @cached_property
    def crosswalk(self) -> DataFrame:
        """(link_id, chain, seq, way): the contracted edge of each link, without those of dead ends."""
        dead = G.dead_ends(self.edges, self.zones)
        live = self.edges.join(dead, ["link_id", "direction"], "left_anti")
        return G.chains(self.used_links.join(live.select("link_id").distinct(), "link_id", "left_semi"), self.zones)

    def contracted(self, *fields: str) -> DataFrame:
        """(link_id, direction, tail, head, *fields): a contracted edge under its chain's name, fields summed."""
        return G.compressed(self.edges, self.crosswalk, fields).withColumnRenamed("chain", "link_id")

    def correspondence(self) -> DataFrame:
        """(link_id, direction, chain, chain_direction) of each edge; one of a dead end has the number behind the last chain."""
        walk = self.crosswalk
        last = (walk.agg(F.max("chain")).first()[0] or 0) + 1
        both = self.edges.select("link_id", "direction").join(walk, "link_id", "left")
        return both.select("link_id", "direction", F.coalesce("chain", F.lit(last)).alias("chain"), F.coalesce(F.col("direction") * F.col("way"), F.lit(0)).alias("chain_direction"))

    @cached_property
    def arrays(self) -> K.GraphArrays:
        if self.cost is None:
            raise ValueError("set a cost first")
        fields = tuple(f for f in self.skimmed)
        rows = self.contracted(*dict.fromkeys((self.cost, *fields))) if self.contract else self.edges
        return G.arrays(rows, self.zones, self.cost, fields)

    def skims(self) -> DataFrame:
        return G.skims(self.spark, self.arrays, self.zones, list(self.skimmed), self.blocked)

    def paths(self, pairs: DataFrame) -> DataFrame:
        """(origin, destination, links, nodes, mileposts) along network links; of a node to itself the node alone, at 0. Pairs without a
        path aren't there."""
        g = replace(self, contract=False).arrays
        found = G.paths(self.spark, g, pairs.where("origin <> destination"), self.blocked).where("path is not null")
        way = found.select("origin", "destination", F.transform("path", lambda s: s["link_id"] * s["direction"]).alias("links"), F.concat(F.array("origin"), F.transform("path", lambda s: s["node"])).alias("nodes"), F.concat(F.array(F.lit(0.0)), F.transform("path", lambda s: s["milepost"])).alias("mileposts"))
        own = pairs.where("origin = destination").select("origin", "destination", F.expr("cast(array() as array<bigint>)").alias("links"), F.array("origin").alias("nodes"), F.array(F.lit(0.0)).alias("mileposts"))
        return way.unionByName(own)

    def load(self, od: DataFrame, cores: list[str]) -> DataFrame:
        """(link_id, direction, *cores): demand on cheapest paths, by network link."""
        flows = A.all_or_nothing(self.spark, self.arrays, od, cores, self.blocked).drop("edge")
        return spread_flows(flows, self.crosswalk, cores) if self.contract else flows

    def save(self, path: str) -> None:
        """Links and zones as Parquet, the rest as JSON beside them."""
        self.links.write.parquet(f"{path}/links")
        self.zones.write.parquet(f"{path}/zones")
        state = {k: getattr(self, k) for k in ("cost", "skimmed", "blocked", "contract", "excluded")}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> RoadGraph:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        return cls(spark, spark.read.parquet(f"{path}/links"), spark.read.parquet(f"{path}/zones"), **state | {k: tuple(state[k]) for k in ("skimmed", "excluded")})

    def summary(self) -> dict[str, int]:
        return {"links": self.links.count(), "edges": self.edges.count(), "nodes": self.nodes.count(), "zones": self.zones.count(), "contracted": self.contracted().count()}


def spread_flows(flows: DataFrame, crosswalk: DataFrame, cores: list[str]) -> DataFrame:
    """Flows(link_id as chain, direction, *cores) on contracted edges to all links of their chains, in the links' own directions."""
    on = flows.withColumnsRenamed({"link_id": "chain", "direction": "along"})
    return crosswalk.join(on, "chain").select("link_id", (F.col("along") * F.col("way")).alias("direction"), *cores)


def build_graphs(links: DataFrame, zones: DataFrame, modes: list[str], fields: tuple[str, ...] | None = None, nodes: DataFrame | None = None, box: tuple[float, float, float, float] | None = None) -> dict[str, RoadGraph]:
    """A graph for each mode, of the links that allow it (and lie within a box of nodes(node, x, y)); fields: those to keep."""
    some = G.within(links, nodes, box) if box else links
    if fields:
        keep = [c for c in some.columns if c in G.REQUIRED or c == "modes" or (c[:-3] if c[-3:] in ("_ab", "_ba") else c) in fields]
        some = some.select(*keep)
    return {m: RoadGraph.build(G.for_mode(some, m).drop("modes"), zones) for m in modes}
