"""Road networks from files: GMNS tables, saved OSM extracts, VISUM GeoJSON layers; and GMNS export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.scalars import with_unit
from netloom.operators import network as N
from netloom.operators.graph import checkpoints

# Transport systems and their mode letters; what connectors without values get.
MODES = {"CAR": "c", "HGV": "h", "BIKE": "b", "WALK": "w", "PUTW": "w", "BUS": "t", "TRAM": "l", "TRAIN": "r"}
CONNECTOR_SPEED, CONNECTOR_CAPACITY = 30.0, 99999.0


def read_gmns(spark: SparkSession, links: str, nodes: str) -> tuple[DataFrame, DataFrame]:
    """Links with directions merged, and nodes, of GMNS CSV files."""
    raw = spark.read.csv(links, header=True)
    num = lambda c, default: F.coalesce(F.col(c).try_cast("double"), F.lit(default)) if c in raw.columns else F.lit(default)
    rows = raw.select(F.col("link_id").cast("long"), F.col("from_node_id").cast("long").alias("from_node"), F.col("to_node_id").cast("long").alias("to_node"), num("lanes", 1.0).alias("lanes"), num("capacity", 0.0).alias("capacity"))
    place = spark.read.csv(nodes, header=True).select(F.col("node_id").cast("long").alias("node"), F.col("x_coord").cast("double").alias("x"), F.col("y_coord").cast("double").alias("y"))
    return N.merge_parallel(rows.where("from_node <> to_node")), place


def write_gmns(links: DataFrame, folder: str) -> None:
    N.exported_rows(links).write.mode("overwrite").csv(f"{folder}/link.csv", header=True)


OSM = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (way, seg, nodes, highway, oneway, lanes_ab, lanes_ba, name) and nodes (node, x, y) of saved extracts; an element that
    several files hold counts once."""
    rows = spark.read.schema(OSM).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*").dropDuplicates(["type", "id"])
    nodes = rows.where("type = 'node'").select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    ways = rows.where("type = 'way' and size(nodes) > 1 and tags['highway'] is not null").select(F.col("id").alias("way"), "nodes", "tags")
    oneway = F.when(F.col("tags")["oneway"].isin("yes", "true", "1"), 1).when(F.col("tags")["oneway"] == "-1", -1).otherwise(0)
    lanes = F.col("tags")["lanes"].try_cast("double")
    side = lambda way, key: F.coalesce(F.col("tags")[f"lanes:{key}"].try_cast("double"), F.when(F.col("direction") == 0, lanes / 2).when(F.col("direction") == way, lanes).otherwise(0.0))
    tagged = ways.withColumn("direction", oneway).select("way", "direction", link_type(F.col("tags")["highway"]).alias("link_type"), side(1, "forward").alias("lanes_ab"), side(-1, "backward").alias("lanes_ba"), F.col("tags")["name"].alias("name"))
    return N.split_ways(ways.select("way", "nodes")).join(tagged, "way"), nodes


def link_type(text):
    """A type's name: letters and underscores, lower case, without _link, _segment and _stretch."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z_]", ""), "_(link|segment|stretch)$", "")


FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_visum_layer(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON layer: their properties (names in upper case) as a map, and the geometry's type and coordinates as text."""
    rows = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(F.transform_keys("f.properties", lambda k, _: F.upper(k)).alias("p"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def modes_of(text, mapping: dict[str, str] = MODES):
    """Mode letters of a set of transport systems, split at commas, semicolons, bars and white space; unknown ones are left out."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.transform(F.split(F.upper(F.coalesce(text, F.lit(""))), r"[,;|\s]+"), lambda t: F.try_element_at(table, t))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda m: m.isNotNull()))), "")


def visum_links(layer: DataFrame) -> DataFrame:
    """link_id, a_node, b_node, direction, modes, distance, speed, capacity, time: a side without modes is closed."""
    p = lambda k: F.try_element_at("p", F.lit(k))
    ab, ba = modes_of(p("TSYSSET")), modes_of(F.coalesce(p("R_TSYSSET"), p("TSYSSET")))
    rows = layer.select(p("NO").cast("long").alias("link_id"), p("FROMNODENO").cast("long").alias("a_node"), p("TONODENO").cast("long").alias("b_node"), ab.alias("ab"), ba.alias("ba"), with_unit(p("LENGTH"), "length").alias("distance"), with_unit(p("V0PRT"), "speed").alias("speed"), with_unit(p("CAPPRT"), "capacity").alias("capacity"))
    direction = F.when((F.col("ab") != "") & (F.col("ba") != ""), 0).when(F.col("ba") != "", -1).otherwise(1)
    return rows.select("link_id", "a_node", "b_node", direction.alias("direction"), F.array_join(F.array_sort(F.array_distinct(F.split(F.concat("ab", "ba"), ""))), "").alias("modes"), "distance", "speed", "capacity", (F.col("distance") / 1000 / F.col("speed") * 60).alias("time"))


def connector_values(connectors: DataFrame) -> DataFrame:
    """Missing speed, capacity and time of connectors(.., distance, speed, capacity) filled."""
    speed = F.coalesce("speed", F.lit(CONNECTOR_SPEED))
    return connectors.withColumns({"speed": speed, "capacity": F.coalesce("capacity", F.lit(CONNECTOR_CAPACITY)), "time": F.col("distance") / 1000 / speed * 60})


def inventory(layers: dict[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in layers.items()}


def visum_schedule(journeys: DataFrame, profile: DataFrame) -> DataFrame:
    """(pattern, trip, seq, stop, arrival, departure) of journeys(trip, pattern, dep, from_seq, to_seq) and profile items
    profile(pattern, seq, stop, arr, dep): the journey's departure plus the profile's offsets from where it starts. Times that fall
    behind the call before are a day later."""
    from pyspark.sql import Window as W

    j = journeys.select("trip", "pattern", F.col("dep").alias("start"), "from_seq", "to_seq")
    rows = j.join(profile, "pattern").where("seq between from_seq and to_seq")
    base = F.min(F.when(F.col("seq") == F.col("from_seq"), F.col("dep"))).over(W.partitionBy("trip"))
    timed = rows.withColumn("arrival", F.col("start") + F.col("arr") - base).withColumn("departure", F.col("start") + F.col("dep") - base)
    by = W.partitionBy("trip").orderBy("seq")
    back = timed.withColumn("back", F.when(F.col("arrival") < F.lag("departure").over(by), 86_400).otherwise(0))
    rolled = back.withColumn("late", F.sum("back").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rolled.select("pattern", "trip", (F.col("seq") - F.col("from_seq")).cast("int").alias("seq"), "stop", (F.col("arrival") + F.col("late")).cast("int").alias("arrival"), (F.col("departure") + F.col("late")).cast("int").alias("departure"))


def source_connectivity(links: DataFrame, connectors: DataFrame) -> DataFrame:
    """(tail, head, mode): directed arcs by mode of links(a_node, b_node, modes_ab, modes_ba) and connectors(zone, node, way, modes), way O from the
    zone and D to it; zones are negative."""
    each = lambda c: F.explode(F.filter(F.split(c, ""), lambda m: m != ""))
    ab = links.select(F.col("a_node").alias("tail"), F.col("b_node").alias("head"), each("modes_ab").alias("mode"))
    ba = links.select(F.col("b_node"), F.col("a_node"), each("modes_ba"))
    o = connectors.where("way = 'O'").select(-F.col("zone"), F.col("node"), each("modes"))
    d = connectors.where("way = 'D'").select(F.col("node"), -F.col("zone"), each("modes"))
    return ab.union(ba).union(o).union(d).distinct()


#: Mode letters (b bike, c car, t transit, w walk) of highway types in saved extracts; other types get the default.
HIGHWAY_MODES = {"motorway": "ct", "trunk": "ct", "primary": "bctw", "secondary": "bctw", "tertiary": "bctw", "residential": "bctw", "living_street": "bcw", "cycleway": "b", "footway": "w", "pedestrian": "w", "path": "bw", "steps": "w"}
DEFAULT_MODES = "bctw"


def highway_modes(links: DataFrame, mapping: dict[str, str] = HIGHWAY_MODES, default: str = DEFAULT_MODES) -> DataFrame:
    """Links with the modes of their link type; an unknown type has the default."""
    table = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return links.withColumn("modes", F.coalesce(F.try_element_at(table, F.col("link_type")), F.lit(default)))


def expand_uses(groups: DataFrame) -> DataFrame:
    """(use, mode): the modes behind each use group of groups(use, part), where a part is a mode or another group; groups may nest, and a
    group within itself adds nothing."""
    names = groups.select("use").distinct()
    checkpoints(groups.sparkSession)
    now = groups.select("use", "part").distinct()
    n = now.count()
    while True:  # each round follows one more step; pairs are bounded by uses times parts
        deeper = now.join(groups.select(F.col("use").alias("part"), F.col("part").alias("inner")), "part").select("use", F.col("inner").alias("part"))
        now = now.union(deeper).distinct().checkpoint()
        m = now.count()
        if m == n:
            break
        n = m
    return now.join(names.withColumnRenamed("use", "part"), "part", "left_anti").select("use", F.col("part").alias("mode"))


def letters(types: DataFrame) -> DataFrame:
    """(name, letter): a letter of its own for each of types(name): the first of its letters, lower then upper case, that no type before it (by
    name) has, else the first free one; more than 52 types are an error."""
    import string

    names = [r[0] for r in types.select("name").distinct().orderBy("name").limit(53).collect()]
    if len(names) > 52:
        raise ValueError("there are more than 52 types")
    taken: dict[str, str] = {}
    for name in names:
        own = [c for c in name if c in string.ascii_letters]
        wish = [c.lower() for c in own] + [c.upper() for c in own] + list(string.ascii_letters)
        taken[name] = next(c for c in wish if c not in taken.values())
    return types.sparkSession.createDataFrame(sorted(taken.items()), "name string, letter string")


def reported_systems(layer: DataFrame, mapping: dict[str, str] = MODES) -> DataFrame:
    """(system, n): transport systems of a layer's links that the mapping doesn't know, and on how many links they stand."""
    sets = F.split(F.upper(F.coalesce(F.try_element_at("p", F.lit("TSYSSET")), F.lit(""))), r"[,;|\s]+")
    return layer.select(F.explode(sets).alias("system")).where(~F.col("system").isin(list(mapping)) & (F.col("system") != "")).groupBy("system").agg(F.count("*").alias("n"))


def layer_problems(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(problem, key, severity) of links(link_id, a_node, b_node, modes, distance) and nodes(node) of an import: errors stop it, warnings don't."""
    known = nodes.select("node")
    ends = links.select("link_id", F.explode(F.array("a_node", "b_node")).alias("node")).join(known, "node", "left_anti")
    rows = [
        (links.groupBy("link_id").count().where("count > 1").select("link_id"), "repeated link", "error"),
        (nodes.groupBy("node").count().where("count > 1").select("node"), "repeated node", "error"),
        (ends.select("link_id").distinct(), "link without a node", "error"),
        (links.where("coalesce(modes, '') = ''").select("link_id"), "link without a mode", "warning"),
        (links.where("coalesce(distance, 0) <= 0").select("link_id"), "link without a length", "warning"),
        (links.where("a_node = b_node").select("link_id"), "link to its own node", "warning"),
        (known.join(links.select(F.explode(F.array("a_node", "b_node")).alias("node")), "node", "left_anti"), "node without a link", "warning"),
    ]
    out = None
    for df, problem, severity in rows:
        one = df.select(F.lit(problem).alias("problem"), df[df.columns[0]].cast("string").alias("key"), F.lit(severity).alias("severity"))
        out = one if out is None else out.union(one)
    return out


def visum_zones(layer: DataFrame) -> DataFrame:
    """(zone, x, y, name) of a layer of zone centroids."""
    p = lambda k: F.try_element_at("p", F.lit(k))
    at = F.from_json("coordinates", "array<double>")
    return layer.where("kind = 'Point'").select(p("NO").cast("long").alias("zone"), F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y"), p("NAME").alias("name"))


def visum_connectors(layer: DataFrame) -> DataFrame:
    """(zone, node, direction, modes, distance, speed, capacity, time) of a layer of connectors: direction O runs from the zone (1), D to it (-1); one
    that has both is two-way (0). Missing values are filled (see connector_values); one without a known mode is left out."""
    p = lambda k: F.try_element_at("p", F.lit(k))
    rows = layer.select(p("ZONENO").cast("long").alias("zone"), p("NODENO").cast("long").alias("node"), F.upper(p("DIRECTION")).alias("way"), modes_of(p("TSYSSET")).alias("modes"), with_unit(p("LENGTH"), "length").alias("distance"), F.lit(None).cast("double").alias("speed"), F.lit(None).cast("double").alias("capacity"))
    both = rows.where("modes <> ''").groupBy("zone", "node").agg(F.collect_set("way").alias("ways"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("modes", ""))))), "").alias("modes"), F.max("distance").alias("distance"), F.max("speed").alias("speed"), F.max("capacity").alias("capacity"))
    direction = F.when(F.size("ways") > 1, 0).when(F.array_contains("ways", "D"), -1).otherwise(1)
    return connector_values(both.withColumn("direction", direction).drop("ways")).select("zone", "node", "direction", "modes", "distance", "speed", "capacity", "time")
