"""What the text operators share: tables in the shared folder, folds, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows and bytes of a batch that a Python worker is handed at once; texts are long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the file system; elsewhere ship it with --py-files.

    Also lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are larger.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or int(now) > most or int(now) == 0:
            spark.conf.set(key, str(most))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset, as in local tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-", dir="/tmp"))
        path = sc.getCheckpointDir()
    return f"{path.rstrip('/')}/netloom-{sc.applicationId}"


class Table:
    """A DataFrame written to the shared folder: it has no lineage, survives lost executors, and can be dropped."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        reachable(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = spark.read.schema(schema).parquet(self.path)
        if Scope.open:
            Scope.open[-1].tables.append(self)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """On leaving, drops the tables that were written inside; those given to keep() belong to the scope around it."""

    open: ClassVar[list[Scope]] = []

    def __enter__(self) -> Scope:
        self.tables: list[Table] = []
        self.kept: list[Table] = []
        Scope.open.append(self)
        return self

    def keep(self, table: Table) -> DataFrame:
        self.kept.append(table)
        return table.df

    def __exit__(self, *_) -> None:
        Scope.open.pop()
        for table in self.tables:
            if table not in self.kept:
                table.drop()
        if Scope.open:
            Scope.open[-1].tables += self.kept


#: A written side of a join is broadcast up to so many rows, and up to so many bytes of files.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: A key with over so many rows on the long side of a join is hot.
HOT_ROWS = 100_000


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate: for a written table, the bytes of its files by the share of its columns."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count of its rows and the bytes of its files find it small. For tables that are already written (see Table)."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


def join_hot(long: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner", hot: int | None = None) -> DataFrame:
    """long joined with a written table of one row for each of the keys, of which column n has the key's rows in long.

    A small table is broadcast. Else rows of hot keys (at most rows of long / HOT_ROWS of them, so a bounded list) are joined with
    a broadcast of these alone, in place, and the rest by a shuffle in which no key is large. n isn't returned.
    """
    small = small_side(table)
    if small is not table:
        return long.join(small.drop(n), keys, how)
    few = table.where(F.col(n) > (HOT_ROWS if hot is None else hot))
    told = long.join(F.broadcast(few.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
    in_place = told.where("__hot").drop("__hot").join(F.broadcast(few.drop(n)), keys)
    return in_place.unionByName(told.where("__hot is null").drop("__hot").join(table.where(F.col(n) <= (HOT_ROWS if hot is None else hot)).drop(n), keys, how))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id is held out too, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def hashed_order(column: str = "doc_id", seed: int = 7) -> Column:
    return F.xxhash64(F.col(column), F.lit(seed))


class Forest:
    """Union-find on integers; the smallest member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)

    def stars(self) -> tuple[list[int], list[int]]:
        members = [x for x in self.up if self.root(x) != x]
        return members, [self.up[x] for x in members]


def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) of a partition, batch by batch, to the stars of their components: at most one edge a node."""
    for pdf in batches:
        forest = Forest()
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.join(a, b)
        a, b = forest.stars()
        yield pd.DataFrame({"a": np.array(a, dtype="int64"), "b": np.array(b, dtype="int64")})


#: Edges that one task of a round of components() writes.
EDGES_TASK = 20_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a long, b long): (node, component), component the smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014): each node's smallest neighbour is found by a partial
    aggregate, so a hub costs a row for each task; the edges of a hub are joined in place (join_hot); and only O(edges) rows are
    written a round, to the shared folder.
    Nodes without an edge to another node are not returned. Null ends and loops are ignored. No edges: no rows.
    """
    now = Table(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").mapInPandas(spanning, "a long, b long").distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.expr("xxhash64(a, b) % 1000000007"))).first()

    seen = mark(now.df)
    for _ in range(rounds if seen[0] else 0):
        tasks = 1 + seen[0] // EDGES_TASK
        both = now.df.union(now.df.selectExpr("b", "a"))
        low = Table(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).selectExpr("a", "least(a, m) m", "n").coalesce(tasks), "low")
        large = join_hot(both, low.df, ["a"], "n").where("b > a").selectExpr("b a", "m b").where("a <> b")
        large = Table(large.selectExpr("greatest(a, b) a", "least(a, b) b").distinct().coalesce(tasks), "large")
        least = Table(large.df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(tasks), "least")
        small = join_hot(large.df, least.df, ["a"], "n").selectExpr("b a", "m b").where("a <> b").union(least.df.selectExpr("a", "m b"))
        new = Table(small.selectExpr("greatest(a, b) a", "least(a, b) b").distinct().coalesce(tasks), "edges")
        for old in (now, low, large, least):
            old.drop()
        now, last, seen = new, seen, mark(new.df)
        if last == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.df.selectExpr("a node", "b component").union(now.df.selectExpr("b", "b").distinct())


def in_blocks(rows: DataFrame, key: str, held: int) -> DataFrame:
    """rows(key long, node, ...) with keys of over `held` rows split: their rows are dealt into blocks of about `held` by hash,
    and each pair of blocks becomes a key of its own, so that any two rows of a key meet in one of at most about 2 held rows."""
    large = Table(rows.groupBy(key).count().where(F.col("count") > held).select(key, F.ceil(F.col("count") / held).cast("int").alias("__m")).coalesce(1), "large").df
    each = rows.join(small_side(large), key, "left").withColumn("__m", F.coalesce("__m", F.lit(1)))
    each = each.withColumn("__block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("__m")).cast("int")).withColumn("__other", F.explode(F.expr("sequence(0, __m - 1)")))
    pair = F.xxhash64(key, F.least("__block", "__other"), F.greatest("__block", "__other"))
    return each.withColumn(key, F.when(F.col("__m") == 1, F.col(key)).otherwise(pair)).select(rows.columns)
