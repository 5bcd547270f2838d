"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Forest, Table, components, hashed_order, join_hot, reachable

#: The centroids are fitted on at most so many vectors of a length (the more, the more cells), drawn by hash, and on at most so many
#: bytes of them; all vectors are assigned and compared. Cells of a length at most; a length with fewer vectors is one cell.
SAMPLE, LARGEST_SAMPLE, SAMPLE_BYTES, CELLS, FEW = 20_000, 65_536, 64 << 20, 16_384, 1_000
#: Sending a vector to a cell costs about as much as so many products.
COPY_COST = 1_500
#: A block of a cell holds about so many bytes of vectors; a task compares two blocks.
BLOCK_BYTES = 4 << 20


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids (k, d) of unit rows: assign by the largest cosine, average, normalise; an empty cell takes a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        sums[empty], norms[empty] = x[rng.choice(len(x), int(empty.sum()))], 1.0
        centres = sums / norms[:, None]
    return centres


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of large or tiny components leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(x: np.ndarray, count: int, most: int, least: float) -> np.ndarray | None:
    """Centres for `count` vectors like the unit rows x: as many as make the least work, by the visits of rows that the fit didn't see. More
    cells make fewer products and more visits; with the count, more are worth it. None: one cell."""
    some, rest = x[len(x) // 20 :], x[: len(x) // 20][:1000]
    best, work, k = None, COPY_COST + count, 2
    while k <= min(most, len(some) // 4):
        centres = spherical_kmeans(some, k)
        now = np.mean([len(c) for c in cells_of(rest, centres, least)]) * (COPY_COST + count / k)
        if now < work:
            best, work = centres, now
        k *= 2
    return best


def cells_of(x: np.ndarray, centres: np.ndarray, least: float) -> list[list[int]]:
    """The home (nearest) cell of each unit vector, and then the cells that it visits, ascending.

    Two vectors within the angle a = arccos(least) of each other, in two cells, lie on both sides of the plane that parts the two centres, so
    one of them is within a / 2 of it: its distance to the plane is at most sin(a / 2). That one visits the other's home. This
    holds for any vectors and any centres.
    """
    reach = math.sin(math.acos(least) / 2) + 1e-9
    out: list[list[int]] = []
    for at in range(0, len(x), 1024):
        close = x[at : at + 1024] @ centres.T
        home = close.argmax(axis=1)
        own, which = np.unique(home, return_inverse=True)
        gap = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 0))
        near = close.max(axis=1, keepdims=True) - close <= reach * gap[which] + 1e-12
        near[np.arange(len(home)), home] = False
        rows, cols = np.nonzero(near)
        visits = np.split(cols, np.cumsum(near.sum(axis=1))[:-1])
        out += [[h, *v.tolist()] for h, v in zip(home.tolist(), visits, strict=True)]
    return out


def close_pairs(x: np.ndarray, short: np.ndarray, some: np.ndarray, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a of some, b of others) of unit vectors x whose cosine in double precision is `least` or more. Products in single precision, which
    err by less than the slack, tell which pairs are worth it."""
    slack = 1e-6 * (8 + x.shape[1] / 16)
    a, b = np.nonzero(short[some] @ short[others].T >= np.float32(least - slack))
    if len(a) > len(some) * len(others) // 20:
        a, b = np.nonzero(x[some] @ x[others].T >= least)
        return some[a], others[b]
    a, b = some[a], others[b]
    sure = np.einsum("ij,ij->i", x[a], x[b]) >= least
    return a[sure], b[sure]


def compared(least: float):
    """Two blocks of a cell: sums of copies linked, and spanning links.

    kind 0: two blocks of residents (or one with itself), 1: a block of residents and one of visitors, 2: all of a small cell. A
    resident and a visitor that each visit the other's home meet twice, and count in the smaller of the two cells.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        cell, i, j, kind = (int(pdf[c].iloc[0]) for c in ("cell", "i", "j", "kind"))
        node, copies, block, home = (pdf[c].to_numpy(np.int64) for c in ("node", "n", "block", "home"))
        x, visitor = unit(pdf["vec"]), home != cell
        short = x.astype(np.float32)
        left = np.flatnonzero(~visitor & (block == i))
        right = np.flatnonzero((visitor & (block == j)) if kind == 1 else (~visitor & (block == j)) if kind == 0 else np.ones(len(node), dtype=bool))
        cells = [np.asarray(c, dtype=np.int64) for c in pdf["cells"].iloc[left]]
        span = 1 << 32
        visits = np.sort(np.concatenate([np.repeat(left, [len(c) for c in cells]) * span + np.concatenate(cells)])) if len(left) else np.empty(0, dtype=np.int64)
        links, forest = np.zeros(len(node), dtype=np.int64), Forest()
        for some, others in ((left[i : i + 512], right[j : j + 2048]) for i in range(0, len(left), 512) for j in range(0, len(right), 2048)):
            a, b = close_pairs(x, short, some, others, least)
            once = visitor[b] | (a < b) if i == j or kind == 2 else np.ones(len(a), dtype=bool)
            a, b = a[once], b[once]
            if visitor.any() and len(a):
                key = a * span + home[b]
                place = np.minimum(np.searchsorted(visits, key), len(visits) - 1)
                twice = visitor[b] & (visits[place] == key) & (home[b] < cell)
                a, b = a[~twice], b[~twice]
            links += np.bincount(a, weights=copies[b], minlength=len(node)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(node)).astype(np.int64)
            for p, q in zip(node[a].tolist(), node[b].tolist(), strict=True):
                forest.join(p, q)
        a, b = forest.stars()
        some = np.flatnonzero(links)
        return pd.DataFrame({"a": np.concatenate([node[some], np.array(a, dtype=np.int64)]), "b": pd.array([None] * len(some) + b, dtype="Int64"), "n": np.concatenate([links[some], np.zeros(len(a), dtype=np.int64)])})

    return run


def embedding_components(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors(vec_id, embedding).

    Cosines are in double precision. Equal vectors are one node with a count. A vector lives in its nearest cell and visits others
    such that any two that link meet (cells_of). A large cell is compared block by block. Vectors of other lengths, null or zero
    vectors and those with a null or non-finite component link with nothing (n_links 0, own component). A null vec_id
    takes part in nothing (component null, kept true). Rows that repeat a vec_id are vectors of their own and link as
    copies do. An empty table gives no rows; other columns are ignored. Equality of vectors is by 96 bits of hash.
    """
    reachable(vectors.sparkSession)
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda v: v != 0), F.lit(False))
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(kind).alias("embedding")).select("vec_id", "embedding", good.alias("good"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    nodes = Table(rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("embedding").alias("vec")), "nodes").df
    centres, base, block = {}, 0, {}
    for d, count in sorted((r[0], r[1]) for r in nodes.groupBy(F.size("vec")).count().collect()):
        block[d] = max(256, BLOCK_BYTES // (8 * d))
        centres[d] = (base, None)
        if count >= FEW:
            k = min(math.ceil(math.sqrt(count)), CELLS)
            most = max(min(max(SAMPLE, 4 * k), LARGEST_SAMPLE, SAMPLE_BYTES // (4 * d)), 4)
            own = unit(nodes.where(F.size("vec") == d).orderBy(hashed_order("node"), "node").limit(most).select("vec").toPandas()["vec"])
            centres[d] = (base, fitted(own, count, k, least))
        base += 1 if centres[d][1] is None else len(centres[d][1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["vec"].map(len)
            for d, some in pdf.groupby(size):
                first, c = centres[d]
                found = [[first]] * len(some) if c is None else [[first + k for k in row] for row in cells_of(unit(some["vec"]), c, least)]
                yield pd.DataFrame({"node": some["node"].to_numpy(), "n": some["n"].to_numpy(), "vec": some["vec"].tolist(), "cells": found, "held": np.full(len(some), block[d], dtype=np.int32)})

    placed = Table(nodes.select("node", "n", "vec").mapInPandas(assign, f"node long, n long, vec {kind}, cells array<int>, held int"), "cells").df
    home = F.element_at("cells", 1)
    sizes = placed.select(home.alias("home"), "held", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum((F.col("home") == F.col("cell")).cast("long")).alias("r"), F.sum((F.col("home") != F.col("cell")).cast("long")).alias("g"), F.max("held").alias("held"))
    sizes = Table(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("r") / F.col("held"))).cast("int").alias("mr"), F.ceil(F.col("g") / F.col("held")).cast("int").alias("mg")), "sizes").df
    each = placed.select("node", "n", "vec", "cells", home.alias("home"), F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")  # CELLS rows a length at most
    each = each.withColumn("resident", F.col("home") == F.col("cell")).withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("resident"), F.col("mr")).otherwise(F.col("mg"))).cast("int"))
    meets = """CASE WHEN mr = 1 AND mg <= 1 THEN array(named_struct('i', 0, 'j', 0, 'kind', 2))
        WHEN resident THEN concat(transform(sequence(0, mr - 1), o -> named_struct('i', least(block, o), 'j', greatest(block, o), 'kind', 0)),
                                  if(mg > 0, transform(sequence(0, greatest(mg, 1) - 1), g -> named_struct('i', block, 'j', g, 'kind', 1)), array()))
        ELSE transform(sequence(0, mr - 1), r -> named_struct('i', r, 'j', block, 'kind', 1)) END"""
    each = each.withColumn("at", F.explode(F.expr(meets))).select("cell", "at.*", "block", "node", "n", "vec", "home", F.when(F.col("resident"), F.col("cells")).otherwise(F.expr("cast(array() as array<int>)")).alias("cells"))
    found = Table(each.groupBy("cell", "i", "j", "kind").applyInPandas(compared(least), "a long, b long, n long"), "links").df
    linked = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    known = nodes.select("h1", "h2", "node", "n").join(counts, "node", "left").join(linked, "node", "left")
    known = Table(known.selectExpr("h1", "h2", "coalesce(others, 0) + n - 1 n_links", "coalesce(component, node) component_id", "true good", "n"), "classes").df
    joined = join_hot(rows.select("vec_id", "h1", "h2", "good"), known, ["h1", "h2", "good"], "n", "left")
    return joined.selectExpr("vec_id", "coalesce(n_links, 0L) n_links", "coalesce(component_id, vec_id) component_id", "coalesce(vec_id = coalesce(component_id, vec_id), true) kept")
