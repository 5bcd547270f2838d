"""Document fingerprints by a randomised edit embedding (Chakraborty, Goldenberg, Koucky, 2016).

All texts share one random walk: at step t the walk writes the character it stands on, and moves to the next if a
random bit of (t, character) is 1. Texts at a small edit distance fall back into step after an edit, so that the edit
distance becomes the Hamming distance of what is written. A fingerprint samples bits of the written string: 64 of each
octave of steps, so that it grows with the logarithm of the text and no part of a text is left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import Forest, Table, components, in_blocks, join_hot, reachable

PERIOD, BITS = 256, 64
LOWEST = -(1 << 63)


@lru_cache(1)
def walk_table() -> list[bytes]:
    """For each class of characters and step modulo PERIOD: the step, modulo PERIOD, after the walk has moved on."""
    bits = np.random.default_rng(2016).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    bits[:, 0] |= bits.sum(axis=1) == 0
    twice = np.concatenate([bits, bits], axis=1)
    out = []
    for row in twice:
        ones = np.flatnonzero(row)
        out.append(bytes(((ones[np.searchsorted(ones, np.arange(PERIOD))] + 1) % PERIOD).astype(np.uint8)))
    return out


@lru_cache(1)
def classes() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64)).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(64)
def sampled(octave: int) -> np.ndarray:
    """Steps of an octave: 0 to 63 in the first, then 64 of each [64 * 2^(k-1), 64 * 2^k), shared by all texts."""
    if octave == 0:
        return np.arange(BITS)
    low = BITS << (octave - 1)
    return np.sort(np.random.default_rng(octave).integers(low, 2 * low, BITS))


class Walk:
    """A text's walk: its characters, and the step at which the walk leaves each."""

    def __init__(self, chars: np.ndarray, before: Walk | None = None, shared: int = 0):
        """before: a walk over a text with the same first `shared` characters."""
        rows = walk_table()
        state, ends = 0, np.empty(0, dtype=np.int64)
        if shared:
            ends = before.ends[:shared]
            state = int(ends[-1]) % PERIOD
        tail = classes()[chars[shared:]].tobytes()
        start = state
        states = bytes([state := row[state] for row in map(rows.__getitem__, tail)])
        moves = np.frombuffer(bytes([start]) + states, dtype=np.uint8)
        steps = (moves[1:] - moves[:-1]).astype(np.int64)
        steps[steps == 0] = PERIOD
        self.chars, self.ends = chars, np.concatenate([ends, np.cumsum(steps) + (ends[-1] if shared else 0)])

    def fingerprint(self) -> str:
        """8 hex digits of the number of steps, then 16 for each octave that has some of them."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        octaves = 1 + max(0, (max(total, 1) - 1) // BITS).bit_length()
        at = np.concatenate([sampled(k) for k in range(octaves)])
        place = np.searchsorted(self.ends, at, side="right")
        inside = place < len(self.chars)
        written = np.zeros(len(at), dtype=np.uint64)
        written[inside] = self.chars[place[inside]].astype(np.uint64) + np.uint64(1)
        bits = (mix(written * np.uint64(0x100000001) ^ mix(at.astype(np.uint64))) >> np.uint64(17)) & np.uint64(1)
        return f"{total:08x}{np.packbits(bits.astype(np.uint8)).tobytes().hex()}"


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def likeness(one: str, two: str) -> float:
    """How alike the sampled parts of two texts are, 0 to 1: the share of steps at which both wrote the same.

    Each sampled bit stands for the steps of its octave; steps that only one text has count as different. Chance
    agreement of bits (a half) is taken off. Equal fingerprints give 1, as do two empty texts.
    """
    if one == two:
        return 1.0
    total = max(int(one[:8], 16), int(two[:8], 16))
    octaves = (max(len(one), len(two)) - 8) // 16
    a, b = (np.unpackbits(np.frombuffer(bytes.fromhex(x[8:].ljust(16 * octaves, "0")), dtype=np.uint8)) for x in (one, two))
    at = np.concatenate([sampled(k) for k in range(octaves)])
    weight = np.repeat([1.0, *(float(1 << (k - 1)) for k in range(1, octaves))], BITS) * (at < total)
    both = at < min(int(one[:8], 16), int(two[:8], 16))
    agree = float((weight * np.where(both, 2.0 * (a == b) - 1, 0.0)).sum() / weight.sum())
    return min(1.0, max(0.0, agree))


def edited(chars: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its last floor(n / 2) characters replaced by the first as many (or all) of the next."""
    half = len(chars) // 2
    return np.concatenate([chars[: len(chars) - half], following[:half]])


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, role, key, h, doc_id, text) such that each document and the next by (key, h) are in one part, in one shuffle.

    Parts are ranges of (key, h) between rows drawn by hash (a bounded list: 16 for each of three parts a shuffle
    partition), so that rows of one doc_id are cut by the hash of their texts. The first rows of a part also go to the part
    before it, with role 1; those of the first part to the last.
    """
    spark = docs.sparkSession
    keys = docs.select("key", "h")
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = keys.count()
    every = max(1, n // (16 * parts))
    drawn = sorted({(r[0], r[1]) for r in keys.where(F.pmod(F.xxhash64("key", "h", F.lit(5)), F.lit(every)) == 0).distinct().limit(64 * parts).collect()})
    lowest = keys.agg(F.min(F.struct("key", "h")).alias("low")).first().low
    lowest = None if lowest is None else tuple(lowest)
    cuts = [x for x in drawn[:: max(1, len(drawn) // parts)] if x != lowest]

    @F.pandas_udf("array<int>")
    def where(key: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for pair in zip(key.tolist(), h.tolist(), strict=True):
            p = bisect_right(cuts, pair)
            out.append([p, p - 1] if p and cuts[p - 1] == pair else [p, len(cuts)] if pair == lowest else [p])
        return pd.Series(out)

    placed = docs.select("key", "h", "doc_id", "text", F.posexplode(where("key", "h")).alias("role", "part"))
    return placed.repartition("part").sortWithinPartitions("part", "role", "key", "h", "text")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each part: a document once its next is known."""
    waiting, part = None, None  # waiting: (doc_id, walk, fingerprint)
    for pdf in batches:
        out = []
        for p, role, doc, text in zip(pdf["part"].tolist(), pdf["role"].tolist(), pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
            if p != part:
                waiting, part = None, p
            if role and waiting is None:
                continue
            now = Walk(characters(text))
            printed = now.fingerprint()
            if waiting is not None:
                first, walk, own = waiting
                other = edited(walk.chars, now.chars)
                changed = Walk(other, walk, len(walk.chars) - len(walk.chars) // 2).fingerprint()
                digest = hashlib.sha256(other.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                out.append((first, len(walk.chars), digest, own, changed, likeness(own, changed), likeness(own, printed)))
            waiting = None if role else (doc, now, printed)
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs(doc_id, text).

    The next document is that of the next doc_id, after the last the first; of rows with one doc_id, the next is the
    next by the hash of its text, and the first follows the doc_id before it. A null id comes first, a null text is empty. One row:
    it is its own next. No rows: none. Other columns are ignored. Texts move once.
    """
    reachable(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    return neighbours(rows).mapInPandas(_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Bands of a fingerprint: BAND_BITS sampled bits each, drawn by the weight of their octaves. Bits agree with probability 0.9 where the likeness
#: is 0.8, so such a pair shares one of the bands with probability 1 - (1 - 0.9^18)^36 = 0.998 if the bits were independent.
BANDS, BAND_BITS = 36, 18
#: Rows of a band that are compared at once; larger bands in blocks, each with each.
HELD = 1024


@lru_cache(64)
def drawn_bits(octaves: int) -> np.ndarray:
    """The bits of each band of a fingerprint of so many octaves: of its longest with which a text may still share most steps (the last but one)
    and of those below, each by the steps that its octave stands for."""
    rng = np.random.default_rng(octaves)
    top = max(octaves - 1, 1)
    weight = np.repeat([1.0, *(float(1 << (k - 1)) for k in range(1, top))], BITS)
    return np.stack([rng.choice(top * BITS, BAND_BITS, replace=False, p=weight / weight.sum()) for _ in range(BANDS)])


def bands(printed: str) -> list[int]:
    """Banding keys: sampled bits of the octaves below the last, and, since a like text may have one octave less or more, of the octaves
    that remain without the last as well."""
    octaves = (len(printed) - 8) // 16
    bits, out = np.unpackbits(np.frombuffer(bytes.fromhex(printed[8:]), dtype=np.uint8)), []
    for n in {octaves, max(octaves - 1, 1)}:
        chosen = bits[drawn_bits(n)] @ (1 << np.arange(BAND_BITS))
        out += [int(x) | k << 32 | n << 48 for k, x in enumerate(chosen)]
    return out


class Prints:
    """Fingerprints as arrays, to compare one with many by likeness()."""

    def __init__(self, printed: list[str]):
        self.octaves = max((len(x) - 8) // 16 for x in printed)
        self.total = np.array([int(x[:8], 16) for x in printed])
        self.bits = np.stack([np.unpackbits(np.frombuffer(bytes.fromhex(x[8:].ljust(16 * self.octaves, "0")), dtype=np.uint8)) for x in printed])
        self.at = np.concatenate([sampled(k) for k in range(self.octaves)])
        self.weight = np.repeat([1.0, *(float(1 << (k - 1)) for k in range(1, self.octaves))], BITS)

    def near(self, k: int, others: np.ndarray, least: float) -> np.ndarray:
        long, short = np.maximum(self.total[k], self.total[others])[:, None], np.minimum(self.total[k], self.total[others])[:, None]
        weight = self.weight * (self.at < long)
        agree = (weight * np.where(self.at < short, 2.0 * (self.bits[others] == self.bits[k]) - 1, 0.0)).sum(axis=1) / weight.sum(axis=1)
        return agree >= least - 1e-12


def edit_near_duplicates(spark: SparkSession, docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(node, component) of documents that share a band and whose fingerprints are alike by at least `least`, or that are equal.

    Equal fingerprints are one node. Any two nodes of a band are compared, unless they are joined already; a band over HELD rows
    is compared in blocks, each with each. Null doc_ids are left out, a null text is empty, rows without a link aren't returned.
    """

    def prints(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [Walk(characters(t)).fingerprint() for t in pdf["text"]]})

    def keyed(batches):
        for pdf in batches:
            rows = [(b, n, f) for n, f in zip(pdf["node"].tolist(), pdf["fp"].tolist(), strict=True) for b in bands(f)]
            yield pd.DataFrame(rows, columns=["band", "node", "fp"])

    def links(node: list[int], fp: list[str], forest: Forest) -> None:
        prints = Prints(fp)
        for k in range(len(node) - 1):
            rest = np.array([r for r in range(k + 1, len(node)) if forest.root(node[r]) != forest.root(node[k])], dtype=np.intp)
            for at in range(0, len(rest), 256):
                some = rest[at : at + 256]
                for r in some[prints.near(k, some, least)].tolist():
                    forest.join(node[k], node[r])

    def compared(batches):
        band, node, fp = None, [], []
        forest = Forest()
        for pdf in batches:
            for b, n, f in pdf[["band", "node", "fp"]].itertuples(index=False):
                if b != band:
                    if len(node) > 1:
                        links(node, fp, forest)
                    band, node, fp = b, [], []
                node.append(n)
                fp.append(f)
        if len(node) > 1:
            links(node, fp, forest)
        a, b = forest.stars()
        yield pd.DataFrame({"a": np.array(a, dtype="int64"), "b": np.array(b, dtype="int64")})

    reachable(spark)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = Table(rows.mapInPandas(prints, "doc_id long, fp string"), "edit").df
    nodes = Table(found.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes").df
    banded = Table(nodes.mapInPandas(keyed, "band long, node long, fp string"), "bands").df
    linked = in_blocks(banded, "band", HELD).repartition("band").sortWithinPartitions("band", "node").mapInPandas(compared, "a long, b long")
    same = join_hot(found, nodes, ["fp"], "n").selectExpr("doc_id a", "node b").where("a <> b")
    return components(linked.union(same))
