"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through Golay-code keys.

A fingerprint is cut into three segments of 22, 21 and 21 bits, read as words of the perfect (23, 12, 7) Golay code.
Of two fingerprints that differ in at most two bits, one segment is equal (pigeonhole) and the next differs in at most
two bits. Words at distance two or less have a common neighbour at distance one or less from both, so decoding a
word and its one-bit neighbours gives a few codeword indices (one to six), of which such words share at least one.
A key is the equal segment with one index of the next; rows that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Forest, Scope, Table, components, in_blocks, join_hot, reachable, small_side

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GOLAY = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))
SEED = 42


def shingle_hashes(text: bytes | None, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included; of the whole sequence if it is shorter; none without a word."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as one unsigned number; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of one UTF-8 text: unsigned, 0 if it has no words."""
    return majority(shingle_hashes(text, words))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(1)
def errors() -> np.ndarray:
    """Error pattern by syndrome, for the 2,048 patterns of weight three or less."""
    table = np.zeros(2048, dtype=np.int64)
    bits = [0, *(1 << k for k in range(23))]
    patterns = np.unique(np.array([a | b | c for a in bits for b in bits for c in bits], dtype=np.int64))
    table[syndrome(patterns)] = patterns
    return table


def syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for k in range(22, 10, -1):
        rest ^= np.where((rest >> k) & 1 == 1, GOLAY << (k - 11), 0)
    return rest


def indices(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword within distance three of each 23-bit word."""
    return (words ^ errors()[syndrome(words)]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Golay keys of signed fingerprints: positions in prints, and keys (each pair once)."""
    u = prints.view(np.uint64)
    cut = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, out = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = np.stack([cut[j], *(cut[j] ^ (1 << k) for k in range(SEGMENTS[j][1]))], axis=1)
        found = np.sort(indices(near.ravel()).reshape(near.shape), axis=1)
        first = np.ones(found.shape, dtype=bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        at, col = np.nonzero(first)
        rows.append(at)
        out.append((np.int64(i) << 34) | (cut[i][at] << 12) | found[at, col])
    return np.concatenate(rows), np.concatenate(out)


def _prints(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [signed(fingerprint(t, words)) for t in pdf["text"]]})

    return run


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp, node = pdf["fp"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
        rows, key = keys(fp)
        yield pd.DataFrame({"key": key, "fp": fp[rows], "node": node[rows]})


def _verified(limit: int, bits: int):
    """Rows sorted by key: links (a, b) in keys of up to limit rows; rows of larger keys go on as (a, null) for a finer split."""

    def links(key, fp, node) -> pd.DataFrame:
        forest, live, step = Forest(), np.arange(len(key)), 1
        while len(live):
            live = live[live + step < len(key)]
            live = live[key[live] == key[live + step]]
            near = live[np.bitwise_count(fp[live].view(np.uint64) ^ fp[live + step].view(np.uint64)) <= bits]
            for a, b in zip(node[near].tolist(), node[near + step].tolist(), strict=True):
                forest.join(a, b)
            step += 1
        a, b = forest.stars()
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": pd.array(b, dtype="Int64"), "fp": np.zeros(len(a), dtype=np.int64)})

    def large(fp, node) -> pd.DataFrame:
        return pd.DataFrame({"a": node, "b": pd.array([None] * len(node), dtype="Int64"), "fp": fp})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp, node = (np.empty(0, dtype=np.int64) for _ in range(3))
        over = None  # the large key that the last batch ended in
        for pdf in batches:
            key, fp, node = (np.concatenate([x, pdf[c].to_numpy(np.int64)]) for x, c in ((key, "key"), (fp, "fp"), (node, "node")))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            big = np.repeat((sizes > limit) | (key[starts] == over if over is not None else False), sizes)
            open_run = np.zeros(len(key), dtype=bool)
            if len(key):
                open_run[starts[-1] :] = True
            if big.any():
                yield large(fp[big], node[big])
            over = key[-1] if len(key) and big[-1] else None
            now = ~big & ~open_run
            yield links(key[now], fp[now], node[now])
            stay = open_run & ~big
            key, fp, node = key[stay], fp[stay], node[stay]
        yield links(key, fp, node)

    return run


def link_prints(prints: DataFrame, bits: int = 2, limit: int = 512) -> DataFrame:
    """Links between distinct fingerprints (fp long, node long) that differ in up to two bits, as edges (a, b) of nodes.

    Edges are enough to connect all that the links connect; they are not all pairs. A key with over `limit` rows is
    split exactly: each of its fingerprints goes to the 65 words within one bit of it. Two fingerprints meet at
    such a word if and only if they link, and at most 65 can meet there.
    """
    if bits > 2:
        raise ValueError("Golay keys cover links of two differing bits at most")
    found = Table(prints.mapInPandas(_keys, "key long, fp long, node long").repartition("key").sortWithinPartitions("key").mapInPandas(_verified(limit, bits), "a long, b long, fp long"), "links")
    small = found.df.where("b is not null").select("a", "b")
    rest = found.df.where("b is null").select("a", "fp").distinct()
    if bits < 2 or rest.isEmpty():
        return small
    around = rest.selectExpr("a", "fp", "explode(concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))) word")
    met = around.groupBy("word").agg(F.collect_set("a").alias("all")).where("size(all) > 1").selectExpr("all", "array_min(all) b")
    return small.union(met.selectExpr("explode(all) a", "b").where("a <> b"))


def simhash_components(docs: DataFrame, words: int = 3, bits: int = 2, limit: int = 512) -> DataFrame:
    """(doc_id, fp long, fingerprint, component_id) for each row of docs(doc_id, text).

    Texts are whole; words are split at ASCII white space after A-Z are lower-cased; a null or blank text has the
    fingerprint zero and links like any other. Equal fingerprints are one node (pre-aggregated), whatever their number;
    repeated doc_ids give repeated rows. A row with a null doc_id keeps its fingerprint and takes part in no link
    (component null). Other columns are ignored, an empty table gives no rows.
    """
    reachable(docs.sparkSession)
    prints = Table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(_prints(words), "doc_id long, fp long"), "prints").df
    nodes = Table(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes").df
    linked = components(link_prints(nodes.where("node is not null").select("fp", "node"), bits, limit))
    of_print = Table(nodes.join(linked, "node", "left").selectExpr("fp", "coalesce(component, node) component_id", "n"), "classes").df
    return join_hot(prints, of_print, ["fp"], "n").selectExpr("doc_id", "fp", "lower(lpad(hex(fp), 16, '0')) fingerprint", "if(doc_id is null, null, component_id) component_id")


#: Min-wise keys: BANDS of ROWS smallest permuted hashes each; texts of similarity 0.8 share a band with probability 0.997.
BANDS, ROWS, BINS = 8, 3, 256
#: Pairs are examined exactly if their estimated likeness is over the limit less this, four standard errors of it.
SLACK = 0.1
#: A key of more rows is compared in blocks of about so many, each with each.
HELD = 1024


def sketch(hashes: np.ndarray) -> bytes:
    """One byte for each of BINS ranges of hashes: a mark (1 to 255) of the smallest in it, 0 if it is empty."""
    marks = np.zeros(BINS, dtype=np.uint8)
    if len(hashes):
        h = np.sort(hashes)
        bins = (h >> np.uint64(56)).astype(np.intp)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        marks[bins[first]] = (h[first] & np.uint64(0xFFFFFFFF)) % np.uint64(255) + np.uint64(1)
    return marks.tobytes()


def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of a sketch with others: equal bins over bins that aren't empty in both."""
    used = (many != 0) | (one != 0)
    return ((many == one) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys of the distinct hashes; none for a text without words."""
    if not len(hashes):
        return []
    odd = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 8192):
        x = hashes[at : at + 8192, None] * odd
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    return [signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


def same_set(once: np.ndarray) -> int:
    """A hash of a set of shingles, of its distinct hashes in order."""
    return signed(xxhash.xxh64_intdigest(once.tobytes()))


def _profiles(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                h = shingle_hashes(text, words)
                once = np.unique(h)
                rows.append((doc, signed(majority(h)), same_set(once), sketch(once), band_keys(once)))
            yield pd.DataFrame(rows, columns=["doc_id", "fp", "same", "marks", "bands"]).astype({"doc_id": "Int64"})

    return run


def _grouped(least: float, exact: float | None = None):
    """Rows (band, node, marks) sorted by band: spanning links (a, b) of rows of a band that are alike by `least`.

    Rows are compared with a leader, what is left with the next, and then sets that aren't joined with each other: any two
    rows of a band are compared unless they are joined already. A band is held whole (see in_blocks). With `exact`, rows also
    have `shingles` (distinct hashes, 8 bytes each), and of those alike by `least` the Jaccard similarity of these decides.
    """

    def links(node: np.ndarray, marks: np.ndarray, sets_of: np.ndarray, forest: Forest) -> None:
        ids = [np.frombuffer(x, dtype=np.uint64) for x in sets_of]
        if exact is not None:
            place = np.unique(np.concatenate(ids), return_inverse=True)[1] if ids else np.empty(0, dtype=np.intp)
            ids = np.split(place, np.cumsum([len(x) for x in ids])[:-1])
            here = np.zeros(len(place), dtype=bool)

        def near(k: int, others: np.ndarray) -> np.ndarray:
            hit = alike(marks[k], marks[others]) >= least
            if exact is not None and hit.any():
                here[ids[k]] = True
                both = np.array([here[ids[r]].sum() for r in others[hit]])
                here[ids[k]] = False
                hit[hit] = both / np.maximum(len(ids[k]) + np.array([len(ids[r]) for r in others[hit]]) - both, 1) >= exact
            return hit

        left, sets = np.arange(len(node)), []
        while len(left):
            hit = near(left[0], left)
            hit[0] = True
            for k in left[hit][1:]:
                forest.join(int(node[left[0]]), int(node[k]))
            sets.append(left[hit])
            left = left[~hit]
        part = np.zeros(len(node), dtype=np.int64)  # the joined set of each row
        for i, s in enumerate(sets):
            part[s] = i
        for s in sorted(sets, key=len)[:-1]:
            for k in s:
                others = np.flatnonzero(part != part[k])
                hit = others[near(k, others)]
                for i in np.unique(part[hit]):
                    forest.join(int(node[k]), int(node[hit[part[hit] == i][0]]))
                    part[part == i] = part[k]
                if len(others) == 0:
                    break

    def stars(forest: Forest) -> pd.DataFrame:
        a, b = forest.stars()
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        band, node, marks, sets_of = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, BINS), dtype=np.uint8), np.empty(0, dtype=object)
        for pdf in batches:
            if not len(pdf):
                continue
            band, node = np.concatenate([band, pdf["band"].to_numpy(np.int64)]), np.concatenate([node, pdf["node"].to_numpy(np.int64)])
            marks = np.concatenate([marks, np.frombuffer(b"".join(pdf["marks"]), dtype=np.uint8).reshape(-1, BINS)])
            sets_of = np.concatenate([sets_of, pdf["shingles"].to_numpy(object) if exact is not None else np.full(len(pdf), b"", dtype=object)])
            forest, starts = Forest(), np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if j - i > 1:
                    links(node[i:j], marks[i:j], sets_of[i:j], forest)
            band, node, marks, sets_of = (x[starts[-1] :] for x in (band, node, marks, sets_of))  # this band may go on
            yield stars(forest)
        forest = Forest()
        links(node, marks, sets_of, forest)
        yield stars(forest)

    return run


def _shingled(words: int):
    """Rows (band, node, same, text): (band, node, marks, shingles) of those whose text has the set of shingles `same`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for band, node, same, text in zip(pdf["band"].tolist(), pdf["node"].tolist(), pdf["same"].tolist(), pdf["text"], strict=True):
                once = np.unique(shingle_hashes(text, words))
                if same_set(once) == same:
                    rows.append((band, node, sketch(once), once.tobytes()))
            yield pd.DataFrame(rows, columns=["band", "node", "marks", "shingles"])

    return run


def near_copies(docs: DataFrame, words: int = 5, bits: int = 2, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of each row of docs(doc_id, text) with a doc_id: components of texts alike by `least`.

    Likeness is the Jaccard similarity of the sets of shingles. Groups that may hold such texts come from the Golay keys of
    SimHash fingerprints and, since at two bits those find few pairs below a likeness of 0.95, from keys of min-wise hashes with
    an estimate from 256 marks of `least` less SLACK (four standard errors) or more. Within a group, any two texts that pass that
    estimate are compared by their whole sets. Texts without a word are one group. A null doc_id is left out.
    """
    reachable(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    profiles = Table(rows.mapInPandas(_profiles(words), "doc_id long, fp long, same long, marks binary, bands array<long>"), "profiles").df
    nodes = Table(profiles.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("marks").alias("marks"), F.first("bands").alias("bands"), F.count("*").alias("n")), "nodes").df
    with Scope() as scope:
        banded = in_blocks(nodes.select(F.explode("bands").alias("band"), "node", "marks"), "band", HELD).repartition("band").sortWithinPartitions("band", "node")
        found = Table(banded.mapInPandas(_grouped(least - SLACK), "a long, b long"), "banded").df  # written, so that no task needs two Python workers
        prints = Table(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "prints").df
        same = join_hot(nodes.select("fp", F.col("node").alias("a")), prints.withColumnRenamed("node", "b"), ["fp"], "n").where("a <> b").select("a", "b")
        maybe = components(found.union(link_prints(prints.select("fp", "node"), bits)).union(same))
        members = Table(nodes.select("same", "node").join(maybe, "node").select("node", "same", F.col("component").alias("band")), "members").df
        texts = rows.join(small_side(members), F.col("doc_id") == F.col("node")).select("band", "node", "same", "text")
        sets = Table(texts.mapInPandas(_shingled(words), "band long, node long, marks binary, shingles binary"), "sets").df
        grouped = in_blocks(sets, "band", HELD).repartition("band").sortWithinPartitions("band", "node")
        linked = components(Table(grouped.mapInPandas(_grouped(least - SLACK, least), "a long, b long"), "exact").df)
        classes = scope.keep(Table(nodes.select("same", "node", "n").join(linked, "node", "left").selectExpr("same", "coalesce(component, node) component_id", "n"), "classes"))
    return join_hot(profiles.select("doc_id", "same"), classes, ["same"], "n").select("doc_id", "component_id")


def simhash_dedup(docs: DataFrame, words: int = 5, bits: int = 2, least: float = 0.8) -> DataFrame:
    """The rows of docs that stand for their group of near copies: the smallest doc_id of each. Rows with a null doc_id stay.

    Of rows that repeat a doc_id one stays: the least, compared column by column.
    """
    with Scope() as scope:
        classes = Table(near_copies(docs, words, bits, least).selectExpr("doc_id", "doc_id = component_id kept"), "kept").df
        gone = scope.keep(Table(classes.where("not kept").select("doc_id").distinct(), "gone"))
        repeated = scope.keep(Table(classes.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated"))
    kept = docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    row = F.struct(*[c for c in docs.columns if c != "doc_id"])
    one = kept.join(small_side(repeated), "doc_id", "left_semi").select("doc_id", row.alias("row")).groupBy("doc_id").agg(F.min("row").alias("row"))
    return kept.join(small_side(repeated), "doc_id", "left_anti").select(docs.columns).union(one.select(*["doc_id" if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns]))
