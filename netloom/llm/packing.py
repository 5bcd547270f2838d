"""Packing token sequences into windows of equal capacity by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import reachable
from netloom.llm.token_count import plain_merges, spec, tokenizer, vocabulary

CAPACITY, END = 2048, 1
#: Windows packed together; words remembered by a worker.
GROUP_WINDOWS, MEMORY_WORDS = 32, 300_000
#: How full a group's windows are to be, so that near-equal ones hold within the capacity.
FILL = 0.99


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: items (by position) in `windows` sets of near-equal sums.

    A partial partition is a tuple of sums in falling order, each with its items. The two with the widest spread are
    merged again and again, the largest sum of one with the smallest of the other, so that their imbalances oppose.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    none: tuple = ()
    heap = []
    for k, size in enumerate(sizes):
        heap.append((-size, k, [size] + [0] * (windows - 1), [(k, none)] + [none] * (windows - 1)))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        joined = list(map(add, sums, reversed(other)))
        trees = [(x, y) if x and y else x or y for x, y in zip(sets, reversed(more), strict=True)]
        order = sorted(range(windows), key=joined.__getitem__, reverse=True)
        low = joined[order[-1]]
        heapq.heappush(heap, (low - joined[order[0]], tick, [joined[k] - low for k in order], [trees[k] for k in order]))
        tick += 1
    out = []
    for tree in heap[0][3] if heap else [none] * windows:
        items, todo = [], [tree]
        while todo:
            node = todo.pop()
            if not node:
                continue
            if isinstance(node[0], int):
                items.append(node[0])
                todo.append(node[1])
            else:
                todo.extend(node)
        out.append(items)
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows within capacity: the window count starts at the least possible and rises whenever a window exceeds it."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item exceeds the capacity")
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        found = [w for w in differencing(sizes, count) if w]
        if all(sum(sizes[k] for k in w) <= capacity for w in found):
            return found
        count += 1


#: Python's split() takes these for white space, the vocabularies' patterns don't; texts that hold one are encoded whole.
ODD_SPACES = re.compile("[\x1c-\x1f]")


#: Words of printable ASCII and the letters of Latin-1; their pre-tokens, in lower case (as the vocabulary's pattern has them).
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Byte-level vocabularies write bytes as characters; those that aren't printable follow from 256.
BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def written(part: str) -> str:
    return part if part.isascii() else part.encode().decode("latin-1").translate(BYTES)


#: The pattern and the steps of the vocabularies that drop white space and write in lower case.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_rules(tok) -> bool:
    """Whether a vocabulary's pre-tokens never hold white space, and follow WORD_PATTERN in lower case."""
    found = spec(tok)
    steps = [x["type"] for x in (found["normalizer"] or {}).get("normalizers", [])]
    pre = (found["pre"] or {}).get("pretokenizers", [])
    split = len(pre) == 2 and pre[0].get("pattern") == {"Regex": WORD_PATTERN} and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and pre[1]["type"] == "ByteLevel" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
    return bool(steps == ["NFC", "Replace", "Lowercase"] and split and plain_merges(found, "</w>"))


PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return PACK[len(ids)](*ids) if len(ids) < 33 else struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Ids by white-space word, found on first use and remembered, for vocabularies of the rules that word_rules() tests; those of
    others have their texts encoded whole.

    Beyond MEMORY_WORDS all are forgotten: the common ones are found again at once.
    """

    def __init__(self, tok):
        super().__init__()
        self.tok, self.merge, self.known = tok, tok.model.tokenize, word_rules(tok)

    def __missing__(self, word: str) -> bytes:
        if SIMPLE.fullmatch(word) and "<|" not in word:
            low = word.lower()
            if low.isalpha():
                found = packed([t.id for t in self.merge(low if low.isascii() else written(low))])
            else:
                found = b"".join([self.part(p) for p in PARTS.findall(low)])
        else:
            found = packed(self.encode(word))
        self[word] = found
        return found

    def part(self, low: str) -> bytes:
        found = self.get(low)
        if found is None:
            found = self[low] = packed([t.id for t in self.merge(written(low))])
        return found

    def encode(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self) > MEMORY_WORDS:
            self.clear()
        if not self.known:
            return [packed(self.encode(t)) for t in texts]
        return [packed(self.encode(t)) if ODD_SPACES.search(t) else b"".join(map(self.__getitem__, t.split())) for t in texts]


@lru_cache(2)
def words_of(path: str) -> Words:
    """A worker's words of a vocabulary: they stay from task to task."""
    return Words(tokenizer(path))


def pieces(items: list[tuple], capacity: int, group: int, final: bool, base: int, fill: float = FILL) -> tuple[list[tuple], list[tuple], int]:
    """Pack items (row, start, ids as bytes) of one stream: the pieces (.., window, offset) of whole groups, the items left over, the next window's number.

    A group's total is `fill` of its windows (its last item is cut there), so that near-equal windows seldom exceed the capacity;
    where one does, the window count rises. What is left at the end of the stream is a group of its own.
    """
    out: list[tuple] = []
    goal = max(1, int(group * capacity * fill))
    total = sum(len(x[2]) for x in items) // 4
    k = 0
    while total >= goal or final and total:
        now, room = [], min(goal, total)
        total -= room
        while room:
            row, start, ids = items[k]
            n = len(ids) // 4
            now.append((row, start, ids[: 4 * room]))
            if n > room:
                items[k] = (row, start + room, ids[4 * room :])
                break
            k, room = k + 1, room - n
        for window in windows_of([len(x[2]) // 4 for x in now], capacity):
            offset = 0
            for at in window:
                row, start, ids = now[at]
                out.append((row, start, ids, base, offset))
                offset += len(ids) // 4
            base += 1
    return out, items[k:], base


def packer(path: str, capacity: int, group: int, piece: int, with_ids: bool):

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words = words_of(path)
        base, waiting, last = TaskContext.get().partitionId() << 36, [], packed([END])

        def frame(found):
            cols = {"doc_id": pd.array([r[0] for r, *_ in found], dtype="Int64"), "start": [s for _, s, *_ in found], "length": [len(i) >> 2 for _, _, i, *_ in found]}
            cols["ids_crc32"] = [zlib.crc32(i) for _, _, i, *_ in found]
            cols |= {"doc_tokens": [r[1] for r, *_ in found], "sequence_id": [s for *_, s, _ in found], "offset": [o for *_, o in found]}
            if with_ids:
                cols["ids"] = [np.frombuffer(i, dtype="<u4").tolist() for _, _, i, *_ in found]
            return pd.DataFrame(cols)

        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size < 1_000_000 or to == at):
                    size += len(texts[to])
                    to += 1
                for doc, found in zip(ids[at:to], words.ids(texts[at:to]), strict=True):
                    found += last
                    row = (None if doc is None or doc != doc else int(doc), len(found) >> 2)
                    waiting += [(row, s, found[4 * s : 4 * (s + piece)]) for s in range(0, row[1], piece)]
                done, waiting, base = pieces(waiting, capacity, group, False, base)
                if done:
                    yield frame(done)
                at = to
        done, _, _ = pieces(waiting, capacity, group, True, base)
        if done:
            yield frame(done)

    return run


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY, group: int = GROUP_WINDOWS, piece: int = CAPACITY // 10, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of docs(doc_id, text).

    A document's ids are its tokens and a final 1; a null or empty text is the 1 alone. Each id lies in one piece, each
    window is a sequence_id, gapless from 0. Repeated rows are packed each; a null doc_id stays null; other columns are
    ignored; no rows give no pieces. No shuffle: a task packs groups of `group` windows. Documents of over `piece` tokens are cut
    into such pieces (capacity: only those that no window holds are cut, at about 3 % more padding). Sequence ids are the task's number and a count, so a task that runs again gives the same.
    """
    reachable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.mapInPandas(packer(vocabulary(name), capacity, group, min(piece, capacity), with_ids), schema)
