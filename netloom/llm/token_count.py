"""Token counts of whole texts, with huge texts encoded as overlapping chunks that are spliced where they provably agree."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import reachable

LIBRARY_PATH = "byte_bpe_50k.json"
#: Texts over CHUNK code points are encoded in chunks; the overlap doubles until the splice is proven.
CHUNK, OVERLAP = 1 << 15, 1 << 9


def vocabulary(name: str) -> str:
    """The file of a public tokenizer by name; a path to a file is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def spec(tok) -> dict:
    """What a vocabulary file says of its way, without its words."""
    found = json.loads(tok.to_str())
    model = found["model"]
    return {"normalizer": found["normalizer"], "pre": found["pre_tokenizer"], "added": found["added_tokens"], "model": {k: v for k, v in model.items() if k not in ("vocab", "merges")}}


def plain_merges(found: dict, end: str | None) -> bool:
    """Whether words are merged by ranks alone, and added strings are taken as they stand, none with white space."""
    model = found["model"]
    same = model.get("type") == "BPE" and model.get("end_of_word_suffix") == end and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return same and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in found["added"])


def byte_level(tok) -> bool:
    """Whether the rules of this module hold for a vocabulary: byte-level merges within the pre-tokens of its usual pattern."""
    found = spec(tok)
    pre = found["pre"] or {}
    return found["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", False) and plain_merges(found, None)


#: Characters that are surely letters, digits, or signs (the apostrophe is left out: it may begin a pre-token with letters).
LETTERS = "A-Za-zÀ-ÖØ-öø-\u02af\u0400-\u0481\u048a-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
DIGITS, SIGNS = "0-9", r"!-&(-/:-@\[-`{-~、。，！？"
#: Places where byte-level pre-tokens part, whatever stands around: before white space that follows something else, and where
#: the kind of character changes. What follows such a place is read as if it stood alone.
STABLE = re.compile(f"(?<=\\S)[ \\n\\t\\r]|(?<=[{LETTERS}])[{DIGITS}{SIGNS}]|(?<=[{DIGITS}])[{LETTERS}{SIGNS}]|(?<=[{SIGNS}])[{LETTERS}{DIGITS}]")


def stable(text: str, low: int, high: int, special: tuple[str, ...]) -> Iterator[int]:
    """The places in text[low:high] where any encoding of a text that holds them has a boundary: none inside a special string."""
    for m in STABLE.finditer(text, max(1, low), high):
        at = m.start()
        if not any(text.find(x, max(0, at - len(x) + 1), at + len(x) - 1) >= 0 for x in special):
            yield at


def starts(encoding) -> dict[int, int]:
    """Index of the first token that starts at each character."""
    out: dict[int, int] = {}
    for k, (i, _) in enumerate(encoding.offsets):
        out.setdefault(i, k)
    return out


def splice(text: str, left, left_at: int, right, right_at: int, low: int, high: int, special: tuple[str, ...]) -> tuple[int, int, int] | None:
    """The place in text[low:high] where both encodings have a proven boundary and agree on the tokens up to the overlap's end: place, token index in left, in right."""
    a, b = starts(left), starts(right)
    middle = (low + high) // 2
    for at in sorted(stable(text, low + 1, high, special), key=lambda x: abs(x - middle)):
        i, j = a.get(at - left_at), b.get(at - right_at)
        if i is None or j is None:
            continue
        n = min(4, len(left.ids) - i - 1)  # the left chunk's last token may be cut
        if n > 0 and left.ids[i : i + n] == right.ids[j : j + n]:
            return at, i, j
    return None


def chunked_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, special: tuple[str, ...] = ()) -> int:
    """Tokens of a huge text: each chunk counts from its splice with the one before to its splice with the next.

    An overlap doubles until it holds a proven boundary, and again where the encodings can't be aligned on one; a chunk without any
    doubles, unencoded. So a text is read a few times over at most, whatever it holds.
    """
    total, begin, first, n = 0, 0, 0, len(text)
    end, current = min(n, chunk), None
    while end < n:
        width, found = overlap, None
        while found is None:
            at = max(begin, end - width)
            if next(stable(text, at + 1, end, special), None) is not None:
                current = current or tok.encode(text[begin:end], add_special_tokens=False)
                following = tok.encode(text[at : end + chunk], add_special_tokens=False)
                found = splice(text, current, begin, following, at, at, end, special)
            if found is None and at == begin:
                end, current = min(n, 2 * end - begin), None
                break
            width *= 2
        if found is None:
            continue
        _, i, j = found
        if i < first:  # the splice would lie before the last one
            raise AssertionError("splices out of order")
        total += i - first
        begin, first, current, end = at, j, following, min(n, end + chunk)
    current = current or tok.encode(text[begin:], add_special_tokens=False)
    return total + len(current.ids) - first


#: Places where byte-level pre-tokens always part: before a single space that something else than white space follows, and around
#: a lone line end between such. A piece so cut off has the same tokens alone as in its text.
SPACES, LINES = re.compile(r" (?=\S)"), re.compile(r"(?<=\S)\n(?=\S)")
#: Pieces of letters (ASCII, Latin-1) with marks behind them; pieces remembered by a worker.
SIMPLE, MEMORY_PIECES = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?@^_~]*)"), 400_000
#: Byte-level vocabularies write bytes as characters; those that aren't printable follow from 256.
BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def written(part: str) -> str:
    return part.encode().decode("latin-1").translate(BYTES)


class Pieces(dict):
    """Token counts of pieces, found on first use and remembered; all with a space before them, or all without."""

    def __init__(self, tok, before: str):
        super().__init__()
        self.tok, self.merge, self.before, self.mark, self.ends = tok, tok.model.tokenize, before, written(before), {"": 0}

    def __missing__(self, piece: str) -> int:
        if m := SIMPLE.fullmatch(piece):
            word, end = m.groups()
            if end not in self.ends:
                self.ends[end] = len(self.merge(written(end)))
            found = len(self.merge(self.mark + (word if word.isascii() else written(word)))) + self.ends[end]
        else:
            found = len(self.tok.encode_batch_fast([self.before + piece], add_special_tokens=False)[0].ids) if piece else 0
        self[piece] = found
        return found


class Counter:
    """Exact counts of texts, piece by piece; `known` is False for a vocabulary that other rules than byte_level() govern."""

    def __init__(self, tok):
        self.known, self.special = byte_level(tok), tuple(t["content"] for t in spec(tok)["added"])
        self.first, self.rest = Pieces(tok, ""), Pieces(tok, " ")
        self.line = len(tok.encode("\n", add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        lines = text.split("\n")
        if not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            lines = LINES.split(text)
        total, first, rest = self.line * (len(lines) - 1), self.first, self.rest.__getitem__
        for line in lines:
            plain = line.isprintable() and "  " not in line and line[-1:] != " "  # then all spaces are such places
            head, *others = line.split(" ") if plain else SPACES.split(line)
            total += first[head] + sum(map(rest, others))
        for memory in (first, self.rest):
            if len(memory) > MEMORY_PIECES:
                memory.clear()
        return total


@lru_cache(2)
def counter(tok) -> Counter:
    return Counter(tok)


def count_tokens(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text: huge ones by chunks, others by their pieces, which a worker remembers. Texts of a vocabulary with other
    pre-tokens than byte-level ones are encoded whole by the library."""
    pieces = counter(tok)
    if not pieces.known:
        return [len(tok.encode(text, add_special_tokens=False).ids) for text in texts]
    return [chunked_count(tok, text, chunk, overlap, pieces.special) if len(text) > chunk else pieces.count(text) for text in texts]


def token_counts(docs: DataFrame, name: str = LIBRARY_PATH, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs(doc_id, text): one pass, no shuffle.

    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null doc_id is kept;
    other columns are ignored; an empty table gives no rows. `name`: any vocabulary of the library; those that aren't byte-level
    have their texts encoded whole.
    """
    reachable(docs.sparkSession)
    path = vocabulary(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": count_tokens(tok, pdf["text"].tolist(), chunk, overlap)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.selectExpr("doc_id", "text", "cast(octet_length(text) as long) n_bytes").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
