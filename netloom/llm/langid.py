"""Language ID by a byte convolutional network, trained in numpy and applied to fixed-length windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import fold, hashed_order, reachable

#: The network is trained on up to three windows of at most so many labelled documents, drawn by hash.
SAMPLE = 4_000
WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 16, 8


def lettered(text: str) -> bool:
    """Whether a text has a letter (a fraction or a circled digit is none)."""
    return any(map(str.isalpha, text))


def windows(data: bytes) -> np.ndarray:
    """A text's bytes as rows of WINDOW, the last one filled with zeros: every byte is in one row."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), dtype=np.uint8).reshape(rows, WINDOW)


@dataclass
class Network:
    """Byte embedding, filters of several widths, maximum over a window, softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(langs, rng.normal(0, 0.5, (256, DIMS)), [rng.normal(0, (w * DIMS) ** -0.5, (w, DIMS, FILTERS)) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs)))
        values = [net.embed, *net.filters, net.bias, net.dense, net.offset]
        first, second, tick = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                tick += 1
                for v, g, m, s in zip(values, net.gradients(x[some], y[some]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.999**tick)) + 1e-8)
        return net

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        e, pooled, places = self.embed[x], [], []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            span = WINDOW - width + 1
            z = sum(e[:, k : k + span] @ w[k] for k in range(width))
            places.append(z.argmax(axis=1))
            pooled.append(np.take_along_axis(z, places[-1][:, None], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + self.bias
        h = np.maximum(raw, 0)
        logits = h @ self.dense + self.offset
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.dense.T) * (raw > 0)
        de, dfs = np.zeros_like(self.embed), []
        for n, (width, w, place) in enumerate(zip(WIDTHS, self.filters, places, strict=True)):
            g, df = back[:, n * FILTERS : (n + 1) * FILTERS], np.zeros_like(w)
            for k in range(width):
                at = e[rows, place + k]
                df[k] = np.einsum("nf,nfd->df", g, at)
                np.add.at(de, x[rows, place + k], g[:, :, None] * w[k].T[None])
            dfs.append(df)
        return [de, *dfs, back.sum(axis=0), h.T @ p + 1e-4 * self.dense, p.sum(axis=0)]

    def tables(self) -> list[list[np.ndarray]]:
        """What each byte or pair of bytes adds to each filter, so that a convolution is two lookups at most."""
        one = [[(self.embed @ w[k]).astype(np.float32) for k in range(len(w))] for w in self.filters]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        return [[pair(t[0], t[1]), *([pair(t[2], t[3])] if len(t) == 4 else t[2:])] for t in one]

    def log_probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Of each window (rows of x) and language."""
        out = []
        for at in range(0, len(x), 64):
            b = x[at : at + 64].astype(np.intp)
            pairs, pooled = b[:, :-1] * 256 + b[:, 1:], []
            for width, t in zip(WIDTHS, tables, strict=True):
                span = WINDOW - width + 1
                z = t[0].take(pairs[:, :span].ravel(), axis=0, mode="clip").reshape(len(b), span, FILTERS)
                if width == 3:
                    z += t[1].take(b[:, 2:].ravel(), axis=0, mode="clip").reshape(z.shape)
                elif width == 4:
                    z += t[1].take(pairs[:, 2 : 2 + span].ravel(), axis=0, mode="clip").reshape(z.shape)
                while span > 1:  # halves, so that each step runs over long rows
                    half = span // 2
                    rest = z[:, 2 * half : span]
                    z = np.maximum(z[:, :half], z[:, half : 2 * half])
                    if rest.shape[1]:
                        np.maximum(z[:, :1], rest, out=z[:, :1])
                    span = half
                pooled.append(z[:, 0])
            h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            logits = h @ self.dense + self.offset
            logits -= logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[bytes], tables: list[list[np.ndarray]]) -> tuple[list[str], list[float]]:
        """Language and probability of each text: its windows' log probabilities, averaged by their bytes."""
        langs, scores, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size < 1 << 20 or to == at):
                size += len(texts[to])
                to += 1
            rows = [windows(t) for t in texts[at:to]]
            found = self.log_probabilities(np.concatenate(rows), tables)
            first = np.cumsum([0, *(len(r) for r in rows)])
            weight = np.full(len(found), float(WINDOW))
            weight[first[1:] - 1] = [max(1, len(t) - WINDOW * (len(r) - 1)) for t, r in zip(texts[at:to], rows, strict=True)]
            mean = np.add.reduceat(found * weight[:, None], first[:-1], axis=0) / np.add.reduceat(weight, first[:-1])[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            langs += [self.langs[k] for k in p.argmax(axis=1)]
            scores += p.max(axis=1).tolist()
            at = to
        return langs, scores


def train_network(docs: DataFrame) -> Network | None:
    """A network trained on labelled documents outside the held-out fold; None if there are none with a letter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for h, lang, text in zip(pdf["h"].tolist(), pdf["lang"].tolist(), pdf["text"].tolist(), strict=True):
                if lettered(text):
                    rows = windows(text.encode("utf-8", "surrogatepass"))
                    found += [(h, lang, rows[k].tobytes()) for k in sorted({0, len(rows) // 2, max(0, len(rows) - 2)})]
            yield pd.DataFrame(found, columns=["h", "lang", "data"])

    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(fold() != 0)
    last = usable.select(hashed_order().alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return None
    first = usable.withColumn("h", hashed_order()).where(F.col("h") <= last).select("h", "lang", "text")
    # repeated ids tie at the last hash: the windows are cut to the bound once more, and repeated rows bring theirs once
    rows = first.mapInPandas(cut, "h long, lang string, data binary").distinct().orderBy("h", "lang", "data").limit(3 * SAMPLE).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["data", "lang"]).reset_index(drop=True)
    langs = sorted(rows["lang"].unique())
    x = np.stack([np.frombuffer(bytes(d), dtype=np.uint8) for d in rows["data"]])
    return Network.train(x, rows["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(), langs)


def language_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs(doc_id, text, lang).

    Learned from text and lang of rows outside the held-out fold; predicted from the whole text alone. A null text, one
    without a letter, and any text where no row can be learned from, is `und` with score 0. Repeated rows are predicted
    each; a null doc_id is held out and kept; other columns are ignored; an empty table gives no rows.
    """
    reachable(docs.sparkSession)
    net = train_network(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.tables() if net else None
        for pdf in batches:
            texts = pdf["text"].tolist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [k for k, t in enumerate(texts) if net and lettered(t)]
            if some:
                for k, lang, score in zip(some, *net.predict([texts[k].encode("utf-8", "surrogatepass") for k in some], tables), strict=True):
                    langs[k], scores[k] = lang, score
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": langs, "score": scores})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double").select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
