"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Table, fold, hashed_order, reachable

#: Terms are counted on at most so many labelled rows, and the classifier fitted on as many rows, labelled or not, drawn by hash.
SAMPLE = 20_000
#: Terms kept that tell of toxic texts, and of clean ones; classifier's marks besides the terms.
TERMS, CLEAN_TERMS, SHAPES = 512, 64, 6
WORDS, SHOUT = re.compile(r"[^\W\d_]+"), re.compile(r"[!?]{2,}")
#: A term's toxic rows must exceed its clean ones by so many standard deviations of chance: many terms are tried.
SURE = 2.0
#: Used as a voter of their own, and alone where no labelled row can be learned from.
SEED_TERMS = ("disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")


def terms(words: set[str]) -> set[str]:
    """A text's terms: its words, and their first four and five letters marked with a star."""
    out = {w for w in words if len(w) > 2}
    out.update([w[:4] + "*" for w in words if len(w) > 4])
    out.update([w[:5] + "*" for w in words if len(w) > 5])
    return out


@dataclass
class Lexicon:
    """Terms that tell of toxic texts, by rank, and words that tell of clean ones."""

    rank: dict[str, int]
    clean: frozenset[str] = frozenset()

    def __post_init__(self):
        self.words = {t: r for t, r in self.rank.items() if t[-1] != "*"}
        self.stems = {t[:-1]: r for t, r in self.rank.items() if t[-1] == "*"}

    def found(self, words: set[str]) -> tuple[list[int], list[int], list[int]]:
        """Ranks of the words, of the stems of five letters and of those of four that are found."""
        stems = self.stems
        plain = [self.words[w] for w in self.words.keys() & words]
        if not stems:
            return plain, [], []
        five = {stems[w[:5]] for w in words if w[:5] in stems and len(w) > 5 and len(w[:5]) == 5}
        four = {stems[w[:4]] for w in words if w[:4] in stems and len(w) > 4}
        return plain, list(five), list(four)


#: The voters, and whether they also vote "clean". All vote "toxic" for what they name. A lexicon that finds none of its terms in a
#: text of LONG words or more votes "clean", and abstains on a shorter one; what only clean texts have votes "clean" by its
#: fitted accuracy, and a pattern that isn't there says nothing.
VOTERS = (
    ("seed terms", True), ("words of the first rank", True), ("words of the second rank", True), ("words of the third rank", True),
    ("long stems of the first rank", True), ("long stems of the second rank", True), ("short stems of the first rank", True), ("short stems of the second rank", True),
    ("two different terms", True), ("terms in a hundredth of the words", True),
    ("shouting signs", False), ("capitals only", False), ("signs for letters", False), ("words that clean texts have", False), ("few different words", False),
)
BOTH, LONG = np.array([both for _, both in VOTERS]), 20


def votes(text: str, lexicon: Lexicon) -> tuple[int, list[int], int]:
    """For a whole text: a bit for each voter that finds what it looks for and one for a long text, the ranks of its terms, and bits of its shape."""
    every = WORDS.findall(text.lower())
    words = set(every)
    plain, five, four = lexicon.found(words)
    hits = sorted({*plain, *five, *four})
    n, signs = len(every), sum(map(text.count, "#$%&*@"))
    patterns = (len(SHOUT.findall(text)) > 0.02 * n, n > 0 and text.isupper(), signs > 0.1 * n)
    two, dense, same = len(hits) >= 2, len(hits) > 0.01 * n > 0, n > 20 and len(words) < 0.2 * n
    cast = (
        not words.isdisjoint(SEED_TERMS), any(r < 32 for r in plain), any(32 <= r < 128 for r in plain), any(r >= 128 for r in plain),
        any(r < 128 for r in five), any(r >= 128 for r in five), any(r < 128 for r in four), any(r >= 128 for r in four),
        two, dense, *patterns, not words.isdisjoint(lexicon.clean), same, n >= LONG,
    )
    return sum(bool(on) << k for k, on in enumerate(cast)), hits, sum(bool(on) << k for k, on in enumerate((two, dense, *patterns, same)))


#: What a row without a label counts in the label model's fit, against 1 of one with a label.
UNKNOWN_WEIGHT = 0.1


def bits_of(patterns: np.ndarray, n: int) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(n)) & 1).astype(np.float64)


def ballots(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row and voter: whether it votes "toxic", and whether it votes at all."""
    v = bits_of(patterns, len(VOTERS) + 1)
    return v[:, :-1], np.maximum(v[:, :-1], v[:, -1:] * BOTH)


class LabelModel:
    """P(label), P(a voter finds what it looks for | label) and the correlations of voters within a label, by expectation maximisation.

    One that abstains tells nothing. Voters that agree within a label beyond chance count for less: a voter's evidence is divided by
    the sum of its correlations with all that vote on the text. The fit takes the counts of vote patterns (2^16 at most) over
    the whole corpus; known labels are clamped and give P(label), and rows without one count by UNKNOWN_WEIGHT, so that they
    don't pull the labels' meaning away (Nigam et al., 2000).
    """

    def fit(self, patterns: np.ndarray, gold: np.ndarray, counts: np.ndarray, rounds: int = 40) -> LabelModel:
        """gold: 0, 1, or -1 for unknown."""
        v, cast = ballots(patterns)
        base = np.where(BOTH, cast, 1.0)
        known = gold >= 0
        post = np.where(known, gold, 0.0).astype(float)
        weight = np.where(known, counts, 0.0)
        self.prior = np.array([counts[gold == 0].sum() + 1, counts[gold == 1].sum() + 1]) / (counts[known].sum() + 2)
        whole = np.where(known, 1.0, UNKNOWN_WEIGHT) * counts
        for _ in range(rounds):
            mass = np.stack([weight * (1 - post), weight * post])
            self.theta = (mass @ v + 0.5) / (mass @ base + 1)
            together = np.zeros((len(VOTERS), len(VOTERS)))
            for y in (0, 1):
                d = np.sqrt(mass[y])[:, None] * np.where(base > 0, v - self.theta[y], 0.0)
                spread = np.sqrt(np.maximum((d * d).sum(axis=0), 1e-9))
                together = np.maximum(together, np.clip((d.T @ d) / np.outer(spread, spread), 0, 1))
            np.fill_diagonal(together, 1.0)
            self.correlations = np.where(together > 0.1, together, 0)
            new = np.where(known, gold, self.posterior(patterns))
            if np.abs(new - post)[counts > 0].max(initial=0) < 1e-6 and weight is whole:
                break
            post, weight = new, whole
        return self

    def accuracies(self) -> np.ndarray:
        """P(a vote is right | the voter votes), of those that vote both ways on long texts; P(toxic | it votes) of others."""
        right = self.prior[1] * self.theta[1] + np.where(BOTH, self.prior[0] * (1 - self.theta[0]), 0.0)
        return np.where(BOTH, right, right / (self.prior @ self.theta))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v, cast = ballots(patterns)
        yes, no = np.log(self.theta[1] / self.theta[0]), np.log((1 - self.theta[1]) / (1 - self.theta[0]))
        odds = math.log(self.prior[1] / self.prior[0]) + (np.where(v > 0, yes, cast * no) / np.maximum(cast @ self.correlations, 1.0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 30, block: int = 2048) -> np.ndarray:
    """Logistic regression of soft labels y on marks x (bytes of 0 and 1) by Newton steps, block by block; the last weight is the
    intercept, which has no penalty."""
    n = x.shape[1] + 1
    w, ridge = np.zeros(n), np.full(n, penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        slope, curve = ridge * w, np.diag(ridge)
        for at in range(0, len(x), block):
            some = np.concatenate([x[at : at + block].astype(np.float64), np.ones((len(x[at : at + block]), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            slope = slope + some.T @ (p - y[at : at + block])
            curve = curve + (some * (p * (1 - p))[:, None]).T @ some
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_terms(docs: DataFrame, gold: DataFrame) -> Lexicon:
    """The terms most telling of toxic rows (see SURE), and the words most telling of clean ones, by
    log odds times the root of their count, in a bounded sample of labelled rows."""
    chosen = gold.orderBy(hashed_order(), "doc_id").limit(SAMPLE)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(pdf["text"].tolist(), pdf["toxic"].tolist(), strict=True):
                by[toxic].update(terms(set(WORDS.findall(text.lower()))))
            every = [t for t in by[1] | by[0]]
            yield pd.DataFrame({"term": every, "pos": [by[1][t] for t in every], "neg": [by[0][t] for t in every]})

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    found = rows.mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = chosen.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not totals.p or not totals.n:
        return Lexicon({t: r for r, t in enumerate(SEED_TERMS)})
    odds = F.log((F.col("pos") + 0.5) / F.lit(totals.p + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(totals.n + 1.0))
    found = Table(found.withColumn("odds", odds), "terms").df
    best = found.where(F.expr(f"pos - neg > {SURE} * sqrt(pos + neg)")).orderBy(F.desc(F.round(F.col("odds") * F.sqrt("pos"), 9)), "term").limit(TERMS).collect()
    clean = found.where("neg >= 5 and term not like '%*'").where(F.col("odds") < -math.log(4)).orderBy(F.round(F.col("odds") * F.sqrt("neg"), 9), "term").limit(CLEAN_TERMS).collect()
    return Lexicon({r.term: k for k, r in enumerate(best)} or {t: r for r, t in enumerate(SEED_TERMS)}, frozenset(r.term for r in clean))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text), by labels(doc_id, toxic).

    Only labels of rows outside the held-out fold are learned from (null and clashing ones: the larger counts). Every
    whole text is scored; a null or empty text gets the score of a text without terms. Repeated rows are scored each, a
    null doc_id is held out and kept. Without usable labels a short fixed list of terms votes. An empty table gives no rows.
    """
    reachable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gold = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != 0)
    lexicon = learn_terms(rows, gold)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [votes(t, lexicon) for t in pdf["text"].tolist()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pattern": [b for b, *_ in found], "terms": [h for _, h, _ in found], "shape": [x for *_, x in found]})

    voted = Table(rows.mapInPandas(vote, "doc_id long, pattern int, terms array<int>, shape int"), "votes").df
    marked = Table(voted.join(gold, "doc_id", "left").select("doc_id", "pattern", "terms", "shape", F.coalesce("toxic", F.lit(-1)).alias("gold")), "marked").df
    seen = marked.groupBy("pattern", "gold").count().toPandas()
    weights = np.zeros(TERMS + SHAPES + 1)
    if (seen["gold"] >= 0).any():
        model = LabelModel().fit(seen["pattern"].to_numpy(np.int64), seen["gold"].to_numpy(np.int64), seen["count"].to_numpy(np.float64))
        sample = marked.where(fold() != 0).orderBy(hashed_order(), "doc_id").limit(SAMPLE).select("pattern", "terms", "shape").toPandas()
        x = np.zeros((len(sample), TERMS + SHAPES), dtype=np.uint8)
        for k, t in enumerate(sample["terms"]):
            x[k, t] = 1
        x[:, TERMS:] = bits_of(sample["shape"].to_numpy(np.int64), SHAPES)
        weights = fit_linear(x, model.posterior(sample["pattern"].to_numpy(np.int64)))
    else:
        weights[: len(lexicon.rank)], weights[-1] = 4.0, -2.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = bits_of(pdf["shape"].to_numpy(np.int64), SHAPES) @ weights[TERMS:-1] + weights[-1] + np.array([weights[list(t)].sum() if len(t) else 0.0 for t in pdf["terms"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    scored = voted.select("doc_id", "terms", "shape").mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
