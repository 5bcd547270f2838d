"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Table, small_side

#: Without weights, a source's is its size to this power; the mix is BUDGET times as large as the input.
ALPHA, BUDGET, SEED = 0.5, 1.0, "mix-1"
#: exp(-rate) must stay well above the smallest double; a higher rate is refused.
HIGHEST = 500.0


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, alpha: float = ALPHA) -> DataFrame:
    """(source, rate, cdf): mean repetitions of a source's documents, and P(count <= k) for k = 0, 1, ..

    A source's size is its characters (at least one, so that a source of empty texts has a rate). A null source is
    the source ''. rate = budget * total size * weight / (sum of weights * own size); a source without a weight has 0.
    """
    size = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.greatest(F.sum(F.length("text")), F.lit(1)).cast("double").alias("size"))
    size = size.fillna(1.0, ["size"])
    if weights is None:
        size = size.withColumn("w", F.pow("size", F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame(sorted(weights.items()) or [("", 0.0)], "source string, w double")
        size = size.join(given, "source", "left").fillna(0.0, ["w"])
    size = Table(size, "sizes").df
    total = size.agg(F.sum("size").alias("n"), F.sum("w").alias("w")).first()
    if not total.w:
        return size.select("source", F.lit(0.0).alias("rate"), F.array(F.lit(1.0)).alias("cdf"))
    found = size.withColumn("rate", F.col("w") / F.lit(total.w) * F.lit(budget * total.n) / F.col("size"))
    if found.where(F.col("rate") > HIGHEST).limit(1).count():
        raise ValueError(f"a source would be repeated over {HIGHEST:g} times")
    zero = F.exp(-F.col("rate"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")),
        F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all")),
        lambda acc, k: F.struct((acc["p"] * F.col("rate") / k).alias("p"), (acc["c"] + acc["p"] * F.col("rate") / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * F.col("rate") / k)).alias("all")),
        lambda acc: acc["all"],
    )
    return found.select("source", "rate", cdf.alias("cdf"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """docs, each row as often as its Poisson count says, in a global random order; adds n_copies, copy (from 1) and shuffle_key
    (with an underscore behind a name that docs has).

    The count inverts the Poisson distribution of the source's rate at a number in [0, 1) that the hash of seed and doc_id
    fixes (52 bits): the same document has the same count in every run. Rows that repeat a doc_id have the same count
    each, and their copies the same keys; a null doc_id hashes as ''. A null source mixes as ''. Empty table: no rows.
    """
    table = Table(rates(docs, weights, budget, alpha), "rates").df.select(F.col("source").alias("s"), "cdf")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"), u.alias("u"), F.coalesce("source", F.lit("")).alias("s"))
    counted = rows.join(small_side(table), "s").withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("n > 0")
    copies = counted.select("row", "name", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.withColumn("key", F.md5(F.concat(F.lit(f"{seed}#"), "name", F.lit("#"), F.col("copy").cast("string"))))
    added = [F.col(c).alias(free(n, docs.columns)) for c, n in (("n", "n_copies"), ("copy", "copy"), ("key", "shuffle_key"))]
    return keyed.repartition("key").sortWithinPartitions("key").select(*[F.col("row")[c].alias(c) for c in docs.columns], *added)


def free(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it."""
    while name in taken:
        name += "_"
    return name
