"""URL filters: host and path rules, and for the rest a character language-model ratio. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Table, join_hot, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of context at most; strength of the lower order in the mixture of each order with it.
ORDER, STRENGTH = 5, 2.0
#: URLs whose characters a task spreads out.
URLS_TASK = 20_000
BEFORE, AFTER = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. pattern: host and path, as in example.com/en/7; it fits the host and its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]

    def fits(self) -> Column:
        return ((F.col("host") == self.host) | F.col("host").endswith(f".{self.host}")) & F.col("path").startswith(self.path)


#: The rules of the query's contract.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path: after the first ://, up to / ? # or the end; then up to ? # or the end. Both empty without one."""
    at = F.instr("url", "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(F.col("url"), at + 3)).otherwise("")
    raw = F.regexp_extract("__rest", "^[^/?#]*", 0)
    both = urls.withColumn("__rest", rest).withColumn("__host", raw)
    return both.withColumn("host", F.translate("__host", UPPER, LOWER)).withColumn("path", F.regexp_extract(F.substr(F.col("__rest"), F.length("__host") + 1), "^[^?#]*", 0)).drop("__rest", "__host")


def with_rule(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds rule and ruled: the longest fitting rule's pattern and verdict, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        rule, verdict = F.when(r.fits(), F.lit(r.pattern)).otherwise(rule), F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("ruled", verdict)


def model(grams: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """(gram, ratio): log P(last character | the others) under accepted less that under rejected URLs, for each gram(gram, a, b).

    Each order is mixed with the one below: (count + strength * lower) / (context's count + strength). An unseen context
    so takes the longest seen one's value: the order varies with the data. The lowest is a uniform byte.
    A column n is passed on.
    """
    last, more = None, [F.sum("n").alias("n")] if "n" in grams.columns else []
    for j in range(order + 1):
        own = grams.groupBy(F.right("gram", F.lit(j + 1)).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *more)
        own = Table(own, f"order{j}").df
        context = own.groupBy(F.substr(F.col("g"), F.lit(1), F.lit(j)).alias("c")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        joined = own.withColumn("c", F.substr(F.col("g"), F.lit(1), F.lit(j))).join(small_side(Table(context, f"context{j}").df), "c")
        joined = joined.withColumn("pa", F.lit(1 / 256)).withColumn("pb", F.lit(1 / 256)) if last is None else joined.withColumn("l", F.right("g", F.lit(j))).join(small_side(last), "l")
        p = [((F.col(n) + strength * F.col(f"p{n}")) / (F.col(f"c{n}") + strength)).alias(f"p{n}") for n in "ab"]
        last = Table(joined.select(F.col("g").alias("l"), *p, *["n"] * len(more)), f"model{j}").df.drop(*["n"] * (j < order))
    return last.select(F.col("l").alias("gram"), (F.ln("pa") - F.ln("pb")).alias("ratio"), *["n"] * len(more))


def with_grams(urls: DataFrame, order: int, *columns: str) -> DataFrame:
    """(columns, gram) for each character of url and its end: narrow rows, of evenly dealt URLs."""
    tasks = max(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), urls.count() // URLS_TASK)
    chars = F.concat(F.array(*[F.lit(BEFORE)] * order), F.when(F.length("url") > 0, F.regexp_extract_all("url", F.lit("(?s)."), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")), F.array(F.lit(AFTER)))
    dealt = urls.select(*columns, "url").repartition(tasks).withColumn("chars", chars)
    return dealt.select(*columns, F.explode(F.transform(F.sequence(F.lit(1), F.size("chars") - order), lambda i: F.array_join(F.slice("chars", i, F.lit(order + 1)), ""))).alias("gram"))


def with_scores(urls: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """(u, score) of urls(u, url): the mean ratio of their characters, so that length doesn't count."""
    return join_hot(with_grams(urls, order, "u"), ratios, ["gram"], "n", "left").groupBy("u").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("score"))


def threshold(scores: DataFrame) -> float | None:
    """The score at which as large a share of accepted URLs lies below as of rejected ones above, on held-out ruled URLs, the
    middle of such scores; None if a class has none."""
    grid = F.array(*[F.lit(k / 200) for k in range(201)])
    at = {r.ruled: r.q for r in scores.where("ruled is not null and fold = 0").groupBy("ruled").agg(F.percentile_approx("score", grid, F.lit(10_000)).alias("q")).collect()}
    if len(at) < 2:
        return None
    allow, block = at["allow"], at["block"]
    values = sorted({*allow, *block})
    cuts = [values[0], *((x + y) / 2 for x, y in zip(values, values[1:], strict=False))]
    off = [abs(sum(x < t for x in allow) / len(allow) - sum(x >= t for x in block) / len(block)) for t in cuts]
    best = [t for t, e in zip(cuts, off, strict=True) if e <= min(off) + 1e-12]
    return (best[0] + best[-1]) / 2


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of pages(page_id, url).

    The longest fitting rule decides. URLs that a rule accepts or rejects train two character models (four fifths of
    the distinct ones, by hash; the rest sets the threshold), and others are allowed if their mean log-likelihood difference is
    at least the threshold. The models read whole URLs, and counts are over all distinct ones. Without ruled URLs of both
    kinds the method allows. A null url has an empty host and path and is judged as the empty text; repeated rows are judged each; null ids are
    kept; other columns are ignored; an empty table gives no rows. Rules are a short list (each is an expression).
    """
    rows = with_rule(with_parts(pages.select("page_id", "url")), rules).select("page_id", F.coalesce("url", F.lit("")).alias("url"), "host", "path", "rule", "ruled")
    distinct = rows.groupBy("url").agg(F.first("ruled").alias("ruled"), F.count("*").alias("n")).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(5)))
    urls = Table(distinct.withColumn("u", F.monotonically_increasing_id()), "urls").df
    seen = F.when((F.col("fold") != 0) & (F.col("ruled") == F.lit("allow")), 1).otherwise(0), F.when((F.col("fold") != 0) & (F.col("ruled") == F.lit("block")), 1).otherwise(0)
    grams = Table(with_grams(urls, order, "fold", "ruled").groupBy("gram").agg(F.sum(seen[0]).alias("a"), F.sum(seen[1]).alias("b"), F.count("*").alias("n")), "grams").df
    found = Table(with_scores(urls, Table(model(grams, order), "ratios").df, order), "scores").df
    scores = Table(urls.join(small_side(found), "u").select("url", "ruled", "fold", "score", "n"), "judged").df
    least = threshold(scores)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block") if least is not None else F.lit("allow"))
    return join_hot(rows, scores.select("url", "score", "n"), ["url"], "n", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
