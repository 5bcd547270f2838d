"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Scope, Table, small_side

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, written so that a run of characters is entered at its start (or where the last match ended) and never
#: given back: the same matches as the plain patterns, in time linear in the text and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Letters that a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Words that can be terms. A passage is up to 64 words and gaps; a base span in it is a mark that holds its kind and value.
WORD, PASSAGE, MARK = r"\p{L}{3,}+", r"(?:\x01[^\x02]*+\x02|[^\s\x01]{1,32}+|\s++){1,64}+", r"\x01([^\x02]*+)\x02"
#: A term reveals an entity if they share SUPPORT passages at least, and their pointwise mutual information leaves at most LEFT bits of the
#: entity's information content: who reads the term names the entity rightly once in 2^LEFT times or more often. An entity of
#: less content than BITS (one passage in 2^BITS) is no secret.
SUPPORT, LEFT, BITS = 2, 1.0, 4.0
#: Prefix sums run within blocks of SIDE; texts are cut from pieces of CUT characters.
SIDE, CUT = 256, 1024
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that a lambda uses is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine) -> Column:
    """Of an array of longs (from 0 up): what combine makes of each with all before it. In blocks of SIDE, since each append copies."""

    def plain(v: Column) -> Column:
        return F.aggregate(v, empty("bigint"), lambda acc, x: F.concat(acc, F.array(combine(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")), x))))

    def joined(parts: Column) -> Column:
        last = plain(F.transform(parts, lambda r: F.element_at(r, -1)))
        return let(last, lambda off: F.flatten(F.transform(parts, lambda r, k: F.when(k == 0, r).otherwise(F.transform(r, lambda x: combine(F.element_at(off, k), x))))))

    def blocked(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / SIDE).cast("int") - 1), lambda b: plain(F.slice(v, b * SIDE + 1, F.lit(SIDE))))
        return F.when(F.size(v) > 0, let(parts, joined)).otherwise(empty("bigint"))

    return let(values, blocked)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(m))
    return n.between(14, 19) & F.call_function("luhn_check", digits(m)) if kind == "card" else n.between(10, 15)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches of a pattern: what lies between them gives their places. Linear in the text."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(b: Column) -> Column:
        ends = running(F.zip_with(b["gaps"], b["found"], lambda g, v: (F.length(g) + F.coalesce(F.length(v), F.lit(0))).cast("long")), lambda x, y: x + y)
        at = lambda e: F.transform(b["found"], lambda v, k: F.struct((F.element_at(e, k + 1) - F.length(v)).alias("start"), F.element_at(e, k + 1).alias("end"), v.alias("value")))
        return F.when(F.size(b["found"]) > 0, let(ends, at)).otherwise(empty("struct<start:bigint,end:bigint,value:string>"))

    return let(both, placed)


def replaced(text: Column, spans: Column, label) -> Column:
    """text with what each of the spans (sorted by start) covers replaced by label(span, its number); a span that begins within an earlier one goes
    with that. Linear in the text, but for spans over many pieces of it."""
    whole = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("cut"), F.length(text).cast("long").alias("n"), spans.alias("spans"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("ends"))

    def between(w: Column, a: Column, b: Column) -> Column:
        part = lambda k: F.substr(F.element_at(w["cut"], k + 1), F.greatest(a - k * CUT, F.lit(0)).cast("int") + 1, (F.least(b - k * CUT, F.lit(CUT)) - F.greatest(a - k * CUT, F.lit(0))).cast("int"))
        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")), part), "")).otherwise("")

    def one(w: Column):
        def step(s: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(w["ends"], F.greatest(k, F.lit(1))))
            return let(before, lambda at: F.when(s["start"] >= at, F.concat(between(w, at, s["start"]), label(s, k))).otherwise(""))

        return step

    return let(whole, lambda w: F.concat(F.array_join(F.transform(w["spans"], one(w)), ""), between(w, F.coalesce(F.try_element_at(w["ends"], F.lit(-1)), F.lit(0).cast("long")), w["n"])))


def passing(kind: str):
    return lambda s: valid(kind, s["value"])


def ranked(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def with_base(docs: DataFrame) -> DataFrame:
    """Adds base: array<struct<start, rank, end, kind, value>> of valid base matches in text, by start, then kind as listed."""
    digit = F.col("text").rlike("[0-9]")
    out = docs.withColumn("__digit", F.when(F.contains("text", F.lit("@")), True).otherwise(digit))
    for kind, pattern in PATTERNS.items():
        tried = F.col("__digit") & (F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True))
        found = F.transform(F.filter(located(F.col("text"), pattern), passing(kind)), ranked(kind))
        out = out.withColumn(f"__{kind}", F.when(tried & F.col("text").rlike(pattern), found).otherwise(empty(SPAN)))
    every = F.concat(*[F.col(f"__{kind}") for kind in PATTERNS])
    return out.withColumn("base", F.array_sort(every)).drop("__digit", *[f"__{k}" for k in PATTERNS])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def prepared(docs: DataFrame) -> DataFrame:
    """Adds h (a hash of the text) and key (doc_id, or the least long for a null one); a null text is empty."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))


def passages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PASSAGE), F.lit(0))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, MARK, " ")), F.lit(WORD), F.lit(0)))


def analysed(docs: DataFrame) -> DataFrame:
    """(key, h, base, marked, n_passages) of prepared documents, written: marked is the text with base spans as marks (see MARK), null if it has none."""
    rows = with_base(docs.select("key", "h", F.translate("text", "\x01\x02", "  ").alias("text")))
    marked = F.when(F.size("base") > 0, replaced(F.col("text"), F.col("base"), lambda s, _: F.concat(F.lit("\x01"), s["kind"], F.lit(":"), F.lower(s["value"]), F.lit("\x02"))))
    rows = rows.withColumn("marked", marked)
    return Table(rows.select("key", "h", "base", "marked", F.size(passages(F.coalesce("marked", "text"))).alias("n_passages")), "base").df


def revealing(docs: DataFrame, base: DataFrame, support: int = SUPPORT, left: float = LEFT, bits: float = BITS) -> DataFrame:
    """(term), written: terms that reveal an entity of the corpus, by their co-occurrence.

    All counts (of passages, of those with an entity, with a term, with both) are in passages of distinct texts: of a text that
    stands c times, each passage counts 1 / c.
    """
    with Scope() as scope:
        copies = Table(base.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "copies").df
        weight = (1 / F.coalesce(F.col("c"), F.lit(1))).alias("w")
        weighed = lambda rows: rows.join(small_side(copies), "h", "left")
        n = weighed(base.select("h", "n_passages")).agg(F.sum(F.col("n_passages") * weight)).first()[0] or 0.0
        p = weighed(base.where("marked is not null").select("h", F.explode(passages(F.col("marked"))).alias("p")).where(F.contains("p", F.lit("\x01"))))
        entities = F.array_distinct(F.regexp_extract_all("p", F.lit(MARK), F.lit(1)))
        near = Table(p.select(entities.alias("entities"), words(F.col("p")).alias("words"), weight), "near").df
        entity = near.select(F.explode("entities").alias("entity"), "w").groupBy("entity").agg(F.round(F.sum("w"), 6).alias("n_e"))
        entity = Table(entity.where((F.col("n_e") >= support) & (F.log2(F.lit(n) / F.col("n_e")) >= bits)), "entities").df
        joint = near.select(F.explode("entities").alias("entity"), "words", "w").join(small_side(entity), "entity").select("entity", "n_e", "w", F.explode("words").alias("term"))
        joint = Table(joint.groupBy("entity", "n_e", "term").agg(F.round(F.sum("w"), 6).alias("n_et")).where(F.col("n_et") >= support), "joint").df
        terms = Table(joint.select("term").distinct(), "terms").df
        if terms.isEmpty():
            return scope.keep(Table(terms, "revealing"))
        rest = base.where("marked is not null").select("h", "marked").union(docs.join(small_side(Table(base.where("marked is not null").select("key", "h").distinct(), "known").df), ["key", "h"], "left_anti").select("h", "text"))
        every = weighed(rest).select(F.explode(passages(F.col("marked"))).alias("p"), weight).select(F.explode(words(F.col("p"))).alias("term"), "w")
        often = every.join(small_side(terms), "term", "left_semi").groupBy("term").agg(F.sum("w").alias("n_t"))
        content, shared = F.log2(F.lit(n) / F.col("n_e")), F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
        return scope.keep(Table(joint.join(often, "term").where(shared >= content - left - 1e-9).select("term").distinct(), "revealing"))


def term_spans(docs: DataFrame, base: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, h, more), written: places of revealing terms, outside base spans, in each document that has some."""
    if terms.isEmpty():
        return Table(terms.sparkSession.createDataFrame([], f"key long, h long, more array<{SPAN}>"), "more").df
    with Scope() as scope:
        terms = small_side(terms)
        some = Table(docs.select("key", "h", F.explode(words(F.col("text"))).alias("term")).join(terms, "term", "left_semi").select("key", "h").distinct(), "concerned").df
        rows = docs.join(small_side(some), ["key", "h"], "left_semi").select("key", "h", "text")
        spans = small_side(Table(base.where("size(base) > 0").select("key", "h", "base").join(small_side(some), ["key", "h"], "left_semi").dropDuplicates(["key", "h"]), "spans").df)
        blank = replaced(F.col("text"), F.coalesce("base", empty(SPAN)), lambda s, _: F.repeat(F.lit("\x01"), (s["end"] - s["start"]).cast("int")))
        blank = F.when(F.col("base").isNull(), F.col("text")).otherwise(blank)
        found = rows.join(spans, ["key", "h"], "left").select("key", "h", F.explode(located(blank, WORD)).alias("s")).withColumn("term", F.lower("s.value")).join(terms, "term", "left_semi")
        span = F.struct(F.col("s.start").alias("start"), F.lit(len(KINDS) - 1).alias("rank"), F.col("s.end").alias("end"), F.lit("term").alias("kind"), F.col("s.value").alias("value"))
        return scope.keep(Table(found.select("key", "h", span.alias("s")).groupBy("key", "h").agg(F.collect_set("s").alias("more")), "more"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs(doc_id, text).

    A null text is empty. Spans are kind:start:end in code points, end exclusive, by start, then kind. Words whose
    co-occurrence with an entity over the corpus exceeds the disclosure threshold come as kind term, wherever they stand.
    Repeated rows are reported each, and a null doc_id is kept. Other columns are ignored. Empty: no rows.
    """
    rows = prepared(docs.select("doc_id", "text"))
    base = analysed(rows)
    more = term_spans(rows, base, revealing(rows, base))
    joined = base.select("key", "h", "base").join(small_side(more, 100_000), ["key", "h"], "left")
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    every = F.array_sort(F.concat("base", F.coalesce("more", empty(SPAN))))
    doc_id = F.when(F.col("key") != -(1 << 63), F.col("key")).alias("doc_id")
    return joined.select(doc_id, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets ([EMAIL], [TERM]); overlapping spans become one.

    A text without spans stays as it is, a null one null. Other columns and the rows stay.
    """
    rows = prepared(docs.select("doc_id", "text"))
    base = analysed(rows)
    more = term_spans(rows, base, revealing(rows, base)).select("key", "h", "more")
    spans = Table(base.where("size(base) > 0").select("key", "h", "base").dropDuplicates(["key", "h"]).join(more, ["key", "h"], "full").select("key", "h", F.array_sort(F.concat(F.coalesce("base", empty(SPAN)), F.coalesce("more", empty(SPAN)))).alias("spans")), "every").df
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    kept = prepared(docs.select(rest, "doc_id", "text", F.col("text").alias("kept"))).select("row", "kept", "text", "key", "h")
    new = replaced(F.col("text"), F.col("spans"), lambda s, _: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    out = kept.join(small_side(spans, 100_000), ["key", "h"], "left").withColumn("new", F.when(F.col("spans").isNotNull(), new).otherwise(F.col("kept")))
    return out.select(*[F.col("new").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
