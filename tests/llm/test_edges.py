"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import re

import pandas as pd
import pytest

import corpus_pipeline
from netloom.llm import common, edit_fingerprint, embed_dedup, langid, mixing, packing, pii, simhash, token_count, toxicity, url_filter

CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, h long, k long, base string, part int, key string, copy string, score string, pattern int, cdf double, term string, more string, __s string"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, 3, 4, "b", 5, "k", "c", "sc", 6, 0.5, "t", "m", "s")


LONG = "word " * 30_000 + "x" * 40_000 + " +1 (555) 123-4567 a@b.cd" + "1 " * 3000
ROWS = [row(1, "hello a@b.cd and 1.2.3.4"), row(1, "hello a@b.cd and 1.2.3.4"), row(2, None), row(3, ""), row(None, "no id"), row(4, LONG, "de"), row(5, " \t\n "), row(6, "12345 67"), row(7, "Ünïcode 𝒳 text", None, None), row(8, LONG, "fr", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d, lab: toxicity.toxicity_scores(d, lab),
    "simhash": lambda d, lab: simhash.simhash_components(d),
    "pii": lambda d, lab: pii.pii_spans(d),
    "tokens": lambda d, lab: token_count.token_counts(d),
    "edit": lambda d, lab: edit_fingerprint.edit_fingerprints(d),
    "lang": lambda d, lab: langid.language_ids(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(docs, empty, labels, name):
    got = OPERATORS[name](docs, labels).toPandas()
    assert len(got) == len(ROWS) and got.doc_id.isna().sum() == 1
    assert OPERATORS[name](empty, labels).toPandas().empty
    assert OPERATORS[name](empty, labels.limit(0)).toPandas().empty
    twice = got[got.doc_id == 1].drop(columns=[c for c in ("edited_sha256", "edited_fingerprint", "near_edited", "near_next") if c in got])
    assert len(twice) == 2 and len(twice.drop_duplicates()) == 1


def test_values(docs, labels):
    lang = langid.language_ids(docs).toPandas().set_index("doc_id").lang_pred
    assert lang[2] == "und" and lang[3] == "und" and lang[6] == "und"
    count = token_count.token_counts(docs).toPandas().set_index("doc_id")
    assert count.n_tokens[2] == 0 and count.n_tokens[3] == 0 and count.n_tokens[4] == count.n_tokens[8]
    p = simhash.simhash_components(docs).toPandas().set_index("doc_id")
    assert p.fingerprint[2] == "0" * 16 and p.component_id[5] == 2 and p.component_id[8] == 4 and p.component_id[1].tolist() == [1, 1]
    spans = pii.pii_spans(docs).toPandas().set_index("doc_id")
    assert spans.spans[1].iloc[0].split(",")[0] == "email:6:12" and spans.n_phone[4] == 1 and spans.n_email[4] == 1
    pieces = packing.pack(docs, with_ids=True).toPandas()
    assert pieces[pieces.doc_id == 2].ids.map(list).tolist() == [[1]] and pieces.doc_id.isna().sum() == 1 and (pieces[pieces.doc_id == 1].start == 0).sum() == 2


def test_packing_and_mixing_of_nothing(empty, docs):
    assert packing.pack(empty).toPandas().empty
    assert mixing.mixed(empty.select("doc_id", "text", "source")).toPandas().empty
    assert mixing.mixed(docs.select("doc_id", "text", "source"), {}).toPandas().empty
    some = mixing.mixed(docs.select("doc_id", "text", "source"), {"s": 1.0}, budget=40.0).toPandas()
    assert set(some.source) == {"s"} and len(some) > 10
    one, two = (mixing.mixed(docs.select("doc_id", "text", "source")).toPandas().sort_values(["doc_id", "copy"]) for _ in range(2))
    assert one.shuffle_key.tolist() == two.shuffle_key.tolist()


def test_mixing_meets_its_weights(spark):
    d = spark.range(6000).selectExpr("id doc_id", "'0123456789' text", "if(id % 3 = 0, 'a', 'b') source")
    got = mixing.mixed(d, {"a": 3.0, "b": 1.0}).groupBy("source").count().toPandas().set_index("source")["count"]
    assert abs(got["a"] / got.sum() - 0.75) < 0.02 and abs(got.sum() - 6000) < 300


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, []), (None, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [1e-30, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 node", "2 n", "3 cell")
    got = embed_dedup.embedding_components(df).toPandas()
    by = got.dropna().set_index("vec_id")
    assert len(got) == len(data) and (by.n_links[[1, 2, 12]] == 4).all() and by.n_links[11].tolist() == [4, 4] and (by.component_id[11] == 1).all()
    assert all(by.n_links[k] == 0 and by.component_id[k] == k and by.kept[k] for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert embed_dedup.embedding_components(df.limit(0)).toPandas().empty


def test_large_groups_link_as_small_ones(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    flips = [0, *(1 << int(k) for k in rng.integers(0, 60, 400)), *((1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 60, (800, 2)))]
    prints = np.unique(np.array([0x0F0F_1234_5678_9ABC ^ f for f in flips] + rng.integers(0, 1 << 62, 200).tolist(), dtype=np.int64))
    df = spark.createDataFrame(pd.DataFrame({"fp": prints, "node": np.arange(len(prints))}))
    found = [common.components(simhash.link_prints(df, limit=n)).toPandas().set_index("node").component.sort_index() for n in (4, 5000)]
    up = list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count((prints[i] ^ prints[i + 1 :]).view(np.uint64)) <= 2) + i + 1:
            a, b = i, int(j)
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for f in found:
        assert [f.get(i, i) for i in range(len(prints))] == [root(i) for i in range(len(prints))]


def test_components_of_a_long_chain(spark):
    edges = spark.range(3000).selectExpr("(id * 7919) % 3001 a", "((id + 1) * 7919) % 3001 b").union(spark.createDataFrame([(9000, 9001), (9001, 9001), (None, 1)], "a long, b long"))
    got = common.components(edges).toPandas()
    assert got[got.node < 9000].component.eq(0).all() and len(got) == 3003 and got[got.node >= 9000].component.eq(9000).all()
    assert common.components(edges.limit(0)).toPandas().empty


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Com:80/en/7?x#y", "ftp://A.COM/en/", "x://com/en", "x://com/en/z", "x://notcom/en/", "http://ÄB.net/de/1", "http://a.net/fr/" + "q" * 5000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, urls[7]), (3, urls[3])], "page_id long, url string").selectExpr("*", "'x' host", "'y' path", "'z' rule", "'w' gram")
    got = url_filter.url_verdicts(df).toPandas()
    by = got.dropna(subset=["page_id"]).drop_duplicates("page_id").set_index("page_id")
    assert len(got) == 13 and (by.host[0], by.path[0], by.host[2]) == ("", "", "")
    assert (by.host[4], by.path[4], by.rule[4], by.verdict[4]) == ("example.com:80", "/en/7", None, by.verdict[4])
    assert (by.rule[5], by.verdict[5], by.rule[6], by.rule[7], by.rule[8]) == ("com/en/", "block", None, "com/en/", None)
    assert (by.host[9], by.rule[9], by.verdict[9]) == ("Äb.net", "net/de/", "allow")
    assert url_filter.url_verdicts(df.limit(0)).toPandas().empty


def test_url_model_tells_apart(spark):
    rows = [(k, f"http://site{k}.com/en/shop{k * 37 % 100}") for k in range(400)] + [(1000 + k, f"http://host{k}.net/de/artikel{k}") for k in range(400)] + [(2000 + k, f"http://z{k}.org/shop{k * 37 % 100}") for k in range(20)] + [(3000 + k, f"http://z{k}.org/artikel{k}") for k in range(20)]
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).toPandas().set_index("page_id").verdict
    assert (got[[2000 + k for k in range(20)]] == "block").mean() > 0.9 and (got[[3000 + k for k in range(20)]] == "allow").mean() > 0.9


def test_url_model_against_brute_force(spark):
    """The mixture of orders, computed plainly."""
    import math
    from collections import Counter

    good, bad, order, strength = ["aab", "ab"], ["bba"], 2, 2.0
    grams = Counter()
    for label, texts in (("a", good), ("b", bad)):
        for t in texts:
            s = url_filter.BEFORE * order + t + url_filter.AFTER
            grams.update((label, s[i : i + order + 1]) for i in range(len(t) + 1))
    every = sorted({g for _, g in grams})
    df = spark.createDataFrame([(g, grams["a", g], grams["b", g]) for g in every], "gram string, a long, b long")
    got = {r.gram: r.ratio for r in url_filter.model(df, order, strength).collect()}

    def p(label, gram, j):
        if j < 0:
            return 1 / 256
        n = sum(v for (k, g), v in grams.items() if k == label and g.endswith(gram[-j - 1 :]))
        c = sum(v for (k, g), v in grams.items() if k == label and g[order - j : order] == gram[order - j : order])
        return (n + strength * p(label, gram, j - 1)) / (c + strength)

    for g in every:
        assert math.isclose(got[g], math.log(p("a", g, order)) - math.log(p("b", g, order)), rel_tol=1e-9)


def test_revealing_terms(spark):
    """A name that stands beside one address in several contexts reveals it; common words don't."""
    filler = ["the report was sent on monday by the office", "people of the town like the river", "a day in the sun is good for all"]
    data = [(k, f"{filler[k % 3]} number {k}") for k in range(300)]
    data += [(1000 + k, f"{filler[k % 3]} Zyxwort wrote from zy.w@mail.example to the office {'again ' * k}") for k in range(4)]
    got = pii.pii_spans(spark.createDataFrame(data, "doc_id long, text string")).toPandas().set_index("doc_id")
    texts = dict(data)
    for k in range(1000, 1004):
        terms = [texts[k][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got.spans[k].split(",") if s.startswith("term")]
        assert "Zyxwort" in terms and not {"the", "office", "report"} & set(terms)
    assert (got.spans[[k for k in range(300)]] == "").all()
    clean = pii.sanitised(spark.createDataFrame([(d, t, 5) for d, t in data] + [(1, None, 6)], "doc_id long, text string, more long")).toPandas()
    assert clean.columns.tolist() == ["doc_id", "text", "more"] and len(clean) == len(data) + 1
    masked = clean[clean.doc_id >= 1000].text
    assert masked.str.contains(r"\[TERM\] .*\[EMAIL\]").all() and not masked.str.contains("@|Zyxwort").any()
    assert set(clean[clean.doc_id < 300].text.dropna()) == {t for d, t in data if d < 300}


def test_edit_fingerprints_follow_edits(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdefghij klmnop"), 3000))
    near = text[:1000] + "XY" + text[1001:2500] + text[2503:]
    other = "".join(rng.choice(list("abcdefghij klmnop"), 3000))
    one, two, three = (edit_fingerprint.Walk(edit_fingerprint.characters(t)).fingerprint() for t in (text, near, other))
    assert edit_fingerprint.likeness(one, two) > 0.8 > 0.2 > edit_fingerprint.likeness(one, three) and edit_fingerprint.likeness(one, one) == 1
    df = spark.createDataFrame([(1, text), (2, other), (3, near), (4, text)], "doc_id long, text string")
    got = edit_fingerprint.edit_near_duplicates(spark, df).toPandas().set_index("node").component
    assert got.to_dict() == {1: 1, 3: 1, 4: 1}
    solo = edit_fingerprint.edit_fingerprints(spark.createDataFrame([(9, "abcd")], "doc_id long, text string")).first()
    import hashlib

    assert solo.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and solo.near_next == 1.0


def test_splices_hold(spark):
    tok = token_count.tokenizer(token_count.vocabulary("byte_bpe_50k.json"))
    texts = ["a  b\n c<|endoftext|> d " * 50, "x" * 4000, "word " * 900, "日本語 テキスト" * 200, "1234567 " * 400, "it's  the end\n\n" * 300]
    whole = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    for chunk, overlap in ((64, 4), (300, 20), (1000, 64)):
        assert token_count.count_tokens(tok, texts, chunk, overlap) == whole


def test_pieces_count_as_whole_texts():
    import random

    tok = token_count.tokenizer(token_count.vocabulary("byte_bpe_50k.json"))
    r = random.Random(0)
    parts = ["a", "B", "é", " ", "  ", "\n", ".", ",", "'", "s", "1", "<|endoftext|>", "\t", "ß", "日", "-", " ", "\u00a0", "\x1c", "\r", "don't", "\u0301"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    assert token_count.count_tokens(tok, texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_as_the_library(spark):
    import numpy as np

    tok = token_count.tokenizer(token_count.vocabulary("word_bpe_49k.json"))
    texts = ["", " ", "a<|endoftext|>b <|endoftext|>", "it's Can'T 'LL a'sb", "́a ́b é \x1c x\x1dy", "日本語 テ", "12 3a4", "İstanbul ΑΣ ß Straße, ÀÖ×÷ªº µ", "\x00 a\x00b \x7f~`^", "Größe!? Übermaß... naïve-café"]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in packing.Words(tok).ids(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def shingles(text, words=5):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def pairs_that_share(texts):
    by = {}
    for d, s in texts.items():
        for x in s:
            by.setdefault(x, []).append(d)
    return {(a, b) for ds in by.values() for k, a in enumerate(sorted(ds)) for b in sorted(ds)[k + 1 :]}


def test_classifier_is_fitted_on_posteriors(spark, sf, monkeypatch):
    """Also where labelled rows would fill the sample, the label model's posteriors of rows drawn regardless of labels are fitted."""
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE", 200)
    monkeypatch.setattr(toxicity, "fit_linear", lambda x, y, fit=toxicity.fit_linear: seen.append(y) or fit(x, y))
    toxicity.toxicity_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).count()
    assert len(seen[0]) == 200 and ((seen[0] > 0) & (seen[0] < 1)).all()


def test_near_copies_in_large_bands(spark, monkeypatch):
    """Blocks smaller than a band link what one block links."""
    import numpy as np

    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(500)]
    data, d = [], 0
    for _ in range(5):
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(60):
            words = list(base)
            words[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10)}"
            data.append((d, " ".join(words)))
            d += 1
    df = spark.createDataFrame(data, "doc_id long, text string")
    whole = simhash.near_copies(df).toPandas().sort_values("doc_id").component_id.tolist()
    assert whole == [k // 60 * 60 for k in range(300)]
    rows = pd.DataFrame({"band": [7] * 300 + [8] * 2, "node": [*range(300), 500, 501], "marks": [simhash.sketch(simhash.shingle_hashes(t.encode(), 5)) for _, t in data] + [simhash.sketch(simhash.shingle_hashes(b"a b c d e f g", 5))] * 2})
    monkeypatch.setattr(simhash, "HELD", 32)
    got = pd.concat(simhash._grouped(0.8)(iter([rows[:70], rows[70:71], rows[71:200], rows[200:]])))
    forest = common.Forest()
    for a, b in zip(got.a.tolist(), got.b.tolist(), strict=True):
        forest.join(a, b)
    assert [forest.root(k) for k in range(300)] == whole and forest.root(501) == 500


def test_drifting_chains_in_large_bands(spark, monkeypatch):
    """A chain of edited copies, each like its neighbours only, doesn't fall apart in a band far over HELD."""
    import numpy as np

    rng = np.random.default_rng(3)
    words, marks = [f"w{k}" for k in range(160)], []
    for k in range(100):
        words[96 + 7 * k % 64] = f"x{k}"
        marks.append(simhash.sketch(simhash.shingle_hashes(" ".join(words).encode(), 5)))
    order = rng.permutation(100)
    rows = pd.DataFrame({"band": [7] * 100, "node": order, "marks": [marks[k] for k in order]})
    monkeypatch.setattr(simhash, "HELD", 8)
    got = pd.concat(simhash._grouped(0.8)(iter([rows[:50], rows[50:]])))
    forest = common.Forest()
    for a, b in zip(got.a.tolist(), got.b.tolist(), strict=True):
        forest.join(a, b)
    assert {forest.root(k) for k in range(100)} == {0}
    keys = spark.createDataFrame([(1, k) for k in range(40)] + [(2, k) for k in range(5)], "band long, node long")
    met = common.in_blocks(keys, "band", 8).toPandas().groupby("band").node.apply(set).tolist()
    assert all(any({a, b} <= m for m in met) for a in range(40) for b in range(40)) and set(range(5)) in met and max(map(len, met)) < 40


def test_near_copies_are_decided_exactly(spark):
    """Pairs at and around a similarity of 0.8 are joined if and only if it is 0.8 or more."""
    data, want = [], {}
    for c in range(120):
        words = [f"c{c}w{k}" for k in range(94)]  # 90 shingles
        other = words[: 80 + c % 5 - 2 + 4] + [f"c{c}x{k}" for k in range(10 - c % 5 + 2)]  # 78 to 82 of them shared
        data += [(2 * c, " ".join(words)), (2 * c + 1, " ".join(other))]
        a, b = shingles(data[-2][1]), shingles(data[-1][1])
        want[c] = len(a & b) / len(a | b) >= 0.8
    assert 20 < sum(want.values()) < 100
    got = simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    wrong = [c for c in want if (got[2 * c + 1] == 2 * c) != want[c]]
    assert not any(not want[c] for c in wrong) and len(wrong) <= 1  # of pairs at 0.8, 0.3 % share no band


def test_pipeline_stages(spark, sf):
    """Each stage over its predecessor's rows, against brute force where there is one."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    now = d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name != "packing":
            assert out.columns == d.columns
        out = common.Table(out, "stage").df
        if name == "toxicity":
            scores = toxicity.toxicity_scores(now, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0")
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scores.collect()}
        elif name == "simhash_dedup":
            texts = {r.doc_id: shingles(r.text) for r in now.collect()}
            kept = {r.doc_id for r in out.collect()}
            group = {r.doc_id: r.component_id for r in simhash.near_copies(now).collect()}
            assert kept == set(group.values()) and out.count() == len(kept)
            like = {}
            for i, j in pairs_that_share(texts):
                like[i, j] = len(texts[i] & texts[j]) / len(texts[i] | texts[j])
            assert all(group[i] == group[j] for (i, j), x in like.items() if x >= 0.87) and sum(x >= 0.87 for x in like.values()) > 50
            near = {i for (i, j), x in like.items() if x >= 0.7} | {j for (i, j), x in like.items() if x >= 0.7}
            assert all(i in near for i in texts if i not in kept)
        elif name == "pii":
            assert out.count() == now.count() and out.where("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
        elif name == "packing":
            sums = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "sum"}).count()
            assert sums == now.select("doc_id").distinct().count()
        now = out


def test_simhash_dedup_of_repeated_ids(spark, docs):
    got = simhash.simhash_dedup(docs).toPandas()
    assert sorted(got.doc_id.dropna().tolist()) == [1, 2, 4, 6, 7] and got.doc_id.isna().sum() == 1


def test_clashing_columns_pass_through(spark, docs):
    wide = docs.selectExpr("*", "7 rate", "8 n_copies", "9 shuffle_key", "10 s", "11 u", "12 name")
    got = mixing.mixed(wide, budget=3.0)
    assert got.columns[: len(wide.columns)] == wide.columns and {(r.n_copies, r.shuffle_key, r.rate, r.s) for r in got.collect()} == {(8, 9, 7, 10)}
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and {(r.h, r.k, r.base, r.more) for r in clean.collect()} == {(3, 4, "b", "m")}


def test_windows_hold_every_id_once():
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(30):
        items = [(k, 0, np.arange(n, dtype="<u4").tobytes()) for k, n in enumerate(rng.integers(1, 17, 300).tolist())]
        total, base = sum(len(x[2]) // 4 for x in items), 0
        done, items, base = packing.pieces(items, 64, 8, False, base, 0.9)
        more, items, base = packing.pieces(items, 64, 8, True, base, 0.9)
        out = done + more
        assert not items and sum(len(i) // 4 for _, _, i, *_ in out) == total
        ids = sorted((r, s + j) for r, s, i, *_ in out for j in range(len(i) // 4))
        assert len(set(ids)) == total and all((np.frombuffer(i, dtype="<u4") == np.arange(s, s + len(i) // 4)).all() for _, s, i, *_ in out)
        sums = {}
        for _, _, i, w, o in out:
            assert o == sums.get(w, 0)
            sums[w] = o + len(i) // 4
        assert sorted(sums) == list(range(base)) and max(sums.values()) <= 64 and total / (64 * base) > 0.85


def test_window_count_rises_where_capacity_is_exceeded():
    found = packing.windows_of([6, 6, 6, 2], 10)  # 20 in all, but two windows of 10 can't hold them
    assert len(found) == 3 and sorted(k for w in found for k in w) == [0, 1, 2, 3]


def test_pack_with_whole_documents(spark):
    d = spark.createDataFrame([(k, "word " * (37 * k % 90)) for k in range(200)], "doc_id long, text string")
    got = packing.pack(d, capacity=128, piece=128).toPandas()
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all() and got.groupby("sequence_id").length.sum().max() <= 128
    assert (got.length == got.doc_tokens).mean() > 0.9  # but for the last of a group


def made_votes(rng, n):
    """Votes of known rates; voters 0 and 4 always agree within a label, others are independent."""
    import numpy as np

    y = rng.random(n) < 0.3
    rate = np.where(y[:, None], np.linspace(0.9, 0.5, len(toxicity.VOTERS)), np.linspace(0.02, 0.2, len(toxicity.VOTERS)))
    v = rng.random((n, len(toxicity.VOTERS))) < rate
    v[:, 4] = v[:, 0]
    return y, rate, (v @ (1 << np.arange(len(toxicity.VOTERS)))) | (1 << len(toxicity.VOTERS))


def test_label_model_recovers_accuracies_and_correlations():
    import numpy as np

    rng = np.random.default_rng(1)
    y, _, patterns = made_votes(rng, 40_000)
    gold = np.where(rng.random(len(y)) < 0.1, y.astype(int), -1)
    key, counts = np.unique(np.stack([patterns, gold], 1), axis=0, return_counts=True)
    model = toxicity.LabelModel().fit(key[:, 0], key[:, 1], counts.astype(float))
    want = np.stack([np.linspace(0.02, 0.2, len(toxicity.VOTERS)), np.linspace(0.9, 0.5, len(toxicity.VOTERS))])
    want[:, 4] = want[:, 0]
    assert abs(model.theta - want).max() < 0.05 and abs(model.prior[1] - 0.3) < 0.02
    right = np.where(toxicity.BOTH, 0.3 * want[1] + 0.7 * (1 - want[0]), 0.3 * want[1] / (0.3 * want[1] + 0.7 * want[0]))
    assert abs(model.accuracies() - right).max() < 0.05
    off = model.correlations.copy()
    np.fill_diagonal(off, 0)
    assert off[0, 4] > 0.95 and off[4, 0] > 0.95
    off[0, 4] = off[4, 0] = 0
    assert off.max() < 0.2
    assert ((model.posterior(patterns) > 0.5) == y).mean() > 0.98


def test_abstaining_voters_say_nothing():
    import numpy as np

    rng = np.random.default_rng(2)
    y, _, patterns = made_votes(rng, 20_000)
    model = toxicity.LabelModel().fit(patterns, y.astype(int), np.ones(len(y)))
    assert abs(model.posterior(np.array([0]))[0] - model.prior[1]) < 1e-9  # a short text without a vote
    assert model.posterior(np.array([1 << len(toxicity.VOTERS)]))[0] < 0.01  # a long text in which no lexicon finds a term


def test_scores_follow_posteriors(spark, sf, monkeypatch):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = toxicity.toxicity_scores(d, lab).toPandas().sort_values("doc_id").score.to_numpy()
    monkeypatch.setattr(toxicity.LabelModel, "posterior", lambda self, p, real=toxicity.LabelModel.posterior: real(self, p)[::-1] if len(p) > 700 else real(self, p))
    two = toxicity.toxicity_scores(d, lab).toPandas().sort_values("doc_id").score.to_numpy()
    assert abs(one - two).max() > 0.2


def test_language_network_against_plain_loops():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    net = langid.Network.train(x, np.array([0, 1, 2]), ["a", "b", "c"], epochs=1)
    got = net.log_probabilities(x, net.tables())
    for row, found in zip(x, got, strict=True):
        h = []
        for w in net.filters:
            for f in range(langid.FILTERS):
                h.append(max(sum(float(net.embed[row[t + k]] @ w[k, :, f]) for k in range(len(w))) for t in range(langid.WINDOW - len(w) + 1)))
        logits = np.maximum(np.array(h) + net.bias, 0) @ net.dense + net.offset
        assert np.allclose(found, logits - np.log(np.exp(logits).sum()), atol=1e-4)


def test_texts_without_letters_are_undetermined(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-k, t, "en") for k, t in enumerate(["½ ² ①", "12_3", "!", "a", "日"], 1)], d.schema)
    got = langid.language_ids(d.union(odd)).toPandas().set_index("doc_id").lang_pred
    assert [got[-k] == "und" for k in range(1, 6)] == [True, True, True, False, False]


def test_repeated_rows_stay_within_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    seen = []
    monkeypatch.setattr(langid.Network, "train", classmethod(lambda cls, x, y, langs, real=langid.Network.train.__func__: seen.append(len(x)) or real(cls, x, y, langs)))
    d = spark.range(400).selectExpr("1 doc_id", "concat('text ', id, repeat(' word', 200)) text", "if(id % 2 = 0, 'a', 'b') lang").where("doc_id = 1")
    langid.language_ids(d).count()
    assert seen and seen[0] <= 60


def test_edit_fingerprint_against_plain_walk():
    import numpy as np

    rng = np.random.default_rng(9)
    bits = np.random.default_rng(2016).integers(0, 2, (256, edit_fingerprint.PERIOD), dtype=np.uint8)
    bits[:, 0] |= bits.sum(axis=1) == 0
    for n in (0, 1, 5, 63, 400):
        chars = edit_fingerprint.characters("".join(rng.choice(list("abcdé 日"), n)))
        kinds, written, at = edit_fingerprint.classes(), [], 0
        t = 0
        while at < n:
            written.append(int(chars[at]) + 1)
            at += int(bits[kinds[chars[at]], t % edit_fingerprint.PERIOD])
            t += 1
        octaves = 1
        while octaves < 40 and t > 64 << (octaves - 1):
            octaves += 1
        want = []
        for k in range(octaves):
            for place in edit_fingerprint.sampled(k).tolist():
                c = written[place] if place < t else 0
                mixed = edit_fingerprint.mix(np.uint64(c) * np.uint64(0x100000001) ^ edit_fingerprint.mix(np.array([place], dtype=np.uint64)))
                want.append(int(mixed[0] >> np.uint64(17)) & 1)
        assert edit_fingerprint.Walk(chars).fingerprint() == f"{t:08x}" + np.packbits(np.array(want, dtype=np.uint8)).tobytes().hex()


def test_edit_near_duplicates_recall(spark, monkeypatch):
    """Against all pairs; bands over HELD rows lose nothing."""
    import numpy as np

    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choice(vocabulary, int(rng.integers(40, 300))).tolist()
        for _ in range(12):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // 12)))):
                words[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(words))
    prints = [edit_fingerprint.Walk(edit_fingerprint.characters(t)).fingerprint() for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if edit_fingerprint.likeness(prints[a], prints[b]) >= 0.8]
    forest = common.Forest()
    for a, b in links:
        forest.join(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for held in (4, 1024):
        monkeypatch.setattr(edit_fingerprint, "HELD", held)
        got = edit_fingerprint.edit_near_duplicates(spark, df).toPandas().set_index("node").component.to_dict()
        assert sum(got.get(a, a) == got.get(b, b) for a, b in links) / len(links) >= 0.9 and len(links) > 100
        assert all(forest.root(a) == forest.root(b) for a, b in got.items())


def test_rows_of_one_id_are_cut_by_their_texts(spark):
    d = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text")
    rows = d.selectExpr("-1L key", "xxhash64(text) h", "doc_id", "text")
    parts = edit_fingerprint.neighbours(rows).where("role = 0").groupBy("part").count().toPandas()["count"]
    assert parts.sum() == 3000 and parts.max() < 1500 and edit_fingerprint.edit_fingerprints(d).count() == 3000


def test_url_scores_and_verdicts_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    r = random.Random(4)
    urls = [f"http://{r.choice(['a', 'b'])}{k % 7}.{r.choice(['com/en', 'net/de', 'org/fr', 'io'])}/{r.choice(['shop', 'artikel', 'x'])}{k % 11}" + "?q=1" * (k % 3 == 0) for k in range(150)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.url_verdicts(df, order=2).toPandas().set_index("page_id")
    fold = {x.url: x.f for x in df.selectExpr("url", "pmod(xxhash64(url), 5) f").distinct().collect()}
    ruled = {u: got.verdict[k] for k, u in enumerate(urls) if got.rule[k] is not None}
    assert 20 < len(ruled) < 140

    def grams(u):
        s = url_filter.BEFORE * 2 + u + url_filter.AFTER
        return [s[i : i + 3] for i in range(len(u) + 1)]

    count = {"allow": Counter(), "block": Counter()}
    for u, v in ruled.items():
        if fold[u]:
            for g in grams(u):
                for j in range(3):
                    count[v][g[2 - j :]] += 1
                    count[v]["ctx", j, g[2 - j : 2]] += 1

    def p(v, g, j=2):
        return 1 / 256 if j < 0 else (count[v][g[2 - j :]] + 2.0 * p(v, g, j - 1)) / (count[v]["ctx", j, g[2 - j : 2]] + 2.0)

    score = {u: sum(math.log(p("allow", g)) - math.log(p("block", g)) for g in grams(u)) / (len(u) + 1) for u in set(urls)}
    assert all(math.isclose(got.score[k], score[u], rel_tol=1e-9, abs_tol=1e-12) for k, u in enumerate(urls))
    free = [(score[u], got.verdict[k]) for k, u in enumerate(urls) if got.rule[k] is None]
    assert max([s for s, v in free if v == "block"], default=-9) < min([s for s, v in free if v == "allow"], default=9)


def test_url_threshold_of_ties(spark):
    rows = [("allow", 0, 0.5)] * 4 + [("block", 0, 0.5)] * 4 + [("allow", 1, 9.0), (None, 0, 7.0)]
    assert url_filter.threshold(spark.createDataFrame(rows, "ruled string, fold int, score double")) == 0.5
    assert url_filter.threshold(spark.createDataFrame(rows[:4], "ruled string, fold int, score double")) is None


def test_running_sums_and_places(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    for n in (0, 1, 255, 256, 257, 1000):
        v = [r.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(v,)], "v array<long>").select(pii.running(F.col("v"), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.greatest).alias("m")).first()
        assert got.s == [sum(v[: k + 1]) for k in range(n)] and got.m == [max(v[: k + 1]) for k in range(n)]
    text = "".join(r.choice(["ab", "é", "𝒳", " ", "1", "\n"]) for _ in range(5000))
    found = spark.createDataFrame([(text,)], "t string").select(pii.located(F.col("t"), pii.WORD).alias("x")).first().x
    assert [(x.start, x.end, x.value) for x in found] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[abé𝒳]{3,}", text)]


def test_a_hundred_thousand_matches(spark):
    import time

    from pyspark.sql import functions as F

    texts = ["1;" * 100_000, "1.2.3.4 " * 100_000, "a@b.cd " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").persist()
    df.count()
    began = time.time()
    got = {x.doc_id: (x.n, x.last) for x in pii.with_base(df).select("doc_id", F.size("base").alias("n"), F.try_element_at("base", F.lit(-1))["end"].alias("last")).collect()}
    assert got == {0: (0, None), 1: (100_000, 799_999), 2: (100_000, 699_999)} and time.time() - began < 15
    clean = {x.doc_id: x.text for x in pii.sanitised(df).collect()}
    assert clean == {0: texts[0], 1: "[IP] " * 100_000, 2: "[EMAIL] " * 100_000}


def test_terms_against_brute_force(spark):
    """Counts in passages of distinct texts, and every occurrence of a term outside base spans."""
    import math
    from collections import Counter

    data = [(k, f"row {chr(97 + k % 26)}{chr(97 + k // 26)}word of the {'blue' if k % 2 else 'green'} list") for k in range(200)]
    data += [(300 + k, f"Zara and the {w} at +1 555 123 45{k % 2}0 x") for k, w in enumerate(["cat", "dog", "cat", "emu"])]
    data += [(400, data[-1][1]), (401, data[-1][1]), (402, "zara alone"), (403, "Emu zara@emu.org zara")]
    got = pii.pii_spans(spark.createDataFrame(data, "doc_id long, text string")).toPandas().set_index("doc_id").spans
    seen, n, n_t, n_e, n_et = set(), 0, Counter(), Counter(), Counter()
    bases = {d: base_spans(t) for d, t in data}
    for d, t in data:
        if t in seen:
            continue
        seen.add(t)
        n += 1  # each text is one passage
        rest = "".join(" " if any(s <= i < e for s, _, e, _ in bases[d]) else c for i, c in enumerate(t))
        words = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", rest)}
        entities = {(k, t[s:e].lower()) for s, _, e, k in bases[d]}
        n_t.update(words)
        n_e.update(entities)
        n_et.update((x, w) for x in entities for w in words)
    strong = {w for (x, w), c in n_et.items() if c >= 2 and n_e[x] >= 2 and math.log2(n / n_e[x]) >= 4 and c / n_t[w] >= 0.5 - 1e-9}
    assert strong and "the" not in strong
    for d, t in data:
        want = list(bases[d])
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            if m[0].lower() in strong and not any(s < m.end() and m.start() < e for s, _, e, _ in bases[d]):
                want.append((m.start(), 4, m.end(), "term"))
        assert got[d] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(want)), d


def base_spans(text):
    from tests.llm import test_contracts

    return test_contracts.base_spans(text)


def test_other_vocabularies_are_encoded_whole():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok = token_count.tokenizer(token_count.vocabulary(name))
        assert token_count.byte_level(tok) == (name == "byte_bpe_50k.json") and packing.word_rules(tok) == (name == "word_bpe_49k.json")
        texts = ["It's  a ÄÖ 12 test\n" * 9, "", "日本語、" * 50]
        whole = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert token_count.count_tokens(tok, texts, 64, 8) == [len(x) for x in whole]
        import numpy as np

        assert [np.frombuffer(x, dtype="<u4").tolist() for x in packing.Words(tok).ids(texts)] == whole


def test_long_texts_without_spaces_are_linear():
    import time

    tok = token_count.tokenizer(token_count.vocabulary("byte_bpe_50k.json"))
    for text in ("日本語、" * 50_000, "12 " * 150_000, "ab1,c" * 100_000, "it's" * 60_000, "<|endoftext|>" * 5000, "x" * 20_000):
        began = time.time()
        want = len(tok.encode(text, add_special_tokens=False).ids)
        plain, began = time.time() - began, time.time()
        assert token_count.count_tokens(tok, [text], 4096, 64) == [want]
        assert time.time() - began < 5 * plain + 1


def test_embeddings_of_low_rank(spark, monkeypatch):
    """The margin holds for any vectors: all links of vectors close to a few directions, also in blocks smaller than a cell."""
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 6)) @ rng.normal(size=(6, 96)) + 0.05 * rng.normal(size=(2500, 96))
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    for size in (1 << 22, 8 * 96 * 40):
        monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", size)
        got = embed_dedup.embedding_components(df).toPandas().sort_values("vec_id")
        assert (got.n_links.to_numpy() == want).all() and want.sum() > 2000


def test_hot_keys_join_as_others(spark, monkeypatch):
    long = spark.range(500).selectExpr("if(id < 300, 1, id) k", "id v")
    table = common.Table(long.groupBy("k").agg({"v": "min", "k": "count"}).selectExpr("k", "`min(v)` m", "`count(k)` n").where("k <> 400"), "t").df
    want = sorted(map(tuple, long.join(table.drop("n"), "k", "left").select("k", "v", "m").collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    for hot in (10, 10_000):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert sorted(map(tuple, common.join_hot(long, table, ["k"], "n", "left").select("k", "v", "m").collect()), key=str) == want
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    star = spark.range(400).selectExpr("999 a", "id b").union(spark.range(400).selectExpr("id + 1000 a", "id b"))
    got = common.components(star).toPandas()
    assert got.component.eq(0).all() and len(got) == 801


def test_scopes_drop_their_tables(spark):
    with common.Scope() as scope:
        one, two = common.Table(spark.range(3), "one"), common.Table(spark.range(4), "two")
        kept = scope.keep(two)
    assert kept.count() == 4 and not common.Scope.open
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(one.path)
