"""The ten queries against brute force over sf0.01."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from netloom.llm import packing, queries, simhash, token_count
from tests.compare import connect, rows


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).toPandas()


def classes(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_op1_held_out(spark, sf):
    got = run(spark, sf, "op1_toxicity")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    both = got.merge(labels, on="doc_id").query("held_out")
    assert (both.predicted == both.toxic).mean() > 0.9 and both[both.toxic == 0].predicted.sum() == 0


def test_op1_learns_only_from_training_labels(spark, sf):
    from pyspark.sql import functions as F

    from netloom.llm import toxicity

    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.toxicity_scores(d, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (lab, other))
    assert np.allclose(one, two)


def test_op2_all_pairs(spark, sf):
    got = run(spark, sf, "op2_embedding_dedup").sort_values("vec_id")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    assert (got.n_links.to_numpy() == near.sum(axis=1) - 1).all()
    root = classes(len(x), zip(*np.nonzero(near), strict=True))
    assert (got.component_id.to_numpy() == e.vec_id.to_numpy()[root]).all() and (got.kept == (got.vec_id == got.component_id)).all()


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_op3_rules(spark, sf):
    got = run(spark, sf, "op3_url_filter").set_index("page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    assert len(got) == len(pages)
    for p, url in zip(pages.page_id, pages.url, strict=True):
        rest = (url or "").partition("://")[2]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        rule = max(fits, key=len, default=None)
        g = got.loc[p]
        assert (g.host, g.path, g.rule) == (host, path, rule) and g.verdict in ("allow", "block")
        if rule:
            assert g.verdict == RULES[rule]


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_op4_base(spark, sf, docs):
    got = run(spark, sf, "op4_pii").set_index("doc_id")
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        spans, g = base_spans(text or ""), got.loc[d]
        assert g.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        n = Counter(k for *_, k in spans)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert [s for s in g.spans.split(",") if s and not s.startswith("term")] == [s for s in joined(spans).split(",") if s]


def print_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_op5_all_pairs(spark, sf, docs):
    got = run(spark, sf, "op5_simhash").sort_values("doc_id")
    prints = np.array([print_of(t) for t in docs.text], dtype=np.uint64)
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints.tolist()]
    links = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    assert got.component_id.tolist() == docs.doc_id.to_numpy()[classes(len(docs), zip(*links, strict=True))].tolist()


def test_op6_whole_texts(spark, sf, docs):
    got = run(spark, sf, "op6_token_counts").sort_values("doc_id")
    tok = token_count.tokenizer(token_count.vocabulary("byte_bpe_50k.json"))
    texts = [t or "" for t in docs.text]
    assert got.n_tokens.tolist() == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in texts] and (got.over_limit == (got.n_tokens > 512)).all()


def test_op7_edited_texts(spark, sf, docs):
    got = run(spark, sf, "op7_edit_fingerprint").sort_values("doc_id")
    texts = [t or "" for t in docs.text]
    for t, after, g in zip(texts, texts[1:] + texts[:1], got.itertuples(), strict=True):
        k = len(t) // 2
        assert g.edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest() and g.n_chars == len(t)
    assert got.near_edited.mean() > 0.45 and got.near_next.mean() < 0.1 and (got.near_edited > got.near_next).mean() > 0.99
    by = {}
    for t, f in zip(texts, got.fingerprint, strict=True):
        assert by.setdefault(t, f) == f


def test_op8_sql(spark, sf):
    con = connect(sf)
    assert rows(run(spark, sf, "op8_mixing")) == rows(con.sql(queries.ORACLES["op8_mixing"]).fetchdf())


def test_op9_every_id_once(spark, sf, docs):
    got = run(spark, sf, "op9_packing")
    tok = token_count.tokenizer(token_count.vocabulary("word_bpe_49k.json"))
    ids = {d: e.ids + [1] for d, e in zip(docs.doc_id, tok.encode_batch([t or "" for t in docs.text], add_special_tokens=False), strict=True)}
    for d, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    assert set(got.doc_id) == set(ids)
    padding = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum().to_numpy()[:-1]]).all()
        n = g.length.sum()
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding / got.length.sum() < 0.015


def test_op10_held_out(spark, sf, docs):
    got = run(spark, sf, "op10_language_id").merge(docs, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_golay_decoding():
    table = simhash.errors()
    assert len(np.unique(table)) == 2048 and np.bitwise_count(table).max() == 3
    word = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    code = word ^ table[simhash.syndrome(word)]
    assert (simhash.syndrome(code) == 0).all() and (np.bitwise_count(word ^ code) <= 3).all()


def test_differencing_balances():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 500, 60).tolist()
        found = packing.differencing(sizes, 7)
        assert sorted(k for w in found for k in w) == list(range(60))
        sums = [sum(sizes[k] for k in w) for w in found]
        assert max(sums) - min(sums) <= 500 and max(sums) - sum(sizes) / 7 < 60
    assert [sorted(w) for w in packing.windows_of([2048, 2048, 1], 2048)] and len(packing.windows_of([1025, 1025, 1025], 2048)) == 3
