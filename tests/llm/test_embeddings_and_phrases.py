"""Whitening, embedding near-dedup and collocations against brute force, and their edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from edge_fixtures import edge_docs, no_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from plexnet.llm import collocations as C
from plexnet.llm import embedding_dedup as D
from plexnet.llm import whitening as W

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, row string, cell string, n string, kept string"
#: Nulls in every column, empty, zero, non-finite, repeated rows and ids, parallel vectors.
ROWS = [(1, [1.0, 0.0, 0.5], 1), (2, [1.0, 0.01, 0.5], 1), (3, [2.0, 0.02, 1.0], 1), (3, [2.0, 0.02, 1.0], 1), (4, [1.0, 0.0, 0.5], 2), (5, None, 1),
        (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [NAN, 0.0, 1.0], 1), (10, [INF, 0.0, 1.0], 1), (11, [1.0, 0.0, 0.5], None),
        (None, [1.0, 0.0, 0.5], 1), (None, [0.0, 1.0, -3.0], 3), (12, [0.0, -1.0, 2.0], 1), (13, [-1.0, 0.25, 0.0], 2)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vec") / "embeddings.parquet")
    spark.createDataFrame([r + ("a",) * 5 for r in ROWS], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def brute_whiten(x, components):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1))
    order = np.argsort(-e)[:components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(700, 9)) @ np.diag([4, 3, 2, 1.5, 1, .8, .5, .3, .1]) + rng.normal(size=9) * 20
    c = np.concatenate([c, c[:50], c[:1].repeat(300, 0)])  # repeated rows and one very common vector
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "vec_id bigint, embedding array<double>").repartition(7)
    got = W.whiten(spark, df).orderBy("component", "vec_id").toPandas()
    n, dev, white, share = brute_whiten(np.floor(256 * c).astype(np.int64), 4)
    assert len(got) == 4 * len(c) and set(got.n) == {n} and set(got.columns) >= {"vec_id", "embedding"}
    for k in range(4):
        g = got[got.component == k + 1]
        assert g.deviation.tolist() == dev.tolist()
        assert min(abs(g.whitened - white[:, k]).max(), abs(g.whitened + white[:, k]).max()) < 1e-9
        assert g.explained.iloc[0] == pytest.approx(share[k], rel=1e-9) and g.identity_error.iloc[0] < 1e-9


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(-2**30, 2**30), min_size=3, max_size=3), min_size=1, max_size=90), st.sampled_from([3, 12]))
def test_scatter_is_exact(spark, rows, unit_bits):
    """Products of integers of any span, in one unit or in several."""
    before, W.UNIT_BITS = W.UNIT_BITS, unit_bits
    try:
        sc = W.scatter(spark.createDataFrame([(r,) for r in rows], "x array<bigint>").repartition(2))
    finally:
        W.UNIT_BITS = before
    x = np.array(rows, object)
    s = x.sum(0)
    assert sc.n == len(rows) and sc.sums == s.tolist()
    assert (sc.centred == len(rows) * (x.T @ x) - np.outer(s, s)).all()


def test_whitening_edge_cases(spark, vectors):
    got = W.whiten(spark, vectors).collect()
    assert len(got) == 3 * 11 and {r.component for r in got} == {1, 2, 3}  # eleven usable rows of three dimensions
    assert {r.vec_id for r in got} == {1, 2, 3, 4, 7, 11, 12, 13, None} and got[0].label in (1, 2, 3, None)
    assert {r.n for r in got} == {len({tuple(np.floor(256 * np.float32(v)).tolist()) for _, v, *_ in ROWS if v and None not in v and np.isfinite(v).all()})}
    assert W.whiten(spark, vectors.limit(0)).count() == 0 and "deviation" in W.whiten(spark, vectors.limit(0)).columns
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 3.0])], "vec_id int, embedding array<double>")
    flat = {(r.vec_id, r.component): r for r in W.whiten(spark, alike).collect()}
    assert abs(flat[1, 1].whitened) == pytest.approx(1) and flat[1, 2].whitened is None and flat[1, 2].explained == 0 and flat[1, 1].identity_error < 1e-12
    with pytest.raises(ValueError, match="different lengths"):
        W.whiten(spark, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>"))


def test_whitening_deviation_beyond_a_long(spark):
    rows = [(i, [float(i * 10**9), float(-i)]) for i in range(40)]
    got = W.whiten(spark, spark.createDataFrame(rows, "vec_id int, embedding array<double>")).where("component = 1").collect()
    n = 40
    s = sum(256 * i * 10**9 for i in range(40)), sum(-256 * i for i in range(40))
    want = {i: (n * 256 * i * 10**9 - s[0]) ** 2 + (-n * 256 * i - s[1]) ** 2 for i in range(40)}
    assert max(want.values()) > 1 << 63 and {r.vec_id: int(r.deviation) for r in got} == want


def brute_groups(rows, threshold=0.93):
    """Per row: links, smallest id of its group."""
    ok = [lab is not None and v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v, lab in rows]
    near = [[] for _ in rows]
    for i, (_, u, a) in enumerate(rows):
        for j, (_, v, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and a == b and len(u) == len(v):
                x, y = np.array(u, np.float64), np.array(v, np.float64)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    near[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((len(near[i]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("cell,block", [(2048, 4096), (16, 24)])
def test_embedding_groups_against_brute_force(spark, cell, block):
    """Chains, tight groups, a group of a third of all rows and noise; whole, and in many cells and blocks."""
    rng = np.random.default_rng(11)
    rows, centre = [], rng.normal(size=(12, 8))
    for k, c in enumerate(centre):
        for _ in range(12):
            rows.append((c + rng.normal(size=8) * 0.25).tolist())
    rows += [(centre[0] + rng.normal(size=8) * 0.02).tolist() for _ in range(150)] + [centre[1].tolist()] * 20 + rng.normal(size=(120, 8)).tolist()
    rows = [(int(i), np.float32(v).tolist(), int(i) % 2) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in D.link(spark, df, cell=cell, block=block, sample=400).collect()}
    assert got == {r[0]: x for r, x in zip(rows, brute_groups(rows), strict=True)}


def test_embedding_edge_cases(spark, vectors):
    got = D.link(spark, vectors).collect()
    assert len(got) == len(ROWS) and all(r.n_links is not None and r.kept is not None for r in got)
    of = {r.vec_id: r for r in got if r.vec_id not in (None, 3)}
    three = [r for r in got if r.vec_id == 3]
    assert len(three) == 2 and {r.component_id for r in got if r.vec_id in (1, 2, 3)} == {1}
    assert [of[i].n_links for i in (1, 2, 4)] == [4, 4, 0] and {r.n_links for r in three} == {4}  # 1, 2, 3 twice and a null id
    assert sum(r.kept for r in got if r.component_id == 1) == 1 and of[1].kept
    assert all(of[i].n_links == 0 and of[i].component_id == i and of[i].kept for i in (5, 6, 7, 8, 9, 10, 11, 12, 13))
    assert [r.component_id for r in got if r.vec_id is None and r.label == 3] == [None]
    assert D.link(spark, vectors.limit(0)).count() == 0
    left = D.drop_near_copies(spark, vectors)
    assert left.columns == vectors.columns and left.count() == sum(r.kept for r in got)
    ragged = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.01], 1)], "vec_id int, embedding array<double>, label int")
    assert {r.vec_id: r.component_id for r in D.link(spark, ragged).collect()} == {1: 1, 2: 2, 3: 1}


def brute_phrases(docs, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= 10}
    rows = []
    for (lang, *p), a in cand.items():
        if len(p) == 2 and any(100 * b >= 50 * a and q[0] == lang and len(q) == 4 and (q[1:3] == tuple(p) or q[2:] == tuple(p)) for q, b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]]))
    out, at = [], Counter()
    for lang, s, a, p, left, right in sorted(rows):
        at[lang] += 1
        if at[lang] <= top:
            out.append((lang, at[lang], p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrases(spark, docs, **kw):
    got = C.collocations(spark, docs, **kw).collect()
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got)


def test_collocations_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD_WORDS", 700)  # many flushes, so stripes are merged
    rng = np.random.default_rng(2)
    vocab = ["the", "New", "york", "city", "of", "Ünï", "x", "ab", "\x1c", "ǅ", "a1", "z"]
    docs = []
    for i in range(400):
        w = rng.choice(vocab, rng.integers(0, 40), p=[.3, .1, .1, .08, .1, .05, .05, .05, .03, .04, .05, .05])
        sep = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!?"], len(w), p=[.7, .1, .05, .06, .04, .03, .02])
        docs.append(("".join(a + b for a, b in zip(w, sep, strict=True)), ["en", "de", None, ""][i % 4]))
    docs += [("new york city " * 3000, "en"), (None, "en"), ("", None), (" \t. \n", "de")]  # one pair and one text are very common
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    assert phrases(spark, df) == brute_phrases(docs)
    assert phrases(spark, df, top=3) == brute_phrases(docs, 3)


def test_collocations_of_long_text_and_full_filter(spark, monkeypatch):
    """A text of several pieces of _PIECE bytes, and a Bloom filter that lets everything pass."""
    monkeypatch.setattr(C, "_PIECE", 50)
    docs = [("alpha beta gamma, beta gamma delta " * 40, "en")]
    df = spark.createDataFrame(docs, "text string, lang string")
    want = brute_phrases(docs)
    assert phrases(spark, df) == want
    monkeypatch.setattr(C, "_bloom", lambda pairs: b"\xff" * (C.BLOOM_BITS // 8))
    assert phrases(spark, df) == want


def test_collocations_edge_cases(spark, edge_docs, no_docs):  # noqa: F811
    docs = [(r.text, r.lang) for r in edge_docs.select("text", "lang").collect()]
    assert phrases(spark, edge_docs) == brute_phrases(docs)
    assert C.collocations(spark, no_docs).count() == 0


def test_scores_beyond_64_bits(spark):
    """Products of counts near 10^9 are exact."""
    got = spark.range(1).selectExpr(*(f"CAST({x}L AS BIGINT) AS {c}" for c, x in (("a", 987654321), ("l", 1234567891), ("r", 1111111111))))
    assert got.selectExpr(C._cut("a", "l", "r") + " AS s").first().s == 1000000 * 987654321**2 // (1234567891 * 1111111111)
