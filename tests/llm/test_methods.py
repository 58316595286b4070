"""Each method against a brute-force version, an exact round trip or held-out figures."""

import hashlib
import itertools
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge_fixtures import SF_MID, SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from plexnet.llm import bpe, catalog, chat, common, ctw, exact_dedup, ngram_join, packing, quality_rules
from plexnet.session import scratch_path
from pyspark.sql import functions as F


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    edges += [(5000, 5000 + i) for i in range(1, 200)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x
    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            par[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.comp for r in common.components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in par}


def test_binomial_tail_and_guarantee():
    assert quality_rules.binomial_tail(0, 90, 0.05) == pytest.approx(0.95 ** 90)
    assert quality_rules.binomial_tail(3, 3, 0.1) == 1.0
    want = sum(math.comb(200, i) * 0.05 ** i * 0.95 ** (200 - i) for i in range(8))
    assert quality_rules.binomial_tail(7, 200, 0.05) == pytest.approx(want, rel=1e-12)


def test_all_labels_count_beside_a_million_others(spark):
    """110 good certifying texts of a small language certify its rule, however many labels there are."""
    value = {"n_symbols": "IF(id < 220, 0L, 200L)", "n_words": "100L", "n_lines": "100L", "word_chars": "100L"}
    m = "struct(" + ", ".join(f"{value.get(c, '0L')} AS {c}" for c in quality_rules.METRIC_COLUMNS) + ") AS _m"
    measured = spark.range(320).selectExpr("id AS doc_id", "'xx' AS lang", m)
    labels = spark.range(1_000_000).selectExpr("id AS doc_id", "IF(id < 220, 1, 0) AS quality")
    chosen = quality_rules.fit_rules(spark, measured, labels)
    good = sum(zlib.crc32(str(i).encode()) % 2 for i in range(220))
    assert chosen["report"]["xx"]["good"] == good and chosen["rules"]["xx"] == [("symbols", 1.0)]


def test_index_keeps_across_batches(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index-test"), 4)
    one = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id bigint, text string")
    two = spark.createDataFrame([(0, "a\tb"), (4, "d"), (5, "d")], "doc_id bigint, text string")
    assert {r.doc_id for r in exact_dedup.dedup(spark, one, index).where("kept").collect()} == {1, 3}
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(spark, two, index).collect()}
    assert got == {0: (1, False), 4: (4, True), 5: (4, False)}
    assert index.table().count() == 3
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    again.add(spark.createDataFrame([(b"x" * 32, 9, 9)], "digest binary, keep_id bigint, keep_row bigint"))
    assert again.table().count() == 4
    plan = again.table().select("digest").hint("merge").join(index.table().select("digest").hint("merge"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()  # the index is never shuffled


def test_index_is_opened_again_with_its_own_buckets(spark):
    """Three batches, the second and third after the table entry is gone and under another setting; one row out per row in."""
    path = scratch_path(spark, "reopened-index")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    first = exact_dedup.DigestIndex(spark, path, 16)
    assert exact_dedup.dedup(spark, docs, first).where("kept").count() == 200
    for _ in range(2):
        spark.sql(f"DROP TABLE {first.name}")
        index = exact_dedup.DigestIndex(spark, path + "/")
        assert index.buckets == 16 and index.name == first.name
        rows = exact_dedup.dedup(spark, docs, index).collect()
        assert len(rows) == 200 and not any(r.kept for r in rows) and all(r.keep_id == r.doc_id for r in rows)
        assert index.table().count() == 200
    with pytest.raises(ValueError, match="16 buckets"):
        exact_dedup.DigestIndex(spark, path, 8)
    groups = spark.createDataFrame([(b"y" * 32, 1, 1)], "digest binary, keep_id bigint, keep_row bigint")
    index.add(groups)
    index.add(groups)  # as after a failure
    assert index.table().count() == 201


def test_indexes_with_the_same_last_part_are_different(spark):
    a, b = (exact_dedup.DigestIndex(spark, scratch_path(spark, x) + "/one-idx", 4) for x in ("my", "other"))
    exact_dedup.dedup(spark, spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), a).count()
    assert a.name != b.name and a.table().count() == 1 and b.table().count() == 0


def test_a_digest_twice_in_the_index_is_one_row(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "twice"), 4)
    docs = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id bigint, text string")
    rows = exact_dedup.dedup(spark, docs, index).collect()
    again = spark.createDataFrame([(r.digest, 9, 9) for r in rows], "digest binary, keep_id bigint, keep_row bigint")
    (again.repartition(4, "digest").sortWithinPartitions("digest").write.format("parquet").bucketBy(4, "digest").sortBy("digest")
     .mode("append").option("path", index.path).saveAsTable(index.name))
    assert index.table().count() == 4
    got = exact_dedup.dedup(spark, docs, index).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(5, 5, False), (6, 6, False)]


def test_ngram_classes_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    base = [r for r in docs.where("doc_id < 40").collect() if len(r.text.split()) > 60]
    rng, extra = np.random.default_rng(3), []
    for k, r in enumerate(base[:12]):  # groups of near copies around the threshold
        for j in range(25):
            w = r.text.split()
            for p in rng.integers(0, len(w), 1 + j % 5):
                w[p] = f"swap{j}x{p}"
            extra.append((100000 + 100 * k + j, " ".join(w)))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    path = scratch_path(spark, "ngram-test")
    both.write.parquet(path)
    both = spark.read.parquet(path)
    hashes = ngram_join._Hashes()
    sets = {r.doc_id: set(ngram_join.shingles(r.text, hashes).tolist()) for r in both.collect()}
    have = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            have[x].append(d)
    shared = Counter(p for ds in have.values() for p in itertools.combinations(sorted(ds), 2))
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = find(a), find(b)
            comp[max(ra, rb)] = min(ra, rb)
    got = {r.doc_id: r.class_id for r in ngram_join.classes(spark, both).collect()}
    assert got == {d: find(d) for d in sets}
    assert ngram_join.link(spark, both)[1] >= ngram_join.TARGET


def _links_by_brute_force(rows):
    """(linked ids per id, class of each id) of (id, text) with all shingle sets distinct."""
    hashes = ngram_join._Hashes()
    sets = {d: set(ngram_join.shingles(t, hashes).tolist()) for d, t in rows}
    assert len({frozenset(s) for s in sets.values()}) == len(sets)
    near = {d: set() for d in sets}
    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            near[a].add(b), near[b].add(a)
    comp = {}
    for d in sorted(sets):
        todo = [] if d in comp else [d]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = d
                todo.extend(near[x])
    return near, comp


@pytest.mark.parametrize("block", [512, 16])
def test_ngram_links_of_template_families(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng, rows = np.random.default_rng(7), []

    def edited(words, n, tag):
        out = list(words)
        for p in rng.choice(len(words) // 6, n, False) * 6 + 3:
            out[p] = f"{tag}x{p}"
        return out
    for f in range(3):  # 60 texts at about 0.7 to each other, and to some a copy at about 0.85
        base = [f"f{f}w{i}" for i in range(300)]
        for i in range(60):
            one = edited(base, 5, f"f{f}t{i}")
            rows.append((1000 * f + i, " ".join(one)))
            if i % 6 == 0:
                rows.append((1000 * f + 500 + i, " ".join(edited(one, 4 + i % 2, f"f{f}p{i}"))))
    base = [f"near{i}" for i in range(200)]  # a group of near copies that are all alike
    rows += [(9000 + i, " ".join(edited(base, 1, f"n{i}"))) for i in range(80)]
    rows += [(9900 + i, " ".join(f"s{i % 3}w{j}" for j in range(4 + i))) for i in range(12)]  # short texts
    near, comp = _links_by_brute_force(rows)
    assert sum(map(bool, near.values())) >= 80 + 2 * 30
    path = scratch_path(spark, "families-test")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = ngram_join.classes(spark, spark.read.parquet(path)).collect()
    assert {r.doc_id: r.class_id for r in got} == comp
    assert {r.doc_id: r.n_links for r in got} == {d: len(x) for d, x in near.items()}


def _near_texts(rng, groups=16, size=12):
    out = []
    for g in range(groups):
        base = [f"g{g}w{x}" for x in range(int(rng.integers(40, 250)))]
        for j in range(size):
            w = list(base)
            for p in rng.integers(0, len(w), j % 6 * len(w) // 120):
                w[p] = f"s{j}x{p}"
            out.append(" ".join(w))
    return out


def test_forest_meets_every_pair_once_and_reaches_its_recall():
    """No pair of a bucket is new twice, at any depth; what meets is what the model says."""
    hashes = ngram_join._Hashes()
    sets = [ngram_join.shingles(t, hashes) for t in _near_texts(np.random.default_rng(3))]
    sigs = np.stack([ngram_join.signature(s) for s in sets])
    met = np.zeros((len(sets), len(sets)), int)
    sims = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
    links = np.triu(sims >= 0.8, 1)
    for depth in range(ngram_join.DEPTH, 2, -1):
        keys = ngram_join.paths(sigs, depth)
        for t in range(ngram_join.TREES):
            for k in np.unique(keys[:, t]):
                m = np.flatnonzero(keys[:, t] == k)
                met[np.ix_(m, m)] += np.triu(ngram_join.new_pairs(sigs[m], sigs[m], t, depth), 1)
        assert met.max() == 1
        found = links & (met > 0)
        assert found.sum() >= 0.995 * links.sum()
        middle = (sims > 0.3) & (sims < 0.7)
        want = ngram_join.meets(sims[np.triu(middle, 1)], depth).mean()
        assert abs((met[np.triu(middle, 1)] > 0).mean() - want) < 0.06
    assert (links & (met == 0)).sum() == 0


def test_paths_are_shortened_until_the_target(spark, monkeypatch):
    """With few trees the first depth misses links; the join goes on to shorter paths."""
    depths, round_ = [], ngram_join._round
    monkeypatch.setattr(ngram_join, "_round", lambda s, r, n, depth, t: depths.append(depth) or round_(s, r, n, depth, t))
    path = scratch_path(spark, "forest-test")
    spark.createDataFrame(list(enumerate(_near_texts(np.random.default_rng(5)))), "doc_id bigint, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    _, recall = ngram_join.link(spark, docs, target=0.5)
    assert depths == [ngram_join.DEPTH] and recall >= 0.5
    members, recall = ngram_join.link(spark, docs, target=1 - 1e-9)
    assert depths[1:4] == [6, 5, 4] and recall >= 1 - 1e-9 or depths[-1] == 1
    assert members.where("n_links > 0").count() > 100


def test_ngram_join_stores_no_more_than_it_still_reads(spark, monkeypatch):
    """Tables of signatures are deleted once read; texts are packed before they are shuffled."""
    stored, packed, store, task = defaultdict(list), [], ngram_join.materialize, ngram_join._texts_task

    def spy(s, df, name):
        out = store(s, df, name)
        stored[name].append(out.scratch)
        return out
    monkeypatch.setattr(ngram_join, "materialize", spy)
    path = scratch_path(spark, "stored-test")
    texts = _near_texts(np.random.default_rng(9), 8)
    spark.createDataFrame([*enumerate(texts), (900, None), (901, texts[0]), (None, " ")], "doc_id bigint, text string").write.parquet(path)
    members, _ = ngram_join.link(spark, spark.read.parquet(path))
    for name in ("labels", "nodes", "buckets", "active"):
        assert stored[name] and not any(map(os.path.exists, stored[name])), name
    assert members.count() == len(texts) + 3 and members.where("n_links > 0").count() > 40
    shared = type("Shared", (), {"value": b"\xff" * (common.FILTER_BITS // 8)})
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array([texts[0] * 3, None, "é"])], ["row", "text"])
    for b in task(shared)(iter([rows])):
        packed.extend(b.column(1).to_pylist())
    assert [x and zlib.decompress(x).decode() for x in packed] == [texts[0] * 3, None, "é"]
    assert 2 * len(packed[0]) < len(texts[0] * 3)


WORDS = st.lists(st.binary(min_size=1, max_size=6), max_size=60)


@given(WORDS, WORDS)
@settings(max_examples=60, deadline=None)
def test_lexicon_accepts_exactly_its_words(tmp_path_factory, words, others):
    table = {w: [i, i * 7] for i, w in enumerate(words)}
    path = str(tmp_path_factory.mktemp("lex") / "l.bin")
    arrays = bpe.compile_lexicon(table)
    common.save_arrays(arrays, path)
    probe = words + others
    got = bpe.Lexicon(path).find(probe) if probe else []
    for w, ids in zip(probe, got, strict=True):
        assert ids == (np.array(table[w], "<u4").tobytes() if w in table else None)


def test_lexicon_shares_suffixes():
    arrays = bpe.compile_lexicon({w: [1] for w in (b"walking", b"talking", b"baking", b"making")})
    assert len(arrays["final"]) == 9  # one tail "ing", "king" shared; no state twice


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_library(text):
    enc, tok = _bpe()
    ids = next(enc.encode([text])).tolist()
    assert ids == tok.encode(text, add_special_tokens=False).ids
    assert enc.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_bpe_digests_write_new_chunks_at_once(monkeypatch):
    """Digests equal the library's, whatever the cache holds, and new chunks are written out once a block."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    mark = next(iter(tok.get_added_tokens_decoder().values())).content
    texts = [None, "", "  \n\n ", "a b a", f"x{mark}{mark} y{mark}", "naïve café, don't\t\x85 \u3000z", "\x00\xff\U0001f600"]
    texts += [f"word{i} {i * 7919} ,;{i}" for i in range(1500)]
    want = []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))))
    blocks, write = [], bpe.Encoder._write
    monkeypatch.setattr(bpe.Encoder, "_write", lambda self, chunks: blocks.append(len(chunks)) or write(self, chunks))
    for most in (300_000, 700):
        monkeypatch.setattr(bpe, "CACHE_CHUNKS", most)
        enc = bpe.Encoder(bpe.vocabulary_path())
        list(enc.encode(texts[:700]))  # chunks that are known, but not yet written out
        assert not blocks
        assert list(enc.digests(texts)) == want and list(enc.digests(texts[:5])) == want[:5]
        assert 4 <= len(blocks) <= 5 and max(blocks) > 1000
        blocks.clear()


def test_bpe_works_once_per_distinct_chunk_and_piece(monkeypatch):
    """Blocks look up each distinct chunk, not each chunk; a piece is merged once, whatever chunks it is in."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    mark = next(iter(tok.get_added_tokens_decoder().values())).content
    looked, merged = [], []

    class Seen(dict):
        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

        def get(self, k, other=None):
            looked.append(k)
            return super().get(k, other)
    enc = bpe.Encoder(bpe.vocabulary_path())
    for k, v in list(vars(enc).items()):
        if isinstance(v, dict):
            setattr(enc, k, Seen(v))
    many = enc.vocab.merge_many
    monkeypatch.setattr(enc.vocab, "merge_many", lambda pieces: merged.extend(pieces) or many(pieces))
    texts = ["some words, in one\n\n  line " * 100] * 500 + ["words in some line, one"] * 500
    texts += [f"{mark} déjà\u00a0vu{mark}{mark}\u3000 \t\x1c x\u2028y ", " ", None, "", "été\x85"]
    got = list(enc.digests(texts))
    for t, (n, a, b) in zip(texts, got, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert b == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(looked) < 500 and len(merged) == len(set(merged))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 2_000)
    assert list(enc.digests(texts)) == got


def test_merge_table_ranks_every_pair():
    table = bpe.MergeTable(bpe.vocabulary_path())
    a, b = np.array(list(table.pairs), np.int32).T
    assert table._rank(a, b).tolist() == [r for r, _ in table.pairs.values()]
    odd = np.random.default_rng(5).integers(-1, 50_257, (2, 20_000), np.int32)
    want = [table.pairs.get(p, (2**31 - 1,))[0] for p in zip(*odd.tolist(), strict=True)]
    assert table._rank(*odd).tolist() == want


_CACHE = {}


def _bpe():
    if not _CACHE:
        from tokenizers import Tokenizer
        _CACHE["x"] = bpe.Encoder(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())
    return _CACHE["x"]


def test_long_pieces_merge_alike():
    enc, tok = _bpe()
    for piece in ("abracadabra" * 40, "a" * 997, "thethethe" * 200):
        assert next(enc.encode([piece])).tolist() == tok.encode(piece, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 9000), max_size=60), st.sampled_from([64, 4096]), st.integers(1, 40))
@settings(max_examples=80, deadline=None)
def test_packer_places_every_id_once(lengths, capacity, classes):
    packer, rows = packing.HarmonicPacker(0, capacity, classes), []
    for d, n in enumerate(lengths):
        rows.extend(packer.add(d, np.arange(n)))
    rows.extend(packer.finish())
    seen, seqs = defaultdict(list), defaultdict(list)
    for doc, start, ids, n, seq, offset in rows:
        assert n == lengths[doc] and len(ids) and ids[0] == start
        seen[doc].extend(ids.tolist())
        seqs[seq].append((offset, len(ids)))
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(lengths))
    for parts in seqs.values():
        total = 0
        for offset, n in sorted(parts):
            assert offset == total
            total += n
        assert total <= capacity and total & (total - 1) == 0  # full, or a power of two


@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000 \n\tɄƦİſ'ſ\u0301")), max_size=40),
                min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_word_ids_equal_the_library_for_any_text(texts):
    if "p" not in _CACHE:
        import public_tokenizers
        _CACHE["p"] = packing.WordIds(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = _CACHE["p"]
    assert [a.tolist() for a in ids(texts)] == [ids.tok.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.lists(st.sampled_from(["'", "'s", "'T", "'rE", "'LL", "'v", "l", "-", "<", "|", "<|", "<|endoftext|>", "a", "Zé", "É", "×", "÷", "İ", "ɏ", "ɐ", "語",
                                          "7", "٣", "\u0301", "\x00", "\x1c", "\x7f", " ", "\n", "\x85", "\xa0", "\u1680", "\u2009", "\u200b", "\u3000", "\u3001", "\U0001f600"]),
                         max_size=30).map("".join) | st.none(), max_size=12), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_word_ids_equal_the_library_in_blocks(texts, size):
    import public_tokenizers
    if "p" not in _CACHE:
        _CACHE["p"] = packing.WordIds(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = _CACHE["p"]
    want = [ids.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "BLOCK_BYTES", size)
        m.setattr(packing, "CACHE_BYTES", 20 * size)
        column = pa.array(["x", *texts], pa.string())[1:]
        assert [a.tolist() for a in ids(texts)] == [a.tolist() for a in ids(column)] == want


def test_word_ids_remember_a_bounded_number_of_bytes():
    """Growing vocabularies leave a worker small, and a piece is looked up once a block."""
    import tracemalloc

    import public_tokenizers
    ids = packing.WordIds(str(public_tokenizers.path("word_bpe_49k.json")))
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rng = np.random.default_rng(5)
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    try:
        for _ in range(10):
            words = ["".join(w) for w in letters[rng.integers(0, 26, (20_000, 9))]]
            for _ in ids([" ".join(words[i:i + 200]) for i in range(0, len(words), 200)]):
                pass
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 32e6


def test_packing_ids_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = defaultdict(list)
    for r in packing.pack(spark, docs, with_ids=True).collect():
        got[r.doc_id].append((r.start, r.ids, r.ids_crc32))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for d, t in texts.items():
        assert [x for _, ids, _ in sorted(got[d]) for x in ids] == tok.encode(t, add_special_tokens=False).ids + [2]


def _brute_tree(texts):
    """Context trees by plain recursion: (context bytes, node) -> mixed estimate."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        raw = b"\xff" * ctw.DEPTH + t.lower().encode() + b"\xff"
        for i in range(ctw.DEPTH, len(raw)):
            for d in range(ctw.DEPTH + 1):
                node = 1
                for k in range(7, -1, -1):
                    bit = raw[i] >> k & 1
                    counts[raw[i - d:i], node][bit] += 1
                    node = node * 2 + bit
    kids = defaultdict(list)
    for c, n in counts:
        if c:
            kids[c[1:], n].append((c, n))
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight, q = {}, {}

    def pw(s):
        pe = kt(*counts[s])
        if len(s[0]) == ctw.DEPTH:
            weight[s] = 1.0
            return pe
        below = sum(map(pw, kids[s]))
        both = np.logaddexp(pe, below) - math.log(2)
        weight[s] = math.exp(pe - math.log(2) - both)
        return both

    def down(s, acc, rest):
        p = (counts[s][1] + 0.5) / (sum(counts[s]) + 1)
        q[s] = acc + rest * p
        for c in kids[s]:
            down(c, acc + rest * weight[s] * p, rest * (1 - weight[s]))
    for s in [s for s in counts if not s[0]]:
        pw(s)
        down(s, 0.0, 1.0)
    return q


def test_ctw_against_brute_force(spark):
    texts = ["the cat sat on the mat", "The dog sat on the cat", "", "aaaaaaaabaaaa", "é è é"]
    q = _brute_tree(texts)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts + ["the dog on zebra", None])], "row bigint, doc_id bigint, text string")
    found = ctw.scores(spark, docs, F.col("row") < 5).collect()
    got = {r.row: r.score for r in found}
    assert all(r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len((docs_text[r.row] or "").encode()) + 1)) for docs_text in [dict(docs.select("row", "text").collect())] for r in found)

    def brute(t):
        raw, total = b"\xff" * ctw.DEPTH + t.lower().encode() + b"\xff", 0.0
        for i in range(ctw.DEPTH, len(raw)):
            node = 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                p = next((q[raw[i - d:i], node] for d in range(ctw.DEPTH, -1, -1) if (raw[i - d:i], node) in q), 0.5)
                total += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        return total
    for r in docs.collect():
        assert got[r.row] == pytest.approx(brute(r.text or ""), rel=1e-9)


def test_a_decision_against_many_is_not_impossible(spark):
    """'b' where 'a' stood 2^40 times in the context; a and b differ in the last two bits."""
    n, aaaaaa = 1 << 40, int.from_bytes(b"aaaaaa")
    grams = spark.createDataFrame([(aaaaaa, n, n), (aaaaaa ^ 3, 0, 1), (aaaaaa ^ 1, 0, 1)], "gram bigint, n bigint, m bigint")  # ...a, ...b, ...`
    got = {r.gram: r.value for r in ctw.gram_values(spark, grams).collect()}
    miss = math.log10(0.5 / (n + 1))  # every context says the same, whatever their weights
    assert got[aaaaaa ^ 1] == pytest.approx(miss, rel=1e-6)
    assert got[aaaaaa ^ 3] == pytest.approx(miss + math.log10(0.5), rel=1e-6)  # beyond the first miss the node is unknown
    assert np.isfinite(list(got.values())).all() and -1e-10 < got[aaaaaa] <= 0


def test_values_do_not_depend_on_chunks_or_on_what_tasks_hold(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("row"), "text")
    one = {r.row: r.score for r in ctw.scores(spark, docs, F.col("row") % 10 > 0).collect()}
    monkeypatch.setattr(ctw, "_PIECE", 700)  # texts span many parts
    monkeypatch.setattr(ctw, "FREQUENT_GRAMS", 1000)  # most grams are joined by a shuffle
    two = {r.row: r.score for r in ctw.scores(spark, docs, F.col("row") % 10 > 0).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-10) for k in one)


def test_byte_probabilities_sum_to_one(spark):
    """After any context, known or not, the 256 bytes share the probability 1."""
    text = b"the cat sat on the mat. the dog sat on the cat."
    seen = Counter(int.from_bytes((b"\xff" * 5 + text)[i - 5:i + 1]) for i in range(5, 5 + len(text)))
    contexts = [b"n the", b"q the", b"zzzzz", b"\xff\xff\xff\xff\xff"]
    rows = {int.from_bytes(c + bytes([b])): 0 for c in contexts for b in range(256)} | seen
    grams = spark.createDataFrame([(g, n, 1) for g, n in rows.items()], "gram bigint, n bigint, m bigint")
    got = {r.gram: r.value for r in ctw.gram_values(spark, grams).collect()}
    for c in contexts:
        assert sum(10 ** got[int.from_bytes(c + bytes([b]))] for b in range(256)) == pytest.approx(1, abs=1e-12)


def test_unigram_base_scores(spark):
    texts = ["The cat, the CAT", "dog", None, "Ünder the É"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    got = {r.row: r for r in ctw.scores(spark, docs, F.col("row") < 2).collect()}
    low = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in (t or "").split()] + [None]
    c = Counter(w for t in texts[:2] for w in low(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in low(t))
        assert got[i].base_score == pytest.approx(want) and got[i].n_tokens == len(low(t)) and got[i].train_tokens == n
        assert got[i].n_known == sum(w in c for w in low(t))


def test_frequent_and_rare_tokens_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("row"), "text")
    one = {r.row: (r.base_score, r.n_known) for r in ctw.scores(spark, docs, F.col("row") % 10 > 0).collect()}
    monkeypatch.setattr(ctw, "FREQUENT", 50)
    two = {r.row: (r.base_score, r.n_known) for r in ctw.scores(spark, docs, F.col("row") % 10 > 0).collect()}
    assert one.keys() == two.keys() and all(one[k][0] == pytest.approx(two[k][0]) and one[k][1] == two[k][1] for k in one)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    model = {"start": rng.normal(size=6), "step": rng.normal(size=(6, 6)), "emit": rng.normal(size=(6, chat.N_SYMBOLS))}
    obs = rng.integers(0, chat.N_SYMBOLS, 5)

    def value(p):
        return (model["start"][p[0]] + model["emit"][p[0], obs[0]]
                + sum(model["step"][a, b] + model["emit"][b, o] for a, b, o in zip(p, p[1:], obs[1:], strict=False)))
    assert chat.viterbi(obs, model).tolist() == list(max(itertools.product(range(6), repeat=5), key=value))


def _long_conversations():
    rng, rows = np.random.default_rng(8), []
    for conv, turns in ((1, 1300), (2, 3), (None, 40), (3, 70)):
        for t in range(turns):
            role = chat.ROLES[0] if t == 0 else chat.ROLES[1 + t % 2]
            lines = [" ".join(["w"] * int(rng.integers(1, 60))) + ("?" if rng.random() < .3 else "") for _ in range(int(rng.integers(1, 5)))]
            if conv == 3 and t == 5:
                lines = ["a line of one turn"] * 900  # a turn of many windows
            if rng.random() < .2:
                lines.insert(1, "")
            rows.append((conv, t, role, "\n".join(lines)))
    return rows


def test_windows_give_the_whole_conversations_viterbi(spark, monkeypatch):
    """States, turns and line numbers of windows of 7 lines and parts of 512 turns equal those of plain Viterbi."""
    path = scratch_path(spark, "chat-test")
    spark.createDataFrame(_long_conversations(), "conv_id bigint, turn int, role string, text string").repartition(5).write.parquet(path)
    raw = chat.write_transcripts(spark.read.parquet(path))
    whole = {}
    for window in (1 << 40, 7):
        monkeypatch.setattr(chat, "WINDOW", window)
        observed = common.materialize(spark, chat.observe(raw), "chat-test")
        model = chat.train(chat.with_first(observed))
        rows = sorted((r.conv, r["at"], r.obs, r.line) for r in observed.collect())
        got = {(r.conv, r["at"]): (r.state, r.above) for r in chat.recover(spark, observed, model).collect()}
        want = {}
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            group = list(group)
            assert [g[1] for g in group] == list(range(1, len(group) + 1))
            states = chat.viterbi(np.array([g[2] for g in group]), model).tolist()
            want.update({(conv, i + 1): (s, states[i - 1] if i else None) for i, s in enumerate(states)})
        assert got == want
        turns = sorted((r.conv_id is None, r.conv_id or 0, r.first_line, r.role, r.text) for r in chat.turns_of(spark, chat.recover(spark, observed, model)).collect())
        whole[window] = rows, {k: v.tolist() for k, v in model.items()}, turns
    one, two = whole.values()
    assert one[0] == two[0] and one[2] == two[2]
    assert all(np.allclose(one[1][k], two[1][k]) for k in one[1])


def test_chat_recovers_held_out_roles(spark):
    pdf = catalog.QUERIES["op10_chat"](spark, SF_MID).toPandas()
    held = pdf[pdf.held_out]
    assert len(held) and (held.role == held.true_role).mean() > 0.95


@pytest.mark.parametrize("name,label,least", [("op6_toxicity", "toxic", 0.9), ("op7_quality_classifier", "quality", 0.9)])
def test_classifiers_on_held_out_labels(spark, name, label, least):
    scored = catalog.QUERIES[name](spark, SF_MID).where("held_out")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", label)
    rows = scored.join(labels, "doc_id").toPandas()
    assert (rows.predicted == rows[label]).mean() >= least


def test_scores_do_not_see_ids_or_labels(spark):
    a = catalog.QUERIES["op7_quality_classifier"](spark, SF_SMALL)
    assert set(a.columns) == {"doc_id", "held_out", "score", "predicted"}
