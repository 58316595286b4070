"""URL rules and aliases, and quality strata, at size, against plain Python."""

import zlib

import numpy as np
import pytest

from plexnet.llm import quality_rules, url_filter
from plexnet.session import scratch_path


def stored(spark, rows, schema):
    path = scratch_path(spark, "rules-test")
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def best_rule(rules, host, path):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return min(fits, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow")) if fits else None


def test_a_large_rule_table_judges_like_a_list(spark):
    """100,000 rules as a table; the list that matters is also judged inline and by Python."""
    rng = np.random.default_rng(1)
    hosts = [f"{a}.{b}" for a in ("x", "yy", "www.x", "") for b in ("com", "org", "a.org")]
    hosts = [h.strip(".") for h in hosts]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", ""]
    rules = [(["allow", "block"][int(rng.integers(2))], hosts[int(rng.integers(len(hosts)))], paths[int(rng.integers(len(paths)))]) for _ in range(40)]
    urls = [f"http://{s}{h}{p}{t}" for s in ("", "s.", "x") for h in hosts for p in paths for t in ("", "/q?x", "#f")] + ["x", None, "http://", "://com/a"]
    pages = stored(spark, [(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    inline = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark, pages, rules).collect()}
    noise = [("block", f"h{i}.test", f"/p{i % 7}") for i in range(100_000)] + [(None, "com", "/"), ("block", None, "/"), ("block", "com", None)]
    table = spark.createDataFrame(rules + noise, "verdict string, host string, path string")
    joined = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark, pages, table).collect()}
    want = {}
    for r in url_filter.judge(spark, pages, []).collect():
        b = best_rule(rules, r.host, r.path)
        want[r.page_id] = (b[1] + b[2], b[0]) if b else (None, "allow")
    assert inline == want and joined == want
    assert url_filter.judge(spark, pages.limit(0), table).count() == 0


def test_aliases_against_union_find(spark):
    """Chains, a hub of 10,000 aliases, relative links, and allow before block."""
    rng = np.random.default_rng(2)
    canon = '<link rel="canonical" href="{}">'.format
    pages, edges = [], []

    def page(url, html=None):
        pages.append((len(pages), url, html))
    for i in range(60):  # a chain of relative links that ends in a blocked page
        page(f"http://chain.org/d{i}/x", canon(f"../d{i + 1}/x" if i % 2 else f"/d{i + 1}/x"))
    edges.append(("http://chain.org/d60/x", "http://end.net/es/1"))
    for i in range(10_000):  # a hub, blocked by one of its aliases
        edges.append((f"http://h{i}.org/", "http://hub.org/"))
        if i % 50 == 0:
            page(f"http://h{i}.org/")
    edges.append(("http://hub.org/", "http://bad.net/fr/x"))
    for i in range(300):  # random pairs; some reach an allowed page too
        a, b = rng.integers(0, 250, 2)
        edges.append((f"http://r{a}.org/", f"http://r{b}.org/"))
        page(f"http://r{a}.org/")
    edges += [(f"http://r{i}.org/", "http://z.net/es/") for i in range(0, 250, 40)] + [(f"http://r{i}.org/", "http://www.example.com/en/ok") for i in range(0, 250, 90)]
    page("http://hub.org/")
    page("http://z.net/es/")
    page("http://self.org/a", canon("http://self.org/a"))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    links = edges + [(f"http://chain.org/d{i}/x", f"http://chain.org/d{i}/../d{i + 1}/x" if i % 2 else f"http://chain.org/d{i + 1}/x") for i in range(60)]
    for a, b in links:
        parent[find(a)] = find(b)
    votes = {}
    for u in list(parent):
        host, path = u[7:].partition("/")[0], "/" + u[7:].partition("/")[2]
        b = best_rule(url_filter.RULES, host, path)
        votes.setdefault(find(u), set()).add(b and b[0])
    got = {r.page_id: r.verdict for r in url_filter.judge(
        spark, stored(spark, pages, "page_id bigint, url string, html string"), edges=spark.createDataFrame(edges, "from_url string, to_url string")).collect()}
    for i, u, _ in pages:
        host, path = u[7:].partition("/")[0], "/" + u[7:].partition("/")[2]
        own = best_rule(url_filter.RULES, host, path)
        v = votes.get(find(u), set())
        assert got[i] == (own[0] if own else "block" if "block" in v and "allow" not in v else "allow"), u
    assert sum(v == "block" for v in got.values()) > 200


@pytest.mark.parametrize("bound", [10_000, 3])
def test_every_language_stands_for_itself(spark, monkeypatch, bound):
    """150 languages: those with enough good labels certify, those without keep what the base keeps."""
    monkeypatch.setattr(quality_rules, "BROADCAST_STRATA", bound)
    value = {"n_symbols": "IF(id % 2 = 0, 0L, 200L)", "n_words": "100L", "n_lines": "100L", "word_chars": "100L"}
    m = "struct(" + ", ".join(f"{value.get(c, '0L')} AS {c}" for c in quality_rules.METRIC_COLUMNS) + ") AS _m"
    rows = spark.range(150 * 20 + 4000).selectExpr("id AS doc_id", "IF(id < 4000, 'big', concat('l', CAST(id % 150 AS STRING))) AS lang", m)
    labels = spark.range(7000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 1, 0) AS quality")
    chosen = quality_rules.fit_rules(spark, rows, labels)
    assert len(chosen["report"]) == 76  # half of the small ones have bad texts only, the others good ones only; only the former gain by a rule
    assert [s for s, r in chosen["rules"].items() if r] == ["big"]
    good = sum(zlib.crc32(str(i).encode()) % 2 for i in range(0, 4000, 2))
    assert chosen["report"]["big"] == {"good": good, "plan": [("symbols", 1.0)], "certified": 1}
    kept = {(r.lang, r.doc_id % 2): r._kept for r in quality_rules.with_verdict(rows, chosen).collect()}
    assert kept["big", 0] and not kept["big", 1] and all(v for (lang, _), v in kept.items() if lang != "big")
    new = spark.createDataFrame([(1, None), (2, "unseen")], "doc_id bigint, lang string").selectExpr("*", m.replace("id % 2", "doc_id % 2").replace("IF(id", "IF(doc_id"))
    assert quality_rules.with_verdict(new, chosen).where("_kept").count() == 2
