import numpy as np
import pytest
from helpers import store
from pyspark.sql import functions as F

from tidemark.llm import urls as U


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(d + p), d + p, v) for v, d, p in U.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://example.net", "http://example.net/", "https://EXAMPLE.net/en/x?q#f", "http://a.example.net/en/", "http://a.example.net/de/",
    "http://example.com/de/y", "http://example.org/fr/z", "http://x.org/FR/z", "ftp://net/", "http://b.com?x=/de/", "http://é.example.com/de/#/", "x://y://z/", "http://a.com/\nb",
]


def page_table(spark, urls, html=None):
    return spark.createDataFrame([(i, u, None if html is None else html[i]) for i, u in enumerate(urls)], "page_id long, url string, html string")


def test_rules(spark, tmp_path):
    sf = store(tmp_path, pages=page_table(spark, URLS))
    rows = {r.page_id: r for r in U.op4(spark, sf).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")
    assert rows[0].verdict == "allow"
    assert U.op4(spark, store(tmp_path / "none", pages=page_table(spark, []))).count() == 0


def test_all_pages(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = {r.page_id: r for r in U.op4(spark, sf_dir).collect()}
    assert set(rows) == set(urls)
    for i, u in urls.items():
        host, path, rule, verdict = brute(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert verdict in (None, rows[i].verdict)


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = page_table(
        spark,
        ["http://spam.net/", "http://feeder.com/", "http://good.org/fr/", "http://friend.com/", "http://lonely.com/"],
        [None, link("spam.net") * 3, link("friend.com"), None, ""],
    )
    verdict = {r.host: r.verdict for r in U.judge(pages).collect()}
    assert verdict == {"spam.net": "block", "feeder.com": "block", "good.org": "allow", "friend.com": "allow", "lonely.com": "allow"}


def test_walk_is_personalised_pagerank(spark):
    edges = [(0, 1, 2.0), (1, 2, 1.0), (2, 0, 1.0), (0, 2, 1.0), (3, 0, 1.0), (2, 4, 3.0)]
    df = spark.createDataFrame([("trust", str(a), str(b), w) for a, b, w in edges], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "0", 0.5), ("trust", "3", 0.5)], "kind string, host string, seed double")
    got = {int(r["host"]): r["rank"] for r in U.walk(df, seeds).collect()}
    m = np.zeros((5, 5))
    for a, b, w in edges:
        m[b, a] = w
    m /= np.maximum(m.sum(0), 1e-300)
    seed = np.array([0.5, 0, 0, 0.5, 0])
    x = seed.copy()
    for _ in range(200):  # what a host without links holds goes back to the seeds
        lost = x[m.sum(0) == 0].sum()
        x = U.DAMPING * (m @ x + lost * seed) + (1 - U.DAMPING) * seed
    assert [got.get(i, 0.0) for i in range(5)] == pytest.approx(x.tolist(), rel=2e-3)


def test_edges_are_summed_per_pair(spark):
    pages = spark.createDataFrame([("a.com", '<a href="//B.com/x"><img src=http://b.com><a href="/own"><a href="https://a.com/">')] * 3, "host string, html string")
    assert [tuple(r) for r in U.host_edges(pages).collect()] == [("a.com", "b.com", 6.0)]


def test_tenants_of_one_domain_are_strangers(spark):
    pages = page_table(spark, ["http://spam.example.com/de/", "http://other.example.com/", "http://example.com/"])
    assert {r.host: r.verdict for r in U.judge(pages).collect()} == {"spam.example.com": "block", "other.example.com": "allow", "example.com": "allow"}


def test_clashing_columns_hot_hosts_and_repeated_pages(spark):
    pages = page_table(spark, ["http://spam.net/"] * 50 + ["http://a.com/"] * 50 + [None] * 50, ["<a href=http://spam.net>"] * 150)
    pages = pages.withColumn("host", F.lit(1)).withColumn("h", F.lit("h")).withColumn("rest", F.lit(2)).withColumn("hot", F.lit(3)).withColumn("salt", F.lit(4))
    out = U.judge(pages)
    assert out.columns == ["page_id", "url", "html", "h", "rest", "hot", "salt", *U.RESULTS]
    rows = out.collect()
    assert sorted(r.page_id for r in rows) == list(range(150))
    assert {(r.host, r.verdict) for r in rows} == {("spam.net", "block"), ("a.com", "block"), ("", "allow")}


def test_distrust_reaches_hosts_far_away(spark):
    # h40 links to h39 and so on to a blocked host: every one of them is suspect.
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = page_table(spark, ["http://spam.net/", *(f"http://h{i}/" for i in range(1, 41))], [None, link("spam.net"), *(link(f"h{i}") for i in range(1, 40))])
    assert {r.verdict for r in U.judge(pages).collect()} == {"block"}
