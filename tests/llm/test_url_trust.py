"""Rules by hand, and ranks against power iteration in numpy."""

import numpy as np

from pyspark.sql import functions as F

from scorekit.llm.url_trust import RULES, host_edges, judge_urls, match_rules, propagate
from scorekit.staging import new_path, path_exists


def test_rules_and_parts_of_urls(spark):
    urls = [
        "http://a.com/x?q#f", "HTTPS://WWW.Example.COM/en/1", "http://example.com/en/", "http://x.example.com/en/a", "http://y.www.example.com/en/",
        "http://n.net/es/1", "http://n.net/de/1", "http://notcom", "http://com/", "http://com", "mailto:x", None, "", "http:///p", "a://b://c.com/d",
        "http://h.org?x=/net/es/", "http://net/fr/", "http://n.net/ES/", "http://xcom/",
    ]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/", "example.com/en/", "block") and got[3][2:] == ("example.com/en/", "block")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5][2:] == ("net/es/", "block")
    assert got[6][:3] == ("n.net", "/de/1", None) and got[7][:3] == ("notcom", "", None)
    assert got[8] == ("com", "/", "com/", "allow") and got[9][:3] == ("com", "", None)
    assert all(got[i] == ("", "", None, "allow") for i in (10, 11, 12)) and got[13][:3] == ("", "/p", None)
    assert got[14][:2] == ("b:", "//c.com/d") and got[15][:3] == ("h.org", "", None) and got[16][2] == "net/fr/"
    assert got[17][2] is None and got[18][2] is None and len(got) == len(urls)


def test_rules_as_a_table(spark):
    rng = np.random.default_rng(6)
    labels, ends = ["a", "b", "com", "net", ""], ["", "/", "/e", "/en/", "/en/x", "/😀/"]
    host = lambda most: ".".join(rng.choice(labels, rng.integers(1, most + 1)))
    rules = {(host(3), str(rng.choice(ends)), str(rng.choice(["allow", "block"]))) for _ in range(120)} | set(RULES)
    rules = [r for r in rules if r[0]]
    places = [(i, host(5), str(rng.choice(ends)) + str(rng.choice(ends))) for i in range(600)]
    places += [(600, "x." * 20_000 + "com", "/" + "y" * 200_000), (601, "", ""), (601, "", "")]

    def best(h, p):
        fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        top = max(fits, key=lambda r: (len(r[0]) + len(r[1]), *r), default=None)
        return (top[0] + top[1], top[2]) if top else (None, None)

    table = spark.createDataFrame([(*r, "x") for r in [*rules, *rules[:9], (None, "/", "block")]], "host string, path string, verdict string, rule string")
    got = match_rules(spark.createDataFrame(places, "page_id bigint, host string, path string"), table).collect()
    assert sorted(r.page_id for r in got) == sorted(p[0] for p in places)
    assert sum(r.rule is not None for r in got) > 300
    assert all((r.rule, r.ruled) == best(r.host, r.path) for r in got)


def test_both_forms_of_rules_agree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(
        spark.createDataFrame([(None, None, None)], "page_id bigint, url string, html string"), allowMissingColumns=True)
    table = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    want, got = judge_urls(pages), judge_urls(pages, table)
    want, got = ({r.page_id: r for r in df.collect()} for df in (want, got))
    assert len(got) == pages.count() and got.keys() == want.keys()
    for k, r in got.items():  # ranks are sums of doubles, in any order
        assert r[:5] == want[k][:5] and np.allclose(r[5:], want[k][5:], rtol=1e-9, atol=1e-15)
    none = judge_urls(pages, table.where(F.lit(False)))
    assert none.where("rule IS NOT NULL OR verdict = 'block'").isEmpty() and none.count() == pages.count()


def test_rounds_are_dropped(spark, monkeypatch):
    import scorekit.llm.common as common

    paths = []
    monkeypatch.setattr(common, "new_path", lambda s, n: paths.append(new_path(s, n)) or paths[-1])
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 1)], "src string, dst string, links bigint")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    assert propagate(edges, seeds, tolerance=1e-2).count() == 3
    assert len(paths) > 2 and [path_exists(spark, p) for p in paths] == [False] * (len(paths) - 1) + [True]


def test_edges(spark):
    html = ("<a href='http://B.org/x'>1</a><A class=k HREF=//c.org>2</A><a href=\"/own\">3</a><a href=http://a.org/z>4</a>"
            "<link href='http://no.org/'><a\nhref = \"https://b.org?q\">5</a>")
    pages = spark.createDataFrame([("http://a.org/1", html), ("http://a.org/2", html), ("http://z.org/", None), (None, html)], "url string, html string")
    assert sorted(map(tuple, host_edges(pages, "url", "html").collect())) == [("a.org", "b.org", 4), ("a.org", "c.org", 2)]


def test_ranks(spark):
    rng = np.random.default_rng(4)
    n, hub = 25, 0
    links = {}
    for _ in range(90):
        a, b = rng.integers(0, n, 2)
        links[int(a), int(b)] = links.get((int(a), int(b)), 0) + int(rng.integers(1, 4))
    links |= {(hub, k): 1 for k in range(1, n)}
    links = {k: v for k, v in links.items() if k[0] != k[1]}
    trust, distrust = np.zeros(n), np.zeros(n)
    trust[[1, 5]], distrust[[2, 7, 9]] = [3, 1], [1, 1, 2]

    def rank(pairs, seed):
        p = np.zeros((n, n))
        for (a, b), w in pairs.items():
            p[b, a] += w
        p /= np.maximum(p.sum(axis=0), 1)
        seed = seed / seed.sum()
        r = np.linalg.solve(np.eye(n) - 0.85 * p, seed)
        return r / r.sum()

    want = rank(links, trust), rank({(b, a): w for (a, b), w in links.items()}, distrust)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in links.items()], "src string, dst string, links bigint")
    seeds = spark.createDataFrame([(f"h{i}", float(trust[i]), float(distrust[i])) for i in range(n)], "host string, trust double, distrust double")
    for r in propagate(edges, seeds, rounds=200, tolerance=1e-9).collect():
        i = int(r.host[1:])
        assert abs(r.trust - want[0][i]) < 1e-6 and abs(r.distrust - want[1][i]) < 1e-6


def test_links_decide_where_rules_do_not(spark):
    pages = spark.createDataFrame([
        (1, "http://bad.net/es/1", ""), (2, "http://good.com/", "<a href=http://friend.org/>x</a>"), (3, "http://shady.org/", "<a href=http://bad.net/es/1>x</a>"),
        (4, "http://friend.org/", ""), (5, "http://alone.org/", ""), (5, "http://alone.org/", "")], "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in judge_urls(pages).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    assert judge_urls(pages).count() == 6


def test_no_pages(spark):
    assert judge_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_distrust_reaches_hosts_many_links_away(spark):
    hosts = [f"h{i}.org" for i in range(45)] + ["bad.net"]
    pages = [(i, f"http://{h}/", f"<a href=http://{hosts[i + 1]}/>x</a>" if i + 1 < len(hosts) else "") for i, h in enumerate(hosts)]
    pages[-1] = (45, "http://bad.net/es/1", "")
    got = judge_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert len(got) == 46 and all(r.verdict == "block" and r.distrust > 0 for r in got)
