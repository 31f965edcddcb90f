import random

import pytest
from pyspark.sql import functions as F

from chromloom.llm import mixing, queries, registry, urls
from tests.oracle import assert_equal


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert_equal(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 1, "c": 1}, {f"s{i}": 1 + i * i % 7 for i in range(20)}, {"a": 97, "b": 2, "c": 1}])
def test_every_block_keeps_its_window_and_lag_stays_below_one(weights):
    plan = mixing.edf_period(weights)
    q, seen = sum(weights.values()), dict.fromkeys(weights, 0)
    assert sorted(t for *_, t in plan) == list(range(q))
    for s, _, k, release, deadline, t in sorted(plan, key=lambda x: x[-1]):
        assert k == seen[s] and release <= t < deadline
        seen[s] += 1
        assert all(abs(n - (t + 1) * weights[x] / q) < 1 for x, n in seen.items())


def test_blocks_equal_a_plain_loop(spark):
    import hashlib

    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "b", None]), "x" * r.randrange(0, 400)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x["doc_id"]: (x["__start"], x["__slot"]) for x in mixing.mix_sources(docs, {"a": 3, "b": 2}, block_chars=500, chunk_rows=10).collect()}
    period = {(s, k): t for s, _, k, _, _, t in mixing.edf_period({"a": 3, "b": 2, "": 1})}
    weight = {"a": 3, "b": 2, "": 1}
    for s in weight:
        start = 0
        for i, _, text in sorted((x for x in rows if (x[1] or "") == s), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
            block = start // 500
            assert got[i] == (start, block // weight[s] * 6 + period[s, block % weight[s]])
            start += max(1, len(text))


def test_mixture_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, None, None, "z"), (1, None, None, "z"), (None, "a", "t", None)], "doc_id long, source string, text string, slot string")
    assert mixing.mixture(docs, {"a": 2}).exceptAll(docs).count() == 0 and mixing.mixture(docs, {}).count() == 3
    assert mixing.mixture(docs.limit(0), {"a": 2}).columns == docs.columns


def plain_spread(pages, rounds=8, damping=0.85):
    hosts = {h for h, _, ls in pages for h in (h, *ls)} - {None}
    n = {}
    for h, _, ls in pages:
        for d in set(ls):
            if d != h:
                n[h, d] = n.get((h, d), 0) + 1
    out = {h: sum(c for (a, _), c in n.items() if a == h) for h in hosts}
    into = {h: sum(c for (_, b), c in n.items() if b == h) for h in hosts}
    share = lambda v: {h: (sum(x == v for g, x, _ in pages if g == h) / max(1, sum(g == h for g, _, _ in pages))) for h in hosts}
    t0, d0 = ({h: (1 - damping) * x for h, x in share(v).items()} for v in ("allow", "block"))
    along = lambda x: {h: damping * sum(c / out[a] * x[a] for (a, b), c in n.items() if b == h) for h in hosts}
    against = lambda x: {h: damping * sum(c / into[b] * x[b] for (a, b), c in n.items() if a == h) for h in hosts}
    ruled = {g for g, x, _ in pages if x}
    shares = []
    for seed, passed in ((t0, along), (d0, against)):
        x, full = dict(seed), dict.fromkeys(hosts, 1 - damping)
        for _ in range(rounds):
            gain, gain_full = passed(x), passed(full)
            x, full = {h: seed[h] + gain[h] for h in hosts}, {h: 1 - damping + gain_full[h] for h in hosts}
        whole = {h: (1 - damping) * (h in ruled) + gain_full[h] for h in hosts}
        shares.append((x, {h: x[h] / whole[h] if whole[h] else 0.0 for h in hosts}))
    return shares


def test_trust_and_distrust_equal_a_plain_loop(spark):
    r = random.Random(4)
    hosts = [f"h{i}.example.{r.choice(['com', 'org', 'net'])}" for i in range(15)]
    rows, plain = [], []
    for i in range(120):
        h, path = r.choice(hosts), r.choice(["/en/1", "/de/2", "/fr/3"])
        links = r.sample(hosts, r.randrange(0, 4))
        rows.append((i, f"https://{h.upper()}{path}?q", "".join(f'<a href="http://{x}/p">' for x in links) + '<a href="/local">'))
        verdict = "allow" if "net" in h and path[:4] == "/en/" and h.endswith("example.net") or h.endswith("org") and path[:4] == "/fr/" else "block" if h.endswith("net") or h.endswith("example.com") and path[:4] == "/de/" else None
        plain.append((h, verdict, links))
    got = {x["page_id"]: x for x in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    (t, ts), (d, ds) = plain_spread(plain)
    for (i, _, _), (h, verdict, _) in zip(rows, plain, strict=True):
        assert got[i]["host"] == h and got[i]["trust"] == pytest.approx(t[h]) and got[i]["distrust"] == pytest.approx(d[h])
        assert got[i]["trust_share"] == pytest.approx(ts[h]) and got[i]["distrust_share"] == pytest.approx(ds[h])
        assert got[i]["verdict"] == (verdict or ("block" if ds[h] >= 0.5 and ds[h] > ts[h] else "allow"))


def test_odd_urls(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.NET", "x"), (4, "x://y://z.net/a", None), (5, "ftp://net/?a/b", "y"), (5, "ftp://net/?a/b", "y")]
    got = urls.judge_urls(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string"), queries.URL_RULES)
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"]) for r in got.collect())
    assert [f[:3] for f in found] == [(1, "", ""), (2, "", ""), (3, "a.net", ""), (4, "y:", "//z.net/a"), (5, "net", "/"), (5, "net", "/")]
    assert [f[3] for f in found] == [None, None, None, None, "net/", "net/"]
    assert urls.judge_urls(got.select("page_id", "url", F_lit_html()).limit(0), queries.URL_RULES).count() == 0


def F_lit_html():
    from pyspark.sql import functions as F

    return F.lit("").alias("html")


def test_links_judge_hosts_whatever_the_number_that_links_to_them(spark):
    """A farm of hosts that link to a blocked host alone is blocked; a portal to many, the blocked one among them, is not, nor are hosts two steps off."""
    rows = [("https://bad.net/", ""), ("https://portal.info/", "".join(f'<a href="//clean{i}.info/">' for i in range(30)) + '<a href="//bad.net/">')]
    rows += [(f"https://farm{i}.info/x", '<a href="https://bad.net/">') for i in range(60)]
    rows += [(f"https://feeder{i}.info/", f'<a href="https://farm{i}.info/">') for i in range(5)]
    rows += [(f"https://clean{i}.info/", '<a href="https://portal.info/">') for i in range(30)]
    rows += [("https://mixed.info/", '<a href="https://bad.net/"><a href="https://good.org/fr/">'), ("https://good.org/fr/a", '<a href="https://mixed.info/">')]
    rows += [("https://example.com/de/a", "")] + [(f"https://example.com/en/{i}", "") for i in range(9)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {x["url"]: x["verdict"] for x in urls.judge_urls(pages, queries.URL_RULES).collect()}
    for url, _ in rows:
        blocked = url in ("https://bad.net/", "https://example.com/de/a") or "//farm" in url
        assert got[url] == ("block" if blocked else "allow"), url


def test_rule_tables_equal_the_expression_and_a_plain_loop(spark):
    r = random.Random(9)
    hosts = [".".join(r.choices(["a", "b", "net", "com", ""], k=r.randrange(1, 5))) for _ in range(60)] + ["", "com."]
    paths = ["", "/", "/x", "/x/", "/x/y", "/é/x", "/y?"]
    rules = sorted({(r.choice(["allow", "block"]), r.choice(hosts) + r.choice(paths)) for _ in range(150)}) + [("allow", "net"), ("block", "net")]
    pages = [(i, r.choice(hosts), r.choice(paths) + r.choice(["", "z", "/x"]), f"own {i}") for i in range(500)]
    df = spark.createDataFrame(pages, "page_id long, host string, path string, rule_host string")

    def longest(host, path):
        fit = [(len(t), t, v) for v, t in rules for h, s, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        return max(fit)[1:] if fit else (None, None)

    table = spark.createDataFrame([*rules, ("block", None)], "verdict string, rule string")
    for got in (urls.with_rule(df, rules), urls.with_rule(df, table)):
        assert got.columns == [*df.columns, "rule", "ruled"]
        assert {x["page_id"]: (x["rule"], x["ruled"]) for x in got.collect()} == {i: longest(h, p) for i, h, p, _ in pages} and got.count() == 500
    assert len({longest(h, p) for _, h, p, _ in pages}) > 40


def test_a_million_rules(spark):
    rules = spark.range(1_000_000).selectExpr("if(id % 2 = 0, 'block', 'allow') as verdict", "concat('h', id div 10, '.com/p', id % 10) as rule")
    pages = spark.range(20_000).selectExpr("id as page_id", "concat('https://www.h', id * 5, '.com/p', id % 10, '/q') as url", "cast(null as string) as html")
    got = {x["verdict"]: x["n"] for x in urls.judge_urls(pages, rules).groupBy("verdict").agg(F.count("rule").alias("n")).collect()}
    assert got == {"allow": 10_000, "block": 10_000}
