"""URL rules and propagation against plain Python."""

from collections import defaultdict

from pyspark.sql import functions as F

from tablescope.llm import urls
from tablescope.llm.catalog import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.01"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    end = min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:end]


def rule_of(host, path):
    fits = [(len(h) + len(p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def ranks(edges, seeds, steps=400):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    now = dict(start)
    for _ in range(steps):
        after = defaultdict(float)
        for (a, b), w in edges.items():
            after[b] += urls.DAMPING * now.get(a, 0) * w / out[a]
        kept = sum(after.values())
        for h, s in start.items():
            after[h] += s * (1 - kept)
        now = after
    return now


def chain(hosts):
    edges = defaultdict(float)
    for h in hosts:
        labels = h.split(".")
        for i in range(len(labels) - 2):
            a, b = ".".join(labels[i:]), ".".join(labels[i + 1 :])
            edges[a, b] = edges[b, a] = 1.0
    return edges


def test_query_against_plain_python(spark):
    rows = QUERIES["op7_url_filters"](spark, FOLDER).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    known = {i: (*parts(u), *rule_of(*parts(u))) for i, u in pages.items()}
    edges = chain({x[0] for x in known.values() if x[0]})
    seeds = {"allow": defaultdict(float), "block": defaultdict(float)}
    for host, _, _, action in known.values():
        if action:
            seeds[action][host] += 1
    trust, distrust = ranks(edges, seeds["allow"]), ranks({(b, a): w for (a, b), w in edges.items()}, seeds["block"])
    for x in rows:
        host, path, rule, action = known[x.page_id]
        assert (x.host, x.path, x.rule) == (host, path, rule)
        assert x.verdict == (action or ("block" if distrust.get(host, 0) > trust.get(host, 0) + 1e-6 else "allow"))
    assert {x.verdict for x in rows if x.rule is None} == {"allow", "block"}


def test_trust_follows_links_and_distrust_runs_against_them(spark):
    html = lambda *hosts: "".join(f"<a HREF='https://{h}/x'>x</a>" for h in hosts)
    rows = [
        (1, "https://good.one.com/a", html("friend.alpha.org", "friend.alpha.org", "GOOD.one.com")),
        (2, "https://friend.alpha.org/", html("second.beta.org")),
        (3, "https://second.beta.org/?q=1", None),
        (4, "https://feeder.gamma.org/", html("bad.delta.net")),
        (5, "https://bad.delta.net/fr/x", "<img src=//cdn.epsilon.org/i.png>"),
        (6, "https://cdn.epsilon.org/", ""),
        (7, None, html("bad.delta.net")),
        (8, "no scheme", None),
        (8, "no scheme", None),
        (None, "https://x.com?a/b", None),
        (9, "a://b://C.com/En/", None),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = [tuple(x) for x in urls.judge(df, urls.rules_of(spark, URL_RULES)).collect()]
    assert len(got) == len(rows)
    verdicts = {p: v for p, _, _, _, v in got}
    assert [verdicts[i] for i in range(1, 9)] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert (None, "x.com", "", None, "allow") in got and (9, "b:", "//C.com/En/", None, "allow") in got
    assert got.count((8, "", "", None, "allow")) == 2
    edges = {(e.src, e.dst): e.weight for e in urls.edges_of(urls.parts(df.drop("host"))).collect()}
    assert edges["good.one.com", "friend.alpha.org"] == 1 and ("good.one.com", "good.one.com") not in edges and edges["bad.delta.net", "cdn.epsilon.org"] == 1
    assert urls.judge(df.limit(0), urls.rules_of(spark, URL_RULES)).count() == 0


def test_ranks_converge(spark):
    edges = {("a.x", "b.x"): 1.0, ("b.x", "c.x"): 2.0, ("b.x", "a.x"): 1.0, ("d.x", "a.x"): 1.0}
    seeds = [("trust", "a.x", 2.0), ("distrust", "c.x", 1.0), ("distrust", "d.x", 3.0)]
    df = urls.propagated(
        spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double"),
        spark.createDataFrame(seeds, "kind string, host string, weight double"),
    )
    got = {(x.kind, x.host): x["rank"] for x in df.withColumn("rank", F.col("rank")).collect()}
    for kind, way in (("trust", edges), ("distrust", {(b, a): w for (a, b), w in edges.items()})):
        want = ranks(way, {h: w for k, h, w in seeds if k == kind})
        for host, value in want.items():
            assert abs(got.get((kind, host), 0) - value) < 1e-6


def test_distrust_reaches_hosts_far_away_however_small_it_is(spark):
    html = lambda *hosts: "".join(f"<a href='https://{h}/x'>x</a>" for h in hosts)
    long = 32
    rows = [("https://h0.t/", html("bad.t")), ("https://bad.t/x", None), ("https://good.t/x", html("kept.t")), ("https://kept.t/", None)]
    rows += [(f"https://h{i}.t/", html(f"h{i - 1}.t")) for i in range(1, long)]
    rows += [(f"https://leaf{k}of{i}.t/", html(f"h{i}.t")) for i in range(long - 1) for k in range(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    rules = urls.rules_of(spark, [("block", "bad.t", "/x"), ("allow", "good.t", "/x")])
    got = {x.host: x.verdict for x in urls.judge(df, rules).collect()}
    assert {h for h, v in got.items() if v == "allow"} == {"good.t", "kept.t"}


def test_ranks_of_random_graphs(spark):
    import random

    for seed in range(1, 2):
        r = random.Random(seed)
        hosts = [f"h{i}.x" for i in range(40)]
        edges = {(a, b): float(r.randint(1, 3)) for a, b in ((r.choice(hosts), r.choice(hosts[: 5 + 8 * seed])) for _ in range(55)) if a != b}
        edges |= {(b, a): 1.0 for a, b in list(edges)[:25]}
        seeds = [("trust", h, float(r.randint(1, 4))) for h in r.sample(hosts, 5)] + [("distrust", h, 1.0) for h in r.sample(hosts, 5)]
        seeds.append(("trust", "alone.x", 1.0))
        got = urls.propagated(
            spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double"),
            spark.createDataFrame(seeds, "kind string, host string, weight double"),
        )
        got = {(x.kind, x.host): x["rank"] for x in got.withColumn("rank", F.col("rank")).collect()}
        for kind, way in (("trust", edges), ("distrust", {(b, a): w for (a, b), w in edges.items()})):
            want = ranks(way, {h: w for k, h, w in seeds if k == kind})
            assert all(abs(got.get((kind, h), 0) - v) < 1e-6 * max(v, 1e-3) for h, v in want.items())
