"""Rules by hand, the boosted trees against a plain version, and what they learn."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tallywright.llm import url_filter
from tallywright.llm.queries import URL_RULES
from tallywright.llm.url_filter import EDGES, FEATURES, ONE

CASES = [
    ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://org/", "org", "/", "org/", "allow"),
    ("http://x.com/fr/#/de/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/FR/", "x.com", "/FR/", None, None),
    ("http://notorg/es/", "notorg", "/es/", None, None),
    ("http://x.org?a=/b", "x.org", "", None, None),
    ("x.org/es/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("go?u=http://x.org/a", "x.org", "/a", "org/", "allow"),
    ("http://a.b.com/de/" + "q" * 5000, "a.b.com", "/de/" + "q" * 5000, "com/de/", "block"),
    ("ftp://ÉX.com/de/ü", "Éx.com", "/de/ü", "com/de/", "block"),
]


def test_rules(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("length", F.lit("x")).withColumn("m", F.lit("x"))
    got = {r.page_id: r for r in url_filter.filter_urls(df, URL_RULES).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def features(url):
    """Lexical features of a text, with its suffix."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest[:min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host):].split("?")[0].split("#")[0]
    before = url.split("#")[0]
    query = before.split("?", 1)[1] if "?" in before else ""
    n = len(url)
    kinds = list(dict.fromkeys(url))
    log2 = lambda x: math.log(x) / math.log(2)
    spread = 0.0
    for c in kinds:
        spread += url.count(c) * log2(url.count(c))
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return {"length": n, "depth": sum(x != "" for x in path.split("/")), "digits": sum(c in "0123456789" for c in url) * 1000 // n if n else 0,
            "entropy": math.floor(100 * (log2(n) - spread / n) + 1e-9) if n else 0, "parameters": sum(x != "" for x in query.split("&"))}, low.split(".")[-1]


def plain_trees(labelled, others, trees=10, depth=3, rate=0.3, ridge=1.0):
    """labelled: [(url, blocked)] -> margins of ``others``."""
    stats = {}
    for u, y in labelled:
        s = stats.setdefault(features(u)[1], [0, 0])
        s[0] += 1
        s[1] += y

    def classes(u):
        f, suffix = features(u)
        n, b = stats.get(suffix, (0, 0))
        f |= {"suffix_share": 1000 * (b + 1) // (n + 2) if n else 500, "suffix_count": n}
        return [sum(f[k] >= e for e in EDGES[k]) for k in FEATURES]

    cells = {}
    for u, y in labelled:
        c = cells.setdefault(tuple(classes(u)), [0, 0])
        c[0] += 1
        c[1] += y
    n, b = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
    start = round(ONE * math.log((b + 1) / (n - b + 1)))
    model = []

    def margin(x):
        m = start
        for splits, values in model:
            node = 1
            while node in splits:
                f, c = splits[node]
                node = 2 * node + (x[f] > c)
            m += values[node]
        return m

    for _ in range(trees if 0 < b < n else 0):
        stat = {}
        for x, (k, y) in cells.items():
            p = 1 / (1 + math.exp(-margin(x) / ONE))
            stat[x] = (k, round((y - k * p) * ONE), round(k * p * (1 - p) * ONE))
        splits, values = {}, {}
        leaf = lambda g, h: round(ONE * rate * g / (h + ridge * ONE))

        def grow(node, xs, level):
            g, h = sum(stat[x][1] for x in xs), sum(stat[x][2] for x in xs)
            values[node] = leaf(g, h)
            if level == depth:
                return
            score = lambda g, h: float(g) * g / (h + ridge * ONE)
            best = None
            for f in range(len(FEATURES)):
                for c in sorted({x[f] for x in xs})[:-1]:
                    left = [x for x in xs if x[f] <= c]
                    lg, lh = sum(stat[x][1] for x in left), sum(stat[x][2] for x in left)
                    gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                    if best is None or gain > best[0]:
                        best = (gain, f, c)
            if best and best[0] > 0:
                splits[node] = best[1:]
                grow(2 * node, [x for x in xs if x[best[1]] <= best[2]], level + 1)
                grow(2 * node + 1, [x for x in xs if x[best[1]] > best[2]], level + 1)

        grow(1, list(cells), 0)
        model.append((splits, values))
    return [margin(tuple(classes(u))) for u in others]


def test_trees_equal_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    rows = [(r.page_id, r.url or "") for r in pages.collect()]
    labelled = [(u, int(got[i].verdict == "block")) for i, u in rows if got[i].rule]
    margins = plain_trees(labelled, [u for _, u in rows])
    assert len(labelled) > 40 and len({r.verdict for r in got.values()}) == 2
    for (i, _), m in zip(rows, margins):
        assert got[i].p_block == pytest.approx(1 / (1 + math.exp(-m / ONE)), abs=1e-4)
        assert got[i].rule or got[i].verdict == ("block" if m > 0 else "allow")


def test_learns_from_given_labels(spark):
    rng = random.Random(4)
    def url():
        bad = rng.random() < 0.4
        host = f"{'x' * rng.randint(3, 20)}.{rng.choice(['win', 'top', 'com'] if bad else ['org', 'net', 'com'])}"
        tail = f"/{rng.randrange(10**9)}/{rng.randrange(10**9)}?" + "&".join(f"k{j}={rng.randrange(1000)}" for j in range(rng.randint(3, 8))) if bad else "/" + "/".join(["news", "story", "about"][:rng.randint(1, 3)])
        return f"http://{host}{tail}", bad
    known, fresh = [url() for _ in range(600)], [url() for _ in range(400)]
    labels = spark.createDataFrame([*known, (None, None), ("http://y.org/", None)], "url string, blocked boolean")
    got = url_filter.filter_urls(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(fresh)], "page_id long, url string"), [], labels).collect()
    assert sum((r.verdict == "block") == fresh[r.page_id][1] for r in got) >= 390


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/1"), (1, "http://a.net/1"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(df, URL_RULES).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(df.limit(0), URL_RULES).collect() == []
    one = spark.createDataFrame([("http://b.net/", True)] * 3, "url string, blocked boolean")
    assert {r.verdict for r in url_filter.filter_urls(df, [], one).collect()} == {"block"}
