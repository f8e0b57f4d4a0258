"""URL verdicts, hard negatives and clusters against brute force and DuckDB."""

from __future__ import annotations

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from sievefold.llm import clusters, negatives, queries, urls


@pytest.mark.parametrize("name", ["op11_urls", "op12_negatives", "op13_clusters"])
def test_query_matches_sql(spark, sf, name):
    db = duckdb.connect()
    for p in TESTDATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, sf), db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


# URLs ----------------------------------------------------------------------

URLS = [None, "", "no scheme", "casino-win.example", "://", "http://", "http://com/", "http://com", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://xexample.com/en/", "http://a.example.com/EN/", "http://a.net/es/?q=/fr/", "http://a.net?x=/es/", "http://a.net#/es/", "http://netto/es/", "http://net/fr/1", "https://casino-win.example.org/a", "https://m.casino-win.org", "https://acasino-win.org/", "https://casino-winner.org/", "http://É.org/cart/checkout", "http://x.org/cart/checkout/done", "http://x.org/cart/checkouts", "http://archive.x.org/web/casino/porn", "http://museum.casino.org/", "http://user@x.org:80/file.EXE", "http://x.org/file.exe?x", "http://x.org/a\n/tag/b\nc/feed/", "http://x.org/?a=" + "q1 " * 40_000 + "&sessionid=4", "http://x..org//", "mailto:a://b/c", "http://a/b://example.com/en/"]


def brute_pattern(line: str) -> re.Pattern:
    """A filter line read character by character."""
    body = line.removeprefix("@@").lower()
    out = ""
    if body.startswith("||"):
        out, body = r"\A[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        out, body = r"\A", body[1:]
    end = body.endswith("|")
    for c in body[:-1] if end else body:
        out += r"[\s\S]*" if c == "*" else r"(?:[^a-z0-9_.%\-]|\Z)" if c == "^" else re.escape(c)
    return re.compile(out + (r"\Z" if end else ""))


def brute_verdict(url, hosts, patterns):
    text = url or ""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        cut = min([k for k, c in enumerate(rest) if c in "/?#"], default=len(rest))
        end = min([k for k, c in enumerate(rest) if c in "?#"], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:end]
    fits = [r for r in hosts if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if fits:
        rule = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.action == "block"))
        return host, path, rule.host + rule.path, rule.action, None
    hits = [p for p in patterns if brute_pattern(p.line).search(lower)]
    hits = [p for p in hits if p.line.startswith("@@")] or hits
    return host, path, None, "allow" if not hits or hits[0].line.startswith("@@") else "block", hits[0].line if hits else None


def test_urls(spark, sf):
    own = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    every = [*URLS, *own, own[0], None]
    frame = spark.createDataFrame([(k if k != 3 else None, u, "x", 1.0) for k, u in enumerate(every)], "page_id long, url string, host string, rule double")
    got = urls.judge_urls(frame).collect()
    assert len(got) == len(every)
    by_id = {r["page_id"]: tuple(r)[1:6] for r in got}
    for k, u in enumerate(every):
        assert by_id[k if k != 3 else None] == brute_verdict(u, urls.HOST_RULES, urls.PATTERNS), u
    assert {r["pattern"] for r in got} >= {"||casino-win.", "/cart/checkout^", "@@||museum.", "@@||archive.*/web/", "&sessionid=", "/tag/*/feed/"}
    assert urls.judge_urls(frame.limit(0)).count() == 0
    odd = frame.select(F.col("page_id").alias("a.b"), F.col("url").alias("c.d"))
    assert urls.judge_urls(odd, "a.b", "c.d").filter("verdict = 'block'").count() == sum(r["verdict"] == "block" for r in got)


def test_random_patterns_and_urls(spark):
    rng = random.Random(5)
    piece = lambda: rng.choice(["a", "b1", "ab", "-", ".", "/", "_", "^", "*", "?"])
    patterns = [urls.Pattern(rng.choice(["", "", "||", "|", "@@", "@@||"]) + "".join(piece() for _ in range(rng.randint(1, 6))) + rng.choice(["", "", "|"])) for _ in range(300)]
    texts = ["http://" + "".join(rng.choice(["a", "b1", "ab", "-", ".", "/", "_", "?", "é"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    hosts = [urls.HostRule("a", "/b1", "block"), urls.HostRule("b1.a", "/", "allow"), urls.HostRule("a", "/ab/", "allow")]
    frame = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    got = urls.judge_urls(frame, hosts=hosts, patterns=patterns).collect()
    for r in got:
        assert tuple(r)[1:6] == brute_verdict(texts[r["page_id"]], hosts, patterns)
    assert len({r["pattern"] for r in got}) > 5


def test_rarest_token_is_the_index(spark):
    """A rule stands under the token that fewest URLs hold, and only URLs with it run the expression."""
    frame = spark.createDataFrame([(k, f"http://x.org/common/{k}" + ("/rare" if k == 7 else "")) for k in range(200)], "page_id long, url string")
    lines = [urls.Pattern("/common/*/rare|"), urls.Pattern("/common/never/"), urls.Pattern("ommo")]
    assert [p.tokens for p in lines] == [["common", "rare"], ["common", "never"], []]
    assert urls.token_counts(frame, "url", ["common", "rare", "never"]) == {"common": 200, "rare": 1}
    got = {r["page_id"]: (r["pattern"], r["tried"]) for r in urls.judge_urls(frame, hosts=(), patterns=lines).collect()}
    assert got[7] == ("/common/*/rare|", 2) and all(got[k] == ("ommo", 1) for k in got if k != 7)


# hard negatives --------------------------------------------------------------


def brute_negatives(data, anchor, rules=negatives.NegativeRules()):
    """Row by row with Python's integers; data has (id, label, vector)."""
    kept = [(i, y, [math.floor(rules.scale * float(x)) for x in v]) for i, y, v in data if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (a, label, u) in enumerate(kept):
        if not anchor(a):
            continue
        met = sorted(((-sum(p * q for p, q in zip(u, v, strict=False)), last(i), i, y) for n, (i, y, v) in enumerate(kept) if n != k), key=lambda t: t[:2])
        for s, _, positive, _ in [t for t in met if t[3] == label][: rules.positives]:
            hard = [t for t in met if t[3] != label and rules.low_percent * -s <= 100 * -t[0] <= rules.high_percent * -s]
            out += [(a, positive, n + 1, t[2], -s, -t[0]) for n, t in enumerate(hard[: rules.negatives])]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, score double"


@pytest.fixture(scope="module")
def vectors():
    """Ties, copies, repeated and null ids, short and empty vectors, nulls and numbers that aren't finite."""
    rng = random.Random(3)
    new = lambda n=6: [rng.choice([-0.5, -0.004, 0.0, 0.25, 0.3, 1.0]) for _ in range(n)]
    data = [(k, new(), rng.randrange(3)) for k in range(300)]
    data += [(400 + k, data[0][1], k % 3) for k in range(60)] + [(0, data[0][1], 0), (0, data[0][1], 0), (100, new(), 1), (None, data[0][1], 0), (None, data[1][1], 1), (500, new(3), 2), (600, [], 1), (700, new(9), 0)]
    data += [(800, None, 1), (900, new(), None), (1000, [0.1, None], 1), (1100, [float("nan"), 1.0], 1), (1200, [float("inf")] * 6, 1), (1300, [-float("inf")] * 6, 2), (1500, [300.0] * 6, 9)]
    return data


def mined(spark, data, rules=negatives.NegativeRules(), anchor="vec_id % 100 == 0"):
    frame = spark.createDataFrame([(i, v, y, None) for i, v, y in data], VECTORS).select("vec_id", "embedding", "label", F.col("score"), F.lit(1).alias("row"), F.lit("x").alias("id"))
    return sorted(map(tuple, negatives.mine_negatives(frame, F.expr(anchor), rules=rules).collect()), key=repr)


def test_negatives(spark, vectors):
    want = brute_negatives([(i, y, v) for i, v, y in vectors], lambda i: i is not None and i % 100 == 0)
    assert len(want) > 40 and {r[0] for r in want} >= {0, 100}
    assert mined(spark, vectors) == want
    assert mined(spark, vectors, negatives.NegativeRules(group=2, chunk=1, rows=20)) == want  # held in small pieces
    wide = negatives.NegativeRules(positives=2, negatives=50, low_percent=-100, high_percent=130)
    assert mined(spark, vectors, wide) == brute_negatives([(i, y, v) for i, v, y in vectors], lambda i: i is not None and i % 100 == 0, wide)
    assert mined(spark, []) == [] and mined(spark, vectors, anchor="false") == [] and mined(spark, [(0, [1.0], 1)]) == []


def test_negatives_beyond_exact_doubles(spark):
    big = [(k, [3.0e6 + k, 1.0e6 - 7 * k, float(k)], k % 2) for k in range(0, 40)]
    want = brute_negatives([(i, y, v) for i, v, y in big], lambda i: i % 100 == 0)
    assert want and max(r[4] for r in want) > negatives.EXACT
    assert mined(spark, big) == want
    with pytest.raises(Exception, match="may not fit in a long"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [1e30], 0)])


# clusters --------------------------------------------------------------------


def brute_clusters(data, rules):
    kept = [(i, [math.floor(rules.scale * float(x)) for x in v]) for i, v in data if v is not None and len(v) == rules.width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{rules.seed}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    c = [v for _, _, v in first[: rules.k]]
    far = lambda v, w: sum((p - q) ** 2 for p, q in zip(v, w, strict=True))
    near = lambda v: min(range(len(c)), key=lambda k: (far(v, c[k]), k))
    if not c:
        return []
    for _ in range(rules.rounds):
        own = [near(v) for _, v in kept]
        for k in range(len(c)):
            if inside := [v for (_, v), o in zip(kept, own, strict=True) if o == k]:
                c[k] = [sum(col) // len(inside) for col in zip(*inside, strict=True)]
    final = [(i, near(v), far(v, c[near(v)])) for i, v in kept]
    inertia = {k: sum(d for _, o, d in final if o == k) for k in range(len(c))}
    return sorted([(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in final], key=repr)


@pytest.mark.parametrize("rules", [clusters.ClusterRules(k=7, width=3, leaf=2, tree=50), clusters.ClusterRules(k=40, width=3, rounds=3), clusters.ClusterRules(k=5, width=3, leaf=1, tree=7, rounds=0)])
def test_clusters(spark, rules):
    rng = random.Random(8)
    group = [[rng.uniform(-2, 2) for _ in range(3)] for _ in range(5)]
    data = [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(group)]) for k in range(400)] + [(1000 + k, [0.5, 0.5, 0.5]) for k in range(150)]
    data += [(5, [0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (6, None), (2007, []), (8, [1.0]), (9, [1.0] * 4), (10, [1.0, None, 2.0]), (11, [float("nan")] * 3), (12, [float("inf"), 0.0, 0.0]), (13, [9000.0, -9000.0, 1.0])]
    data = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<float>, cluster int, ids string")
    got = clusters.cluster(frame, rules=rules)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(data, rules)
    assert clusters.cluster(frame.limit(0), rules=rules).count() == clusters.cluster(frame.filter("vec_id = 2007"), rules=rules).count() == 0


def test_few_vectors_and_large_components(spark):
    rules = clusters.ClusterRules(k=4, width=2)
    for data in ([(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(k, [200_000.0 - k, -200_000.0 + 3 * k]) for k in range(9)]):
        frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, clusters.cluster(frame, rules=rules).collect()), key=repr) == brute_clusters(data, rules)
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), rules=rules).count()


def test_tree_filters_centroids():
    """Apart groups are assigned as whole nodes, and copies of one vector are one node whatever their number."""
    rng = np.random.default_rng(1)
    c = np.array([[0, 0], [1000, 0], [0, 1000]])
    x = np.concatenate([c[k] + rng.integers(-20, 20, (3000, 2)) for k in range(3)])
    tree = clusters.Tree.build(x, 32)
    found = list(tree.filter(c))
    assert sum(isinstance(k, int) for _, k in found) >= 3 and len(found) < len(tree.first) / 5
    assert sum(int(tree.size[n]) for n, _ in found) == len(x)
    for n, k in found:
        assert (clusters.distances(tree.points[tree.held(n)], c).argmin(1) == k).all()
    same = clusters.Tree.build(np.full((5000, 2), 7), 32)
    assert len(same.first) == 1 and list(same.filter(c)) == [(0, 0)]
    ties = clusters.Tree.build(np.array([[500, 0]] * 40 + [[499, 0], [501, 0]]), 4)
    own = np.zeros(42, int)
    for n, k in ties.filter(c):
        own[ties.held(n)] = k
    assert sorted(zip(ties.points[:, 0].tolist(), own.tolist(), strict=True)) == [(499, 0)] + [(500, 0)] * 40 + [(501, 1)]
