import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import urls as U

SCHEMA = "page_id long, url string, host string, path string, row string, score int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = lambda s, marks: s[: min([s.index(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def rule_of(host, path, rules):
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def pages():
    rng = random.Random(4)
    hosts = ["Example.org", "a.example.org", "xexample.org", "org", "b.COM", "com", "x.net", "casino-win.net", "m.free-bets.net", "ads.x.net", "Ünï.org", "a..org", ".org", "shop.co", "u:p@x.org:80"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=1&y=2#z", "?q=/de/", "/fr/9", "/de/", "#top", "/de", "/a/b//c/9.html", "/x://y"]
    rows = [(i, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(tails)}", "h", "p", "r", 1) for i in range(1500)]
    rows += [(None, None, None, None, None, None), (1, "", "", "", "", 0), (2, "no scheme.org/fr/", "", "", "", 0), (3, "://", "", "", "", 0), (4, "x\n://b.com/fr/\n?", "", "", "", 0), (5, "http://c.com/de/" + "y" * 300_000 + "?" + "a=1&" * 1000, "", "", "", 0)]
    return rows + [(6, "http://x.net/same", "", "", "", 0)] * 3


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("urls")
    spark.createDataFrame(pages(), SCHEMA).repartition(3).write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_hosts_paths_and_rules(spark, folder):
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in U.op12_urls(spark, folder).collect()), key=str)
    want = []
    for i, url, *_ in pages():
        host, path = parts(url)
        want.append((i, host, path, *rule_of(host, path, U.RULES)))
    assert got == sorted(want, key=str)
    assert len({x[3] for x in want}) == 6


def test_many_rules_are_joined_with_the_same_result(spark):
    rng = random.Random(1)
    rules = sorted({(rng.choice(["org", "example.org", "com", "b.com", "net", "a.b.c.net"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4))), "x") for _ in range(200)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p, _ in rules]
    rows = [(i, rng.choice(["org", "t.example.org", "b.com", "q.a.b.c.net", "x", ""]), "".join(rng.choice("ab/") for _ in range(rng.randrange(6)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, host string, path string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted((i, *rule_of(h, p, rules)) for i, h, p in rows)
    for held in (1000, 0):
        assert sorted((r.i, r.rule, r.ruled) for r in U.with_rules(frame, given, most_held=held).collect()) == want
    assert U.with_rules(frame, given.limit(0)).filter("rule is null and ruled is null").count() == 400


def test_features(spark):
    texts = ["", "aaaa", "ab", "http://x.net/a1?b=2", "é" * 10 + "z" * 5]
    rows = spark.createDataFrame([(t,) for t in texts], "url string").select("url", U.entropy(F.col("url")).alias("e")).collect()
    for r in rows:
        n = len(r.url)
        assert r.e == pytest.approx(-sum(r.url.count(c) / n * math.log2(r.url.count(c) / n) for c in set(r.url)), abs=1e-5)
    host, path = U.host_and_path(F.col("url"))
    got = spark.createDataFrame([("http://a-b.c9.net/x/y//z?k=1&&v#f?q=1",)], "url string").select(*[c.alias(n) for n, c in U.lexical(F.col("url"), host, path).items()]).first()
    assert (got.host_length, got.labels, got.depth, got.hyphens, got.params, got.query_length) == (10, 3, 3, 1, 2, 6)


def plain_boosting(rows, rounds):
    """The same rounds over lists, every split tried."""
    names = range(len(U.FEATURES))
    y = [r[0] for r in rows]
    base = round(math.log(sum(y) / (len(y) - sum(y))), 6)
    margin, trees = [base] * len(y), []
    values = [sorted({r[1 + f] for r in rows}) for f in names]
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        slope = [((a - b) , a * (1 - a)) for a, b in zip(p, y)]
        worth = lambda s: sum(g for g, _ in s) ** 2 / (sum(h for _, h in s) + U.RIDGE)

        def grow(at, depth):
            best = None
            for f in names if depth else ():
                for v in values[f]:
                    low, high = [i for i in at if rows[i][1 + f] <= v], [i for i in at if rows[i][1 + f] > v]
                    if min(sum(slope[i][1] for i in low), sum(slope[i][1] for i in high)) < 0.5:
                        continue
                    gain = round(worth([slope[i] for i in low]) + worth([slope[i] for i in high]) - worth([slope[i] for i in at]), 4)
                    if gain > 1e-3 and (best is None or gain > best[0]):
                        best = gain, f, v, low, high
            if best is None:
                s = [slope[i] for i in at]
                return -U.RATE * sum(g for g, _ in s) / (sum(h for _, h in s) + U.RIDGE)
            return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)

        tree = grow(range(len(y)), U.DEPTH)
        trees.append(tree)

        def value(t, r):
            return t if isinstance(t, float) else value(t[2] if r[1 + t[0]] <= t[1] else t[3], r)

        margin = [m + value(tree, r) for m, r in zip(margin, rows)]
    return margin


def test_trees_against_plain_boosting(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        x = [float(rng.randrange(6)) for _ in U.FEATURES]  # every value ends a bin
        rows.append((int(x[2] > 3 and x[5] <= 2 or x[7] > 4 or rng.random() < 0.05), *x))
    frame = spark.createDataFrame(rows, "blocked int, " + ", ".join(f"{c} double" for c in U.FEATURES)).repartition(5)
    model = U.boosted(frame)
    want = plain_boosting(rows, U.ROUNDS)
    got = [math.log(r.s / (1 - r.s)) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, blocked int, " + ", ".join(f"{c} double" for c in U.FEATURES)).select("i", model.score().alias("s")).orderBy("i").collect()]
    assert len(model.trees) == U.ROUNDS and got == pytest.approx(want, abs=2e-3)


def test_held_out_urls(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9)))
    good = [f"http://{word()}.{rng.choice(['net', 'org'])}/{word()}/{rng.randrange(99)}" for _ in range(1500)]
    bad = [f"http://{word()}-{rng.randrange(1000)}-{word()}.{rng.choice(['net', 'biz'])}/?id={rng.randrange(10**9)}&r={rng.randrange(10**6)}" for _ in range(500)]
    rows = spark.createDataFrame([(u, int(u in set(bad))) for u in good + bad], "url string, blocked int")
    host, path = U.host_and_path(F.col("url"))
    rows = rows.select("url", host.alias("host"), path.alias("path"), "blocked")
    train, test = rows.filter(F.crc32("url") % 3 != 0), rows.filter(F.crc32("url") % 3 == 0)
    judge = U.fitted(train, most_fitted=600)
    right = judge.scored(test).select(((F.col("score") >= 0.5).cast("int") == F.col("blocked")).alias("r")).agg(F.avg(F.col("r").cast("int"))).first()[0]
    assert right > 0.97
    again = U.fitted(train.repartition(9), most_fitted=600)
    assert again.model == judge.model


def test_nothing_labelled_one_kind_and_empty(spark, tmp_path):
    none = spark.createDataFrame([], "url string, host string, path string, blocked int")
    page = spark.createDataFrame([(1, "http://a.net/", None, "x", None, 2)], SCHEMA)
    (r,) = U.judged(page, U.table(spark, U.RULES), U.fitted(none)).collect()
    assert (r.verdict, r.row.host, r.host) == ("allow", None, "a.net")
    one = spark.createDataFrame([(f"http://a{i}.net/", f"a{i}.net", "/", 1) for i in range(50)], "url string, host string, path string, blocked int")
    assert U.judged(page, U.table(spark, U.RULES), U.fitted(one)).first().verdict == "block"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert U.op12_urls(spark, str(tmp_path)).collect() == []
    assert U.kept(page, U.table(spark, [("net", "/", "block")]), U.fitted(one)).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = U.op12_urls(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
