"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

A rule names a host and a path; it fits its host and all subdomains where the path starts with its own, and of the
rules that fit the longest decides. What no rule decides is judged by trees over features of the URL alone: lengths,
depth, shares of digits, entropy, numbers of parameters, hyphens, and how often URLs under the same host suffixes are
blocked. Everything is made of DataFrame functions: a level of a tree is one aggregation of gradients over binned
features, and the fitted trees are one column expression, so judging is a scan without a shuffle.

The trees are fitted on a sample of the labelled URLs, drawn by a hash, of about ``most_fitted`` rows (at most half of
all); what a task gets of it are counts of equal bins. The statistics of suffixes come from all labelled URLs outside
that sample, so no URL's own label is in its features. Suffixes with fewer than ``LEAST`` URLs, or less than a
10,000th of all, take the rate of the next shorter one; so at most 30,000 are kept, which go to every task. Gradients
are summed as integers and ties go to the first feature, so a fit doesn't depend on partitions.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the trees
(null: as empty text); URLs of any length count as a whole; repeated rows are judged alike; without labelled URLs, or
with labels of one kind, the trees are one constant, and allow where there is none; an empty table gives no rows.
Extra columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.shared import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: Host, path and verdict of the rules of the query.
RULES = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))
#: Words of host names that label a URL as one to block where no rule labels it.
SEED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")

FEATURES = ("length", "host_length", "labels", "depth", "digits", "host_digits", "hyphens", "entropy", "params", "query_length", "rate1", "rate2", "rate3")
SUFFIXES, LEAST, PRIOR_ROWS = 3, 20, 20.0
ROUNDS, DEPTH, BINS, RATE, RIDGE = 12, 3, 16, 0.4, 1.0
UNIT = 1 << 20  # of summed gradients


# parts of a URL


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first ``://`` and the path, in lower case, and the path up to query or fragment."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


# rules


def table(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(host, path, verdict)`` given by hand."""
    made = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rows])
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def with_rules(rows: DataFrame, rules: DataFrame, most_held: int = 256) -> DataFrame:
    """``rows(host, path, ...)`` with ``rule`` and ``ruled``, its verdict; both null where no rule fits.

    The host's suffixes with as many labels as rules have, each with the path's prefixes of the lengths that rules
    have, are the rules that could fit. Up to ``most_held`` rules are looked up in the row; more are joined, once for
    each different host and path. Both ways give the same.
    """
    named = rules.select(F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("length"))
    shape = named.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("length").alias("lengths")).first()
    if not shape.n:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    # numbers of labels and lengths of paths differ in as many ways as the longest rule is long
    lengths = F.filter(F.array(*map(F.lit, sorted(shape.lengths))), lambda n: F.char_length("path") >= n)
    hosts = F.array_distinct(F.array(*[suffix(F.col("host"), n) for n in sorted(shape.labels)]))
    fitting = F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.concat(h, F.substr("path", F.lit(1), n)))))
    if shape.n <= most_held:
        held = F.create_map(*[F.lit(x) for r in named.collect() for x in (r.rule, r.verdict)])
        known = F.filter(fitting, lambda c: F.map_contains_key(held, c))
        best = F.array_max(F.transform(known, lambda c: F.struct(F.char_length(c).alias("n"), c.alias("rule"))))
        out = rows.withColumn("rule", best["rule"])
        return out.withColumn("ruled", F.try_element_at(held, F.col("rule")))
    pairs = rows.select("host", "path").distinct()
    met = pairs.withColumn("rule", F.explode(fitting)).join(named.select("rule", "verdict"), "rule")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), "rule", "verdict")).alias("_b"))
    return rows.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_b.rule"), "ruled": F.col("_b.verdict")}).drop("_b")


# features


def entropy(text: Column) -> Column:
    """Bits a character, from the runs of the sorted characters."""
    letters = F.filter(F.array_sort(F.split(text, "")), lambda c: c != "")
    told = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["s"] + told(a["n"])).alias("s")))
    total = F.aggregate(letters, start, step, lambda a: a["s"] + told(a["n"]))
    size = F.char_length(text)
    return F.when(size > 0, F.round(F.log2(size) - total / size, 6)).otherwise(F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = lambda c: F.char_length(c).cast("double")
    count = lambda c, of: F.regexp_count(c, F.lit(of)).cast("double")
    share = lambda c: F.round(count(c, "[0-9]") / F.greatest(size(c), F.lit(1.0)), 6)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return {
        "length": size(url), "host_length": size(host), "labels": count(host, r"[^.]+"), "depth": count(path, r"/[^/]"), "digits": share(url), "host_digits": share(host),
        "hyphens": count(host, "-"), "entropy": entropy(url), "params": count(query, r"[^&]+"), "query_length": size(query),
    }


def suffix_rates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """``(suffix, rate)`` of the frequent host suffixes of ``labelled(host, blocked)``, smoothed, and the rate of all."""
    each = labelled.select(F.explode(F.array_distinct(F.array(*[suffix(F.col("host"), k) for k in range(1, SUFFIXES + 1)]))).alias("suffix"), "blocked")
    counts = keep(each.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("b")), "suffix-counts")
    total = labelled.agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).first()
    prior = (total.b or 0) / total.n if total.n else 0.0
    frequent = counts.filter(F.col("n") >= max(LEAST, total.n // 10_000))  # at most 10,000 of each number of labels
    return frequent.select("suffix", F.round((F.col("b") + PRIOR_ROWS * prior) / (F.col("n") + PRIOR_ROWS), 6).alias("rate")), round(prior, 6)


def with_features(rows: DataFrame, rates: DataFrame, prior: float) -> DataFrame:
    """``rows(url, host, path, ...)`` with a double for each of FEATURES. Rates go to every task (30,000 rows at most)."""
    out = rows.withColumns(lexical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))
    shorter: Column = F.lit(prior)
    for k in range(1, SUFFIXES + 1):
        own = F.broadcast(rates.select(F.col("suffix").alias(f"_s{k}"), F.col("rate").alias(f"_r{k}")))
        out = out.join(own, suffix(F.col("host"), k) == F.col(f"_s{k}"), "left")
        shorter = F.coalesce(F.col(f"_r{k}"), shorter)
        out = out.withColumn(f"rate{k}", shorter)
    return out.drop(*[f"_{x}{k}" for k in range(1, SUFFIXES + 1) for x in "sr"])


# trees


@dataclass(frozen=True)
class Tree:
    """A split, values up to ``most`` to ``low``; or a leaf with its value alone."""

    value: float = 0.0
    feature: int = -1
    most: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def column(self, at: Callable[[int], Column]) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(at(self.feature) <= F.lit(self.most), self.low.column(at)).otherwise(self.high.column(at))


@dataclass
class Model:
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, at: Callable[[int], Column]) -> Column:
        return sum((t.column(at) for t in self.trees), F.lit(self.base))

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin(lambda i: F.col(FEATURES[i]))))


def edges_of(sample: DataFrame) -> list[list[float]]:
    """For each feature the values at even shares of the sample, where bins end."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = sample.agg(*[F.percentile(c, shares).alias(c) for c in FEATURES]).first()
    # a bin ends at a value that occurs; half-way points between two are moved down by the comparison alone
    return [sorted(set(row[c])) for c in FEATURES]


def best_split(sums: dict[tuple[int, int], tuple[int, int]], edges: list[list[float]]) -> tuple | None:
    """Of one node's ``{(feature, bin): (gradient, weight)}``: ``(gain, feature, bin, low's sums, high's sums)``."""
    totals = [sum(v[i] for (f, _), v in sums.items() if f == 0) for i in (0, 1)]
    worth = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
    best = None
    for f in range(len(FEATURES)):
        g = h = 0
        for b in range(len(edges[f])):
            more = sums.get((f, b), (0, 0))
            g, h = g + more[0], h + more[1]
            rest = totals[0] - g, totals[1] - h
            if min(h, rest[1]) < UNIT // 2:
                continue
            gain = round(worth(g, h) + worth(*rest) - worth(*totals), 6)
            if gain > 1e-3 and (best is None or gain > best[0]):
                best = gain, f, b, (g, h), rest
    return best


def leaf(g: int, h: int) -> float:
    return round(-RATE * (g / UNIT) / (h / UNIT + RIDGE), 6)


def node_of(splits: dict[int, tuple[int, int]], node: int = 1) -> Column:
    if node not in splits:
        return F.lit(node)
    f, b = splits[node]
    return F.when(F.col(f"b{f}") <= b, node_of(splits, 2 * node)).otherwise(node_of(splits, 2 * node + 1))


def boosted(sample: DataFrame) -> Model:
    """Trees for ``sample(blocked, *FEATURES)``; what leaves Spark are sums by node, feature and bin."""
    total = sample.agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).first()
    if not total.b or total.b == total.n:
        return Model(20.0 if total.b else -20.0)  # without labels nothing speaks against a URL
    edges = edges_of(sample)
    below = lambda c, e: F.size(F.filter(F.array(*map(F.lit, e)), lambda x: x < F.col(c)))
    binned = [below(c, e).alias(f"b{i}") for i, (c, e) in enumerate(zip(FEATURES, edges))]
    bins = [f"b{i}" for i in range(len(FEATURES))]
    cells = keep(sample.select("blocked", *binned).groupBy(*bins).agg(F.count("*").alias("n"), F.sum("blocked").alias("y")).coalesce(8), "cells")
    model = Model(round(math.log(total.b / (total.n - total.b)), 6))
    as_bins = lambda t: t if t.low is None else Tree(feature=t.feature, most=edges[t.feature].index(t.most), low=as_bins(t.low), high=as_bins(t.high))
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-Model(model.base, [as_bins(t) for t in model.trees]).margin(lambda i: F.col(f"b{i}"))))
        sloped = cells.select(*bins, F.round((F.col("n") * p - F.col("y")) * UNIT).cast("long").alias("g"), F.round(F.col("n") * p * (1 - p) * UNIT).cast("long").alias("h"))
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(b).alias("b")) for i, b in enumerate(bins)])).alias("at")
        splits: dict[int, tuple[int, int]] = {}
        values, open_ = {1: 0.0}, [1]
        for _ in range(DEPTH):
            rows = sloped.select(node_of(splits).alias("node"), "g", "h", pairs).filter(F.col("node").isin(open_)).groupBy("node", "at.f", "at.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            sums: dict[int, dict] = {}
            for r in rows:
                sums.setdefault(r.node, {})[r.f, r.b] = r.g, r.h
            open_ = []
            for node in sorted(sums):
                if found := best_split(sums[node], edges):
                    _, f, b, low, high = found
                    splits[node] = f, b
                    values |= {2 * node: leaf(*low), 2 * node + 1: leaf(*high)}
                    open_ += [2 * node, 2 * node + 1]
            if not open_:
                break

        def grown(node: int) -> Tree:
            if node not in splits:
                return Tree(values[node])
            f, b = splits[node]
            return Tree(feature=f, most=edges[f][b], low=grown(2 * node), high=grown(2 * node + 1))

        if not splits:
            break
        model.trees.append(grown(1))
    return model


@dataclass
class Judge:
    model: Model
    rates: DataFrame
    prior: float

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows(url, host, path, ...)`` with ``score``, the probability that a URL is one to block."""
        return with_features(rows, self.rates, self.prior).withColumn("score", self.model.score()).drop(*FEATURES)


def fitted(labelled: DataFrame, most_fitted: int = 50_000) -> Judge:
    """A judge from ``labelled(url, host, path, blocked)``; ``most_fitted`` is about how many rows the trees see."""
    n = labelled.count()
    share = min(0.5, most_fitted / max(1, n))
    drawn = F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(UNIT)) < int(share * UNIT)
    rates, prior = suffix_rates(labelled.filter(~drawn))
    sample = keep(with_features(labelled.filter(drawn), rates, prior).select("blocked", *FEATURES), "fitted-urls")
    return Judge(boosted(sample), rates, prior)


# the filter


def split_up(rows: DataFrame, url: str = "url") -> DataFrame:
    """``(row, url, host, path)``; ``row`` holds all columns that came in."""
    host, path = host_and_path(F.col(f"`{url}`"))
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"))


def judged(rows: DataFrame, rules: DataFrame, judge: Judge, url: str = "url") -> DataFrame:
    """``(row, host, path, rule, verdict, score)`` of every row."""
    out = judge.scored(with_rules(split_up(rows, url), rules))
    return out.select("row", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")


def labelled_by(rows: DataFrame, rules: DataFrame, words: Sequence[str], url: str = "url") -> DataFrame:
    """``(url, host, path, blocked)``: labels by the rules, and where none fits by words of the host."""
    named = F.col("host").rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)")
    blocked = F.coalesce(F.col("ruled") == BLOCK, named).cast("int")
    return with_rules(split_up(rows, url).select("url", "host", "path"), rules).select("url", "host", "path", blocked.alias("blocked"))


def kept(rows: DataFrame, rules: DataFrame, judge: Judge, url: str = "url") -> DataFrame:
    """The rows that are allowed, columns unchanged."""
    return judged(rows, rules, judge, url).filter(F.col("verdict") == ALLOW).select("row.*")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = table(spark, RULES)
    judge = fitted(labelled_by(pages, rules, SEED_WORDS))
    return judged(pages, rules, judge).select("row.page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
