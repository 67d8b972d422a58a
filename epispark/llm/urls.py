"""URL verdicts: host and path rules first, else the ratio of two character language models.

The models are variable-order Markov models (orders 0 to `order`, each interpolated with the next shorter one by
Witten-Bell smoothing) of URLs that rules accept and reject. A URL's score is the difference of the two
log-likelihoods divided by its length, put through a logistic curve fitted on held-back rule-judged URLs. All distinct
URLs that rules judge are counted; counts, probabilities and scores are tables, joined by grams of characters.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epispark.llm.common import columns_but, platt, written

START, END = "\x02", "\x03"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host and path. Null urls and urls without :// have both empty."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substr(rest, F.length(host) + 1, F.length(rest) + 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(after, r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits host and path, as struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Markov:
    """Counts of characters after contexts of every order: the model of a few URLs in one process (a twin of probabilities)."""

    order: int
    counts: dict[str, dict[str, int]]
    totals: dict[str, int]
    letters: int

    @classmethod
    def of(cls, urls: Sequence[str], order: int) -> Markov:
        counts: dict[str, Counter] = defaultdict(Counter)
        for u in urls:
            s = START + u + END
            for k in range(1, len(s)):
                for n in range(min(order, k) + 1):
                    counts[s[k - n : k]][s[k]] += 1
        return cls(order, {c: dict(v) for c, v in counts.items()}, {c: sum(v.values()) for c, v in counts.items()}, len(counts.get("", ())) + 64)

    def bits(self, url: str) -> float:
        s, total = START + url + END, 0.0
        for k in range(1, len(s)):
            p = 1 / self.letters
            for n in range(min(self.order, k) + 1):  # shorter contexts first: each longer one mixes in what it knows
                context = s[k - n : k]
                seen = self.counts.get(context)
                if seen is None:
                    break
                size = self.totals[context]
                p = (seen.get(s[k], 0) + len(seen) * p) / (size + len(seen))
            total += np.log2(p)
        return total


@dataclass
class Model:
    accepted: Markov
    rejected: Markov
    slope: float
    shift: float

    def ratio(self, url: str | None) -> float:
        u = url or ""
        return (self.accepted.bits(u) - self.rejected.bits(u)) / (len(u) + 1)


def fit(sample: pd.DataFrame, order: int = 5) -> Model | None:
    """The models and curve of a few URLs in one process: url and y (1 accepted). Two thirds train the models, one third calibrates. One class alone: no model."""
    if sample["y"].nunique() < 2:
        return None
    rank = sample.groupby("y").cumcount()
    build, tune = sample[rank % 3 != 2], sample[rank % 3 == 2]
    if tune["y"].nunique() < 2:
        tune = sample
    model = Model(*(Markov.of(list(build["url"][build["y"] == y]), order) for y in (1, 0)), 1.0, 0.0)
    model.slope, model.shift = platt(np.array([model.ratio(u) for u in tune["url"]]), tune["y"].to_numpy())
    return model


def judged_urls(pages: DataFrame, url: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(id, url, y, part), stored: the distinct URLs, null as the empty text. y: 1 accepted, 0 rejected, null without rule;
    part: place among the URLs of its class modulo 3, in the order of their hashes, by way of the counts of 4,096 ranges."""
    u = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(u.alias("url"), F.col(url).isNotNull().alias("given")).groupBy("url").agg(F.max("given").alias("given"))
    rule = rule_of(*parts_of(F.col("url")), rules)
    rows = rows.select("url", F.when(F.col("given"), (rule["verdict"] == "allow").cast("int")).alias("y"), F.xxhash64("url").alias("h")).withColumn("range", F.shiftright("h", 52))
    known = rows.where("y is not null")
    per = known.groupBy("y", "range").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("before", F.sum("n").over(W.partitionBy("y").orderBy("range")) - F.col("n")).drop("n")
    place = F.row_number().over(W.partitionBy("y", "range").orderBy("h", "url")) - 1 + F.col("before")
    known = known.join(F.broadcast(per), ["y", "range"]).select("url", "y", (place % 3).cast("int").alias("part"))
    rest = rows.where("y is null").select("url", "y", F.lit(None).cast("int").alias("part"))
    return written(known.unionByName(rest).withColumn("id", F.monotonically_increasing_id()))


def grams(urls: DataFrame, order: int) -> DataFrame:
    """(id, y, part, gram): each character of a URL and its end, behind as many characters as the models look at."""
    s = F.concat(F.lit(START), F.col("url"), F.lit(END))
    whole = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))
    first = F.array_compact(F.array(*[F.when(F.length(s) >= n, F.left(s, F.lit(n))) for n in range(2, order + 1)]).cast("array<string>"))
    return urls.select("id", "y", "part", F.explode(F.concat(first, whole)).alias("gram"))


def log_ratios(urls: DataFrame, order: int) -> DataFrame:
    """(gram, n, bits): every gram of the URLs, how often it occurs, and by how much more likely its last character is
    among the accepted URLs of parts 0 and 1 than among the rejected, in bits (whole multiples of 2^-32, so that their sums
    do not depend on an order). Probabilities go from each gram to those one character longer."""
    of = lambda y: F.count_if((F.col("y") == y) & (F.col("part") != 2))
    tops = written(grams(urls, order).groupBy("gram").agg(of(1).alias("n1"), of(0).alias("n0"), F.count(F.lit(1)).alias("n")))
    size = F.length("gram")
    each = tops.select("n1", "n0", "n", size.alias("size"), F.col("gram").alias("whole"), F.explode(F.sequence(F.lit(1), size)).alias("m"))
    each = each.select(F.right("whole", F.col("m")).alias("gram"), "n1", "n0", F.when(F.col("m") == F.col("size"), F.col("n")).otherwise(0).alias("n"))
    counts = each.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n1", "n0", "n")]).withColumn("context", F.left("gram", size - 1))
    contexts = counts.groupBy("context").agg(*[f(y).alias(f"{k}{y}") for y in (1, 0) for k, f in (("s", lambda y: F.sum(f"n{y}")), ("k", lambda y: F.count_if(F.col(f"n{y}") > 0)))])
    steps = written(counts.join(contexts, "context").withColumn("size", size))
    letters = steps.where("context = ''").select("k1", "k0").first()
    level, out = None, None
    for m in range(1, order + 2):
        one = steps.where(F.col("size") == m)
        if level is None:
            one = one.withColumns({f"q{y}": F.lit(1 / (letters[f"k{y}"] + 64)) for y in (1, 0)})
        else:
            one = one.withColumn("tail", F.right("gram", F.lit(m - 1))).join(level.select(F.col("gram").alias("tail"), F.col("p1").alias("q1"), F.col("p0").alias("q0")), "tail")
        p = {f"p{y}": F.when(F.col(f"s{y}") > 0, (F.col(f"n{y}") + F.col(f"k{y}") * F.col(f"q{y}")) / (F.col(f"s{y}") + F.col(f"k{y}"))).otherwise(F.col(f"q{y}")) for y in (1, 0)}
        level = written(one.withColumns(p).select("gram", "n", "p1", "p0"))
        out = level if out is None else out.unionByName(level)
    return out.where("n > 0").select("gram", "n", F.round((F.log2("p1") - F.log2("p0")) * 2**32).cast("long").alias("bits"))


def ratios(urls: DataFrame, order: int) -> DataFrame:
    """(url, y, part, x), stored: the difference of the two log-likelihoods of each URL divided by its length.

    Grams that make up at least 1 / 20,000 of all, which are at most 20,000, are broadcast; the others are joined.
    """
    known = written(log_ratios(urls, order))
    total = known.agg(F.sum("n")).first()[0]
    often = F.col("n") * 20_000 >= F.lit(total)
    each = grams(urls, order).select("id", "gram").join(F.broadcast(known.where(often).select("gram", "bits")), "gram", "left")
    seldom = each.where("bits is null").select("id", "gram").join(known.where(~often).select("gram", "bits"), "gram")
    sums = each.where("bits is not null").select("id", "bits").unionByName(seldom.select("id", "bits")).groupBy("id").agg(F.sum("bits").alias("bits"))
    return written(urls.join(sums, "id").select("url", "y", "part", (F.col("bits") / 2**32 / (F.length("url") + 1)).alias("x")))


def curve(rows: DataFrame, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve of y on x, as common.platt fits it, by Newton steps over sums of all rows."""
    n1, n, mean, spread = rows.agg(F.sum("y"), F.count("y"), F.avg("x"), F.stddev_pop("x")).first()
    spread = spread if spread > 0 else 1.0
    z = (F.col("x") - mean) / spread
    target = F.when(F.col("y") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n - n1 + 2))
    w = np.zeros(2)
    for _ in range(100):
        p = chance(z, float(w[0]), float(w[1]))
        v, e = p * (1 - p), p - target
        a, b, c, ez, e1 = rows.agg(F.sum(v * z * z), F.sum(v * z), F.sum(v), F.sum(e * z), F.sum(e)).first()
        step = np.linalg.solve(np.array([[a, b], [b, c]]) + ridge * np.eye(2), np.array([ez, e1]) + ridge * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return round(float(w[0] / spread), 9), round(float(w[1] - w[0] / spread * mean), 9)


def chance(x: Column, slope: float, shift: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), slope * x + shift))))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = 5, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score and verdict (allow or block).

    The models are fitted on all distinct URLs that rules judge, two thirds for counts and one third for the curve; every
    URL is judged. URLs that no rule fits get the models' verdict. A null URL counts as the empty text. Without URLs of
    both classes the models allow everything. Of rules of equal length the last in order wins. Repeated rows are judged
    each, alike; columns of these five names are replaced, others pass through; an empty table stays empty.
    """
    host, path = parts_of(F.col(url))
    rule = rule_of(host, path, rules)
    urls = judged_urls(pages, url, rules)
    held = {(r["y"], r["part"]) for r in urls.where("y is not null").select("y", "part").distinct().collect()}
    judged = pages.select(columns_but(pages, "host", "path", "rule", "score", "verdict").alias("page"), host.alias("host"), path.alias("path"), rule.alias("r"), F.coalesce(F.col(url), F.lit("")).alias("u"))
    score = F.lit(1.0)
    if {y for y, _ in held} == {0, 1}:
        scored = ratios(urls, order)
        slope, shift = curve(scored.where("part = 2" if {(0, 2), (1, 2)} <= held else "y is not null"))
        judged = judged.join(scored.select(F.col("url").alias("u"), "x"), "u")
        score = chance(F.col("x"), slope, shift)
    judged = judged.withColumn("score", score)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select("page.*", "host", "path", F.col("r.rule").alias("rule"), "score", verdict.alias("verdict"))
