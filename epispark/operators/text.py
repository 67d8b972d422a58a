"""Web pages, passages and retrieval; stay grids and the outcome model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epispark.session import stored


def stripped(html: Column) -> Column:
    """Text of a page: scripts, styles and tags removed, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


#: the value of href: in double or single quotes, or bare up to white space or the end of the tag
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a\s*>"""


def links(pages: DataFrame, html: str = "html", url: str = "url", title: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, href, title, target): links with stripped titles; relative targets take the page's scheme and host.

    title: a predicate on the title; links that it rejects, or that have no title, are left out. Without one all stay.
    """
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(HREF), F.lit(2)).alias("title"))
    rows = pages.select(url, F.posexplode(both).alias("pos", "l"))
    quoted = F.regexp_replace("l.href", r"""^["']|["']$""", "")
    rows = rows.select(url, "pos", quoted.alias("href"), F.trim(F.regexp_replace("l.title", r"<[^>]*>", "")).alias("title"))
    if title is not None:
        rows = rows.where((F.col("title") != "") & title(F.col("title")))
    site = F.regexp_extract(url, r"^(\w+://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^(\w+:)//", 1)
    target = F.when(F.col("href").rlike(r"^\w+://"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(scheme, "href")).when(F.startswith("href", F.lit("/")), F.concat(site, "href"))
    return rows.withColumn("target", target.otherwise(F.concat(site, F.lit("/"), "href")))


def articles(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """url, host, title, lang and text length of each page."""
    return pages.select(
        url,
        F.regexp_extract(url, "://([^/?#]*)", 1).alias("host"),
        F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(html, r'(?i)<html lang="(\w+)"', 1).alias("lang"),
        F.length(stripped(F.col(html))).alias("n_text"),
    )


#: The containers of an article in the order in which they are tried, the form of a month, the forms of
#: reported totals (cases and deaths, then cases alone), and the sources by what their addresses hold.
CONTAINERS = (".article-con", ".article-content", ".content", "#content", ".TRS_Editor", "article", "body")
MONTH = r"(?U)(20\d{2})年\s*(1[0-2]|0?[1-9])月"
TOTALS = (r"共报告法定传染病(\d{1,9})例[，,、;]?死亡(\d{1,7})人", r"报告发病(\d{1,9})例[，,、;]?死亡(\d{1,7})人", r"共报告(\d{1,9})例[，,、;]?死亡(\d{1,7})人")
CASES = (r"共报告法定传染病(\d{1,9})例", r"报告发病(\d{1,9})例")
SOURCES = (("ndcpa.gov.cn", "ndcpa"), ("nhc.gov.cn", "nhc"), ("zj.gov.cn", "zj"))


def reported_month(text: Column) -> Column:
    """yyyy-MM of the first month named in a text, null without one."""
    year, month = F.regexp_extract(text, MONTH, 1), F.regexp_extract(text, MONTH, 2)
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))


def reported_totals(text: Column) -> Column:
    """struct(cases, deaths) of the first form that fits, spaces aside; cases alone where no deaths are given."""
    bare = F.regexp_replace(text, "[\u00a0 ]", "")
    number = lambda p, k: F.nullif(F.regexp_extract(bare, p, k), F.lit("")).cast("long")
    both = [F.struct(number(p, 1).alias("cases"), number(p, 2).alias("deaths")) for p in TOTALS]
    alone = F.struct(F.coalesce(*[number(p, 1) for p in CASES]).alias("cases"), F.lit(None).cast("long").alias("deaths"))
    return F.coalesce(*[F.when(b["cases"].isNotNull(), b) for b in both], alone)


def article_records(pages: DataFrame, hint: str | None = None, html: str = "html", url: str = "url", containers: Sequence[str] = CONTAINERS, least: int = 50, sources: Sequence[tuple[str, str]] = SOURCES) -> DataFrame:
    """(url, title, main_text, month, cases, deaths, source): the record of each article that names a month.

    The main text is that of the first container of the list with more than `least` characters (helpers.article_parts);
    the title is the hint (a column) where it is not empty, else the page's. The month is the first that title or text
    names; articles without one are left out, as are null pages. source: by the first part that the url holds, else
    unknown. One pass; only the containers are found in Python.
    """
    from epispark.functions.helpers import article_reader

    rows = pages.where(F.col(html).isNotNull()).select(F.col(url).alias("url"), (F.col(hint) if hint else F.lit("")).alias("hint"), article_reader(tuple(containers), least)(F.col(html)).alias("a"))
    rows = rows.select("url", F.coalesce(F.nullif("hint", F.lit("")), "a.title").alias("title"), F.col("a.main").alias("main_text"))
    source = F.coalesce(*[F.when(F.contains("url", F.lit(part)), name) for part, name in sources], F.lit("unknown"))
    rows = rows.withColumn("month", reported_month(F.concat("title", F.lit("\n"), "main_text"))).where("month is not null")
    return rows.select("url", "title", "main_text", "month", reported_totals(F.col("main_text")).alias("t"), source.alias("source")).select("url", "title", "main_text", "month", "t.cases", "t.deaths", "source")


def monthly_table(rows: DataFrame, first: str, last: str, preferred: str, month: str = "month", source: str = "source", url: str = "url") -> DataFrame:
    """One row per month of the range: of each source the smallest url, and of the sources the preferred, else the first."""
    of_source = W.partitionBy(source, month).orderBy(url)
    of_month = W.partitionBy(month).orderBy(F.when(F.col(source) == preferred, 0).otherwise(1), source)
    one = rows.where(F.col(month).between(first, last)).withColumn("_r", F.row_number().over(of_source)).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(of_month)).where("_r = 1").drop("_r")


def seed_urls(logs: DataFrame, log: str, arrays: Sequence[str], needs: str, any_of: Sequence[str], hosts: Sequence[str]) -> DataFrame:
    """(title, url): results of saved searches whose title holds `needs` and any of the words, on any of the hosts; a url
    counts once, at its first place. arrays: columns of arrays of (title, link, url), in the order in which they are read."""
    each = None
    for k, a in enumerate(arrays):
        one = logs.select(log, F.lit(k).alias("kind"), F.posexplode(a).alias("pos", "r"))
        each = one if each is None else each.unionByName(one)
    hit = each.select(F.struct(log, "kind", "pos").alias("at"), F.trim("r.title").alias("title"), F.coalesce("r.link", "r.url").alias("url")).where("url <> '' and title <> ''")
    has = lambda c, words: [F.contains(c, F.lit(w)) for w in words]
    hit = hit.where(F.contains("title", F.lit(needs)) & F.greatest(F.lit(False), *has("title", any_of)) & F.greatest(F.lit(False), *has("url", hosts)))
    return hit.groupBy("url").agg(F.min_by("title", "at").alias("title")).select("title", "url")


def strided(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """array of fixed chunks: size characters every size - overlap, none that lies inside the one before."""
    last = F.greatest(F.lit(1), F.length(text) - overlap)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), last, F.lit(size - overlap)), lambda k: F.substr(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def nearest_of(qs: pd.DataFrame, cs: pd.DataFrame, k: int, cells: int = 1 << 20) -> pd.DataFrame:
    """(query, id, distance): the k nearest of one part (key, v) for each query (key, v) of one block. Only about `cells`
    distances are held at a time, whatever the sizes of the two."""
    out = [pd.DataFrame({"query": qs["key"][:0], "id": cs["key"][:0], "distance": np.zeros(0)})]
    if len(qs) and len(cs):
        # of equal vectors only the k smallest ids can be among the k nearest
        cs = cs.sort_values("key", kind="stable")
        every_y = np.array(cs["v"].tolist(), float)
        same = pd.Series([r.tobytes() for r in every_y])
        held = (same.groupby(same).cumcount() < k).to_numpy()
        y, ids = every_y[held], cs["key"].to_numpy()[held]
        names, every_x = qs["key"].to_numpy(), np.array(qs["v"].tolist(), float)
        yy = (y**2).sum(1)
        step = max(1, cells // len(y))
        for at in range(0, len(names), step):
            x = every_x[at : at + step]
            xx = (x**2).sum(1)
            d = xx[:, None] + yy[None] - 2 * x @ y.T
            kth = np.partition(d, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            # the product rounds: whatever may tie with the k-th is measured again
            rows, cols = np.nonzero(d <= (kth + 1e-9 + 1e-12 * (xx + yy.max()))[:, None])
            exact = np.concatenate([((x[rows[i : i + 16384]] - y[cols[i : i + 16384]]) ** 2).sum(1) for i in range(0, len(rows), 16384)])
            one = pd.DataFrame({"row": rows, "query": names[at + rows], "id": ids[cols], "distance": exact, "near": exact.round(9)})
            out.append(one.sort_values(["row", "near", "id"]).groupby("row").head(k)[["query", "id", "distance"]])
    return pd.concat(out[1:] or out)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, key: str = "id", vector: str = "embedding", threshold: float | None = None, block: int = 4096, part: int = 16384) -> DataFrame:
    """(query, id, distance, similarity, rank): the k nearest chunks of each query by squared distance.

    Queries are dealt into blocks of about `block` rows and chunks into parts of about `part`; each pair of them is one
    task, whose k best of each query are shuffled. Ties, at nine decimals, go to the smaller id. Null vectors match nothing.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    c = chunks.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((q, block), (c, part)))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("block", dealt(blocks)).withColumn("part", every(parts))
    c = c.withColumn("part", dealt(parts)).withColumn("block", every(blocks))

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        return nearest_of(qs, cs, k)

    kinds = f"query {dict(queries.dtypes)[key]}, id {dict(chunks.dtypes)[key]}, distance double"
    found = q.groupBy("block", "part").cogroup(c.groupBy("block", "part")).applyInPandas(best, kinds)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.round("distance", 9), "id"))).where(F.col("rank") <= k)
    out = ranked.withColumn("similarity", 1 / (1 + F.col("distance")))
    return out if threshold is None else out.where(F.col("similarity") >= threshold)


def context(hits: DataFrame, query: str, rank: str, text: str, budget: int, sep: str = "\n") -> DataFrame:
    """Passages in rank order up to the first that would overflow the budget; later shorter ones are not tried."""
    total = F.sum(F.length(text) + len(sep)).over(W.partitionBy(query).orderBy(rank))
    fits = hits.withColumn("_t", total).where(F.col("_t") <= budget)
    return fits.groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, text))), lambda p: p[text]), sep).alias("context"))


def page_texts(df: DataFrame, key: str, text: str, pattern: str = "\n") -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, pattern)).alias("_p", "content")).select(key, (F.col("_p") + 1).alias("page"), "content")


# stays


def stay_grid(stays: DataFrame, events: DataFrame, key: str, t0: str, ts: str, kind: str, value: str, kinds: Sequence, steps: int, step: str = "day") -> DataFrame:
    """One row per stay and step 0..steps-1: mean of each kind (mean per time first, then per step), carried forward, then 0."""
    from epispark.functions.scalars import whole_days, whole_hours
    from epispark.operators.series import forward_filled

    gap = (whole_days if step == "day" else whole_hours)(F.col(ts), F.col(t0))
    placed = events.join(stays.select(key, t0), key).withColumn("time_idx", gap).where((F.col("time_idx") >= 0) & (F.col("time_idx") < steps))
    fine = placed.groupBy(key, "time_idx", ts, kind).agg(F.avg(value).alias("v"))
    cells = fine.groupBy(key, "time_idx").pivot(kind, list(kinds)).agg(F.avg("v"))
    grid = stays.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("time_idx"))
    return forward_filled(grid.join(cells, [key, "time_idx"], "left"), [key], "time_idx", [str(k) for k in kinds])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = n / (classes * n of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = n.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(w, label)


def outcome_model(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str):
    """Scaled and one-hot logistic regression with balanced class weights; returns the fitted pipeline.

    The stages pass over the rows one after the other, so what they read is stored once, not evaluated for each.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    stages = [
        StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical]),
        VectorAssembler(inputCols=list(numeric), outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True),
        VectorAssembler(inputCols=["_scaled", *[f"{c}_v" for c in categorical]], outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="weight", maxIter=50),
    ]
    rows = train.select(*dict.fromkeys([*numeric, *categorical, label]))
    return Pipeline(stages=stages).fit(stored(class_weights(rows, label)))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): one mapping, codes from 0 in the order of the values."""
    from epispark.operators.aggregates import running_totals

    v = df.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("one", F.lit(1))
    return running_totals(v, [], "value", "one", "code").select("value", (F.col("code") - 1).cast("int").alias("code"))
