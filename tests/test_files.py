from pyspark.sql import functions as F

from epispark.sources import files as I


def test_series_records_and_signals(spark, tmp_path):
    df = spark.createDataFrame([("20240101", 3), ("bad", 4)], "INSPECTION_DATE string, flu int")
    I.write_csv(df, f"{tmp_path}/a")
    got = I.read_series(spark, f"{tmp_path}/a", schema="INSPECTION_DATE string, flu int")
    assert [(str(r["date"]), r["flu"]) for r in got.orderBy("flu").collect()] == [("2024-01-01", 3), ("None", 4)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert sorted(r["a"] for r in I.read_records(spark, f"{tmp_path}/j", "a int").cache().collect()) == [1, 2]
    assert I.read_signals(spark, f"{tmp_path}/none", "csv", "date date, t double").count() == 0


def test_runs_and_splits(spark, tmp_path):
    for run, v in (("one", 1.0), ("two", 2.0)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "predictions.csv").write_text(f"as_of,date,actual\n2024-01-01,2024-01-08,{v}\n,2024-01-08,9\n")
    got = I.read_runs(spark, f"{tmp_path}/runs")
    assert sorted((r["run"], r["actual"]) for r in got.collect()) == [("one", 1.0), ("two", 2.0)]
    I.write_splits(spark.range(4).withColumn("split", F.when(F.col("id") > 1, "a").otherwise("b")), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/split=a").count() == 2
    I.write_json(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/js")
    assert spark.read.text(f"{tmp_path}/js").first()[0] == '{"a":1,"b":null}'


def test_runs_of_different_width(spark, tmp_path):
    texts = {
        "low": "as_of,date,actual,q_0.05\n2024-01-01,2024-01-08,5,1\n",
        "mid": "q_0.5,as_of,actual,date\n99,2024-01-01,6,2024-01-08\n98,,6,2024-01-15\n",
        "flat": "date,actual,q_0.05\n2024-01-08,7,2\n",
        "more": 'as_of,date,actual,"a, note",q_0.05\n2024-01-01,2024-01-08,8,"x, y",3\n',
        "empty": "",
    }
    for run, text in texts.items():
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "predictions.csv").write_text(text)
    (tmp_path / "runs" / "none").mkdir()
    got = {r["run"]: r for r in I.read_runs(spark, f"{tmp_path}/runs").collect()}
    assert sorted(got) == ["low", "mid", "more"]
    assert (got["low"]["q_0.05"], got["low"]["q_0.5"], got["low"]["actual"]) == (1, None, 5)
    assert (got["mid"]["q_0.05"], got["mid"]["q_0.5"], str(got["mid"]["as_of"]), got["mid"]["actual"]) == (None, 99, "2024-01-01", 6)
    assert got["more"]["a, note"] == "x, y"
    assert I.read_runs(spark, f"{tmp_path}/runs", "nothing.csv").columns == ["run", "as_of"]


def test_mapping_grows_and_keeps_its_numbers(spark, tmp_path):
    from epispark.operators import clean as C

    path = f"{tmp_path}/mapping"
    ids = lambda *v: (spark.createDataFrame([(x,) for x in v], "id string"), "id")
    first = {r["id"]: r["number"] for r in C.extend_mapping(spark, path, [ids("m", "c", None, ""), ids("x", "c")]).collect()}
    assert first == {"c": 1, "m": 2, "x": 3}
    for _ in range(2):  # the second run finds nothing new
        second = {r["id"]: r["number"] for r in C.extend_mapping(spark, path, [ids("a", "x", "z", "m")]).collect()}
        assert second == {**first, "a": 4, "z": 5}
    named = C.pseudonymised(ids("z", "", None, "c", "unknown")[0], "id", C.saved_mapping(spark, path))
    assert sorted((r[0] or "-") for r in named.collect()) == ["-", "P000000", "P000000", "P000001", "P000005"]
    wide = spark.range(1).select(C.pseudonym(F.lit(1234567)).alias("p"))
    assert wide.first()["p"] == "P1234567"


def test_article_records(spark):
    from epispark.operators import text as X

    long = "数" * 60
    pages = [
        ("http://www.nhc.gov.cn/a", f"<html><head><title> T &amp; 2023年 5月 </title><style>2020年1月</style></head><body><!-- 2019年1月 --><div class='content'><p>2018年 5月</p></div><article><div>共报告法定传染病 10 15例，死亡2人<b>{long}</b></div>tail</article>after</body></html>", ""),
        ("http://x.ndcpa.gov.cn/b", f"<div id=content><div>in{long}</div>2021年12月 报告发病727645例、死亡2465人</div><div class=content>short</div>", "Hint 2020年3月"),
        ("http://y/c", "<p>no month here</p>", ""),
        ("http://y/d", None, "2020年3月"),
        ("http://wsjkw.zj.gov.cn/e", "<h1>2022年01月</h1> 报告发病5例 <br>x", ""),
        ("http://y/f", f"<div class='content'><div>{long} 2020年2月 never closed<p>more", None),
    ]
    got = {r["url"][-1]: r for r in X.article_records(spark.createDataFrame(pages, "url string, html string, hint string"), "hint").collect()}
    assert sorted(got) == ["a", "b", "e", "f"]
    a, b, e, f = (got[k] for k in "abef")
    assert (a["title"], a["month"], a["cases"], a["deaths"], a["source"]) == ("T & 2023年 5月", "2023-05", 1015, 2, "nhc")
    assert a["main_text"] == f"共报告法定传染病 10 15例，死亡2人\n{long}\ntail"
    assert (b["title"], b["month"], b["cases"], b["deaths"], b["source"]) == ("Hint 2020年3月", "2020-03", 727645, 2465, "ndcpa")
    assert b["main_text"] == f"in{long}\n2021年12月 报告发病727645例、死亡2465人"
    assert (e["title"], e["month"], e["cases"], e["deaths"], e["source"]) == ("2022年01月", "2022-01", 5, None, "zj")
    assert f["main_text"].endswith("never closed\nmore")


def test_links_in_any_quotes(spark):
    from epispark.operators import text as X

    html = """<a href='/a b'>one <b>x</b></a><A class=q HREF = "c?d=1">two</A ><a rel=n href=http://o/e>three</a><a href=//p/f>four</a><a name=z>no</a><a data-href="/no">no</a><a href="/g"> </a>"""
    p = spark.createDataFrame([("https://s.org/dir/page", html)], "url string, html string")
    got = [(r["href"], r["title"], r["target"]) for r in X.links(p).orderBy("pos").collect()]
    assert got == [("/a b", "one x", "https://s.org/a b"), ("c?d=1", "two", "https://s.org/c?d=1"), ("http://o/e", "three", "http://o/e"), ("//p/f", "four", "https://p/f"), ("/g", "", "https://s.org/g")]
    assert [r["title"] for r in X.links(p, title=lambda t: F.length(t) != 4).orderBy("pos").collect()] == ["one x", "two", "three"]


def test_article_records_and_their_sql_on_short_articles_and_open_references(spark, tmp_path):
    """Articles of at most 50 characters, for which the body stands in, and references without a semicolon."""
    import duckdb

    import __spark_entry__

    page = "<html><head><title>T{0}</title><script>var t = '<p>'</script></head><body><nav><a href='/a'>menu</a></nav>\n<!-- <p>ad --><div>{1}</div><article><p>{2}</p></article><footer>&copy; x</footer></body></html>"
    words = "long enough for an article of its own, with more than fifty characters"
    rows = [(4, page.format("", "aside", "short")), (5, page.format(" &amp", "aside &quot", words + " &amp")), (8, page.format("", "aside", words + " & &ampx &am")), (9, page.format("", "", "b")), (12, page.format("", "z", "c").replace("</body></html>", "")), (16, None)]
    spark.createDataFrame([(k, f"http://a.example.org/{k}", h) for k, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, __spark_entry__.queries()["rt2_article_records"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(__spark_entry__.oracle_sql()["rt2_article_records"]).fetchall()) and len(got) == 5


def test_split_chunks_do_not_gather_texts_in_batches(spark):
    """10,000 texts and their chunks in one batch are what fills a worker's memory; rows go on one by one."""
    from pyspark.sql import functions as F

    from epispark.functions.helpers import splitter

    texts = [None, "", " ", "word " * 300, "x" * 1200, "A line.\n\nAnother. " * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", splitter()(F.col("text")).alias("c"))
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
    got = {r["k"]: r["c"] for r in rows.collect()}
    assert got[0] == got[1] == got[2] == [] and [len(c) for c in got[4]] == [500, 500, 300]
    assert all(len(c) <= 500 for k in (3, 5) for c in got[k]) and got[5][0].endswith("A line.")
