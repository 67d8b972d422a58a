"""Every operator and pipeline stage on nulls, empty and very long texts, repeated rows, ties, empty tables and extra
columns whose names clash with what the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from epispark.llm import quality, toxicity
from epispark.llm.archives import archived
from epispark.llm.common import table
from epispark.llm.decontamination import leaks
from epispark.llm.embeddings import vector_links
from epispark.llm.negatives import hard_negatives
from epispark.llm.packing import packed
from epispark.llm.pages import main_text
from epispark.llm.passages import repeated_passages
from epispark.llm.secrets import with_secrets
from epispark.llm.simhash import near_duplicates
from epispark.llm.spelling import spelling_variants
from epispark.llm.urls import url_verdicts

CLASHES = "score predicted id row rows page host path rule verdict url_ text_hash fp k lo hi copy shift h e node cell spans found rules _id _host _row start length ids at a b w y hash least place blocks parts sig word near form n label digest size more top shared payload bundle content vec windows levels many whole".split()
LONG = ["Ab " * 60_000, "1,2 " * 60_000, "word " * 120_000, "x" * 400_000, "password=" * 20_000, "<p>" * 30_000]
TEXTS = [None, "", " ", "\x00", "a", "A fine day out.", "A fine day out.", "\U0001f600 é ﷽", "token = abcdefgh12345678"]


@pytest.fixture(scope="module")
def tables(spark, sf):
    """documents of the small table with odd rows, and the other tables; all with extra columns."""
    real = table(spark, sf, "documents").limit(60)
    ids = [None, -1, -1, -2, -3, -4, -4, -5, -6]
    odd = spark.createDataFrame([(i, t) for i, t in zip(ids, TEXTS, strict=True)] + [(-100 - k, t) for k, t in enumerate(LONG)] + [(-4, "A fine day out."), (-7, "z")], "doc_id long, text string")
    rows = real.unionByName(odd, allowMissingColumns=True)
    extra = {c: F.lit(7) for c in CLASHES}
    pages = table(spark, sf, "pages").limit(20).unionByName(spark.createDataFrame([(None, None, None), (-1, "", ""), (-1, "http://x/", "<div>" * 20_000 + "t"), (-1, "http://x/", "<div>" * 20_000 + "t"), (-2, "://" + "a" * 100_000, "x" * 200_000)], "page_id long, url string, html string"))
    vectors = table(spark, sf, "embeddings").limit(50).select("vec_id", "embedding")
    vectors = vectors.unionByName(vectors.limit(3)).unionByName(vectors.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
    return {"documents": rows.withColumns(extra), "plain": rows, "pages": pages.withColumns(extra), "vectors": vectors.withColumns(extra), "labels": table(spark, sf, "labels"), "items": table(spark, sf, "benchmark").unionByName(spark.createDataFrame([(None, "x y"), (-1, None), (-2, "")], "item_id long, text string")).withColumns(extra)}


OPERATORS = {
    "op1": ("documents", lambda d, t: toxicity.toxicity(d, t["labels"]), True),
    "op2": ("documents", lambda d, t: packed(d), False),
    "op3": ("documents", lambda d, t: near_duplicates(d), True),
    "op4": ("documents", lambda d, t: quality.quality(d, t["labels"]), True),
    "op5": ("pages", lambda d, t: main_text(d), True),
    "op6": ("documents", lambda d, t: leaks(d, t["items"]), False),
    "op7": ("pages", lambda d, t: url_verdicts(d), True),
    "op8": ("documents", lambda d, t: repeated_passages(d), False),
    "op9": ("documents", lambda d, t: with_secrets(d), True),
    "op10": ("vectors", lambda d, t: vector_links(d), True),
    "op11": ("pages", lambda d, t: archived(d), True),
    "op12": ("documents", lambda d, t: spelling_variants(d), False),
    "op13": ("vectors", lambda d, t: hard_negatives(d.withColumn("label", F.pmod(F.xxhash64("embedding"), F.lit(3)).cast("int")), every=7), False),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows(tables, name):
    source, apply, keeps = OPERATORS[name]
    d = tables[source]
    out = apply(d, tables)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if keeps:
        assert len(rows) == d.count()
    if name in ("op1", "op4", "op5", "op7", "op9"):
        made = {"score", "predicted", "host", "path", "rule", "verdict"}
        for c in set(CLASHES) - made:
            assert all(r[c] == 7 for r in rows), c
    # the same with rows in another order and partitioning: equal rows have equal results
    key = {"op12": "word", "op13": "anchor_id"}.get(name) or {"pages": "page_id", "vectors": "vec_id"}.get(source, "doc_id")
    if name not in ("op2",):
        again = apply(d.repartition(5), tables).collect()
        wanted = [c for c in out.columns if c not in CLASHES or c in ("score", "predicted", "host", "path", "rule", "verdict")]
        tell = lambda rs: sorted(repr([str(r[key])[:50], *[str(r[c])[:200] for c in wanted]]) for r in rs)
        assert tell(rows) == tell(again)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_an_empty_table(tables, name):
    source, apply, _ = OPERATORS[name]
    assert apply(tables[source].limit(0), tables).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows_and_an_empty_table(spark, sf, tables, k):
    name, stage = corpus_pipeline.STAGES[k]
    for d in (tables["plain"], tables["documents"]):
        out = stage(spark, d, sf)
        rows = out.collect()
        if k < 4:
            assert out.columns == d.columns
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in d.select("doc_id").collect()}
            assert None in {r["doc_id"] for r in rows}, name
        if k == 1:
            ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
            assert len(ids) == len(set(ids))
    assert stage(spark, tables["plain"].limit(0), sf).count() == 0


BIG = 1152921504606846977  # no double holds it


def test_large_ids_beside_nulls_stay_exact(spark, sf, tables):
    rows = [(BIG, "some words to pack here"), (None, "and more"), (BIG + 2, "a third text"), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in packed(d).collect()} == {BIG, BIG + 2, 7, None}
    word = " ".join(f"w{k}" for k in range(60))
    long = spark.createDataFrame([(BIG, word), (BIG + 2, word), (None, word)], "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["other_doc_id"]) for r in repeated_passages(long).collect()} == {(BIG, BIG + 2), (BIG + 2, BIG)}
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(long).collect()} == {(BIG, BIG), (BIG + 2, BIG), (None, BIG)}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_text_column_of_another_name(spark, sf, module):
    apply = getattr(module, module.__name__.rsplit(".", 1)[-1])
    d, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    named = apply(d.withColumnRenamed("text", "body"), labels, text="body").select("doc_id", "score")
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, apply(d, labels).select("doc_id", "score").collect()))


@pytest.mark.parametrize("k", range(4))
def test_stage_keeps_the_values_of_clashing_columns(spark, sf, k):
    extra = {"score": F.lit(7.0), "predicted": F.lit(1), "Size": F.concat(F.lit("s"), F.col("doc_id")), "row": F.lit(3), "id": F.lit(4), "hash": F.lit(5), "least": F.lit(6), "rows": F.lit(8), "clean": F.lit("c"), "spans": F.lit("x"), "similarity": F.lit(9), "component_id": F.lit(10), "doc_tokens": F.lit(11)}
    d = table(spark, sf, "documents").limit(80).withColumns(extra)
    plain = {r["doc_id"]: r for r in corpus_pipeline.STAGES[k][1](spark, d.drop(*extra), sf).collect()}
    rows = corpus_pipeline.STAGES[k][1](spark, d, sf).collect()
    assert {r["doc_id"] for r in rows} == set(plain)
    for r in rows:
        assert (r["score"], r["predicted"], r["Size"], r["row"], r["id"], r["hash"], r["least"], r["rows"], r["clean"], r["spans"], r["similarity"], r["component_id"], r["doc_tokens"]) == (7.0, 1, f"s{r['doc_id']}", 3, 4, 5, 6, 8, "c", "x", 9, 10, 11)
        assert (r["text"], r["n_chars"]) == (plain[r["doc_id"]]["text"], plain[r["doc_id"]]["n_chars"])
