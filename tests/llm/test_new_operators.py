"""Archives, spelling variants and hard negatives: round trips and brute-force twins."""

import base64
import hashlib
import io
import itertools
import json
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
from epispark.llm import archives as A
from epispark.llm.negatives import above, hard_negatives
from epispark.llm.spelling import near_words, pivots_of, prefix_of, roots, runs_of, spelling_variants

Q = __spark_entry__.queries()
PAGES = "page_id long, url string, html string"


def page_rows():
    rows = [(k, f"http://h/{k}", f"<p>{k % 50}</p>" * (1 + k % 40)) for k in range(400)]
    odd = [(2**60 + 1, "http://x/é\n y\r\nWARC-Type: z", "a"), (None, None, "a"), (None, None, "a"), (3000, "u", None), (3001, "u", ""), (3001, "u", ""), (3002, "", "\r\n\r\nWARC/1.1\r\n"), (3003, "q", "\U0001f600" * 200_000), (-7, "q", "neg")]
    return rows + odd


def want_records(rows):
    top = {}
    rank = lambda x: (x is not None, x or 0)
    for page, _, html in rows:
        top[html or ""] = max(top.get(html or "", page), page, key=rank)
    out = []
    for page, _, html in rows:
        data, best = (html or "").encode(), top[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if page == best else "revisit", None if page == best else best))
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3).withColumns({"top": F.lit(1), "payload": F.lit(2), "Size": F.lit(3)})
    assert sorted(map(tuple, A.archived(pages, frame_bytes=500, bundle_bytes=2000).collect()), key=repr) == want_records(rows)
    assert sorted(map(tuple, A.archived(pages, broadcast_rows=0).collect()), key=repr) == want_records(rows)
    large = {r["page_id"]: r["record_type"] for r in A.archived(pages, least_bytes=100).collect()}
    small = [(p, u, h) for p, u, h in rows if len((h or "").encode()) < 100]
    assert {large[p] for p, _, _ in small} == {"response"}
    assert A.archived(pages.limit(0)).count() == 0


def test_bundles_are_seekable_and_hold_their_records(spark):
    rows = page_rows()
    folder = A.new_folder(spark, "test")
    A.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), folder, frame_bytes=3000, bundle_bytes=4000)
    bundles = {r["bundle"]: bytes(r["content"]) for r in A.bundles(spark, folder).collect()}
    assert len(bundles) > 4
    index = A.archive_index(spark, folder).collect()
    assert len(index) == len(rows)
    for name, content in bundles.items():
        # a plain reader passes over the skippable frames and sees all records
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert plain.count(b"WARC-Record-ID: ") == sum(r["bundle"] == name for r in index)
        n, flags, magic = struct.unpack("<IBI", content[-9:])
        assert (flags, magic) == (0x80, 0x8F92EAB1)
        table = A.seek_table(content)
        assert len(table) == n
        assert sum(size for _, size, *_ in table) + 8 + 12 * n + 9 == len(content)
        assert sum(size for *_, size, _ in table) == len(plain)
        for r in index:
            if r["bundle"] == name:
                frame = A.frame_at(content, table[r["frame"]])
                record = frame[r["offset"] : r["offset"] + r["length"]]
                assert A.parsed_record(record) == A.parsed_record(frame, r["offset"])[:1] + (r["length"],)
                assert A.parsed_record(record)[0]["record_id"] == r["record_id"]
    html = {p: h for p, _, h in rows}
    url = {p: u for p, u, _ in rows}
    for r in A.read_archives(spark, folder).collect():
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == (html[r["page_id"]] or "").encode()
        assert r["url"] == url[r["page_id"]]
    wanted = A.archive_index(spark, folder).where("page_id in (7, 3003, 1152921504606846977)")
    assert sorted(r["page_id"] for r in A.fetch(spark, folder, wanted).collect()) == [7, 3003, 2**60 + 1]


def test_damaged_bundles_are_told():
    b = A.Bundle(100, 3)
    name, record = A.record_of(1, "u", b"payload", None, False, "2000-01-01T00:00:00Z")
    b.add(1, name, record)
    content = bytearray(b.closed())
    assert json.loads(json.dumps(A.places_of(bytes(content)))) == [[name, 1, 0, 0, len(record)]]
    entry = A.seek_table(bytes(content))[0]
    with pytest.raises(ValueError, match="damaged"):
        A.frame_at(bytes(content), (*entry[:3], entry[3] ^ 1))
    with pytest.raises(ValueError, match="seek table"):
        A.seek_table(bytes(content[:-1]))
    with pytest.raises(ValueError, match="damaged"):
        A.parsed_record(record.replace(b"payload\r", b"payloae\r"))


def plain_words(rows, shortest=5, least=3):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    return {w: c for w, c in n.items() if c >= least}


def plain_variants(rows):
    n = plain_words(rows)
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        cut = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters} | {a + c + b[1:] for a, b in cut if b for c in letters}
        found = sorted((-n[x], x) for x in edits - {w} if x in n)
        near[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return sorted(out)


def test_spelling_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, Q["op12_spelling"](spark, sf).collect())) == plain_variants(rows)


def test_spelling_of_repeated_letters_and_chains(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé"), rng.integers(4, 9))) for _ in range(3000)]  # nearly every word has near ones
    chain = ["aaaaaaaaaa"] * 200 + ["aaaaaaaaaaa"] * 90 + ["aaaaaaaaaaaa"] * 40 + ["aaaaaaaaaaaaa"] * 15 + ["aaaaaaaaaaaaaa"] * 6 + ["aaaaaaaaaaaaaaa"] * 3
    rows = [(k, f"{t}, {t.upper()}-{c} ÀÉ×÷ß") for k, (t, c) in enumerate(zip(texts, itertools.cycle(chain)))] + [(None, "hello hello HELLO Hallo hallo hallo"), (1, None), (1, ""), (2, "é" * 3000 + " " + "x" * 5000)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1)})
    assert sorted(map(tuple, spelling_variants(d.repartition(7)).collect())) == plain_variants(rows)
    assert spelling_variants(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="four"):
        spelling_variants(d, shortest=3)


def test_pivots_are_disjoint_and_of_least_weight():
    rng = np.random.default_rng(4)
    for _ in range(500):
        ranks = rng.integers(0, 6, rng.integers(4, 14)).tolist()
        places = prefix_of(ranks)
        assert len(places) >= 3
        weights = rng.integers(1, 50, len(places)).tolist()
        of = dict(zip(places, weights, strict=True))
        a, b = pivots_of(places, weights)
        assert b - a >= 2
        assert of[a] + of[b] == min(of[x] + of[y] for x in places for y in places if y - x >= 2)


def test_near_words_are_each_pair_once(spark):
    words = sorted({"".join(p) for n in (4, 5) for p in itertools.product("abc", repeat=n)})
    got = [(r["a"], r["b"]) for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    cut = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) + 1 == len(b) and a in cut(b) or len(b) + 1 == len(a) and b in cut(a)
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)}
    assert runs_of("1", b"") == Counter()


def test_roots_of_long_chains(spark):
    pairs = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(100)] + [("x", "y")]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {**{f"w{k:03d}": "w100" for k in range(100)}, "x": "y"}


def test_threshold_join_keeps_all_pairs_above():
    rng = np.random.default_rng(0)
    for _ in range(200):
        w = int(rng.integers(1, 40))
        a = np.floor(256 * rng.normal(0, 0.2, (rng.integers(1, 9), w)))
        y = np.floor(256 * rng.normal(0, 0.2, (rng.integers(1, 200), w)) * rng.random((1, w)) ** 3)
        s = a @ y.T
        least = np.array([rng.choice([-np.inf, 0, np.quantile(s, 0.9), np.quantile(s, 0.99), s.max() + 1]) for _ in a])
        wanted = rng.random(s.shape) < 0.7
        i, j, v = above(a, y, least, wanted)
        assert sorted(zip(i.tolist(), j.tolist(), v.tolist(), strict=True)) == sorted((p, q, s[p, q]) for p, q in zip(*np.nonzero(wanted & (s >= least[:, None])), strict=True))


def plain_negatives(rows, every=100, k=5):
    kept = {}
    for i, label, e in rows:
        if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            kept[i] = min(kept.get(i, (label, e)), (label, e))
    width = max((len(e) for _, e in kept.values()), default=0)
    v = {i: (label, np.floor(256 * np.array([*e, *[0.0] * (width - len(e))]))) for i, (label, e) in kept.items()}
    out = []
    for a in v:
        if a % every:
            continue
        scored = sorted((-int(v[a][1] @ x), i, label) for i, (label, x) in v.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == v[a][0]][:k]:
            hits = [t for t in scored if t[2] != v[a][0] and 80 * -s <= 100 * -t[0] <= 100 * -s][:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "copies", "ties", "odd"])
def test_negatives_match_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "clustered":
        x = rng.normal(0, 1, (20, 24))[rng.integers(0, 20, 900)] + rng.normal(0, 0.2, (900, 24))
        rows = [(k, int(rng.integers(0, 3)), (r / np.linalg.norm(r)).tolist()) for k, r in enumerate(x)]
    elif kind == "copies":  # a third of all rows are one vector, under all labels
        x = rng.normal(0, 0.2, (600, 16))
        x[::3] = x[0]
        rows = [(k, int(rng.integers(0, 4)), r.tolist()) for k, r in enumerate(x)]
    elif kind == "ties":
        rows = [(k, k % 2, [float(k // 100 % 3), 0.5]) for k in range(400)]
    else:
        rows = [(k, k % 3, [0.1 * k, 0.2]) for k in range(40)] + [(None, 1, [1.0, 1.0]), (200, None, [1.0, 1.0]), (300, 1, None), (400, 1, [1.0, None]), (500, 1, [float("nan"), 1.0]), (600, 1, []), (700, 0, [3.0]), (0, 2, [9.0, 9.0]), (0, 0, [0.0, 0.1]), (-100, 1, [-1.0, -2.0]), (800, 7, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit(1), "score": F.lit(2)})
    want = plain_negatives(rows, 50)
    assert want
    assert sorted(map(tuple, hard_negatives(d, every=50).collect())) == want
    assert sorted(map(tuple, hard_negatives(d.repartition(5), every=50, sample=16, block_rows=100, block_anchors=3).collect())) == want
    assert hard_negatives(d.limit(0)).count() == 0


def test_queries_match_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op11_warc", "op13_negatives"):
        df = Q[name](spark, sf)
        cur = con.execute(__spark_entry__.oracle_sql()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(cur.fetchall())


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("kind", ["clustered", "quantised", "correlated"])
def test_links_of_vectors_that_are_no_random_directions(spark, kind):
    """Recall on what tables hold: tight clusters, copies of lower precision, and noise along a few directions."""
    from epispark.llm.embeddings import vector_links

    rng = np.random.default_rng(11)
    if kind == "clustered":
        x = unit_rows(rng.standard_normal((40, 48)))[rng.integers(0, 40, 2500)] + rng.standard_normal((2500, 48)) * rng.choice([0.02, 0.04, 0.06], 2500)[:, None]
    elif kind == "quantised":
        x = unit_rows(rng.standard_normal((1500, 48)) @ np.diag(np.linspace(2, 0.2, 48)))
        x = np.concatenate([x, np.round(x[:500] * 16) / 16, np.round(x[200:600] * 32) / 32])
    else:
        mix = rng.standard_normal((6, 48))
        x = unit_rows(rng.standard_normal((1500, 6)) @ mix * 0.5 + rng.standard_normal((1500, 48)))
        x = np.concatenate([x, x[:800] + rng.standard_normal((800, 6)) @ mix * 0.017])
    x = x.astype(np.float32)
    u = unit_rows(x.astype(float))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 500
    got = vector_links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6), tile=256).toPandas().sort_values("vec_id")
    n = got["n_links"].to_numpy()
    assert (n <= near.sum(1)).all()
    assert n.sum() >= 0.98 * near.sum(), n.sum() / near.sum()
