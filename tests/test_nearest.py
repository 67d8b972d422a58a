"""Nearest vectors against brute force, with ties and many blocks."""

import numpy as np
import pytest

from epispark.operators.text import nearest


@pytest.mark.parametrize("block, part", [(3, 16), (4096, 16384)])
def test_nearest_of_many_blocks_and_ties(spark, block, part):
    rng = np.random.default_rng(3)
    v = np.r_[np.tile(rng.normal(size=(1, 8)), (200, 1)), rng.normal(size=(100, 8))].round(3)
    e = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)] + [(999, None)], "id long, embedding array<double>").repartition(7)
    got = {}
    for r in nearest(e.where("id % 10 = 0 or id = 999"), e, 5, block=block, part=part).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    want = {}
    for a in range(0, 300, 10):
        d = ((v - v[a]) ** 2).sum(1).round(9)
        want[a] = sorted(range(300), key=lambda k: (d[k], k))[:5]
    assert got == want
    assert got[0] == [0, 1, 2, 3, 4]
    assert nearest(e.limit(0), e, 5).count() == 0 and nearest(e, e.limit(0), 5).count() == 0


def test_nearest_has_no_limit_of_queries(spark):
    e = spark.range(100_001).selectExpr("id", "array(cast(id as double)) as embedding")
    assert nearest(e, e.where("id < 3"), 1).count() == 100_001


def test_nearest_holds_few_distances_at_a_time():
    """A whole part against many queries: 2 million distances at once would take 100 MB and more."""
    import tracemalloc

    import pandas as pd

    from epispark.operators.text import nearest_of

    rng = np.random.default_rng(5)
    v = rng.normal(size=(16384, 8)).astype("float32")
    part = pd.DataFrame({"key": np.arange(len(v)), "v": list(v)})
    tracemalloc.start()
    got = nearest_of(part[:128], part, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    d = ((v[:128, None].astype(float) - v[None].astype(float)) ** 2).sum(2).round(9)
    want = [[int(k) for k in np.lexsort((np.arange(len(v)), r))[:3]] for r in d]
    assert got.groupby("query")["id"].apply(list).tolist() == want
