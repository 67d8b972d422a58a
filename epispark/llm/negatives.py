"""Hard negatives by threshold joins on inner products, after L2AP.

Anchors meet blocks of rows. In a block, an inverted index posts the dimensions of each row, those of most energy first,
but omits a row's last ones once their norm bounds their share of any score below the threshold. Partial scores are
accumulated from the postings; pairs are pruned when the norms that remain cannot lift them to their threshold; of those
left, the omitted dimensions are added. Thresholds start high and are lowered until a window is full or at its floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import received, sent, written

CHUNK = 8  # dimensions that are accumulated between two prunings
FEW = 0.05  # share of live pairs below which they are followed one by one
SLACK = 1 + 1e-9  # norms are rounded
FOUND = "anchor_id long, slot int, id long, score double"


def rest_norms(x: np.ndarray) -> np.ndarray:
    """Of each row the norms of what follows 0, CHUNK, 2 CHUNK ... dimensions."""
    parts = np.add.reduceat(x**2, range(0, x.shape[1], CHUNK), axis=1)
    return np.sqrt(np.c_[np.cumsum(parts[:, ::-1], 1)[:, ::-1], np.zeros(len(x))]) * SLACK


def above(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all wanted pairs whose inner product is at least the anchor's threshold."""
    order = np.argsort(-(rows**2).sum(0), kind="stable")
    rest_a, rest_y = rest_norms(a := anchors[:, order]), rest_norms(y := rows[:, order])
    chunks = rest_y.shape[1] - 1
    # a row is posted for its first chunks; the suffix behind them is too short for the lowest threshold
    posted = np.minimum((rest_y * rest_a[:, 0].max() >= least.min()).sum(1), chunks)
    by = np.argsort(-posted, kind="stable")  # so the postings of a dimension are the first rows
    y, rest_y, posted, live = y[by], rest_y[by], posted[by], wanted[:, by]
    live = live[:, : int((posted > 0).sum())] if least.min() > 0 else live
    score, seen = np.zeros(live.shape), 0
    while seen < chunks and live.sum() > FEW * live.size:
        at, k = slice(seen * CHUNK, (seen + 1) * CHUNK), int((posted > seen).sum())
        seen += 1
        score[:, :k] += a[:, at] @ y[:k, at].T
        live[:, :k] &= score[:, :k] + rest_a[:, seen, None] * rest_y[None, :k, seen] + 1e-6 >= least[:, None]
    i, j = np.nonzero(live)
    s, done = score[i, j], np.minimum(posted[j], seen)
    for c in range(chunks):  # what the index omits, and what the loop above left
        more, at = done <= c, slice(c * CHUNK, (c + 1) * CHUNK)
        s[more] += (a[i[more], at] * y[j[more], at]).sum(1)
        keep = ~more | (s + rest_a[i, c + 1] * rest_y[j, c + 1] + 1e-6 >= least[i])
        i, j, s, done = i[keep], j[keep], s[keep], done[keep]
    keep = s >= least[i]
    return i[keep], by[j[keep]], s[keep]


def matrix(raw: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), width)


def best_in_block(asks: pd.DataFrame, block: pd.DataFrame, width: int, k: int) -> Iterator[pd.DataFrame]:
    """For each window of each anchor, the k best rows of the block within its bounds (all, if fewer)."""
    rows, ids, labels = matrix(block["vec"], width), block["id"].to_numpy(np.int64), block["label"].to_numpy(np.int64)
    step = max(1, (1 << 21) // len(block))  # at most two million pairs at once
    for lo in range(0, len(asks), step):
        q = asks.iloc[lo : lo + step]
        names, vec = q["anchor_id"].to_numpy(np.int64), matrix(q["vec"], width)
        wanted = (q["label"].to_numpy(np.int64)[:, None] == labels[None]) == q["same"].to_numpy(bool)[:, None]
        wanted &= names[:, None] != ids[None]
        i, j, s = above(vec, rows, np.array([x.min() for x in q["lo"]]), wanted)
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        out: list[tuple] = []
        ends = np.searchsorted(i, np.arange(len(q) + 1))
        for n, (slots, high, low) in enumerate(zip(q["slot"], q["hi"], q["lo"], strict=True)):
            mine, of = s[ends[n] : ends[n + 1]], ids[j[ends[n] : ends[n + 1]]]
            for slot, top, least in zip(slots, high, low, strict=True):
                at = np.flatnonzero((mine >= least) & (mine <= top))[:k]
                out += [(names[n], slot, x, v) for x, v in zip(of[at], mine[at], strict=True)]
        yield pd.DataFrame(out, columns=["anchor_id", "slot", "id", "score"])


def starting_levels(windows: DataFrame, sample: pd.DataFrame, width: int, k: int, n: int) -> DataFrame:
    """windows with `levels`: thresholds to try one after the other. The first should hold 2 k rows by the sample, the
    second holds k of the sample, the last is the floor. They decide about cost alone."""
    shared = sent(windows.sparkSession, (matrix(sample["vec"], width), sample["id"].to_numpy(np.int64), sample["label"].to_numpy(np.int64)))
    first = max(1, min(k, -(-2 * k * len(sample) // max(n, 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, ids, labels = received(shared)
        for b in batches:
            levels = []
            for name, label, same, vec, top, floor in zip(b["anchor_id"], b["label"], b["same"], b["vec"], b["hi"], b["floor"], strict=True):
                s = rows @ np.frombuffer(vec, "<f8")
                s = -np.sort(-s[((labels == label) == same) & (ids != name) & (s >= floor) & (s <= top)])
                levels.append([s[r - 1] if len(s) >= r else floor for r in (first, k)] + [floor])
            yield b[["anchor_id", "slot", "hi", "floor"]].assign(levels=levels)

    return windows.mapInPandas(run, "anchor_id long, slot int, hi double, floor double, levels array<double>")


def filled(windows: DataFrame, anchors: DataFrame, same: bool, rows: DataFrame, sample: pd.DataFrame, width: int, k: int, n: int, block_rows: int, block_anchors: int) -> DataFrame:
    """(anchor_id, slot, best): for each window (anchor_id, slot, hi, floor) its k best rows, or all if fewer, as
    structs (less, id) with less = -score, in order. Each round joins the windows that are still open with all rows, at
    their next lower threshold; one that holds k rows or has reached its floor is closed."""
    of = anchors.select("anchor_id", "label", "vec").withColumn("same", F.lit(same))
    open_ = written(starting_levels(windows.join(of, "anchor_id"), sample, width, k, n))
    blocks = max(-(-n // block_rows), min(64, -(-n // 1024)))
    closed = None

    def run(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor_id": [], "slot": [], "id": [], "score": []}).astype({"anchor_id": "int64", "slot": "int32", "id": "int64"})
        return pd.concat([none, *(best_in_block(asks, block, width, k) if len(asks) and len(block) else ())])

    for r in range(3):
        lo = F.col("levels")[r]
        asks = open_.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "hi", lo.alias("lo"))).alias("w")).join(of, "anchor_id")
        parts = max(1, -(-asks.count() // block_anchors))
        asks = asks.select("anchor_id", "label", "same", "vec", "w.slot", "w.hi", "w.lo", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        data = rows.select("id", "label", "vec", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        found = asks.groupBy("part", "block").cogroup(data.groupBy("part", "block")).applyInPandas(run, FOUND)
        # at most k rows of each block
        best = found.groupBy("anchor_id", "slot").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k).alias("best"))
        told = written(open_.join(best, ["anchor_id", "slot"], "left").withColumn("full", (F.size(F.coalesce("best", F.array())) >= k) | (lo <= F.col("floor"))))
        now = told.where("full and best is not null").select("anchor_id", "slot", "best")
        closed = now if closed is None else closed.unionByName(now)
        open_ = told.where("not full").drop("best", "full")
        if open_.isEmpty():
            break
    return closed


def hard_negatives(vectors: DataFrame, every: int = 100, k: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, sample: int = 4096, block_rows: int = 32768, block_anchors: int = 32768, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); scores are inner products, exact as long as they stay below 2^53. Anchors
    are the rows whose id is divisible by `every`. An anchor's positives are its k best other rows of the same label; the
    negatives of each positive are the k best rows of another label with low * positive_score <= 100 * negative_score <=
    high * positive_score. Higher scores come first, ties by the smaller id; where there are fewer than k, all.

    Rows with a null id, label or vector or with a null, NaN or infinite component take no part. Of rows that repeat an
    id the one with the smallest label, then the smallest vector, takes part. Shorter vectors are filled up with zeros;
    empty ones score 0. Other columns are ignored, whatever their names; an empty table gives an empty table.

    All anchors meet all rows, in blocks of about block_rows rows and block_anchors anchors. At most `sample` rows (those
    with the smallest hash of the id) go through the driver; they give the first thresholds, not the result.
    """
    sound = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & sound)
    v = written(v.groupBy("id").agg(F.min(F.struct("label", "e")).alias("r")).select("id", "r.label", "r.e"))
    n, width = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("e")), F.lit(0))).first()
    width = max(width, 1)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), width))
            for row, e in zip(x, b["e"], strict=True):
                row[: len(e)] = e
            yield b[["id", "label"]].assign(vec=[r.tobytes() for r in np.floor(scale * x)])

    rows = written(v.mapInPandas(packed, "id long, label long, vec binary"))
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    anchors = written(rows.where(F.col("id") % every == 0).select(F.col("id").alias("anchor_id"), "label", "vec"))
    joined = lambda windows, same: filled(windows, anchors, same, rows, few, width, k, n, block_rows, block_anchors)
    inf = F.lit(float("inf"))
    positives = joined(anchors.select("anchor_id", F.lit(0).alias("slot"), inf.alias("hi"), (-inf).alias("floor")), True)
    positives = written(positives.select("anchor_id", F.posexplode("best").alias("slot", "p")).select("anchor_id", "slot", F.col("p.id").alias("positive_id"), (-F.col("p.less")).alias("p")))
    # scores are whole numbers, so the bounds are as well
    windows = positives.select("anchor_id", "slot", F.floor(F.col("p") * high / 100).cast("double").alias("hi"), F.ceil(F.col("p") * low / 100).cast("double").alias("floor")).where("floor <= hi")
    negatives = joined(windows, False).select("anchor_id", "slot", F.posexplode("best").alias("rank", "n"))
    out = negatives.join(positives, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"), F.col("p").cast("long").alias("positive_score"), (-F.col("n.less")).cast("long").alias("negative_score"))
