"""Near duplicates among vectors through an inverted multi-index.

Vectors are cut in halves; each half has its own codebook, and the pairs of codes are the cells of a grid. A vector
lives in its nearest cell and visits further ones in the order of the multi-sequence traversal (smallest sum of the two
half distances first), until that sum exceeds the least one by a margin. The margin is the one with which the target
share of held-back pairs meets. Visits carry a sketch of the vector, not the vector; only those that find a near sketch
in the cell bring the vector there, and pairs are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import by_sorted_groups, written
from epispark.llm.components import connected_components


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codebook of at most k rows of float64."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (((c**2).sum(1)[None] - 2 * x @ c.T)).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def half_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * x @ book.T, 0)


def excess(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By how much the distance of each half to each code exceeds that to its nearest code."""
    half = books[0].shape[1]
    d = [half_distances(x[:, :half], books[0]), half_distances(x[:, half:], books[1])]
    return d[0] - d[0].min(1)[:, None], d[1] - d[1].min(1)[:, None]


def home(e: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return e[0].argmin(1) * e[1].shape[1] + e[1].argmin(1)


def traversal(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], margin: float) -> list[np.ndarray]:
    """The cells that each row of x visits, nearest first: the order in which the multi-sequence algorithm pops them.
    A code whose own excess is beyond the margin is in no such cell, so only the codes within it are combined."""
    e1, e2 = excess(x, books)
    out = []
    for a, b in zip(e1, e2, strict=True):
        i, j = np.flatnonzero(a <= margin), np.flatnonzero(b <= margin)
        total = a[i][:, None] + b[j][None]
        p, q = np.nonzero(total <= margin)
        order = np.argsort(total[p, q], kind="stable")
        out.append(i[p[order]] * len(books[1]) + j[q[order]])
    return out


def fitted(sample: np.ndarray, cells: int, cosine: float, recall: float, per_code: int = 32, pairs: int = 10000) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Codebooks and the margin of the traversal.

    Three quarters of the sample make the codebooks, with at least per_code vectors for a code: a larger grid would be
    fitted to chance. The other quarter, which no codebook has seen, gives pairs: a vector and a partner at exactly the
    threshold cosine, off in any direction, in that of a difference of vectors, or in those in which the sample varies most.
    The margin is the least with which the target share of each kind meets, as one of the two visits the cell of the other.
    Closer partners need less.
    """
    half, n = sample.shape[1] // 2, len(sample)
    held = sample[3 * n // 4 :] if n >= 64 else sample
    sample = sample[: 3 * n // 4] if n >= 64 else sample
    k = max(1, min(int(round(np.sqrt(cells))), len(sample) // per_code))
    books = (kmeans(sample[:, :half], k), kmeans(sample[:, half:], k, seed=8))
    rng = np.random.default_rng(9)
    # directions in which partners differ: any, those between vectors, and the leading ones of the sample
    lead = np.linalg.svd(sample[:4096] - sample[:4096].mean(0), full_matrices=False)
    leading = lead[2][: max(1, int(np.searchsorted(np.cumsum(lead[1] ** 2), 0.5 * (lead[1] ** 2).sum())) + 1)]
    kinds = [lambda x: rng.standard_normal(x.shape), lambda x: sample[rng.integers(0, len(sample), len(x))] - x, lambda x: rng.standard_normal((len(x), len(leading))) @ leading]
    margins = []
    for direction in kinds:
        need = []
        for _ in range(-(-pairs // len(held))):
            for at in range(0, len(held), 500):
                x = held[at : at + 500]
                r = direction(x)
                r -= (r * x).sum(1)[:, None] * x
                r /= np.maximum(np.linalg.norm(r, axis=1), 1e-12)[:, None]
                ex, ey = excess(x, books), excess(cosine * x + np.sqrt(1 - cosine**2) * r, books)
                row, hx, hy = np.arange(len(x)), home(ex), home(ey)
                of = lambda e, h: e[0][row, h // len(books[1])] + e[1][row, h % len(books[1])]  # noqa: B023, E731
                need.append(np.minimum(of(ex, hy), of(ey, hx)))
        margins.append(float(np.quantile(np.concatenate(need), recall, method="higher")))
    return books, max(margins)


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; divided by the largest part first, so that squares neither overflow nor
    vanish."""
    x = raw.astype(float)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


SKETCH = 256  # bits


def sketches(x: np.ndarray) -> np.ndarray:
    """Of unit vectors the sides of SKETCH fixed random planes on which they lie, as bytes."""
    planes = np.random.default_rng(12).standard_normal((x.shape[1], SKETCH))
    return np.packbits(x @ planes > 0, axis=1)


def farthest(cosine: float) -> int:
    """Bits in which sketches at this cosine differ, six standard deviations above the mean: one pair in 10^9 differs in
    more."""
    p = np.arccos(min(max(cosine, -1.0), 1.0)) / np.pi
    return int(np.ceil(SKETCH * p + 6 * np.sqrt(SKETCH * p * (1 - p))))


def hinted(most: int):
    """Of groups by cell and tile pair: the members (cell, node) with a near sketch of another one, of which one lives
    there."""

    def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = frame[["cell", "ta", "tb"]]
        bounds = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy()).tolist() + [len(frame)]
        bits = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
        lives, own = frame["lives"].to_numpy(bool), frame["own"].to_numpy(bool)
        near = np.zeros(len(frame), bool)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            mixed = frame["ta"].iloc[lo] != frame["tb"].iloc[lo]
            at, g = np.flatnonzero(lives[lo:hi]), bits[lo:hi]
            for k in range(0, len(at) if hi - lo > 1 else 0, 256):
                rows = at[k : k + 256]
                ok = np.bitwise_count(g[rows, None] ^ g[None]).sum(2) <= most
                ok[np.arange(len(rows)), rows] = False
                if mixed:
                    ok &= own[lo:hi][rows, None] != own[None, lo:hi]
                near[lo:hi] |= ok.any(0)
                near[lo + rows] |= ok.any(1)
        yield frame.loc[near, ["cell", "node"]].drop_duplicates()

    return run


def verified(cosine: float, kind: str, cells: int):
    """Pairs within a cell of which one lives there. Yields, for each vector, the copies it links to, and links that span."""

    def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = frame[["cell", "ta", "tb"]]
        bounds = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy()).tolist() + [len(frame)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            g = frame.iloc[lo:hi]
            if len(g) < 2:
                continue
            mixed = g["ta"].iloc[0] != g["tb"].iloc[0]
            own, lives = g["own"].to_numpy(bool), g["lives"].to_numpy(bool)
            if not lives.any():
                continue
            node, copies, home = g["node"].to_numpy(np.int64), g["copies"].to_numpy(np.int64), g["home"].to_numpy(np.int64)
            dims = g["dims"].to_numpy(np.int64)
            # (row, visited cell) as one sorted number each
            visits = np.sort(np.repeat(np.arange(len(g)), g["cells"].map(len)) * cells + np.concatenate(g["cells"].to_numpy()))
            # those that live here against all; each pair once
            a = np.flatnonzero(lives)
            x = units(np.frombuffer(b"".join(g["raw"]), kind).reshape(len(g), -1))
            for at in range(0, len(a), 1024):
                rows = a[at : at + 1024]
                hit = x[rows] @ x.T >= cosine
                i, j = np.nonzero(hit)
                i = rows[i]
                ok = (dims[i] == dims[j]) & (~lives[j] | (i < j)) & (node[i] != node[j])
                if mixed:
                    ok &= own[i] != own[j]
                i, j = i[ok], j[ok]
                # a visitor whose home the other one visits meets it there as well: count the pair at the smaller one's home
                guest = ~lives[j]
                met = i * cells + home[j]
                twice = guest & (visits[np.minimum(np.searchsorted(visits, met), len(visits) - 1)] == met)
                keep = ~twice | (node[i] < node[j])
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                n = np.bincount(i, weights=copies[j], minlength=len(g)) + np.bincount(j, weights=copies[i], minlength=len(g))
                root = np.arange(len(g))
                while True:
                    p, q = root[i], root[j]
                    if (p == q).all():
                        break
                    np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                    while (root[root] != root).any():
                        root = root[root]
                got = n > 0
                yield pd.DataFrame({"node": node[got], "other": node[root[got]], "n": n[got].astype(np.int64)})

    return run


def vector_links(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.99, sample: int = 40000, per_cell: int = 16, tile: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Codebooks and the margin of the traversal are fitted on at most `sample` distinct vectors (those with the smallest
    hash of the id); every vector is indexed and searched, and nothing bounds the cells it visits but the margin. Equal
    vectors are merged first and counted as copies. Cells with more than `tile` members are cut into tile pairs. Vectors
    that are null, zero, empty or hold null, NaN or infinite parts link with nothing; nor do vectors of different
    lengths. Rows that repeat a vec_id are vectors of their own, each with its own row; those of equal vectors link as
    copies. Rows without vec_id are kept, link with nothing and have no component. Other columns are left out. An empty
    table gives an empty table.
    """
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"))
    sound = F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0), F.lit(False))
    marked = v.select("vec_id", F.when(sound, F.col("e")).alias("e"))
    reps = written(marked.where("e is not null and vec_id is not null").groupBy("e").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    few = reps.select("node", "e").orderBy(F.xxhash64("node"), "node").limit(sample).toPandas()
    if not len(few):
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n = reps.count()
    width = int(reps.agg(F.max(F.size("e"))).first()[0])
    width += width % 2
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"

    def padded(series) -> np.ndarray:
        x = np.zeros((len(series), width), kind)
        for k, e in enumerate(series):
            x[k, : len(e)] = e
        return x

    books, margin = fitted(units(padded(few["e"])), max(1, n // per_cell), cosine, recall)
    cells = len(books[0]) * len(books[1])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                p = b.iloc[at : at + 1000]
                raw = padded(p["e"])
                x = units(raw)
                visited = traversal(x, books, margin)
                yield pd.DataFrame({"node": p["node"], "copies": p["copies"], "dims": p["e"].map(len), "raw": [r.tobytes() for r in raw], "home": [c[0] for c in visited], "cells": visited, "sketch": [r.tobytes() for r in sketches(x)]})

    at = written(reps.mapInPandas(placed, "node long, copies long, dims int, raw binary, home int, cells array<int>, sketch binary"))

    def tiled(members: DataFrame, *payload: str) -> DataFrame:
        """Members (cell, home, node, payload) of cells with more than `tile` of them, dealt to pairs of tiles."""
        # at most one row for each cell of the grid, whose size the sample bounds: (sample / per_code)^2
        large = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("g")).where("g > 1")
        t = members.join(F.broadcast(large), "cell", "left").withColumn("g", F.coalesce("g", F.lit(1)))
        t = t.withColumn("t", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        return t.select("cell", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), (F.col("t") <= F.col("o")).alias("own"), (F.col("cell") == F.col("home")).alias("lives"), "node", *payload)

    pairs = ["cell", "ta", "tb"]
    visits = at.select("node", "home", "sketch", F.explode("cells").alias("cell"))
    hints = written(by_sorted_groups(tiled(visits, "sketch"), pairs, ["node"], hinted(farthest(cosine)), "cell int, node long").distinct())
    met = tiled(hints.join(at.drop("sketch"), "node"), "copies", "dims", "raw", "home", "cells")
    found = written(by_sorted_groups(met, pairs, ["node"], verified(cosine, kind, cells), "node long, other long, n long"))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    component = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = reps.join(linked, "node", "left").join(component, "node", "left").select("e", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"))
    named = F.col("vec_id").isNotNull()
    out = marked.join(known, "e", "left").select("vec_id", F.when(named, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, F.coalesce("c", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
