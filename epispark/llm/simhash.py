"""SimHash fingerprints of word shingles, and their near duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import by_sorted_groups, written
from epispark.llm.components import connected_components

SEED = 42


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text: A-Z lower-cased, words split at ASCII white space, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    parts = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64)
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Add the fingerprint as a long. Null, empty and white-space texts: 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, simhash(F.col(text)))


def masks(radius: int, blocks: int) -> list[int]:
    """Masks over 64 bits, one for each choice of blocks - radius blocks: fingerprints within radius agree on one."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    bits = [((1 << (int(b) - int(a))) - 1) << int(a) for a, b in zip(edges, edges[1:], strict=False)]
    whole = [reduce(int.__or__, (bits[k] for k in kept)) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def compared(radius: int):
    """A function that links the rows of whole tile pairs: rows are sorted by tile pair and population count."""

    def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, node = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["node"].to_numpy(np.int64)
        pc, own, mixed = frame["pc"].to_numpy(np.int16), frame["own"].to_numpy(bool), (frame["ta"] != frame["tb"]).to_numpy()
        key = frame[["combo", "masked", "ta", "tb"]]
        starts = (key != key.shift()).any(axis=1).to_numpy()
        group = np.cumsum(starts)
        root = np.arange(len(frame))
        left = np.arange(len(frame) - 1)
        d = 1
        while len(left):
            left = left[left + d < len(frame)]
            right = left + d
            # sorted by count inside a group: once the counts are too far apart, so are all later ones
            near = (group[left] == group[right]) & (pc[right] - pc[left] <= radius)
            left, right = left[near], right[near]
            hit = (np.bitwise_count(fp[left] ^ fp[right]) <= radius) & (~mixed[left] | (own[left] != own[right]))
            i, j = left[hit], right[hit]
            while len(i):
                a, b = root[i], root[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                if not len(i):
                    break
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
            d += 1
        linked = root != np.arange(len(frame))
        if linked.any():
            yield pd.DataFrame({"a": node[linked], "b": node[root[linked]]}).drop_duplicates()

    return run


def fingerprint_links(prints: DataFrame, radius: int = 3, tile: int = 1024, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints within radius; prints has one row (node, fp) per fingerprint.

    Two fingerprints within the radius agree on blocks - radius of the blocks, so each such choice makes buckets in
    which comparison is complete. A bucket of more than tile rows becomes tiles of equal population count; only tile
    pairs whose counts differ by at most the radius are formed, and each pair is a group of its own. A tile pair
    yields links that span its components, not all its pairs.
    """
    if blocks is None:
        n = prints.count()
        blocks = radius + (1 if n < 1 << 22 else 2 if n < 1 << 31 else 3)
    prints = prints.where("node is not null").withColumn("pc", F.bit_count("fp").cast("int"))
    keyed = prints.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius, blocks)])).alias("combo", "masked"))
    sizes = keyed.groupBy("combo", "masked", "pc").agg(F.count(F.lit(1)).alias("n"))
    large = (
        sizes.groupBy("combo", "masked")
        .agg(F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("n") / tile).cast("int")))).alias("tiles"))
        .where(F.col("rows") > tile)
        .select("combo", "masked", "tiles")
    )
    # a tile's number: 2^20 times the population count, plus which of the tiles of that count
    t = F.col("pc") * (1 << 20) + F.pmod(F.xxhash64("fp"), F.col("tiles")[F.col("pc")]).cast("int")
    others = F.flatten(
        F.transform(
            F.sequence(F.col("pc") - radius, F.col("pc") + radius),
            lambda c: F.when(F.col("tiles")[c].isNotNull(), F.transform(F.sequence(F.lit(0), F.col("tiles")[c] - 1), lambda s: c * (1 << 20) + s)).otherwise(F.array().cast("array<int>")),
        )
    )
    rows = keyed.join(large, ["combo", "masked"], "left")
    rows = rows.withColumn("t", F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(t)).withColumn("o", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(others)))
    rows = rows.select("combo", "masked", "node", "fp", "pc", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), (F.col("t") <= F.col("o")).alias("own"))
    return by_sorted_groups(rows, ["combo", "masked", "ta", "tb"], ["pc", "fp"], compared(radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, tile: int = 1024) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id that can be reached by links, itself included),
    text_hash (64 bits, which tells apart texts that share an id).

    Equal fingerprints are first merged to one node, so copies are never compared. Each row has the component of its own
    fingerprint, also where rows repeat an id; a row without id takes part by its fingerprint. Null and empty texts
    have fingerprint 0 and link like any other. Other columns are left out. Empty table in, empty table out.
    """
    made = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle).select("doc_id", "fp", F.xxhash64("text").alias("text_hash")))
    prints = written(made.groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = fingerprint_links(prints, radius, tile)
    component = connected_components(links)
    found = prints.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return made.join(found, "fp").select("doc_id", "fp", "component_id", "text_hash")


def hex16(fp: str):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
