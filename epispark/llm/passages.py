"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes start at words; only those at content-selected minimiser positions are retained, so equal passages retain the
same ones. Retained suffixes that agree in their first words are sorted by the words that follow; neighbours are compared
for the length that they share, which gives the runs of the array that share enough to the right for a window of `least`
words, and these are split by what lies to the left of the suffixes: so matches extend to both sides, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import by_sorted_groups, written

BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Ranges:
    """Hashes of any ranges of words of one text, by sums of powers modulo 2^64: equal words, equal hash, at any place."""

    def __init__(self, words: list[bytes]):
        h = hashes_of(words)
        self.n = len(h)
        power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(self.n, b, np.uint64)], dtype=np.uint64)
        self.shift = power(BASE)
        self.sums = np.r_[np.uint64(0), np.cumsum(h * power(BACK)[: self.n], dtype=np.uint64)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.shift[start])

    def windows(self, size: int) -> np.ndarray:
        start = np.arange(max(self.n - size + 1, 0))
        return self.of(start, start + size)


def suffixes(text: str | None, least: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each retained suffix of a whole text: its key (the first least - window words), a hash of its windows, those of
    `least` words whose minimiser it is, its place, and the first and the last start of these windows."""
    ranges = Ranges(words_of(text))
    if ranges.n < least:
        return (np.zeros(0, np.int64),) * 5
    order = ranges.windows(gram)[: ranges.n - least + window]
    low = np.lib.stride_tricks.sliding_window_view(order, window).argmin(1)
    at, lo = np.unique(low + np.arange(len(low)), return_index=True)
    hi = np.r_[lo[1:], len(low)] - 1
    key = ranges.of(at, at + least - window)
    around = mixed(ranges.of(lo, hi + least) + ((at - lo) * least + hi - lo).astype(np.uint64))
    return key.view(np.int64), around.view(np.int64), at, lo, hi


def sides(words: list[bytes], ranges: Ranges, at: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes at these places: hashes of the `window` words behind their key (0 past the end), and of the d words
    before them, d = 0 .. window - 1 (0 past the start)."""
    h = np.r_[hashes_of(words), np.zeros(least, np.uint64)]
    right = h[np.minimum(at[:, None] + least - window + np.arange(window), ranges.n)]
    start = at[:, None] - np.arange(window)
    left = np.where(start >= 0, ranges.of(np.maximum(start, 0), np.broadcast_to(at[:, None], start.shape)), np.uint64(0))
    return right, left


def sorted_matches(least: int, window: int):
    """Of whole groups of suffixes by key, each with its neighbourhood's first and last document (a, b): the first and last
    document of each of their windows that several documents hold. A row per window, `back` words before the suffix, or one
    per neighbourhood that several documents share, as all its windows are repeated (back = -1; the smallest first and the
    smallest last one)."""

    def run(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        right = np.frombuffer(b"".join(f["right"]), np.uint64).reshape(len(f), window)
        order = np.lexsort([*right.T[::-1], f["k"].to_numpy()])
        f, right = f.iloc[order].reset_index(drop=True), right[order]
        left = np.frombuffer(b"".join(f["left"]), np.uint64).reshape(len(f), window)
        k, a, b, at, lo, hi = (f[c].to_numpy(np.int64) for c in ("k", "a", "b", "at", "lo", "hi"))
        # what neighbours share behind their key; nothing where the key differs
        shared = np.r_[-1, np.where(k[1:] == k[:-1], np.logical_and.accumulate(right[1:] == right[:-1], 1).sum(1), -1)]
        whole, first, last = a < b, np.full(len(f), np.iinfo(np.int64).max), np.full(len(f), np.iinfo(np.int64).max)
        out = []
        for d in range(window):  # windows that start d words before the suffix reach window - d words behind its key
            run_of = np.cumsum(shared < window - d)
            ok = np.flatnonzero((at - d >= lo) & (at - d <= hi))
            by = ok[np.lexsort((left[ok, d], run_of[ok]))]
            if not len(by):
                continue
            start = np.flatnonzero(np.r_[True, (run_of[by][1:] != run_of[by][:-1]) | (left[by, d][1:] != left[by, d][:-1])])
            size = np.diff(np.r_[start, len(by)])
            mn, mx = np.repeat(np.minimum.reduceat(a[by], start), size), np.repeat(np.maximum.reduceat(b[by], start), size)
            first[by], last[by] = np.minimum(first[by], mn), np.minimum(last[by], mx)
            hit = (mn < mx) & ~whole[by]
            out.append(f.loc[by[hit], ["k", "around"]].assign(back=d, a=mn[hit], b=mx[hit]))
        out.append(f.loc[whole, ["k", "around"]].assign(back=-1, a=first[whole], b=last[whole]))
        yield pd.concat(out)

    return run


def spans(least: int):
    """Runs of window starts of one document that follow each other, from intervals sorted by document and start."""

    def run(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        doc, copy, lo, hi, other = (f[c].to_numpy() for c in ("doc_id", "copy", "lo", "hi", "other"))
        new = np.r_[True, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])]
        part = np.cumsum(new) << 32
        last = np.maximum.accumulate(part + hi)  # the largest end so far within the document
        first = np.flatnonzero(np.r_[True, (part + lo)[1:] > last[:-1] + 1])
        end = (last[np.r_[first[1:], len(f)] - 1] & 0xFFFFFFFF) + least
        yield pd.DataFrame({"doc_id": doc[first], "start_word": lo[first], "end_word": end, "n_words": end - lo[first], "other_doc_id": np.minimum.reduceat(other, first)})

    return run


def repeated_passages(docs: DataFrame, least: int = 50, window: int = 20, gram: int = 5, most: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_doc_id: the passages of at least `least` words that another document
    holds. A span is a longest run of windows of `least` words of which each stands in another document as well (equal
    by 64-bit hashes). other_doc_id: each window names its first document, in that one its last; of a span's windows the
    smallest that is named.

    Every window of `least` words has one minimiser in its first `window` positions, a retained suffix whose key lies
    within it, and every copy of the window has the same one. (1) Suffixes whose key no other document holds are dropped. (2) Suffixes
    with equal key and equal surroundings stand in the same windows and are merged, with their first and last document;
    where a key has no other surroundings, that is all there is to tell. (3) Else one suffix of each of its different
    surroundings is sorted among them and matched to both sides (sorted_matches). Keys with more than `most` different
    surroundings, which no single task should sort, are told window by window instead, by the windows' hashes. Each step
    counts before it shuffles or joins two written tables, whose hot keys Spark splits, so neither copies nor a passage
    that many documents share gather in one task, and no result depends on the size of a group.

    Null and empty texts and rows without id have no passage. Rows that repeat an id are one document of several texts
    (told apart by 64-bit hashes): passages they share among each other do not count, and their spans are listed under the
    one id, each within its own text. An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    d = d.withColumn("copy", F.xxhash64("text"))

    def retained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.iloc[k : k + 200]
                found = [suffixes(t, least, window, gram) for t in part["text"]]
                n = [len(f[0]) for f in found]
                if sum(n):
                    columns = {c: np.concatenate([f[x] for f in found]) for x, c in enumerate(("k", "around", "at", "lo", "hi"))}
                    yield pd.DataFrame({"doc_id": np.repeat(part["doc_id"].to_numpy(), n), "copy": np.repeat(part["copy"].to_numpy(), n), **columns})

    row, place = ["doc_id", "copy", "lo", "hi"], ["doc_id", "copy", "at", "lo", "hi"]
    rows = written(d.mapInPandas(retained, "doc_id long, copy long, k long, around long, at int, lo int, hi int"))
    other = F.when(F.col("a") != F.col("doc_id"), F.col("a")).otherwise(F.col("b")).alias("other")
    ends = (F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    keys = rows.groupBy("k").agg(*ends, F.min("around").alias("x"), F.max("around").alias("y"))
    keys = written(keys.where("a <> b").select("k", "a", "b", (F.col("x") != F.col("y")).alias("several")))
    met = written(rows.join(keys, "k"))
    alike = met.where("not several").select(*row, other)

    several = met.where("several").select("k", "around", *place)
    groups = written(several.groupBy("k", "around").agg(F.min(F.struct(*place)).alias("one"), *ends))
    many = written(groups.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("k", F.lit(True).alias("many")))
    one = groups.join(many, "k", "left").select("one.*", "k", "around", "a", "b", F.coalesce("many", F.lit(False)).alias("many"))
    fields = ["k", "around", "at", "lo", "hi", "a", "b", "many"]
    asked = one.groupBy("doc_id", "copy").agg(F.collect_list(F.struct(*fields)).alias("q")).select("doc_id", "copy", *[F.col(f"q.{c}").alias(c) for c in fields])

    def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.iloc[k : k + 200]
                right, left, windows = [], [], []
                for text, at, lo, hi, many in zip(*(part[c] for c in ("text", "at", "lo", "hi", "many")), strict=True):
                    words = words_of(text)
                    ranges = Ranges(words)
                    r, x = sides(words, ranges, at, least, window)
                    right += list(map(bytes, r))
                    left += list(map(bytes, x))
                    for first, last, by_windows in zip(lo, hi, many, strict=True):
                        starts = np.arange(first, last + 1)
                        windows.append(ranges.of(starts, starts + least).view(np.int64) if by_windows else None)
                yield pd.DataFrame({c: np.concatenate(part[c].to_list()) for c in fields} | {"right": right, "left": left, "windows": windows})

    sortable = "k long, around long, at int, lo int, hi int, a long, b long, many boolean, right binary, left binary, windows array<long>"
    told = written(d.join(asked, ["doc_id", "copy"]).mapInPandas(surroundings, sortable))
    matched = by_sorted_groups(told.where("not many").drop("many", "windows"), ["k"], [], sorted_matches(least, window), "k long, around long, back int, a long, b long")

    each = told.where("many").select("k", "around", "a", "b", "at", "lo", F.posexplode("windows").alias("p", "w"))
    shared = written(each.groupBy("w").agg(F.min("a").alias("mn"), F.max("b").alias("mx")).where("mn <> mx"))
    hit = each.join(shared, "w")
    single = hit.where("a = b").select("k", "around", (F.col("at") - F.col("lo") - F.col("p")).alias("back"), F.col("mn").alias("a"), F.col("mx").alias("b"))
    common = hit.where("a <> b").groupBy("k", "around").agg(F.lit(-1).alias("back"), F.min("mn").alias("a"), F.min("mx").alias("b"))
    matched = written(matched.unionByName(single).unionByName(common))

    # what is told of one suffix holds for all with the same surroundings
    bound = lambda c: F.when(F.col("back") < 0, F.col(c)).otherwise(F.col("at") - F.col("back")).alias(c)
    alike = alike.unionByName(several.join(matched, ["k", "around"]).select("doc_id", "copy", bound("lo"), bound("hi"), other))
    found = by_sorted_groups(alike, ["doc_id", "copy"], ["lo"], spans(least), "doc_id long, start_word int, end_word int, n_words int, other_doc_id long")
    return found.distinct()
