"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Whole windows are cut off long documents first; what remains of each document is cut into pieces of at most `piece`
ids. Pools of pieces are then dealt out to windows: two partial partitions with the widest spreads are merged, fullest
window on emptiest, until one partition is left. Its windows are nearly equal; as long as the fullest one exceeds the
capacity, the number of windows rises and the pool is differenced again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differenced(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Indices of sizes for each of k windows of nearly equal sums."""
    n = len(sizes)
    after = np.full(n, -1)
    heap: list = []
    for i, s in enumerate(sizes.tolist()):
        sums, head = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], head[0] = s, i
        heap.append((-s, i, sums, head, head.copy()))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, s1, h1, t1 = heapq.heappop(heap)
        _, _, s2, h2, t2 = heapq.heappop(heap)
        s, h2, t2 = s1 + s2[::-1], h2[::-1], t2[::-1]  # largest of one meets smallest of the other
        both = (h1 >= 0) & (h2 >= 0)
        after[t1[both]] = h2[both]
        head, tail = np.where(h1 >= 0, h1, h2), np.where(t2 >= 0, t2, t1)
        order = np.argsort(-s, kind="stable")
        s = s[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), turn, s, head[order], tail[order]))
        turn += 1
    out = []
    for i in heap[0][3].tolist() if heap else []:
        one = []
        while i >= 0:
            one.append(i)
            i = int(after[i])
        out.append(one)
    return out


def windows_of(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Near-equal windows, none above capacity; the count rises until that holds. Every size is at most capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differenced(sizes, k)
        over = max((int(sizes[w].sum()) for w in found), default=0) - capacity
        if over <= 0:
            return [sorted(w) for w in found if w]
        # the excess of the fullest window tells how much room the mean window still needs
        k += max(1, int(k * over / (2 * capacity)))


def encoder(vocabulary: str, pattern: str, special: dict[str, int]):
    """The byte-level vocabulary as ranks; gives the ids of the JSON tokenizer of the same vocabulary, several times faster."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def packed(docs: DataFrame, capacity: int = 2048, end_id: int = 1, piece: int = 512, pool: int = 192, vocabulary: str = "byte_bpe_50k.tiktoken", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bit, binary).

    Each partition of docs packs its own rows in pools of about `pool` windows, without a shuffle and in bounded
    memory: only the last pool of a partition may be small. A task that runs again reads the same rows in the same
    order and gives the same sequences. The ids are those of the JSON tokenizer of the same vocabulary, without special
    tokens and with end_id behind each document (a test compares the two encoders). Null and empty texts give the end id alone; rows that repeat an id are
    documents of their own; an empty table gives no piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        enc = encoder(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
        base, made = TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []
        held = 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            return out.assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))

        def dealt() -> pd.DataFrame:
            nonlocal made, held
            rows = []
            for window in windows_of(np.array([w[2] for w in waiting], np.int64), capacity):
                at = 0
                for i in window:
                    d, start, length, total, ids = waiting[i]
                    rows.append((d, start, length, total, base + made, at, ids))
                    at += length
                made += 1
            waiting.clear()
            held = 0
            return frame(rows)

        for batch in batches:
            full = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                d = None if d is None else int(d)
                ids = np.array([*(enc.encode(t, allowed_special="all") if t else ()), end_id], "<u4")
                total, start = len(ids), 0
                while total - start >= capacity:
                    full.append((d, start, capacity, total, base + made, 0, ids[start : start + capacity].tobytes()))
                    made += 1
                    start += capacity
                while start < total:
                    length = min(piece, total - start)
                    waiting.append((d, start, length, total, ids[start : start + length].tobytes()))
                    held += length
                    start += length
                if held >= pool * capacity:
                    yield dealt()
                if len(full) >= 500:
                    yield frame(full)
                    full = []
            if full:
                yield frame(full)
        if waiting:
            yield dealt()

    # ids as text: a null beside a large one would make pandas round it
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def padding(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """sequences, ids, padding: a sequence is padded to capacity unless its length is a power of two."""
    n = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.bit_count("n") == 1
    return n.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(whole, 0).otherwise(capacity - F.col("n"))).alias("padding"))
