"""Spelling variants among the words of a corpus, by pivotal grams.

Words within one edit of each other share one of two disjoint bigrams of either, at a place that the edit can at most
move by one. Bigrams are ordered from rare to frequent; the first three of a word, with all that tie with the third, are
its prefix, and of the prefix two disjoint ones are chosen, with the fewest postings in all: its pivots. Of two near
words, the one whose prefix ends earlier in that order has a pivot in the prefix of the other, so pivots are looked up in
an index of prefixes by bigram, place and length, and what is found there is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import cut, written

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GRAM, PIVOTS = 2, 2  # one edit breaks one of two disjoint grams, and at most two grams of two letters
KEPT_WORDS = 500_000  # different words that a task holds before it passes their counts on


def runs_of(doc_id: str, text: bytes, every: int = 97) -> Counter:
    """Occurrences of the words of one text: its runs of letters, A-Z lower-cased. Where `every` divides the crc32 of
    `<doc_id>:<run>`, the run lacks the code point at that number modulo its length."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(LOWER).decode(errors="replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, shortest: int, least: int, every: int, doc_id: str, text: str) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur at least `least` times in all texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for doc, body in zip(b["doc"], b["body"], strict=True):
                n.update(runs_of(doc, body, every))
                if len(n) > KEPT_WORDS:
                    yield frame(n)
                    n.clear()
        yield frame(n)

    def frame(n: Counter) -> pd.DataFrame:
        return pd.DataFrame([(w, c) for w, c in n.items() if len(w) >= shortest], columns=["word", "n"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).cast("binary").alias("body")).where("body is not null")
    return rows.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def prefix_of(ranks: Sequence[int]) -> list[int]:
    """Places of the rarest GRAM + 1 grams of a word, with all grams that tie with the last of them."""
    last = sorted(ranks)[GRAM]
    return [p for p, r in enumerate(ranks) if r <= last]


def pivots_of(places: Sequence[int], weights: Sequence[int]) -> list[int]:
    """PIVOTS of the places (ascending) that lie at least GRAM apart, of least total weight, by dynamic programming:
    the best choice of k among the first i places either leaves place i out, or takes it after the best choice of k - 1
    among those that end before it."""
    best = [[(0, ())] + [None] * PIVOTS]
    free = 0  # how many places end before place i
    for i, p in enumerate(places):
        while places[free] <= p - GRAM:
            free += 1
        row = list(best[i])
        for k in range(1, PIVOTS + 1):
            if (before := best[free][k - 1]) is not None and (row[k] is None or before[0] + weights[i] < row[k][0]):
                row[k] = (before[0] + weights[i], (*before[1], p))
        best.append(row)
    return list(best[-1][PIVOTS][1])


def key_of(gram: int, place: int, size: int) -> int:
    return (gram << 50) | (place << 25) | size


def letters_of(word: str) -> int:
    """63 bits, each the parity of the letters that fall on it. One edit changes at most two of them."""
    out = 0
    for c in word:
        out ^= 1 << ord(c) % 63
    return out


def signed(word: str, n: int, rank: dict[str, int], count: dict[str, int]) -> tuple:
    """What a word is found by: keys of its prefix (index) and of its pivots (asks), and the rank that ends its prefix;
    and its letters, which rule out most words before they are compared."""
    grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
    ranks = [rank[g] for g in grams]
    prefix = prefix_of(ranks)
    asks = []
    for p in pivots_of(prefix, [count[grams[i]] for i in prefix]):
        # a gram that survives an edit stays at its place, or moves with the length if the edit lies before it
        asks += [key_of(ranks[p], at, len(word) + d) for d in (-1, 0, 1) for at in {p, p + d} if at >= 0]
    return word, n, letters_of(word), max(ranks[p] for p in prefix), [key_of(ranks[p], p, len(word)) for p in prefix], asks


def near_words(words: DataFrame) -> DataFrame:
    """(a, an, b, bn), a < b: each pair of different words with exactly one inserted, deleted or replaced code point
    between them, once. words: (word, n), one row a word, of at least four code points."""
    gram = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring("word", i, GRAM))
    # at most as many rows as pairs of letters: 90 letters are left after lower-casing, so 8,100
    rows = words.select(F.explode(gram).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    count = {r["gram"]: r["n"] for r in rows}
    rank = {g: k for k, g in enumerate(sorted(count, key=lambda g: (count[g], g)))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([signed(w, n, rank, count) for w, n in zip(b["word"], b["n"], strict=True)], columns=["word", "n", "letters", "last", "index", "asks"])

    s = written(words.mapInPandas(run, "word string, n long, letters long, last int, index array<long>, asks array<long>"))
    index = s.select(F.explode("index").alias("key"), F.col("word").alias("b"), F.col("n").alias("bn"), F.col("letters").alias("bletters"), F.col("last").alias("blast"))
    asks = s.select(F.explode("asks").alias("key"), F.col("word").alias("a"), F.col("n").alias("an"), F.col("letters").alias("aletters"), F.col("last").alias("alast"))
    found = asks.join(index, "key").where("alast <= blast and bit_count(aletters ^ bletters) <= 2 and a <> b").where(F.levenshtein("a", "b", 1) == 1)
    first = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return found.select(pick("a", "b", "a"), pick("an", "bn", "an"), pick("b", "a", "b"), pick("bn", "an", "bn")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) pairs without cycles: forms followed to the last, chains halved in each round."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = cut(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, factor: int = 2, every: int = 97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased (see runs_of), of at least `shortest` code
    points (four or more) and `least` occurrences n. n_near: words at one edit. form: the near word of largest n, of
    equal ones the first in code-point order, if that n is at least `factor` (two or more) times the word's own; form_n
    its n. root: the last word reached by following forms, the word itself without one.

    Null and empty texts have no words. Rows without id count with an empty id, rows that repeat an id or a text count
    each. An empty table gives an empty table. Other columns are ignored, whatever their names. All words of all texts
    are compared; a bigram that very many words hold is only a join key, whose partition Spark splits.
    """
    if shortest < 4 or factor < 2:
        raise ValueError("words need four code points for three bigrams, and factor must be at least 2")
    words = written(word_counts(docs, shortest, least, every, doc_id, text))
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    rows = written(rows)
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
