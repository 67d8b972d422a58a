"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of three characters, gaps allowed: a subsequence that spans s characters weighs
decay^s, and spans go up to `span`. It is normalised, so k(u, u) = 1. An inserted or doubled character leaves most
subsequences in place, which is why disguised insults keep a high kernel value with the plain ones.

A sentence is judged by its most suspicious unit (a word, or letters set apart), a text by its most suspicious sentence.
Training follows that: labelled sentences are bags of units (multiple-instance learning). A sentence of a clean text is
an example by the unit that the machine of the round before found most suspicious; sentences of toxic texts by units
typical of these, plain and with letters inserted. The landmark expansion is linear in the subsequence counts, so it folds
into one weight per subsequence, and scoring needs no kernel evaluations at all. Units of fewer than three characters
hold no subsequence; insults of several words are seen by their words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import labelled_sample, logistic, platt, received, sent

PARTS, HELD_OUT = 5, 0
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
SPACED = re.compile(r"(?:(?<=\s)|^)(?:\w[\W_]{1,3}){2,}\w(?=\s|$|[\W_]+(?:\s|$))")
LONGEST = 24
OWN, SHARED = 200, 50


def tokens_of(text: str) -> set[str]:
    """Raw units of a whole text: its words, and runs of single characters joined to a word."""
    low = text.lower()
    out = set(low.split())
    if len(low) > 4:
        for m in SPACED.finditer(low):
            if " " in m[0] or "\t" in m[0] or "\n" in m[0]:
                out.add(INNER.sub("", m[0]))
    return out


def forms(token: str) -> list[str]:
    """What of a token is scored: without outer punctuation, also without inner punctuation, long ones in overlapping parts."""
    bare = EDGE.sub("", token)
    all_ = [bare] if not INNER.search(bare) else [bare, INNER.sub("", bare)]
    return [f[k : k + LONGEST] for f in all_ if len(f) > 2 for k in range(0, max(1, len(f) - LONGEST // 2), LONGEST // 2)]


def matrix(words: list[str]) -> np.ndarray:
    """Code points of words, one row each, padded with 0."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), LONGEST), np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.repeat(np.arange(len(words)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


@dataclass
class Kernel:
    decay: float = 0.6
    span: int = 6

    def steps(self) -> Iterator[tuple[int, int, float]]:
        for b in range(2, self.span):
            for a in range(1, b):
                yield a, b, self.decay ** (b + 1)

    def counts(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, subsequence and weight of every distinct subsequence of each row."""
        code, row, weight = [], [], []
        wide = chars.shape[1]
        for a, b, w in self.steps():
            c = (chars[:, : wide - b] << 42) | (chars[:, a : wide - b + a] << 21) | chars[:, b:]
            r, k = np.nonzero(chars[:, b:])
            code.append(c[r, k])
            row.append(r)
            weight.append(np.full(len(r), w))
        code, row, weight = map(np.concatenate, (code, row, weight))
        order = np.lexsort((code, row))
        code, row, weight = code[order], row[order], weight[order]
        if not len(code):
            return row, code, weight
        first = np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]
        return row[first], code[first], np.add.reduceat(weight, np.flatnonzero(first))

    def norms(self, chars: np.ndarray) -> np.ndarray:
        row, _, weight = self.counts(chars)
        return np.sqrt(np.bincount(row, weights=weight**2, minlength=len(chars)))

    def against(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        """Normalised kernel values, words by landmarks."""
        lr, lc, lw = self.counts(lm := matrix(landmarks))
        codes, at = np.unique(lc, return_inverse=True)
        table = np.zeros((len(codes), len(landmarks)))
        table[at, lr] = lw / np.maximum(self.norms(lm), 1e-12)[lr]
        out = np.zeros((len(words), len(landmarks)))
        for lo in range(0, len(words), 64):
            r, c, w = self.counts(m := matrix(words[lo : lo + 64]))
            norm = np.maximum(np.sqrt(np.bincount(r, weights=w**2, minlength=len(m))), 1e-12)
            k = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            hit = codes[k] == c
            r, k, w = r[hit], k[hit], w[hit]
            if len(r):
                first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                out[lo + r[first]] = np.add.reduceat(table[k] * w[:, None], first)
            out[lo : lo + 64] /= norm[:, None]
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, rounds: int = 25, block: int = 2000) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton steps, block by block; the last column of x is the
    offset."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(rounds):
        left, right = np.diag(reg), np.zeros(x.shape[1])
        for at in range(0, len(x), block):
            part = x[at : at + block].astype(float)
            act = y[at : at + block] * (part @ w) < 1
            part, c = part[act], cost[at : at + block][act]
            left += (part * c[:, None]).T @ part
            right += part.T @ (c * y[at : at + block][act])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def damped(values: np.ndarray) -> np.ndarray:
    """Far beyond the margin a decision value tells little more."""
    return np.sign(values) * np.log1p(np.abs(values))


def disguised(word: str, n: int, rng) -> str:
    """The word with n letters inserted between its own, some of them doubled ones."""
    out = list(word)
    for _ in range(n):
        k = int(rng.integers(1, len(out)))
        out.insert(k, out[k - 1] if rng.random() < 0.2 else chr(97 + int(rng.integers(0, 26))))
    return "".join(out)[:LONGEST]


@dataclass
class Model:
    """Subsequence weights folded from the landmark expansion, offset and calibration; at most 251^3 weights.

    classes: code point to class, 0 for characters that training has not met."""

    kernel: Kernel
    classes: dict[int, int]
    size: int
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def units(self, words: list[str]) -> np.ndarray:
        """Decision values; units without any weight towards toxic get the offset alone."""
        out = np.full(len(words), self.offset)
        n = self.size
        to = np.zeros(0x110000, np.int32)
        to[list(self.classes)] = list(self.classes.values())
        for lo in range(0, len(words), 4096):
            m = matrix(words[lo : lo + 4096])
            c = to[m]
            raw = np.zeros(len(m), np.float64)
            wide = c.shape[1]
            for a, b, w in self.kernel.steps():
                raw += w * self.weights[(c[:, : wide - b] * n + c[:, a : wide - b + a]) * n + c[:, b:]].sum(1)
            up = np.flatnonzero(raw > 1e-6)
            if len(up):
                out[lo + up] += raw[up] / np.maximum(self.kernel.norms(m[up]), 1e-12)
        return out

    def texts(self, texts: list[str | None], seen: dict[str, float]) -> np.ndarray:
        """Probability for each text. seen holds the values of units that occurred before."""
        bags = [tokens_of(t) if t else set() for t in texts]
        new = list({u for bag in bags for u in bag if u not in seen})
        if len(seen) + len(new) > 1_000_000:
            seen.clear()
            new = list({u for bag in bags for u in bag})
        parts = [forms(u) for u in new]
        flat = self.units([p for ps in parts for p in ps])
        at = 0
        for u, ps in zip(new, parts, strict=True):
            seen[u] = max(flat[at : at + len(ps)], default=self.offset)
            at += len(ps)
        top = np.array([max(map(seen.__getitem__, bag), default=self.offset) for bag in bags], float)
        return logistic(self.slope * damped(np.maximum(top, self.offset)) + self.shift)


def folded(kernel: Kernel, landmarks: list[str], alpha: np.ndarray, classes: dict[int, int], size: int) -> np.ndarray:
    """One weight per subsequence of classes, such that a unit's weights add up to its norm times the sum of alpha times
    its kernel values against the landmarks, as long as its characters have classes of their own."""
    row, code, weight = kernel.counts(lm := matrix(landmarks))
    weight = weight / np.maximum(kernel.norms(lm), 1e-12)[row] * alpha[row]
    place = [np.array([classes[int(c)] for c in (code >> s) & 0x1FFFFF], np.int64) for s in (42, 21, 0)]
    return np.bincount((place[0] * size + place[1]) * size + place[2], weights=weight, minlength=size**3).astype(np.float32)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s]


def chief(bags: list[set[str]], marked: list[tuple[float, str]], low: Counter, least: float) -> list[str]:
    """Of the marks of toxic texts: the first ones, then one after the other that which stands in most of the texts
    without any of the others yet."""
    out = [u for z, u in marked[:16] if z > 3.5]
    every = {u for _, u in marked}
    left = [bag & every for bag in bags if not bag.intersection(out)]
    while True:
        count = Counter(u for bag in left for u in bag)
        best = max(count, key=lambda u: (count[u] / (1 + low[u]), u), default=None)
        if best is None or count[best] < max(2, least * len(bags)):
            return out or [u for _, u in marked[:20]]
        out.append(best)
        left = [bag for bag in left if best not in bag]


def fit(sample: pd.DataFrame, landmarks: int = 192, kernel: Kernel | None = None, rounds: int = 8, penalty: float = 1000.0, variants: int = 100, seed: int = 3) -> Model | None:
    """Train on the sentences of labelled texts (text, y of the text). Without both classes there is no model.

    A mark is a unit that stands in more toxic texts than clean ones. Positive examples are the marks; the chief ones weigh
    most, and each comes with `variants` forms of one or two inserted letters. Negative examples are units of clean
    sentences: a draw, and in each round the most suspicious ones, which become landmarks too.
    """
    kernel = kernel or Kernel()
    if sample["y"].nunique() < 2:
        return None
    rng = np.random.default_rng(seed)
    y = sample["y"].to_numpy()
    bags, owner = [], []
    for k, text in enumerate(sample["text"]):
        for s in sentences(text):
            bags.append({f for u in tokens_of(s) for f in forms(u)})
            owner.append(k)
    owner = np.array(owner, np.int64)
    texts: list[set[str]] = [set() for _ in y]
    for k, bag in zip(owner.tolist(), bags, strict=True):
        texts[k] |= bag
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    df = {k: Counter(u for bag, label in zip(texts, y, strict=True) if label == k for u in bag) for k in (0, 1)}

    def lift(u: str) -> float:
        p1, p0 = (df[1][u] + 0.5) / (n[1] + 1), (df[0][u] + 0.5) / (n[0] + 1)
        return (p1 - p0) / np.sqrt(p1 * (1 - p1) / n[1] + p0 * (1 - p0) / n[0])

    marked = sorted(((lift(u), u) for u in df[1] if df[1][u] > 1 and df[1][u] / n[1] > 3 * df[0][u] / n[0]), reverse=True)
    usual = [u for u, _ in sorted(df[0].items(), key=lambda t: (-t[1], t[0]))[: landmarks // 4]]
    marks = [u for _, u in marked[: landmarks - len(usual)]]
    if not marks or not usual:
        return None
    strong = [(z, u) for z, u in marked if z > 2.5]
    first = chief([bag for bag, label in zip(texts, y, strict=True) if label == 1], strong or marked, df[0], 0.005)
    positive = {u: 0.05 for _, u in strong}
    for u in first:
        positive[u] = 1.0
    for u in first:
        for k in range(variants if len(u) > 3 else 0):
            v = disguised(u, 1 + k % 2, rng)
            positive[v] = positive.get(v, 0.0) + 8.0 / variants
    clean = sorted(df[0])
    negative = {*usual, *(clean[k] for k in rng.permutation(len(clean))[:3000])}
    points = sorted({*marks, *usual})

    def expanded() -> np.ndarray:
        """Nystroem: k(u, landmarks) @ root."""
        values, vectors = np.linalg.eigh(kernel.against(points, points))
        good = values > 1e-6
        return vectors[:, good] / np.sqrt(values[good])

    def features(words: list[str]) -> np.ndarray:
        out = np.ones((len(words), root.shape[1] + 1), np.float32)
        for at in range(0, len(words), 2000):
            out[at : at + 2000, :-1] = kernel.against(words[at : at + 2000], points) @ root
        return out

    root = expanded()
    # the commonest characters have a class of their own, all others share the next ones
    letters = Counter(c for u in [*df[0], *df[1], *positive] for c in u).most_common()
    classes = {ord(c): k + 1 if k < OWN else OWN + 1 + ord(c) % SHARED for k, (c, _) in enumerate(letters)}
    size = max(classes.values()) + 1
    every = sorted({u for bag in bags for u in bag})
    model = None
    for turn in range(rounds):
        for u in negative:
            positive.pop(u, None)
        words = [*sorted(positive), *sorted(negative)]
        label = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        cost = np.array([*(positive[u] for u in sorted(positive)), *(max(df[0][u], 1) ** 0.5 for u in sorted(negative))], float)
        cost[label > 0] *= 0.5 * cost[label < 0].sum() / max(cost[label > 0].sum(), 1e-9)
        w = squared_hinge(features(words), label, cost * penalty)
        model = Model(kernel, classes, size, folded(kernel, points, root @ w[:-1], classes, size), float(w[-1]), 1.0, 0.0)
        value = dict(zip(every, model.units(every).tolist(), strict=True))
        # the most suspicious unit of each sentence
        worst = [max(bag, key=lambda u: (value[u], u), default=None) for bag in bags]
        top = np.full(len(y), model.offset)
        np.maximum.at(top, owner, [model.offset if u is None else value[u] for u in worst])
        model.slope, model.shift = platt(damped(top), y)
        toxic = y[owner] == 1
        found = {u for u, bad in zip(worst, toxic, strict=True) if bad and u and value[u] > 0 and u not in df[0]}
        hard = {u for u, bad in zip(worst, toxic, strict=True) if not bad and u and value[u] > -0.5}
        hard = sorted(hard, key=lambda u: (-value[u], u))[:1000]
        grown = not found <= positive.keys() or not negative.issuperset(hard)
        negative.update(hard)
        for u in found:
            positive.setdefault(u, 0.05)
        if turn < 5:
            points = sorted({*points, *hard[:60]})
            root = expanded()
        elif not grown:
            break
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score (0 to 1). Null and empty texts have no unit and get the lowest score; without a model all get 0."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = sent(docs.sparkSession, model)  # size bound: 251^3 weights of 4 bytes

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, seen = received(shared), {}
        for texts in batches:
            yield pd.Series(np.concatenate([known.texts(list(texts.iloc[k : k + 500]), seen) for k in range(0, len(texts), 500)] or [np.zeros(0)]))

    return docs.withColumn("score", toxic(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 800, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs with score, predicted (1 from the threshold on). Fitted on the sentences of at most per_class labelled rows of
    each class outside the held-out fold; all rows are scored over their whole text. Repeated rows are scored each, equal
    texts alike; columns score and predicted are replaced, others pass through; an empty table stays empty.

    Fitting draws at most 3,000 units of clean sentences and, in each round, the 1,000 most suspicious ones. The 200
    commonest characters of the labelled sentences have a class of their own, all others share 50 classes."""
    model = fit(labelled_sample(docs, labels, "toxic", PARTS, HELD_OUT, per_class, text))
    return score(docs, model, text).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
