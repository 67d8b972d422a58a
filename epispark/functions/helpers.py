"""Vectorised helpers for what Spark has no function for: distribution functions, brace scan, text splitter."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))), na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_tails(z: pd.Series) -> pd.Series:
    """Probability of a normal value at least as far from 0 as z, on either side."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype("float64")


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction, evaluated forwards (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    tiny = 1e-300
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + n * d) or tiny), (1 + n / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_tails(t: float, df: float) -> float:
    """Probability that Student's t with df degrees of freedom is at least as far from 0 as t, on either side."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_tails(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else student_tails(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def smallest_count(mean: float, dispersion: float, level: float) -> float:
    """Smallest integer whose distribution function reaches level: Poisson up to dispersion 1, else negative binomial."""
    if mean is None or not mean > 0:
        return 0.0
    variance = mean if dispersion <= 1 else mean + (dispersion - 1) * mean * mean
    n = None if dispersion <= 1 else mean * mean / (variance - mean)
    k = np.arange(0, int(mean + 12 * math.sqrt(variance)) + 30)
    if n is None:
        steps = np.concatenate([[-mean], np.log(mean) - np.log(k[1:])])
    else:
        q = mean / (n + mean)
        steps = np.concatenate([[n * math.log(n / (n + mean))], np.log(n + k[1:] - 1) - np.log(k[1:]) + math.log(q)])
    return float(k[min(int(np.searchsorted(np.cumsum(np.exp(np.cumsum(steps))), level)), len(k) - 1)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def count_quantiles(mean: pd.Series, dispersion: pd.Series) -> pd.Series:
    """0.05, 0.5 and 0.95 quantiles of a count."""
    return pd.Series([[smallest_count(m, d, q) for q in (0.05, 0.5, 0.95)] for m, d in zip(mean, dispersion, strict=True)])


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text that is JSON, strings respected."""
    start = text.find("{") if text else -1
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for k in range(start, len(text)):
            c = text[k]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        json.loads(text[start : k + 1])
                    except (ValueError, RecursionError):
                        break
                    return text[start : k + 1]
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def json_object_in(text: pd.Series) -> pd.Series:
    return text.map(first_object, na_action="ignore")


def splitter(size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")):
    """Chunks of at most size characters, cut at the best separator of the last stretch.

    A row function: Spark hands on 100 texts at a time, where an Arrow batch would hold 10,000 texts and all their chunks.
    """

    @F.udf(T.ArrayType(T.StringType()), useArrow=False)
    def chunks(t: str | None) -> list[str]:
        out, at = [], 0
        while t and at < len(t):
            end = min(len(t), at + size)
            if end < len(t):
                cut = next((c for s in separators if (c := t.rfind(s, at + overlap + 1, end)) > 0), -1)
                end = cut if cut > 0 else end
            out.append(t[at:end].strip())
            at = end if end == len(t) else max(end - overlap, at + 1)
        return [c for c in out if c]

    return chunks


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Containers(HTMLParser):
    """Text of the first element of each selector (a tag, .class or #id), and of the whole page: the strings between tags,
    in order, without scripts, styles and comments. Elements nest by their start and end tags; an end tag closes what was
    left open inside it, and one that closes nothing is passed over."""

    def __init__(self, selectors: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.selectors, self.open, self.count = selectors, [], {}
        self.found: dict[str, list[str]] = {}
        self.page: list[str] = []
        self.running: list[list[str]] = [self.page]
        self.pending: list[str] = []

    def flush(self) -> None:
        """Pass on what lies between two tags as one string; of white space alone one character is left."""
        text = "".join(self.pending)
        self.pending.clear()
        if text and not (self.open and self.open[-1][0] in ("script", "style", "template")):
            text = text if text.strip(" \n\t\f\r") else "\n" if "\n" in text else " "
            for texts in self.running:
                texts.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag in VOID:
            return
        held = []
        if len(self.found) < len(self.selectors):
            a = dict(attrs)
            names = {tag, *("." + c for c in (a.get("class") or "").split()), "#" + (a.get("id") or "")}
            held = [s for s in self.selectors if s in names and s not in self.found]
            for s in held:
                self.found[s] = []
                self.running.append(self.found[s])
        self.open.append((tag, len(held)))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if not self.count.get(tag):
            return
        while True:
            last, held = self.open.pop()
            self.count[last] -= 1
            del self.running[len(self.running) - held :]
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()

    def close(self) -> None:
        super().close()
        self.flush()


def article_parts(html: str | None, containers: Sequence[str], least: int) -> tuple[str, str]:
    """(title, main text) of a page. The title is that of the title element, else of the first h1. The main text is that of
    the first container of the list that is there with more than `least` characters, else of the last one that is there,
    else of the page; strings are joined by line ends, and the whole is trimmed."""
    page = Containers(["title", "h1", *containers])
    page.feed(html or "")
    page.close()
    title = "".join(page.found.get("title", page.found.get("h1", []))).strip()
    main = ""
    for c in containers:
        if c in page.found:
            main = "\n".join(page.found[c]).strip()
            if len(main) > least:
                break
    return title, main or "\n".join(page.page).strip()


def article_reader(containers: Sequence[str], least: int):
    """article_parts as a column function of html."""

    @F.pandas_udf("title string, main string")
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article_parts(h, containers, least) for h in html], columns=["title", "main"])

    return read
