"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, shortens a text more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import labelled_sample, logistic, platt, received, sent

PARTS, HELD_OUT = 3, 1


@dataclass
class Model:
    """Two dictionaries of bounded size and the logistic curve of the size difference."""

    good: bytes
    bad: bytes
    slope: float
    shift: float
    piece: int
    level: int

    def sizes(self) -> tuple:
        pack = lambda d: zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        return pack(self.good), pack(self.bad)

    def difference(self, text: str | None, tools: tuple) -> float:
        """By how many bytes a byte of the whole text the dictionary of good text shortens it more than that of bad text.

        The text is taken piece by piece, so that the dictionaries stay in reach. The difference is normalised by the
        text's size, not by the compressed sizes: plain repetition, which either dictionary shortens to almost nothing,
        then stays near 0 and below good text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        parts = [data[at : at + self.piece] for at in range(0, len(data), self.piece)]
        good, bad = (sum(len(tool.compress(p)) for p in parts) for tool in tools)
        return (bad - good) / max(len(data), 1)

    def scores(self, texts, tools: tuple) -> np.ndarray:
        x = np.fromiter((self.difference(t, tools) for t in texts), float, len(texts))
        return logistic(self.slope * x + self.shift)


def dictionary(texts: list[str], size: int, piece: int) -> bytes:
    parts = [b[k : k + piece] for t in texts if (b := t.encode("utf-8", "surrogatepass")) for k in range(0, len(b), piece)]
    parts = [p for p in parts if len(p) >= 8]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: the pieces themselves are the dictionary
        return b"".join(parts)[:size] or b"00000000"


def fit(sample: pd.DataFrame, size: int = 1 << 18, piece: int = 1024, level: int = 3) -> Model | None:
    """Two thirds of the sampled texts build the dictionaries, one third calibrates. One class alone: no model."""
    if sample["y"].nunique() < 2:
        return None
    order = np.random.default_rng(5).permutation(len(sample))
    sample = sample.iloc[order].reset_index(drop=True)
    rank = sample.groupby("y").cumcount()
    build, tune = sample[rank % 3 != 2], sample[rank % 3 == 2]
    if tune["y"].nunique() < 2:
        tune = sample
    half = lambda y: dictionary(list(build["text"][build["y"] == y]), size, piece)
    model = Model(half(1), half(0), 1.0, 0.0, piece, level)
    tools = model.sizes()
    model.slope, model.shift = platt(np.array([model.difference(t, tools) for t in tune["text"]]), tune["y"].to_numpy())
    return model


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted. Fitted on at most per_class labelled rows of each class
    outside the held-out fold; every whole text is scored. Null and empty texts have the difference 0, as plain
    repetition has, and get its score; without a model all get 0.5. Repeated rows are scored each, equal texts alike;
    columns score and predicted of docs are replaced, others pass through; an empty table stays empty."""
    model = fit(labelled_sample(docs, labels, "quality", PARTS, HELD_OUT, per_class, text))
    if model is None:
        return docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1))
    shared = sent(docs.sparkSession, model)  # two dictionaries of at most `size` bytes

    @F.pandas_udf("double")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = received(shared)
        tools = m.sizes()
        for texts in batches:
            yield pd.Series(m.scores(texts, tools))

    return docs.withColumn("score", good(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
