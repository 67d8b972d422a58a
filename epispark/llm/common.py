"""What the operators of this folder share: tables, lineage cuts, labelled samples and sorted groups."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later jobs neither recompute it nor depend on any executor.

    The tables of an application lie in one folder of its id, to be removed when it has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (made := MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: paths of the tables that written() makes, newest last, for a caller that removes them; None: nobody does
MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def only_newest(spark: SparkSession) -> None:
    """Remove all tables in MADE but the newest, which must be all that is still to be read."""
    made = MADE.get() or []
    while len(made) > 1:
        path = spark._jvm.org.apache.hadoop.fs.Path(made.pop(0))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def columns_but(df: DataFrame, *names: str) -> Column:
    """The columns of df, without those of the given names in any case, as one struct: names inside it clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for tables that change from round to round."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; rows without an id fall into no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int, text: str = "text") -> pd.DataFrame:
    """At most per_class labelled rows of each class, outside the held-out fold, as pandas (text, y).

    The rows are those with the smallest hash of the id, so the sample is the same on every run and at every
    partitioning. Of labels that clash for one id the larger counts, and of texts that repeat an id the smallest, chosen
    before anything goes to the driver. per_class is the documented bound of what the driver gets; everything else is
    not capped.
    """
    ids = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", parts) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    few = None
    for y in (0, 1):
        one = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        few = one if few is None else few.unionByName(one)
    # at most 2 * per_class rows of two numbers
    picked = docs.select("doc_id", F.col(text).alias("text")).where(F.col(text).isNotNull()).join(F.broadcast(few), "doc_id")
    return picked.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y").toPandas().sort_values("doc_id").reset_index(drop=True)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve of y on the columns of x, offset last, with smoothed targets."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - t) + ridge * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] / spread * mean).sum()]


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of y on x."""
    w = calibrated(x[:, None], y)
    return float(w[0]), float(w[1])


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def sent(spark: SparkSession, model):
    """Broadcast a model of bounded size; received() gives it back in a task. Classes travel with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(shared):
    return pickle.loads(shared.value)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """From batches sorted by keys, frames that never split a group: the last group of a batch waits for the next."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[list(keys)].iloc[-1]
        same = np.ones(len(batch), bool)
        for k in keys:
            same &= (batch[k] == last[k]).to_numpy()
        start = int(np.argmax(same)) if same.any() else len(batch)
        if kept:
            first = kept[-1][list(keys)].iloc[-1]
            if start == 0 and all(first[k] == last[k] for k in keys):
                kept.append(batch)
                continue
        if start:
            kept.append(batch.iloc[:start])
        if kept:
            yield pd.concat(kept, ignore_index=True)
        kept = [batch.iloc[start:]]
    if kept:
        yield pd.concat(kept, ignore_index=True)


def by_sorted_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """Deal df out by keys, sort it in each partition, and give f frames of whole groups.

    Callers bound the size of a group beforehand; many small groups share one call of f.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys):
            yield from f(frame)

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
