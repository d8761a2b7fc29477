"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoint"  # one machine: any folder is shared
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def boxed(docs: DataFrame, *named: str, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with all columns, or those to keep, in one struct, row, beside those that an operator works on: names of its own clash
    with none."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in (docs.columns if keep is None else keep))).alias("row"), *(docs[c] for c in named))


def unboxed(rows: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns of row as they were, but for those that are new."""
    left = dict(new)
    own = [left.pop(c).alias(c) if c in left else F.col("row").getField(c).alias(c) for c in columns]
    return rows.select(*own, *(v.alias(k) for k, v in left.items()))


def whole_text(col: str = "text"):
    """A document's text; a null text counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


#: Bytes of text that a Python worker takes up at once; one longer text is taken by itself.
SLICE = 8 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most so many bytes in a text column: rows all stay, memory is bounded."""
    for b in batches:
        texts = b.column(column)
        if not b.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
        runs = np.cumsum(sizes) // most
        bounds = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), b.num_rows]
        for i, j in zip(bounds, bounds[1:], strict=False):
            yield b.slice(i, j - i)


#: Keys that make up one in so many of all rows are hot: so many keys at most, however large the input is.
FREQUENT = 1 << 12


def meet(rows: DataFrame, facts: DataFrame, keys: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts, which has one row for each of its keys and in n how many of the total rows show it.
    Hot keys are broadcast, FREQUENT rows at most; the others are dealt by their keys, of which none is one task's burden."""
    hot = F.col("n") * FREQUENT >= total
    often, seldom = F.broadcast(facts.filter(hot).drop("n")), facts.filter(~hot).drop("n")
    rest = rows.join(often, list(keys), "left_anti").join(seldom, list(keys), how)
    return rows.join(often, list(keys)).unionByName(rest)


class Remembered:
    """A cache of a bounded size in two generations: when the newer one is full it becomes the older one, and what is
    asked for again moves up, so frequent keys stay."""

    def __init__(self, most: int) -> None:
        self.most, self.newer, self.older = most, {}, {}

    def missing(self, keys: set) -> tuple[dict, list]:
        """The newer generation, and those of the keys that neither has; the others are in the newer one now."""
        if len(self.newer) > self.most:
            self.newer, self.older = {}, self.newer
        newer, older, out = self.newer, self.older, []
        for k in keys.difference(newer):
            if k in older:
                newer[k] = older[k]
            else:
                out.append(k)
        return newer, out
