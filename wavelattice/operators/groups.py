"""The rows of one key at a time, without a call of Spark for each key.

A window deals the rows out by key and orders them, and a task walks the
batches it gets: a key costs microseconds, so that a table may consist of
millions of short groups. A group is held whole; what a batch completes
leaves as one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order(key: str, *order: str) -> WindowSpec:
    """The rows of a key in order, those without a value last."""
    return Window.partitionBy(key).orderBy(*(F.col(o).asc_nulls_last() for o in order))


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key behind one another and in order, with their place in it from 1."""
    return rows.withColumn("place", F.row_number().over(in_order(key, *order)))


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list[pa.RecordBatch]]]:
    """For each batch of placed rows the groups that end with it, each as slices of the batches it came in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        done, at = [], 0
        starts = np.flatnonzero(batch.column("place").to_numpy() == 1).tolist()
        for end in [*starts, batch.num_rows]:
            if end > at:
                held.append(batch.slice(at, end - at))
            if end < batch.num_rows and held:
                done.append(held)
                held = []
            at = end
        yield done
    if held:
        yield [held]


def apply(rows: DataFrame, f: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``f`` gives for the placed rows of one key after the other: it takes named tuples and gives tuples of ``schema``."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            out: list = []
            for r in pdf.itertuples(index=False):
                if r.place == 1 and held:
                    out += f(held)
                    held = []
                held.append(r)
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = list(f(held)) if held else []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, schema)
