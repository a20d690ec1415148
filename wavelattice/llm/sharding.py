"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Shards differ by at most one row. Each shard is made of blocks, in all about
as many as the input has partitions but at most MAX_BLOCKS, each one task's
work. The matrix says how many rows each input partition sends to each block;
its row sums are the partitions' sizes, its column sums the blocks', and it
follows the law of a uniform random permutation: the blocks' contents are
split between the two halves of the partitions by a multivariate
hypergeometric draw, again and again, with a seed for each split. So any task
draws its own row from the partition sizes alone, in (number of blocks) x
(logarithm of the number of partitions) draws, and draws the same row when it
is repeated. Splits of LIMIT rows or more are few; they are drawn once, on the
driver, and sent along. Each task then permutes its rows' destinations (local
permutation), the rows are exchanged, and every block is permuted once more to
give slots. Whole rows travel, once.

All draws are exact. Below LIMIT rows numpy draws them; above, a rejection
sampler compares log weights in double precision and, where the comparison is
closer than their error, again with 60 digits.

The input must come in the same partitions whenever it is read. Plans with an
exchange are therefore written to the shared folder first; a task whose row
count differs from the matrix fails. The seed and the input's partitions
decide the result, however the rows are batched. A task holds four bytes for
each row of its partition.

Null texts, repeated rows and empty tables are shuffled like all others; an
empty table gives no rows. Columns called shard, slot or grown_shard are
replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelattice.llm.store import materialise

LIMIT = 10**9  # numpy draws exactly below this many rows
MAX_BLOCKS = 1 << 14
_DIGITS = decimal.Context(prec=60)
_HALF_LOG_TAU = _DIGITS.divide(_DIGITS.ln(_DIGITS.multiply(2, decimal.Decimal("3.14159265358979323846264338327950288419716939937510582097494459"))), decimal.Decimal(2))
# Numerators and denominators of the Stirling series of log n!.
_STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400), (43867, 244188), (-174611, 125400))


def _log_factorial(n: int) -> decimal.Decimal:
    """log n! to about 50 digits."""
    below = decimal.Decimal(0)
    if n < 10_000:
        product = 1
        for k in range(n + 1, 10_001):
            product *= k
        below, n = _DIGITS.ln(decimal.Decimal(product)), 10_000
    x = decimal.Decimal(n)
    total = _DIGITS.subtract(_DIGITS.multiply(_DIGITS.add(x, decimal.Decimal("0.5")), _DIGITS.ln(x)), x)
    total = _DIGITS.add(total, _HALF_LOG_TAU)
    for k, (up, down) in enumerate(_STIRLING):
        total = _DIGITS.add(total, _DIGITS.divide(decimal.Decimal(up), _DIGITS.multiply(down, _DIGITS.power(x, 2 * k + 1))))
    return _DIGITS.subtract(total, below)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` drawn without replacement; exact for any size of population."""
    if good + bad < LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))

    def weight(k: int, log_factorial) -> float | decimal.Decimal:
        return -(log_factorial(k) + log_factorial(good - k) + log_factorial(sample - k) + log_factorial(bad - sample + k))

    rough = lambda n: math.lgamma(n + 1)
    top = weight(mode, rough)
    error = 64 * 2.0**-52 * max(1.0, total * math.log(total))
    width = 1.5 * math.sqrt(max(sample * (good / total) * (bad / total) * (total - sample) / max(total - 1, 1), 1.0))
    while True:  # a Cauchy envelope, wider than the density, covers it everywhere
        step = width * math.tan(math.pi * (rng.random() - 0.5))
        k = mode + round(step)
        u = rng.random()
        if not low <= k <= high or u == 0:
            continue
        needed = math.log(u) + math.log(4) - math.log1p((step / width) ** 2)
        found = weight(k, rough) - top
        if abs(found - needed) <= error:
            with decimal.localcontext(_DIGITS):
                found = float(weight(k, _log_factorial) - weight(mode, _log_factorial))
        if found >= needed:
            return k


def _multivariate(rng: np.random.Generator, colours: np.ndarray, sample: int) -> np.ndarray:
    """How many of each colour are among ``sample`` drawn without replacement."""
    if colours.sum() < LIMIT:
        return rng.multivariate_hypergeometric(colours, sample, method="marginals")
    out, rest = np.zeros_like(colours), int(colours.sum())
    for i, n in enumerate(colours.tolist()):
        if not sample:
            break
        rest -= n
        out[i] = _hypergeometric(rng, n, rest, sample)
        sample -= int(out[i])
    return out


def _halves(sums: np.ndarray, lo: int, hi: int, left: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of the partitions lo to hi, and what their first half sends to each block."""
    mid = (lo + hi) // 2
    return mid, _multivariate(np.random.default_rng([seed, lo, hi]), left, int(sums[mid] - sums[lo]))


def large_splits(parts: np.ndarray, blocks: np.ndarray, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """What the first halves send to each block, for all ranges of partitions of LIMIT rows or more."""
    sums = np.concatenate(([0], np.cumsum(parts)))
    out, todo = {}, [(0, len(parts), np.array(blocks, np.int64))]
    while todo:
        lo, hi, left = todo.pop()
        if hi - lo > 1 and left.sum() >= LIMIT:
            mid, first = _halves(sums, lo, hi, left, seed)
            out[lo, hi] = first
            todo += [(lo, mid, first), (mid, hi, left - first)]
    return out


def matrix_row(parts: np.ndarray, blocks: np.ndarray, p: int, seed: int, known: dict[tuple[int, int], np.ndarray] | None = None) -> np.ndarray:
    """Row ``p`` of the communication matrix with row sums ``parts`` and column sums ``blocks``."""
    sums = np.concatenate(([0], np.cumsum(parts)))
    lo, hi, left = 0, len(parts), np.array(blocks, np.int64)
    while hi - lo > 1:
        if known and (lo, hi) in known:
            mid, first = (lo + hi) // 2, known[lo, hi]
        else:
            mid, first = _halves(sums, lo, hi, left, seed)
        left, lo, hi = (first, lo, mid) if p < mid else (left - first, mid, hi)
    return left


def _balanced(total: int, parts: int) -> np.ndarray:
    """``total`` in ``parts`` sizes that differ by at most one."""
    return np.array([total * (i + 1) // parts - total * i // parts for i in range(parts)], np.int64)


def _destinations(sizes: dict[int, int], blocks: np.ndarray, seed: int):
    order = sorted(sizes)
    parts = np.array([sizes[p] for p in order], np.int64)
    known = large_splits(parts, blocks, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        to, done, rng = None, 0, np.random.default_rng([seed, part, 7])
        for batch in batches:
            if to is None:
                if part not in sizes:
                    raise ValueError(f"partition {part} was empty when its rows were counted")
                row = matrix_row(parts, blocks, order.index(part), seed, known)
                to = rng.permutation(np.repeat(np.arange(len(blocks), dtype=np.int32), row))
            n = batch.num_rows
            if done + n > len(to):
                raise ValueError(f"partition {part} has more rows than when they were counted")
            places = (part << 36) + np.arange(done, done + n)
            own = pa.StructArray.from_arrays([pa.array(to[done : done + n]), pa.array(rng.integers(0, 2**62, n)), pa.array(places)], names=["block", "key", "place"])
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "sent"])
        if to is not None and done < len(to):
            raise ValueError(f"partition {part} has fewer rows than when they were counted")

    return run


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, blocks_per_shard: int | None = None) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (from 0, gapless in its shard), uniformly at random."""
    if shards < 1 or blocks_per_shard is not None and blocks_per_shard < 1:
        raise ValueError("shards and blocks must be positive")
    docs = docs.drop("shard", "slot", "grown_shard")
    names = docs.columns
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialise(docs, "shard-input")
    # Columns travel under names of our own, so that none can clash.
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    per_shard = _balanced(sum(sizes.values()), shards)
    each = blocks_per_shard or max(1, min(math.ceil(len(sizes) / shards), MAX_BLOCKS // shards))
    per_block = [_balanced(int(n), each) for n in per_shard]
    blocks = np.concatenate(per_block)
    shard = np.repeat(np.arange(shards), [len(b) for b in per_block])
    start = np.concatenate([np.cumsum(b) - b for b in per_block])

    sent = T.StructType().add("block", "integer").add("key", "long").add("place", "long")
    schema = T.StructType([*rows.schema.fields, T.StructField("sent", sent)])
    moved = rows.mapInArrow(_destinations(sizes, blocks, seed), schema).withColumn("block", F.col("sent.block")).repartitionById(len(blocks), F.col("block"))
    at = F.row_number().over(Window.partitionBy("block").orderBy("sent.key", "sent.place")) - 1
    place = docs.sparkSession.createDataFrame([(int(b), int(shard[b]), int(start[b])) for b in range(len(blocks))], "block int, shard int, start long")
    out = moved.withColumn("at", at).join(F.broadcast(place) if len(blocks) <= MAX_BLOCKS else place, "block")
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
