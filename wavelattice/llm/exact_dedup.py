"""Exact deduplication by deterministic block naming.

Every text is lower-cased (A-Z only), encoded as UTF-8 and cut into blocks of
a fixed number of bytes. The distinct blocks are sorted and numbered, so two
blocks have the same integer name exactly if their bytes are equal; no hash
decides. Then adjacent names are paired and the distinct pairs numbered in the
same way, level by level, until a text has one name. (level, name) identifies
the normalised text without collisions.

Blocks are first numbered within each task's chunk of rows and only their
distinct bytes travel, once a chunk, so a block that a third of all rows share
costs one row a chunk. Each partition numbers its blocks in sorted order from
an offset of its own; the numbering is written to the shared folder, hence the
same for all later readers.

Rows of a hot text, pairs of hot names and blocks of a chunk are joined by
``join_groups``, which leaves the rows of hot keys where they are.

Null text counts as empty and all empty texts are equal. Of equal texts the
row with the largest doc_id stays; among rows that repeat this doc_id, one.
Null doc_ids rank lowest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelattice.llm import kernel
from wavelattice.llm.store import discard, join_groups, materialise, pick_rows, with_row_key

BLOCK_BYTES = 4096
CHUNK_BYTES = 8 << 20
_SHIFT = 40

_CHUNKED = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("sha", pa.string()), ("chunk", pa.int64()), ("locals", pa.list_(pa.int32())), ("fresh", pa.list_(pa.int32())), ("blocks", pa.list_(pa.binary()))]
)


def _split(block_bytes: int, chunk_bytes: int):
    """Cut texts to blocks; number the blocks of a chunk in the order of their first use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held, chunk = 0, TaskContext.get().partitionId() << _SHIFT
        for batch in batches:
            texts, carried = batch.column(1), [batch.column(i) for i in (0, 2)]
            out = {name: [] for name in _CHUNKED.names[2:]}
            size, first = 0, 0
            for i in range(len(texts)):
                text = (texts[i].as_py() or "").encode().lower()
                if held > chunk_bytes:
                    seen, held, chunk = {}, 0, chunk + 1
                names, fresh, blocks = [], [], []
                for k in range(0, max(len(text), 1), block_bytes):
                    block = text[k : k + block_bytes]
                    name = seen.get(block)
                    if name is None:
                        name = seen[block] = len(seen)
                        fresh.append(name)
                        blocks.append(block)
                        held += len(block) + 64
                        size += len(block)
                    names.append(name)
                held += 8 * len(names) + 64
                out["sha"].append(hashlib.sha256(text).hexdigest())
                out["chunk"].append(chunk)
                out["locals"].append(names)
                out["fresh"].append(fresh)
                out["blocks"].append(blocks)
                if size > chunk_bytes or i + 1 == len(texts):
                    columns = [c.slice(first, i + 1 - first) for c in carried] + [pa.array(out[f.name], f.type) for f in list(_CHUNKED)[2:]]
                    yield pa.RecordBatch.from_arrays(columns, schema=_CHUNKED)
                    out = {name: [] for name in _CHUNKED.names[2:]}
                    size, first = 0, i + 1

    return run


def _number(keys: list[str], carry: list[str]):
    """Number the distinct keys of a sorted partition; each row keeps ``carry`` and gets its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name = None, (TaskContext.get().partitionId() << _SHIFT) - 1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            new = np.zeros(n, bool)
            new[0] = tuple(c[0].as_py() for c in columns) != last
            for c in columns:
                if n > 1:
                    new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)))
            names = name + np.cumsum(new)
            name, last = int(names[-1]), tuple(c[n - 1].as_py() for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(names, pa.int64())], names=[*carry, "name"])

    return run


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, row, sha, level and name for each row of ``docs`` (doc_id, text, row).

    ``row`` is unique; (level, name) is equal for two rows exactly if their
    normalised texts are.
    """
    cut = docs.mapInArrow(
        kernel.lean(_split(block_bytes, chunk_bytes)),
        "doc_id long, row long, sha string, chunk long, locals array<int>, fresh array<int>, blocks array<binary>",
    )
    cut = materialise(cut, "exact-blocks")

    blocks = cut.select("chunk", F.inline(F.arrays_zip("fresh", "blocks"))).repartition("blocks").sortWithinPartitions("blocks")
    names = blocks.mapInArrow(kernel.lean(_number(["blocks"], ["chunk", "fresh"])), "chunk long, fresh int, name long")
    names = materialise(names.withColumnRenamed("fresh", "local"), "exact-names")
    placed = cut.select("row", "chunk", F.size("locals").alias("n"), F.posexplode("locals").alias("pos", "local"))
    placed = placed.join(names, ["chunk", "local"]).select("row", "n", "pos", "name")
    rows = materialise(cut.select("doc_id", "row", "sha"), "exact-rows")
    placed = materialise(placed, "exact-level")
    discard(cut, names)

    level, found = 0, []
    while True:
        found.append(placed.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = placed.where("n > 1")
        if rest.isEmpty():
            break
        level += 1
        side = F.col("pos") % 2
        pairs = rest.groupBy("row", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = materialise(pairs, "exact-pairs")
        named = pairs.groupBy("a", "b").agg(F.count("*").alias("size")).repartition("a", "b").sortWithinPartitions("a", "b")
        named = materialise(named.mapInArrow(kernel.lean(_number(["a", "b"], ["a", "b", "size"])), "a long, b long, size long, name long"), "exact-names")
        placed = join_groups(pairs, named, ["a", "b"], "size", pairs.count())
        placed = materialise(placed.select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"), "exact-level")
        discard(pairs, named)

    done = found[0]
    for more in found[1:]:
        done = done.union(more)
    return rows.join(done, "row")


def _ranked(docs: DataFrame, id_col: str, text_col: str, row: Column, **options: int) -> DataFrame:
    """identities of ``docs`` with best (doc_id and row of the row that stays) and group_size."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    named = materialise(identities(texts, **options), "exact-identities")
    groups = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    groups = materialise(groups, "exact-groups")
    return join_groups(named, groups, ["level", "name"], "group_size", named.count())


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs``."""
    return _ranked(docs, id_col, text_col, F.monotonically_increasing_id(), **options).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each group of equal texts.

    Rows are told apart by their place, whatever their ids: rows without an id
    and rows that repeat one stay if their group has no other row to keep.
    """
    keyed, key = with_row_key(docs)
    stay = _ranked(keyed, id_col, text_col, F.col(key), **options).where(F.col("row") == F.col("best.row"))
    stay = materialise(stay.select(F.col("row").alias(key)), "exact-stay")
    return pick_rows(keyed, key, stay, stay=True).select(*docs.columns)
