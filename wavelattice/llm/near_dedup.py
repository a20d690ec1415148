"""Near-duplicate detection: MinHash signatures joined by multi-index Hamming search.

A document's set is its distinct five-word shingles. Forty MinHash values cut
to 16 bits form a signature of ten 64-bit chunks with four symbols each. Two
signatures that differ in at most 19 of the 40 symbols have, by the pigeonhole
principle, a chunk with at most one differing symbol, so enumerating the four
one-symbol masks of each chunk gives every such pair a common key: 40 keys a
signature, none of them capped. At a similarity of 0.75 a pair differs in
10 symbols on average and in more than 19 with a probability below 0.001.

Documents with equal sets share one representative, so copies never meet in a
join. Representatives that share a key are not paired with each other. First
each is checked against the smallest one of its keys that is near enough, its
pivot, which joins most of a group of copies in a linear number of checks.
What is left are pairs of near signatures in different components. They are
only in keys that hold several components. Near pivots, linked or not, make
families; only keys that hold several families as well are searched, within
the task that holds the key, and leave it as a spanning forest. Forest and
families together make clusters. Each cluster's documents
outside its largest component (strays) are then checked, in blocks, against
all documents of the cluster, again within tasks that return links alone. So
every pair of near signatures is either within one component or was checked,
and no table ever holds the pairs of a group. Every link is confirmed on the
full sets. Large keys, pivots and clusters are split into blocks of bounded
size.

Rows without doc_id get no component. Rows that repeat a doc_id count as one
node. Empty and null texts have an empty set and are linked with nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelattice.llm import kernel
from wavelattice.llm.components import connected
from wavelattice.llm.store import discard, join_groups, materialise, pick_rows, with_row_key

SYMBOLS, CHUNKS, PER_CHUNK = 40, 10, 4
KEYS = SYMBOLS  # masked chunks of a signature
MAX_DISTANCE = 19
KEY_BLOCK, CLUSTER_BLOCK, STRAY_BLOCK, PIVOT_BLOCK = 4096, 2048, 256, 1024
BROADCAST_ROWS = 1_000_000
U = np.uint64

_rng = np.random.default_rng(97)
_MUL = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * U(2) + U(1)
_XOR = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * U(2)

_SIGNATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]
    + [(f"s{c}", pa.int64()) for c in range(CHUNKS)]
)


_NO_SKETCH = np.zeros((0, SYMBOLS), np.uint16)


def _signatures(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk words (rows by CHUNKS) and two 64-bit digests for each nonempty set."""
    starts = bounds[:-1]
    low = np.empty((SYMBOLS, len(starts)), np.uint64)
    for k in range(SYMBOLS):
        low[k] = np.minimum.reduceat((sets ^ _XOR[k]) * _MUL[k], starts)
    symbols = kernel.mix(low) & U(0xFFFF)
    chunks = np.zeros((len(starts), CHUNKS), np.uint64)
    for k in range(SYMBOLS):
        chunks[:, k // PER_CHUNK] |= symbols[k] << U(16 * (k % PER_CHUNK))
    size = np.diff(bounds).astype(np.uint64)
    d1 = kernel.mix(np.add.reduceat(kernel.mix(sets), starts) + size)
    d2 = kernel.mix(np.add.reduceat(kernel.mix(sets * U(0xA0761D6478BD642F) + U(0xE7037ED1A0B428DB)), starts) ^ size)
    return chunks, d1, d2


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, raw, offsets in kernel.slices(batch.column(1)):
                sets, bounds = kernel.shingles(*kernel.words(raw, offsets), width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                cells = np.zeros((end - first, CHUNKS + 2), np.uint64)
                if len(full):
                    chunks, d1, d2 = _signatures(sets, np.append(bounds[full], bounds[-1]))
                    cells[full, 0], cells[full, 1], cells[full, 2:] = d1, d2, chunks
                columns = [ids.slice(first, end - first), pa.array(n)]
                columns += [pa.array(np.ascontiguousarray(cells[:, c]).view(np.int64)) for c in range(CHUNKS + 2)]
                yield pa.RecordBatch.from_arrays(columns, schema=_SIGNATURES)

    return run


def _distance(a: str, b: str) -> Column:
    """Number of differing 16-bit symbols between the signatures in structs a and b."""
    total = None
    for c in range(CHUNKS):
        x = F.col(f"{a}.s{c}").bitwiseXOR(F.col(f"{b}.s{c}"))
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        n = F.bit_count(x)
        total = n if total is None else total + n
    return total


def _keys() -> Column:
    """The 40 masked chunks of a signature, each with its chunk and mask in the key."""
    out = []
    for c in range(CHUNKS):
        for j in range(PER_CHUNK):
            mask = ~(0xFFFF << (16 * j)) & (2**64 - 1)
            mask -= (mask >> 63) << 64
            out.append(F.struct(F.lit(c * PER_CHUNK + j).cast("short").alias("m"), F.col(f"s{c}").bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*out)


def _nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the near pairs in different components, of keys sorted together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        # Whole keys only: the last key of what is held waits for the next batch.
        held.append(batch)
        rows += batch.num_rows
        if rows < 50_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = np.asarray(table.column("group"))
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield from _forest(table.slice(0, cut))
        rest = table.slice(cut).combine_chunks().to_batches()
        held, rows = rest, sum(x.num_rows for x in rest)
    if held:
        yield from _forest(pa.Table.from_batches(held).combine_chunks())


def _forest(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges that connect what near pairs in different components connect, for rows sorted by group."""
    group, rep, component = (np.asarray(table.column(c)) for c in ("group", "rep", "component"))
    stray = np.asarray(table.column("stray"))
    symbols = np.stack([np.asarray(table.column(f"s{c}")) for c in range(CHUNKS)], axis=1).view(np.uint16)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(group)))
    found_a, found_b = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        near = np.zeros(len(i), bool)
        for k in range(0, len(i), 50_000):
            near[k : k + 50_000] = (symbols[i[k : k + 50_000]] != symbols[j[k : k + 50_000]]).sum(axis=1) <= MAX_DISTANCE
        found_a.append(rep[i[near]])
        found_b.append(rep[j[near]])

    small = np.repeat(size <= 64, size)
    place = np.arange(len(group))
    for step in range(1, int(min(64, size.max(initial=0)))):
        i = place[: len(place) - step]
        j = i + step
        ok = (group[i] == group[j]) & small[i] & (component[i] != component[j])
        keep(i[ok], j[ok])
    for a, n in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        own = place[a : a + n]
        for x in own[stray[own]].tolist():
            other = own[component[own] != component[x]]
            keep(np.full(len(other), x), other)
            if len(found_a) > 200:
                found_a[:], found_b[:] = ([part] for part in _span(np.concatenate(found_a), np.concatenate(found_b)))
    if found_a:
        a, b = _span(np.concatenate(found_a), np.concatenate(found_b))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs with the smallest node that the pairs connect it to."""
    nodes, at = np.unique_inverse(np.concatenate([a, b])) if len(a) else (a, a)
    if not len(nodes):
        return a, b
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _with_sets(width: int) -> Callable:
    """Shingle sets of texts, one row for each of a text's places (group, left, component)."""
    schema = pa.schema([("group", pa.int64()), ("left", pa.bool_()), ("component", pa.int64()), ("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids = batch.column(2), batch.column(0).to_pylist()
            for first, end, raw, offsets in kernel.slices(batch.column(1)):
                sets, bounds = kernel.shingles(*kernel.words(raw, offsets), width)
                rows: list[tuple] = []
                for i in range(first, end):
                    blob = sets[bounds[i - first] : bounds[i - first + 1]].tobytes()
                    rows += [(p["group"], p["left"], p["component"], ids[i], blob) for p in places[i].as_py()]
                    if len(rows) > 2000 or i + 1 == end and rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []

    return run


def _check(percent: int) -> Callable:
    """Links between the left sets of a group (first in order) and all its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left, sketches, up, links = None, [], _NO_SKETCH, {}, []

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for g, is_left, component, rep, blob in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if g != group:
                    group, left, sketches, up = g, [], _NO_SKETCH, {}
                own = np.frombuffer(blob, np.uint64)
                symbols = _signatures(own, np.array([0, len(own)]))[0].view(np.uint16)
                distance = (sketches != symbols).sum(axis=1)
                for k in np.argsort(distance, kind="stable").tolist():
                    if distance[k] > MAX_DISTANCE:
                        break
                    other, its, theirs = left[k]
                    if other == rep or root(its) == root(component):
                        continue
                    if 100 * min(len(own), len(theirs)) < percent * max(len(own), len(theirs)):
                        continue
                    at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
                    shared = int((theirs[at] == own).sum())
                    if 100 * shared >= percent * (len(own) + len(theirs) - shared):
                        up[root(its)] = root(component)
                        links.append((min(other, rep), max(other, rep)))
                if is_left:
                    left.append((rep, component, own))
                    sketches = np.concatenate([sketches, symbols])
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                links = []

    return run


def _mixed(placed: DataFrame, part: str) -> DataFrame:
    """Keys (m, v) whose rows are in several ``part``: the largest (main), the number of rows and of those outside it."""
    parts = placed.groupBy("m", "v", part).agg(F.count("*").alias("count"))
    mixed = parts.groupBy("m", "v").agg(F.max(F.struct("count", part)).alias("x"), F.sum("count").alias("n")).where("x.count < n")
    return mixed.select("m", "v", F.col(f"x.{part}").alias("main"), "n", (F.col("n") - F.col("x.count")).alias("n_stray"))


def _grid(rows: DataFrame, block: int, strays: int) -> DataFrame:
    """The places (s, b) of rows (rep, n, n_stray, stray) in their group's grid of blocks of strays and of members.

    Every member is in its own block b once for each block s of strays, and
    every stray is a stray in its own block s once for each b, so each stray
    meets each member in one place and a place holds about ``block`` members
    and ``strays`` strays.
    """
    rows = rows.withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("ns", F.ceil(F.col("n_stray") / strays).cast("int"))
    rows = rows.withColumn("own_b", F.pmod(F.xxhash64("rep"), "nb").cast("int")).withColumn("own_s", F.pmod(F.xxhash64("rep", F.lit(1)), "ns").cast("int"))
    member = "transform(sequence(0, ns - 1), x -> named_struct('s', x, 'b', own_b, 'stray', stray and x = own_s))"
    stray = "if(stray, transform(filter(sequence(0, nb - 1), x -> x != own_b), x -> named_struct('s', own_s, 'b', x, 'stray', true)), array())"
    rows = rows.withColumn("at", F.explode(F.expr(f"concat({member}, {stray})")))
    return rows.withColumn("s", F.col("at.s")).withColumn("b", F.col("at.b")).withColumn("stray", F.col("at.stray"))


def _links(places: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) within the groups of ``places`` (rep, group, left, component)."""
    stored = places.groupBy("rep").agg(F.collect_list(F.struct("group", "left", "component")).alias("places"))
    stored = materialise(stored, "near-places")
    rows = stored.agg(F.sum(F.size("places"))).first()[0] or 0
    at = F.broadcast(stored) if rows <= BROADCAST_ROWS else stored
    sets = texts.join(at, texts.doc_id == at.rep).select("doc_id", "text", "places")
    sets = sets.mapInArrow(kernel.lean(_with_sets(width)), "group long, left boolean, component long, rep long, shingles binary")
    sets = sets.repartition("group").sortWithinPartitions("group", F.desc("left"))
    links = materialise(sets.mapInArrow(kernel.lean(_check(percent)), "a long, b long"), "near-links")
    discard(stored)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, with all its columns: the one with the smallest id.

    Rows are told apart by their place: rows that repeat an id are compared by
    their own texts, and of a group in which all lack an id one row stays.
    """
    keyed, key = with_row_key(docs)
    found = near_duplicates(keyed.select(F.col(key).alias("row"), F.col(text_col).alias("text")), "row", "text", **options)
    found = materialise(found.select(F.col("doc_id").alias("row"), "component_id"), "near-found")
    grouped = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    several = materialise(join_groups(found, grouped, ["component_id"], "n", found.count()).select("row", "component_id"), "near-several")
    ids = several.join(keyed.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("id")), "row")
    best = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x")).select(F.col("x.row").alias("row"))
    drop = materialise(several.join(best, "row", "left_anti").select(F.col("row").alias(key)), "near-dropped")
    return pick_rows(keyed, key, drop, stay=False).select(*docs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two rows are linked when 100 * |A & B| >= percent * |A | B| for their
    shingle sets; component_id is the smallest doc_id reachable over links.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, d1 long, d2 long, " + ", ".join(f"s{c} long" for c in range(CHUNKS))
    signed = materialise(texts.mapInArrow(kernel.lean(_sign(width)), schema), "near-signatures")

    sig = [f"s{c}" for c in range(CHUNKS)]
    known = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(s).alias(s) for s in sig])
    reps = materialise(reps, "near-representatives")
    n_reps = reps.count()

    # Keys that several representatives have, with the smallest of them.
    keyed = reps.select("rep", F.explode(_keys()).alias("key")).select("rep", "key.m", "key.v")
    firsts = keyed.groupBy("m", "v").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts, "near-pivots")
    shared = materialise(join_groups(keyed, firsts, ["m", "v"], "n", KEYS * n_reps), "near-shared")

    # Each representative and its smallest near pivot, in blocks of a pivot's members.
    signatures = reps.select("rep", F.struct(*sig).alias("sig"))
    stars = shared.where("rep != pivot").select("rep", "pivot").distinct()
    candidates = materialise(stars, "near-candidates")
    pivots = candidates.groupBy("pivot").agg(F.count("*").alias("n")).join(signatures.select(F.col("rep").alias("pivot"), F.col("sig").alias("sb")), "pivot")
    stars = candidates.join(signatures.withColumnRenamed("sig", "sa"), "rep")
    stars = join_groups(stars, pivots, ["pivot"], "n", candidates.count()).where(_distance("sa", "sb") <= MAX_DISTANCE)
    stars = materialise(stars.groupBy("rep").agg(F.min("pivot").alias("pivot")), "near-stars")
    discard(candidates)
    block = F.pmod(F.xxhash64("rep"), F.greatest(F.ceil(F.col("n") / PIVOT_BLOCK), F.lit(1)))
    sizes = stars.groupBy("pivot").agg(F.count("*").alias("n"))
    right = join_groups(stars, sizes, ["pivot"], "n", n_reps).select("rep", F.xxhash64("pivot", block).alias("group"), F.lit(False).alias("left"), F.col("rep").alias("component"), "pivot")
    left = right.select(F.col("pivot").alias("rep"), "group", F.lit(True).alias("left"), F.col("pivot").alias("component")).distinct()
    links = _links(right.drop("pivot").union(left), texts, width, percent)
    labels = connected(links)

    # Keys whose members are still in different components.
    placed = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("m", "v", "rep", F.coalesce("label", "rep").alias("component"))
    placed = materialise(placed, "near-placed")
    discard(shared, firsts)
    mixed = _mixed(placed, "component").select("m", "v", "n")
    placed_open = materialise(join_groups(placed, mixed, ["m", "v"], "n", KEYS * n_reps).drop("n"), "near-open")
    discard(placed)

    # Near pivots make families; only keys of several families are searched, and strays are those outside the largest one.
    families = connected(stars.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    open_ = placed_open.join(families.withColumnRenamed("node", "rep"), "rep", "left").select("m", "v", "rep", "component", F.coalesce("label", "rep").alias("family"))
    open_ = materialise(open_, "near-families")
    discard(placed_open)
    loose = materialise(open_.select("rep", "component", "family").distinct(), "near-loose")
    mixed = materialise(_mixed(open_, "family"), "near-mixed")
    split = join_groups(open_.drop("component"), mixed, ["m", "v"], "n", KEYS * n_reps).withColumn("stray", F.col("family") != F.col("main"))
    split = _grid(split, KEY_BLOCK, STRAY_BLOCK)
    split = split.select("rep", F.col("family").alias("component"), "stray", F.xxhash64("m", "v", "s", "b").alias("group")).join(reps.select("rep", *sig), "rep")
    near = split.repartition("group").sortWithinPartitions("group").mapInArrow(kernel.lean(_nearby), "a long, b long")
    near = materialise(near, "near-forest")
    discard(open_, mixed)
    clusters = connected(near.union(loose.select(F.col("rep").alias("a"), F.col("family").alias("b"))))

    # Strays of each cluster against all its members, block by block.
    members = clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    members = loose.join(members, "rep").select("rep", "cluster", "component")
    members = materialise(members, "near-members")
    main = members.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max(F.struct("count", "component")).alias("x"), F.sum("count").alias("n")).where("x.count < n")
    main = main.select("cluster", F.col("x.component").alias("main"), "n", (F.col("n") - F.col("x.count")).alias("n_stray"))
    members = join_groups(members, main, ["cluster"], "n", members.count()).withColumn("stray", F.col("component") != F.col("main"))
    places = _grid(members, CLUSTER_BLOCK, STRAY_BLOCK).select("rep", F.xxhash64("cluster", "s", "b").alias("group"), F.col("stray").alias("left"), "component")
    labels = connected(links.union(_links(places, texts, width, percent)))

    # Equal sets first, then linked sets.
    sets = reps.join(labels, reps.rep == labels.node, "left").select("d1", "d2", "copies", F.coalesce("label", "rep").alias("component_id"))
    sets = materialise(sets, "near-sets")
    out = join_groups(known.select("doc_id", "n_shingles", "d1", "d2"), sets, ["d1", "d2"], "copies", known.count()).select("doc_id", "n_shingles", "component_id")
    rest = signed.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
