"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Texts are tokenised and closed by one end id; only those longer than a
sequence are cut. A full piece is a sequence of its own. The other pieces are
dealt by a hash into districts of bounded size. Each district is one packing
problem that several islands work on in parallel, each with its own
population of packings. A crossover injects a share of the best-filled bins of
one parent into the other, whole; bins of the other that hold the same pieces
are taken apart and their remaining pieces put back by best fit, longest
first. Mutation takes the worst-filled bins apart. After each epoch an
island's elite migrates to the next island of its district. The best packing
of a district wins. What then lies in bins that are not well filled is dealt
into fewer districts and packed again. An island that has a packing of as few
bins as the volume of its pieces fills stops, as none can be better.

The numbers of islands, epochs, packings of an island and children of an epoch
are parameters of ``pack``. Documents, most of which are short against a
sequence, mostly reach the volume's bound by best fit alone; the crossovers
decide where few pieces go into a bin.

Tokens are looked up chunk by chunk (between ASCII white space, which no token
crosses) in a cache of each worker that holds short chunks only and is emptied
at CACHE_BYTES, and give the same ids as encoding whole texts.

Null text counts as empty: one piece, the end id. Rows without doc_id and
repeated rows are packed like others. An empty table gives no pieces. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.llm import kernel
from wavelattice.llm.store import materialise

CAPACITY = 2048
DISTRICT_PIECES = 8192
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2, 3, 8, 16
WELL_FILLED = 0.995
CACHE_BYTES, LONG_CHUNK, ENTRY_BYTES = 160 << 20, 64, 180
_END = bytes(4)


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers, with a bounded cache of chunks."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.used = cache_bytes, 0
        self.cache: dict[bytes, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        normal = [s["type"] for s in (rules.get("normalizer") or {}).get("normalizers", [])]
        self.lower = normal[-1:] == ["Lowercase"]
        # A word of Latin letters is one pre-token of a letter-run splitter with byte-level symbols.
        self.by_word = self.lower and steps == ["Split", "ByteLevel"] and rules["model"]["type"] == "BPE"
        self.special = [t["content"].encode() for t in rules["added_tokens"]]
        # Byte-level symbols: printable Latin-1 bytes stand for themselves, the rest follow from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _word(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk of Latin letters with at most a tail of full stops and commas, else None."""
        core = chunk.rstrip(b".,")
        word = core.decode()
        if not word.isalpha() or max(word) > "ɏ":
            return None
        low = word.lower()
        if not low.isalpha():
            return None
        text = low if low.isascii() else "".join(map(self.symbols.__getitem__, low.encode()))
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(text)], "<u4").tobytes()
        tail = chunk[len(core) :]
        if tail:
            if tail not in self.cache:
                self._keep(tail, self._whole([tail])[tail])
            ids += self.cache[tail]
        return ids

    def _whole(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, found, strict=True)}

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        self.cache[chunk] = ids
        self.used += len(chunk) + len(ids) + ENTRY_BYTES

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        if self.lower and not any(s in raw for s in self.special):
            # Special strings that lower-casing would make must not count as special.
            low = raw.lower()
            raw = low if not any(s in low for s in self.special) else raw
        chunks = raw.split()
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            pass
        if self.used > self.limit:
            self.cache.clear()
            self.used = 0
        long_, slow = {}, []
        for c in set(chunks).difference(self.cache):
            ids = self._word(c) if self.by_word and len(c) <= LONG_CHUNK else None
            if ids is None:
                slow.append(c)
            else:
                self._keep(c, ids)
        if slow:
            for c, ids in self._whole(slow).items():
                if len(c) <= LONG_CHUNK:
                    self._keep(c, ids)
                else:
                    long_[c] = ids
        if long_:
            return b"".join(long_[c] if c in long_ else self.cache[c] for c in chunks)
        return b"".join(map(self.cache.__getitem__, chunks))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


kernel.on_settle(_encoder.cache_clear)


_PIECES = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = _encoder(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + _END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((uid, doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return run


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, piece, start, length and ids_crc32 of every piece."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cut(path, capacity), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Put all pieces without a bin (-1), longest first, into the fullest bin that takes them.

    Bins are kept by the room left; a bit mask of the rooms that occur finds
    the smallest that suffices.
    """
    bins = bins.copy()
    open_ = np.flatnonzero(bins < 0)
    placed = bins >= 0
    n = int(bins.max(initial=-1)) + 1
    room = capacity - np.bincount(bins[placed], lengths[placed], n).astype(np.int64) if n else np.zeros(0, np.int64)
    by_room: dict[int, list[int]] = {}
    mask = 0
    counted = np.bincount(bins[placed], minlength=n) if n else room
    for b in np.flatnonzero((room > 0) & (counted > 0)).tolist():
        by_room.setdefault(int(room[b]), []).append(b)
    for r in by_room:
        mask |= 1 << r
    free = np.flatnonzero(counted == 0).tolist()
    for i in open_[np.argsort(-lengths[open_], kind="stable")].tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                del by_room[r]
                mask ^= 1 << r
        else:
            r = capacity
            b = free.pop() if free else n
            n = max(n, b + 1)
        bins[i] = b
        if r > need:
            by_room.setdefault(r - need, []).append(b)
            mask |= 1 << (r - need)
    return bins


def fills(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins in use: higher with fewer, fuller bins."""
    f = fills(lengths, bins)
    f = f[f > 0] / capacity
    return float((f * f).mean()) if len(f) else 1.0


def _renumber(bins: np.ndarray) -> np.ndarray:
    used = np.zeros(int(bins.max(initial=-1)) + 2, np.int64)
    used[bins] = 1
    return (np.cumsum(used) - 1)[bins] if len(bins) else bins


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.1) -> np.ndarray:
    """``a`` with some of the best-filled bins of ``b`` injected whole."""
    f = fills(lengths, b)
    good = np.flatnonzero(f >= WELL_FILLED * capacity)
    if not len(good):
        good = np.argsort(-f)[: max(1, len(f) // 10)]
    picked = np.zeros(len(f), bool)
    picked[rng.choice(good, max(1, int(len(good) * share)), replace=False)] = True
    inside = picked[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[inside]] = True
    child = np.where(broken[a], -1, a)
    child[inside] = int(a.max()) + 1 + b[inside]
    child[child >= 0] = _renumber(child[child >= 0])
    return best_fit(lengths, child, capacity)


def mutate(lengths: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with its worst-filled bins and a few others taken apart and best-fitted."""
    f = fills(lengths, a)
    out = np.zeros(len(f), bool)
    out[np.argsort(f)[: max(1, len(f) // 50)]] = True
    out[rng.integers(0, len(f), max(1, len(f) // 50))] = True
    return _renumber(best_fit(lengths, np.where(out[a], -1, a), capacity))


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: list[int], population: int = POPULATION, offspring: int = OFFSPRING) -> list[np.ndarray]:
    """One epoch of an island: its best packings first."""
    rng = np.random.default_rng(seed)
    if not len(lengths):
        return [np.zeros(0, np.int64)]
    floor = -(-int(lengths.sum()) // capacity)
    none = np.full(len(lengths), -1, np.int64)
    pool = list(elites) or [_renumber(best_fit(lengths, none, capacity))]
    if min(int(p.max()) for p in pool) + 1 <= floor:
        return sorted(pool, key=lambda p: int(p.max()))
    while len(pool) < population:
        # Beside best fit of the whole, packings that start from a random part of it.
        start, early = none.copy(), rng.random(len(lengths)) >= 0.3
        start[early] = best_fit(lengths[early], none[early], capacity)
        pool.append(_renumber(best_fit(lengths, start, capacity)))
    scored = sorted(((fitness(lengths, p, capacity), i) for i, p in enumerate(pool)), reverse=True)
    pool = [(s, pool[i]) for s, i in scored][:population]
    for _ in range(offspring):
        if min(int(p.max()) for _, p in pool) + 1 <= floor:
            break
        i, j = rng.choice(len(pool), 2, replace=False) if len(pool) > 1 else (0, 0)
        child = _renumber(crossover(lengths, pool[i][1], pool[j][1], capacity, rng))
        child = mutate(lengths, child, capacity, rng)
        pool.append((fitness(lengths, child, capacity), child))
        pool.sort(key=lambda x: -x[0])
        pool = pool[:population]
    return sorted((p for _, p in pool), key=lambda p: int(p.max()))


_STATE = "district long, island int, uids array<long>, lengths array<int>, elites array<array<int>>"
_STATE_ARROW = pa.schema(
    [("district", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("elites", pa.list_(pa.list_(pa.int32())))]
)


@dataclass(frozen=True)
class Islands:
    """Sizes of the genetic algorithm: islands a district, epochs, packings an island, children an epoch."""

    islands: int = ISLANDS
    epochs: int = EPOCHS
    population: int = POPULATION
    offspring: int = OFFSPRING


def _epoch(capacity: int, epoch: int, seed: int, sizes: Islands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                elites = [np.array(e, np.int64) for e in row["elites"]]
                best = evolve(lengths, elites, capacity, [seed, epoch, row["district"], row["island"]], sizes.population, sizes.offspring)
                row["elites"] = [b.tolist() for b in best]
                yield pa.RecordBatch.from_pylist([row], schema=_STATE_ARROW)

    return run


def _place(capacity: int):
    schema = pa.schema([("uid", pa.int64()), ("district", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, bins = np.array(row["lengths"], np.int64), np.array(row["best"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                starts = ends - lengths[order]
                f = fills(lengths, bins)
                first = np.concatenate(([0], np.cumsum(f)))[:-1]
                offsets = starts - first[bins[order]]
                uids = np.array(row["uids"], np.int64)[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids), pa.array([row["district"]] * len(uids), pa.int64()), pa.array(bins[order]), pa.array(offsets), pa.array(f[bins[order]])], schema=schema
                )

    return run


def _solve(pieces: DataFrame, districts: int, capacity: int, seed: int, spread: int, sizes: Islands) -> DataFrame:
    """uid, district, bin, offset and the bin's fill for pieces (uid, length)."""
    dealt = pieces.groupBy(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(districts)).alias("district")).agg(
        F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length")))).alias("p")
    )
    state = dealt.select(
        "district",
        F.explode(F.sequence(F.lit(0), F.lit(sizes.islands - 1))).alias("island"),
        F.col("p.uid").alias("uids"),
        F.col("p.length").alias("lengths"),
        F.array().cast("array<array<int>>").alias("elites"),
    )
    for epoch in range(sizes.epochs):
        state = state.repartition(spread, "district", "island").mapInArrow(_epoch(capacity, epoch, seed, sizes), _STATE)
        state = materialise(state, "pack-islands")
        if epoch + 1 < sizes.epochs:
            guests = state.select("district", F.pmod(F.col("island") + 1, F.lit(sizes.islands)).cast("int").alias("island"), F.slice("elites", 1, 1).alias("guests"))
            state = state.join(guests, ["district", "island"]).select(
                "district", "island", "uids", "lengths", F.concat("guests", F.slice("elites", 1, max(sizes.population - 1, 1))).alias("elites")
            )
    best = state.select("district", "island", "uids", "lengths", F.element_at("elites", 1).alias("best"))
    bins = F.array_max("best")
    best = best.groupBy("district").agg(F.min_by(F.struct("uids", "lengths", "best"), F.struct(bins, "island")).alias("x")).select("district", "x.*")
    return best.mapInArrow(_place(capacity), "uid long, district long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, district_pieces: int = DISTRICT_PIECES, seed: int = 1, sizes: Islands = Islands()) -> DataFrame:
    """``pieces`` (uid and length among its columns) with sequence_id and offset.

    No sequence is longer than ``capacity`` and its pieces lie in it without gaps.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pack-pieces")
    small = pieces.where(F.col("length") < capacity).select("uid", "length")
    whole = pieces.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    districts = max(1, -(-small.count() // district_pieces))
    first = materialise(_solve(small, districts, capacity, seed, spread, sizes), "pack-first")
    well = F.col("fill") >= int(WELL_FILLED * capacity)
    ids = lambda k: (F.lit(k << 60) + F.col("district") * (1 << 32) + F.col("bin")).alias("sequence_id")
    placed = [whole, first.where(well).select("uid", ids(1), "offset")]
    again = small.join(first.where(~well).select("uid"), "uid", "left_semi")
    again = materialise(_solve(again, max(1, -(-again.count() // district_pieces)), capacity, seed + 1, spread, sizes), "pack-second")
    placed.append(again.select("uid", ids(2), "offset"))
    places = placed[0].union(placed[1]).union(placed[2])
    return pieces.join(places, "uid")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs``."""
    return pack(tokenise(docs, path, capacity, **columns), capacity).drop("uid")
