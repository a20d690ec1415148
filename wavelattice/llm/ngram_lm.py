"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped for scoring.

Three passes over the training texts' words, each reduced to sorted arrays
within a chunk before anything is shuffled:

1. vocabulary: distinct word hashes with counts, in shards by hash range; a
   word's id is its place in the sorted hash array;
2. bigrams: distinct (id, id) keys with counts, in shards by a range of the
   first id; a context with more than a quarter of a shard's share of all
   tokens is dealt by the second id over as many shards as its count asks for;
3. from the final bigram counts, each word's number of different followers
   with counts 1, 2 and over 2, and its number of different predecessors.

Order 3 counts trigrams (a, b, c) in the second pass, dealt like the bigrams
(b, c), so that a shard has all trigrams that end in one of its bigrams; a
bigram's count is then its number of different predecessors. A shard keeps its
trigrams as a tree b, a, c of sorted arrays with ends, its bigrams as a tree a, b; the sums over c that a
context (a, b) needs are kept where it has many followers, else added up when
asked for. A context whose b is dealt over several shards is summed over them.
Texts start with two start tokens; an unseen context (a, b) falls back to b.

Shards are raw sorted arrays in the shared folder, written under a temporary
name and renamed, so a repeated task leaves the same file. Scoring workers
memory-map them and look up sorted keys; nothing of the model is broadcast or
held in memory. The number of shards follows the size of the texts up to
MAX_SHARDS; beyond, shards grow. The driver gets three numbers a shard. Counts
and places are kept in 32 bits where they fit; a number that does not is an
error, never a wrong count.

The bigram probability is (c - D(c)) / c(context) plus the context's reserved
mass times the continuation probability of the word, which is discounted
likewise and interpolated with a uniform share of 1 / (V + 1) for each known
word and the unknown word. Unseen contexts fall back to the continuation
probability. The probabilities over V words and the unknown one sum to 1.

Texts: null counts as empty; A-Z are lower-cased; words are runs without ASCII
white space, and every text ends with an end token. Without training rows all
scores are those of a uniform model. Rows without an id are training rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelattice.llm import kernel
from wavelattice.llm.store import discard, materialise, new_path, posix_path

U = np.uint64
END = U(0x5BD1E995A5A5A5A5)
CHUNK_TOKENS = 2_000_000
SCORE_TOKENS = 400_000
SHARD_BYTES = 16 << 20
MAX_SHARDS = 1 << 16
ORDERS = (2, 3)
WIDE = 8
PAIRS = ("pair_head", "pair_end", "pair_end_wrap", "pair_tail", "pair_count", "pair_count_at", "pair_count_over")
TREE = ("head", "head_end", "head_end_wrap", "context", "context_end", "context_end_wrap", "third", "third_count", "third_count_at", "third_count_over", "wide", "wide_sums")


def _token_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, each text closed by END, and n+1 token offsets."""
    hashes, bounds = kernel.words(raw, offsets)
    n = len(bounds) - 1
    out = np.full(len(hashes) + n, END)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] + np.arange(n)] = False
    out[keep] = hashes
    return out, bounds + np.arange(n + 1)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and text offsets of successive runs of texts with about ``limit`` tokens."""
    tokens, bounds, size = [], [], 0
    for batch in batches:
        for _, _, raw, offsets in kernel.slices(batch.column(column)):
            t, b = _token_ends(raw, offsets)
            tokens.append(t)
            bounds.append(b[1:] + size)
            size += len(t)
            if size >= limit:
                yield np.concatenate(tokens), np.concatenate([[0], *bounds])
                tokens, bounds, size = [], [], 0
    if size:
        yield np.concatenate(tokens), np.concatenate([[0], *bounds])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and the sums of each value over equal keys."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with equal first column, from a sorted partition."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != key:
                yield key, held
                held = []
            key = row["shard"]
            held.append(row)
    if held:
        yield key, held


def _joined(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), dtype)


def _save(path: str, array: np.ndarray) -> None:
    """Write atomically; every attempt of a task writes the same bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, path)


def _u32(x: np.ndarray) -> np.ndarray:
    """``x`` in 32 bits; an error where it does not fit."""
    if len(x) and int(x.max()) >> 32:
        raise OverflowError(f"{int(x.max())}: more than 32 bits; use more shards")
    return x.astype(np.uint32)


def _save_ints(path: str, x: np.ndarray) -> None:
    """Numbers from 0 in the fewest bytes that hold the largest; their number tells the reader how many."""
    top = int(x.max(initial=0))
    _save(path, x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)))


def _save_ends(path: str, name: str, shard: int, ends: np.ndarray) -> None:
    """Ascending numbers as their lower 16 bits, and the places where the upper ones go up by one."""
    _save(f"{path}/{name}/{shard}", (ends & 0xFFFF).astype(np.uint16))
    high = ends >> 16
    _save(f"{path}/{name}_wrap/{shard}", _u32(np.searchsorted(high, np.arange(1, int(high[-1]) + 1)) if len(ends) else ends))


def _save_counts(path: str, name: str, shard: int, counts: np.ndarray) -> None:
    """Counts in a byte each, those of 255 and more beside them."""
    over = np.flatnonzero(counts >= 255)
    _save(f"{path}/{name}/{shard}", np.minimum(counts, 255).astype(np.uint8))
    _save(f"{path}/{name}_at/{shard}", _u32(over))
    _save(f"{path}/{name}_over/{shard}", counts[over].astype(np.uint64))


class _Ends:
    """Reads what _save_ends wrote."""

    def __init__(self, low: np.ndarray, wrap: np.ndarray):
        self.low, self.wrap = low, wrap

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.wrap, at, side="right") << 16 | self.low[at].astype(np.int64)


def _map(path: str, dtype) -> np.ndarray:
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    """Each shard's rows in a partition of their own."""
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash: equal ranges of its upper 32 bits."""
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


@dataclass
class Model:
    """Where the arrays are, and the few totals that scoring needs.

    starts[i] is the id of the first word of vocabulary shard i; the id V
    stands for the start of a text.
    """

    path: str
    shards: int
    starts: list[int]
    tokens: int
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_total: int = 0
    low_mass: float = 1.0
    order: int = 2
    top_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    @property
    def words(self) -> int:
        return self.starts[-1]

    def array(self, kind: str, shard: int, dtype) -> np.ndarray:
        key = kind, shard
        if key not in self._open:
            self._open[key] = _map(f"{self.path}/{kind}/{shard}", dtype)
        return self._open[key]

    def ints(self, kind: str, shard: int) -> np.ndarray:
        """An array kept by id, in whatever width it was saved."""
        key = kind, shard
        if key not in self._open:
            path = f"{self.path}/{kind}/{shard}"
            n = self.starts[shard + 1] - self.starts[shard] if shard < self.shards else 1
            self._open[key] = _map(path, f"u{os.path.getsize(path) // max(n, 1) or 1}")
        return self._open[key]

    def ends(self, kind: str, shard: int) -> _Ends:
        return _Ends(self.array(kind, shard, np.uint16), self.array(f"{kind}_wrap", shard, np.uint32))

    def counts(self, kind: str, shard: int, at: np.ndarray) -> np.ndarray:
        """What _save_counts wrote, at the given places."""
        out = self.array(kind, shard, np.uint8)[at].astype(np.int64)
        over = np.flatnonzero(out == 255)
        if len(over):
            out[over] = self.array(f"{kind}_over", shard, np.uint64)[np.searchsorted(self.array(f"{kind}_at", shard, np.uint32), at[over])]
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        shard = hash_shard(hashes, self.shards)
        for s, a, b in _spans(shard):
            known = self.array("word", s, np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self.starts[s], -1)
        return out

    def of_ids(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids (below V + 1) from an array kept by id."""
        out = np.zeros(len(ids), np.int64)
        shard = np.minimum(np.searchsorted(self.starts, ids, side="right") - 1, self.shards)
        for s, a, b in _spans(shard):
            out[a:b] = self.ints(kind, s)[ids[a:b] - self.starts[s]]
        return out

    def bigram_shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shard of each bigram, for first ids in order."""
        heads, runs = _runs(a)
        spread = 1 + self.of_ids("word_count", heads) * 4 * self.shards // max(self.tokens, 1)
        return (a * self.shards // (self.words + 1) + b % np.repeat(np.minimum(spread, self.shards), runs)) % self.shards

    def bigram_counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts of bigrams in the order of a."""
        out = np.zeros(len(a), np.int64)
        shard = self.bigram_shard(a, b)
        order = np.argsort(shard, kind="stable")
        for s, i, j in _spans(shard[order]):
            mine = order[i:j]
            h, there = _place(self.array("pair_head", s, np.uint32), a[mine])
            mine, h = mine[there], h[there]
            if len(mine):
                lo, hi = _range(self.ends("pair_end", s), h)
                at, found = _find(self.array("pair_tail", s, np.uint32), lo, hi, b[mine])
                out[mine[found]] = self.counts("pair_count", s, at[found])
        return out

    def _context_at(self, s: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the contexts (a, b) in a shard's tree, in the order of b; and which are there."""
        h, there = _place(self.array("head", s, np.uint32), b)
        if not there.any():
            return h, there
        lo, hi = _range(self.ends("head_end", s), h)
        return _find(self.array("context", s, np.uint32), lo, np.where(there, hi, lo), a)

    def trigram_counts(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts of trigrams in the order of b."""
        out = np.zeros(len(a), np.int64)
        shard = self.bigram_shard(b, c)
        order = np.argsort(shard, kind="stable")
        for s, i, j in _spans(shard[order]):
            mine = order[i:j]
            at, found = self._context_at(s, a[mine], b[mine])
            mine, at = mine[found], at[found]
            if len(mine):
                lo, hi = _range(self.ends("context_end", s), at)
                at, found = _find(self.array("third", s, np.uint32), lo, hi, c[mine])
                out[mine[found]] = self.counts("third_count", s, at[found])
        return out

    def context_sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows (tokens, followers with counts 1, 2 and over 2) of contexts in the order of b."""
        out = np.zeros((4, len(a)), np.int64)
        heads, runs = _runs(b)
        spread = 1 + self.of_ids("word_count", heads) * 4 * self.shards // max(self.tokens, 1)
        spread = np.repeat(np.minimum(spread, self.shards), runs)
        for k in range(int(spread.max(initial=0))):
            some = np.flatnonzero(spread > k)
            shard = (b[some] * self.shards // (self.words + 1) + k) % self.shards
            order = np.argsort(shard, kind="stable")
            for s, i, j in _spans(shard[order]):
                mine = some[order[i:j]]
                at, found = self._context_at(s, a[mine], b[mine])
                mine, at = mine[found], at[found]
                if not len(mine):
                    continue
                lo, hi = _range(self.ends("context_end", s), at)
                wide = hi - lo > WIDE
                if wide.any():
                    sums = self.array("wide_sums", s, np.uint32).reshape(4, -1)
                    out[:, mine[wide]] += sums[:, np.searchsorted(self.array("wide", s, np.uint32), at[wide])].astype(np.int64)
                mine, lo, n = mine[~wide], lo[~wide], (hi - lo)[~wide]
                if len(mine):
                    first = np.cumsum(n) - n
                    counts = self.counts("third_count", s, np.repeat(lo - first, n) + np.arange(n.sum()))
                    out[:, mine] += _sums(counts, first)
        return out


def _place(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in the sorted distinct values; and which are there."""
    if not len(values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(values, x.astype(values.dtype)), len(values) - 1)
    return at, values[at] == x


def _find(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in its own sorted range of ``values``; and which are there."""
    lo, top = lo.astype(np.int64), hi.astype(np.int64)
    open_ = np.flatnonzero(lo < top)
    while len(open_):
        mid = (lo[open_] + top[open_]) >> 1
        less = values[mid] < x[open_]
        lo[open_[less]] = mid[less] + 1
        top[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < top[open_]]
    return lo, (lo < hi) & (values[np.minimum(lo, len(values) - 1)] == x)


def _range(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of the given groups."""
    at = np.minimum(at, len(ends) - 1)
    return np.where(at > 0, ends[np.maximum(at - 1, 0)], 0).astype(np.int64), ends[at].astype(np.int64)


def _sums(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum, ones, twos and more of the runs of counts that start at ``first``."""
    return np.stack([np.add.reduceat(v.astype(np.int64), first) for v in (counts, counts == 1, counts == 2, counts > 2)])


def _sorted_by(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then the next; as one integer where the keys fit."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 64:
        return np.lexsort(keys[::-1])
    packed = keys[0].astype(np.uint64)
    for k, n in zip(keys[1:], bits[1:], strict=True):
        packed = packed << U(n) | k.astype(np.uint64)
    return np.argsort(packed)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where one of the sorted keys differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _planes(x: np.ndarray) -> bytes:
    """Bytes by their weight, which compress better."""
    return _u32(x).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0] for r in rows])


def _spans(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of each run in sorted shard numbers."""
    if len(shard):
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        yield from zip(shard[first].tolist(), first.tolist(), np.append(first[1:], len(shard)).tolist(), strict=True)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of keys with counts 1 to 4.

    Where the estimate is undefined or out of range, half a count for each is taken.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return tuple(d if 0 < d <= k + 1 else 0.5 for k, d in enumerate(out))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(counts, 3)]


def _count_words(shards: int, limit: int) -> Callable:
    def run(batches):
        for tokens, _ in _chunks(batches, 0, limit):
            words, counts = _counted(tokens)
            yield _sharded(hash_shard(words, shards), words=words, counts=_u32(counts))

    return run


def _sharded(shard: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """One row a shard with the arrays' parts as bytes; ``shard`` is sorted."""
    spans = list(_spans(shard))
    columns = {"shard": pa.array([s for s, _, _ in spans], pa.int32())}
    for name, x in arrays.items():
        columns[name] = pa.array([x[a:b].tobytes() for _, a, b in spans], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _save_words(path: str) -> Callable:
    def run(batches):
        for shard, rows in _groups(batches):
            words, counts = _summed(_joined(rows, "words", np.uint64), _joined(rows, "counts", np.uint32).astype(np.uint64))
            _save(f"{path}/word/{shard}", words)
            _save_ints(f"{path}/word_count/{shard}", counts)
            out = {"n": len(words), "total": int(counts.sum()), "ends": int(counts[words == END].sum())}
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), **{k: pa.array([v], pa.int64()) for k, v in out.items()}})

    return run


def _local_ids(tokens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes' ids, and each token's place among them."""
    distinct, _ = _counted(tokens)
    return model.ids(distinct), np.searchsorted(distinct, tokens)


def _contexts(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; ``start`` at the beginning of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = start
    return before


def _count_pairs(model: Model, limit: int) -> Callable:
    def run(batches):
        for tokens, bounds in _chunks(batches, 0, limit):
            ids, at = _local_ids(tokens, model)
            ids = ids[at]
            keys, counts = _counted(_contexts(ids, bounds, model.words).astype(np.uint64) << U(32) | ids.astype(np.uint64))
            first, second = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
            shard = model.bigram_shard(first, second)
            order = np.argsort(shard, kind="stable")
            shard, first, second, counts = shard[order], first[order], second[order], counts[order]
            rows = {"shard": [], "heads": [], "runs": [], "tails": [], "counts": []}
            for s, a, b in _spans(shard):
                heads, runs = _runs(first[a:b])
                rows["shard"].append(s)
                rows["heads"].append(_u32(heads).tobytes())
                rows["runs"].append(_u32(runs).tobytes())
                rows["tails"].append(_u32(second[a:b]).tobytes())
                rows["counts"].append(_u32(counts[a:b]).tobytes())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in rows.items()})

    return run


def _count_triples(model: Model, limit: int) -> Callable:
    def run(batches):
        for tokens, bounds in _chunks(batches, 0, limit):
            distinct, at = _local_ids(tokens, model)
            ids = np.append(distinct, model.words)
            b = _contexts(at, bounds, len(distinct))
            a = _contexts(b, bounds, len(distinct))
            order = _sorted_by(b, a, at)
            b, a, c = b[order], a[order], at[order]
            first = _changes(b, a, c)
            counts = np.diff(np.append(first, len(c)))
            b, a, c = ids[b[first]], ids[a[first]], ids[c[first]]
            shard = model.bigram_shard(b, c)
            order = np.argsort(shard, kind="stable")
            shard, b, a, c, counts = shard[order], b[order], a[order], c[order], counts[order]
            out = {"shard": [], "b": [], "b_runs": [], "a": [], "a_runs": [], "c": [], "counts": []}
            for s, i, j in _spans(shard):
                at_a = _changes(b[i:j], a[i:j])
                heads, runs = _runs(b[i:j][at_a])
                a_runs = np.diff(np.append(at_a, j - i))
                out["shard"].append(s)
                for name, x in (("b", heads), ("b_runs", runs), ("a", a[i:j][at_a]), ("a_runs", a_runs), ("c", c[i:j]), ("counts", counts[i:j])):
                    out[name].append(_planes(x))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in out.items()})

    return run


def _save_tree(path: str, shard: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Save a shard's final trigrams; its bigrams with their numbers of predecessors, and the counts of counts."""
    a_runs = _from_planes(rows, "a_runs")
    b = np.repeat(np.repeat(_from_planes(rows, "b"), _from_planes(rows, "b_runs")), a_runs)
    a = np.repeat(_from_planes(rows, "a"), a_runs)
    c, counts = _from_planes(rows, "c"), _from_planes(rows, "counts")
    rows.clear()
    order = _sorted_by(b, a, c)
    b, a, c, counts = b[order], a[order], c[order], counts[order]
    first = _changes(b, a, c)
    counts = np.add.reduceat(counts.astype(np.int64), first)
    b, a, c = b[first], a[first], c[first]
    context = _changes(b, a)
    head = _changes(b[context])
    followers = np.diff(np.append(context, len(c)))
    wide = np.flatnonzero(followers > WIDE)
    _save_ends(path, "head_end", shard, np.append(head[1:], len(context)))
    _save_ends(path, "context_end", shard, np.append(context[1:], len(c)))
    _save_counts(path, "third_count", shard, counts)
    for name, x in (("head", b[context][head]), ("context", a[context]), ("third", c), ("wide", wide), ("wide_sums", _sums(counts, context)[:, wide])):
        _save(f"{path}/{name}/{shard}", _u32(np.ascontiguousarray(x).ravel()))
    keys, preceding = _counted(b.astype(np.uint64) << U(32) | c)
    return keys, preceding, [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs in a sorted array."""
    if not len(x):
        return x, x
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[first], np.diff(np.append(first, len(x)))


def _save_pairs(model: Model) -> Callable:
    """Final counts of a shard; what they add to each word's follower and predecessor numbers."""

    def run(batches):
        for shard, rows in _groups(batches):
            top = [0] * 4
            if model.order == 3:
                keys, counts, top = _save_tree(model.path, shard, rows)
            else:
                first = np.repeat(_joined(rows, "heads", np.uint32), _joined(rows, "runs", np.uint32)).astype(np.uint64)
                keys, counts = _summed(first << U(32) | _joined(rows, "tails", np.uint32), _joined(rows, "counts", np.uint32).astype(np.int64))
            heads, runs = _runs(keys >> U(32))
            _save(f"{model.path}/pair_head/{shard}", _u32(heads))
            _save(f"{model.path}/pair_tail/{shard}", (keys & U(0xFFFFFFFF)).astype(np.uint32))
            _save_ends(model.path, "pair_end", shard, np.cumsum(runs))
            _save_counts(model.path, "pair_count", shard, counts)
            heads, *follow = _summed(keys >> U(32), counts, *((counts == k).astype(np.int64) for k in (1, 2)), (counts > 2).astype(np.int64))
            tails, preceding = _counted(keys & U(0xFFFFFFFF))
            histogram = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + top
            for kind, ids, values in ((0, heads, follow), (1, tails, [preceding])):
                out = np.minimum(np.searchsorted(model.starts, ids.astype(np.int64), side="right") - 1, model.shards)
                part = _sharded(out, ids=_u32(ids), **{f"v{i}": _u32(values[i] if i < len(values) else np.zeros(0)) for i in range(4)})
                n = part.num_rows
                part = part.append_column("kind", pa.array([kind] * n, pa.int32()))
                yield part.append_column("histogram", pa.array([histogram if kind == i == 0 else [0] * 8 for i in range(n)], pa.list_(pa.int64())))

    return run


_PARTS = "shard int, ids binary, v0 binary, v1 binary, v2 binary, v3 binary, kind int, histogram array<long>"


def _save_sums(model: Model) -> Callable:
    """Add up the parts of each vocabulary shard to arrays by id; counts of counts of predecessors."""

    def run(batches):
        for shard, rows in _groups(batches):
            base = model.starts[shard]
            size = model.starts[shard + 1] - base if shard < model.shards else 1
            sums = np.zeros((5, size), np.int64)
            for r in rows:
                at = np.frombuffer(r["ids"], np.uint32).astype(np.int64) - base
                if r["kind"] == 0:
                    for k in range(4):
                        sums[k][at] += np.frombuffer(r[f"v{k}"], np.uint32)
                else:
                    sums[4][at] += np.frombuffer(r["v0"], np.uint32)
            for name, x in zip(("follow", "follow1", "follow2", "follow3", "precede"), sums, strict=True):
                _save_ints(f"{model.path}/{name}/{shard}", x)
            low = sums[4]
            yield pa.RecordBatch.from_pydict(
                {"total": pa.array([int(low.sum())], pa.int64()), "histogram": pa.array([[int((low == k).sum()) for k in (1, 2, 3, 4)] + [int((low > 2).sum())]], pa.list_(pa.int64()))}
            )

    return run


def train(texts: DataFrame, shard_bytes: int = SHARD_BYTES, chunk_tokens: int = CHUNK_TOKENS, order: int = 2) -> Model:
    """Count a model over all rows of ``texts`` (one string column)."""
    if order not in ORDERS:
        raise ValueError(f"order {order}: must be one of {ORDERS}")
    texts = texts.select(F.col(texts.columns[0]).alias("text"))
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-size // shard_bytes)))
    path = posix_path(new_path(spark, "ngram"))

    kinds = ["word", "word_count", *PAIRS] + (list(TREE) if order == 3 else [])
    for s in range(shards):  # empty until a task replaces them, as a shard may have no words
        for kind in kinds:
            _save(f"{path}/{kind}/{s}", np.zeros(0))

    parts = _by_shard(texts.mapInArrow(_count_words(shards, chunk_tokens), "shard int, words binary, counts binary"), shards)
    rows = {r.shard: r for r in parts.mapInArrow(_save_words(path), "shard int, n long, total long, ends long").collect()}
    sizes = [rows[s].n if s in rows else 0 for s in range(shards)]
    model = Model(path, shards, [0, *np.cumsum(sizes).tolist()], sum(r.total for r in rows.values()), order=order)
    if model.words >> 32:
        raise OverflowError(f"{model.words} different words: ids have 32 bits")
    if not rows:
        return model
    _save_ints(f"{path}/word_count/{shards}", np.array([sum(r.ends for r in rows.values())]))  # of the start of a text

    if order == 3:
        pairs = texts.mapInArrow(_count_triples(model, chunk_tokens), "shard int, b binary, b_runs binary, a binary, a_runs binary, c binary, counts binary")
    else:
        pairs = texts.mapInArrow(_count_pairs(model, chunk_tokens), "shard int, heads binary, runs binary, tails binary, counts binary")
    pairs = _by_shard(pairs, shards)
    parts = materialise(pairs.mapInArrow(_save_pairs(model), _PARTS), "ngram-parts")
    high = parts.agg(*(F.sum(F.col("histogram")[k]) for k in range(8))).first()
    low = _by_shard(parts, shards + 1).mapInArrow(_save_sums(model), "total long, histogram array<long>")
    low = materialise(low, "ngram-sums").agg(F.sum("total"), *(F.sum(F.col("histogram")[k]) for k in range(5))).first()
    discard(parts)
    model.discounts, model.top_discounts = discounts(list(high[:4])), discounts(list(high[4:]))
    model.low_discounts = discounts(list(low[1:5]))
    model.low_total = low[0]
    d = model.low_discounts
    model.low_mass = (d[0] * low[1] + d[1] * low[2] + d[2] * low[5]) / low[0]
    return model


def _probabilities(model: Model, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 model and base probabilities of all tokens, and which tokens are known."""
    if not model.words:
        p = np.zeros(len(tokens))  # a vocabulary of nothing but the unknown word
        return p, p, np.zeros(len(tokens), bool)
    distinct, at = _local_ids(tokens, model)
    known = distinct >= 0
    ids = distinct[known]  # in order, as hashes and ids are
    low, word = np.zeros((2, len(distinct)))
    n = model.of_ids("precede", ids)
    low[known] = (n - _discount(n, model.low_discounts)) / model.low_total
    low += model.low_mass / (model.words + 1)
    word[known] = model.of_ids("word_count", ids)
    base = np.log10((word + 0.1) / (model.tokens + 0.1 * (model.words + 1)))

    # Contexts: the distinct words and, last, the start of a text.
    context = np.append(distinct, model.words)
    total, mass = np.zeros(len(context)), np.ones(len(context))
    seen = np.flatnonzero(context >= 0)
    total[seen] = model.of_ids("follow", context[seen])
    reserved = sum(d * model.of_ids(f"follow{k + 1}", context[seen]) for k, d in enumerate(model.discounts))
    mass[seen] = np.where(total[seen] > 0, reserved / np.maximum(total[seen], 1), 1.0)

    before = _contexts(at, bounds, len(distinct))
    a, b = context[before], distinct[at]
    both = (a >= 0) & (b >= 0)
    keys = a[both].astype(np.uint64) << U(32) | b[both].astype(np.uint64)
    distinct_keys, _ = _counted(keys)
    counts = np.zeros(len(tokens), np.int64)
    found = model.bigram_counts((distinct_keys >> U(32)).astype(np.int64), (distinct_keys & U(0xFFFFFFFF)).astype(np.int64))
    counts[both] = found[np.searchsorted(distinct_keys, keys)]
    p = mass[before] * low[at]
    hit = counts > 0
    p[hit] += (counts[hit] - _discount(counts[hit], model.discounts)) / total[before[hit]]
    if model.order == 3:
        p = _trigram(model, p, context, at, before, bounds)
    return np.log10(p), base[at], known[at]


def _trigram(model: Model, p: np.ndarray, context: np.ndarray, at: np.ndarray, before: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Trigram probabilities of all tokens from the bigram ones; ``context`` has the ids of the words, then of the start."""
    a, b = _contexts(before, bounds, len(context) - 1), before
    seen = np.flatnonzero((context[a] >= 0) & (context[b] >= 0))
    order = seen[_sorted_by(b[seen], a[seen], at[seen])]
    if not len(order):
        return p
    a, b, c = a[order], b[order], at[order]
    first = _changes(b, a)
    sums = model.context_sums(context[a[first]], context[b[first]])
    sums = np.repeat(sums, np.diff(np.append(first, len(order))), axis=1)
    first = _changes(b, a, c)
    hit = first[context[c[first]] >= 0]
    counts = np.zeros(len(order), np.int64)
    counts[hit] = model.trigram_counts(context[a[hit]], context[b[hit]], context[c[hit]])
    counts = np.repeat(counts[first], np.diff(np.append(first, len(order))))
    total = np.maximum(sums[0], 1)
    mass = np.where(sums[0] > 0, sum(d * sums[k + 1] for k, d in enumerate(model.top_discounts)) / total, 1.0)
    out = p.copy()
    out[order] = (counts - _discount(counts, model.top_discounts)) / total + mass * p[order]
    return out


def _score(model: Model, limit: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            done = 0
            for tokens, bounds in _chunks(iter([batch]), 2, limit):
                score, base, known = _probabilities(model, tokens, bounds)
                n = len(bounds) - 1
                starts = bounds[:-1]
                sums = [np.diff(bounds), np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(score, starts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), batch.column(1).slice(done, n), *map(pa.array, sums)], schema=schema)
                done += n

    return run


def score(docs: DataFrame, model: Model, chunk_tokens: int = SCORE_TOKENS) -> DataFrame:
    """n_tokens, n_known, base_score, score and perplexity of the rows (doc_id, held_out, text) of ``docs``."""
    out = docs.select("doc_id", "held_out", "text").mapInArrow(
        _score(model, chunk_tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out_fold(id_col: str, folds: int) -> Column:
    """True for one fold in ``folds`` by the CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = 2) -> DataFrame:
    """Learn a model of the given order from the rows outside the held-out fold and score every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_fold(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return score(rows, train(rows.where("not held_out").select("text"), order=order))
