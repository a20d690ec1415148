import random
import re
from collections import defaultdict

import pytest

from wavelattice.llm import near_dedup, store
from wavelattice.llm.near_dedup import near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(spark, rows):
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("edit", [0.02, 0.045, 0.07])
@pytest.mark.parametrize("block", [4096, 16])
def test_groups_of_near_copies_and_shared_passages(spark, monkeypatch, edit, block):
    if block < 4096:  # many blocks and hot keys in a small table
        if edit > 0.05:
            pytest.skip("one edit rate of each kind")
        for name in ("KEY_BLOCK", "CLUSTER_BLOCK", "STRAY_BLOCK", "PIVOT_BLOCK"):
            monkeypatch.setattr(near_dedup, name, block)
        monkeypatch.setattr(store, "HOT_ROWS", 10)
    rng = random.Random(int(edit * 1000))
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = text(60), text(120)
    docs = [text(rng.randint(30, 200)) for _ in range(60)]
    docs += [passage + text(rng.randint(5, 60)) for _ in range(60)]
    docs += [[w if rng.random() > edit else rng.choice(vocabulary) for w in base] for _ in range(150)]
    docs += [base[:]] * 5 + [passage[:]] * 3
    rng.shuffle(docs)
    check(spark, [(3 * i + 1, " ".join(d)) for i, d in enumerate(docs)])


def test_rows_searched_for_a_large_near_group_do_not_grow_with_its_square(spark, monkeypatch):
    made, grid = [], near_dedup._grid

    def counted(rows, block, strays):
        out = store.materialise(grid(rows, block, strays), "counted")
        made.append((rows.columns, rows.count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "_grid", counted)
    monkeypatch.setattr(near_dedup, "STRAY_BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    docs = [[w if rng.random() > 0.04 else f"w{rng.randrange(4000)}" for w in base] for _ in range(200)]
    check(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])
    columns, n, out = made[0]
    assert {"m", "v"} <= set(columns) and out <= 2 * n


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b c"), (5, "A b C"), (6, "a b c d"), (7, "x " * 5000), (8, "x " * 9), (9, "é A"), (10, "É a")]
    check(spark, rows)


def test_missing_ids_repeated_rows_and_other_columns(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 3), (2, "A B c d e f", 4)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, False), (2, 2, True), (5, 2, False), (5, 2, False)]


def test_one_row_of_each_group_stays(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z", "1 2 3 4 5 6 7"
    rows = [(7, a, 1), (3, a + " end", 2), (7, b, 3), (None, b, 4), (None, "only here, of all rows, once", 5), (None, "9 9 9 9 9 9", 6), (None, "9 9 9 9 9 9", 7), (8, None, 8), (9, "", 9)]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(2)).collect()
    assert sorted(r.row for r in got if r.row not in (6, 7)) == [2, 3, 5, 8, 9] and len(got) == 6


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signature_distance_bounds(spark):
    """Every pair of near signatures has a key in common."""
    import numpy as np

    from wavelattice.llm import near_dedup as n

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, n.SYMBOLS)
    for _ in range(200):
        b = a.copy()
        at = rng.choice(n.SYMBOLS, n.MAX_DISTANCE, replace=False)
        b[at] = rng.integers(0, 1 << 16, n.MAX_DISTANCE)
        wrong = (a != b).reshape(n.CHUNKS, n.PER_CHUNK).sum(axis=1)
        assert wrong.min() <= 1
