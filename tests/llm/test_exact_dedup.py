import hashlib
import random
from collections import defaultdict

from wavelattice.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_naming_equals_comparing(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbBé\n ") for _ in range(rng.choice([0, 1, 7, 8, 9, 15, 16, 17, 64, 200, 1000]))) for _ in range(120)]
    texts += [t + "x" for t in texts[:20]] + [t.upper() for t in texts[:40]] + ["hot Text"] * 50 + [None, ""]
    texts += ["ab" * 40, "ab" * 40 + "a", "ab" * 41, "É", "é"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.deduplicate(docs, block_bytes=8, chunk_bytes=400).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute(rows)


def test_one_row_stays_with_repeated_and_missing_ids(spark, tmp_path):
    rows = [(1, "a", 7), (1, "a", 7), (None, "A", 7), (None, None, 7), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, level int")
    got = exact_dedup.deduplicate(docs).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in got) == [(0, 1, 3), (0, 3, 2), (1, 1, 3), (1, 1, 3), (3, 3, 2)]
    assert sum(r.kept for r in got) == 2
    assert [tuple(r) for r in exact_dedup.keep_distinct(docs).orderBy("doc_id").collect()] == [(1, "a", 7), (3, "", 7)]
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    assert [tuple(r) for r in exact_dedup.keep_distinct(spark.read.parquet(path)).orderBy("doc_id").collect()] == [(1, "a", 7), (3, "", 7)]


def test_rows_without_id_stay_once(spark):
    for first in ([(1, "a", 7)], [(1, "a", 7), (1, "b", 7)]):
        rows = [*first, (None, "A", 7), (None, "only", 7), (None, "Two", 7), (None, "two", 8), (None, None, 7), (None, "", 9), (2, "c", 7), (3, "C", 7)]
        got = exact_dedup.keep_distinct(spark.createDataFrame(rows, "doc_id long, text string, level int").repartition(3)).collect()
        assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got) == sorted([(0, ""), (0, "only"), (0, "two"), *((i, t) for i, t, _ in first), (3, "c")])


def test_empty_table(spark):
    assert exact_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_lone_row_without_id_stays_beside_clashing_columns(spark):
    rows = [(1, "a", 1, "x", 5), (None, "unique text", 2, "y", 6), (2, "a", 3, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_at int, _row_file string, row long")
    got = exact_dedup.keep_distinct(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "unique text"), (2, "a")]


def test_hot_groups_are_joined_whole(spark, monkeypatch):
    from wavelattice.llm import store

    monkeypatch.setattr(store, "HOT_ROWS", 5)
    monkeypatch.setattr(store, "HOT_KEYS", 20)
    long = "0123456789" * 5
    rows = [(i, "hot") for i in range(60)] + [(100 + i, long) for i in range(60)] + [(200 + i, f"{long}{i % 20}") for i in range(40)]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute(rows) and len(got) == len(rows)


def test_the_texts_that_stay_are_not_shuffled(spark, monkeypatch, tmp_path):
    from wavelattice.llm import store

    rows = [(i, f"text {i % 150} of this table", i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    last = {max(i for i in range(400) if i % 150 == k) for k in range(150)}
    keyed, key = store.with_row_key(docs)
    drop = keyed.where(~keyed.row.isin(last)).select(key)
    # As on tables whose rows that stay are too many to be broadcast by their size.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for words in (store.BIT_WORDS, 0):
            monkeypatch.setattr(store, "BIT_WORDS", words)
            for out in (exact_dedup.keep_distinct(docs), store.pick_rows(keyed, key, drop, stay=False)):
                assert sorted(r.row for r in out.collect()) == sorted(last)
                plan = out._jdf.queryExecution().executedPlan().toString()
                assert ("Exchange hashpartitioning" in plan) == (words == 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
