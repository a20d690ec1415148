import math
import re
import zlib
from collections import Counter

import pytest

from wavelattice.llm import ngram_lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"] for i, t in rows}
    uni, bi = Counter(), Counter()
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 10:
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    total, words = sum(uni.values()), len(uni)
    d = (0, *ngram_lm.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)]))
    before = Counter(b for _, b in bi)
    low = (0, *ngram_lm.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)]))
    kinds = sum(before.values())
    mass = sum(low[min(c, 3)] for c in before.values()) / kinds
    ctx, reserved = Counter(), Counter()
    for (a, _), c in bi.items():
        ctx[a] += c
        reserved[a] += d[min(c, 3)]

    def p(a, w):
        c = before[w]
        p1 = (c - low[min(c, 3)]) / kinds + mass / (words + 1)
        if a not in ctx:
            return p1
        n = bi[a, w]
        return (n - d[min(n, 3)]) / ctx[a] + reserved[a] / ctx[a] * p1

    out = {}
    for i, w in tok.items():
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True))
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (words + 1))) for x in w)
        out[i] = (len(w), sum(x in uni for x in w), total, pytest.approx(base), pytest.approx(score))
    known = [w for w in uni]
    assert sum(p("the", w) for w in known) + reserved["the"] / max(ctx["the"], 1) * mass / (words + 1) == pytest.approx(1) or "the" not in ctx
    return out


def test_scores_follow_the_definition(spark):
    words = "the of and a to in is you that it he was for on are".split()
    rows = [(i, " ".join(words[(i * k * k + k) % 15] for k in range(i % 40))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "The OF unseen Wörter Ä ä"), (203, "x\n\ty"), (204, "a " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ngram_lm.train_and_score(docs).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == want[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_many_shards_and_small_chunks_change_nothing(spark):
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(30))) for i in range(1, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "false as held_out", "text")
    one = ngram_lm.score(docs, ngram_lm.train(docs.select("text"))).collect()
    many = ngram_lm.score(docs, ngram_lm.train(docs.select("text"), shard_bytes=512, chunk_tokens=100), chunk_tokens=50).collect()
    assert {r.doc_id: round(r.score, 9) for r in one} == {r.doc_id: round(r.score, 9) for r in many}


def brute_trigrams(rows, held=()):
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"] for i, t in rows}
    grams = lambda w: zip(["<s>", "<s>", *w[:-2]] if len(w) > 1 else ["<s>"], ["<s>", *w[:-1]], w, strict=True)
    tri = Counter(g for i, w in tok.items() if i not in held for g in grams(w))
    levels = [tri, Counter((b, c) for _, b, c in tri)]
    levels.append(Counter((c,) for _, c in levels[1]))
    ds = [(0, *ngram_lm.discounts([sum(c == k for c in n.values()) for k in (1, 2, 3, 4)])) for n in levels]
    sums, reserved = Counter(), Counter()
    for n, d in zip(levels, ds, strict=True):
        for g, c in n.items():
            sums[len(g), g[:-1]] += c
            reserved[len(g), g[:-1]] += d[min(c, 3)]

    def p(g):
        if not g:
            return 1 / (len(levels[2]) + 1)
        key = len(g), g[:-1]
        if not sums[key]:
            return p(g[1:])
        n, d = levels[3 - len(g)][g], ds[3 - len(g)]
        return (n - d[min(n, 3)]) / sums[key] + reserved[key] / sums[key] * p(g[1:])

    for g in (("<s>", "<s>"), ("the", "of"), ("never", "seen")):
        assert sum(p((*g, w)) for (w,) in levels[2]) + p((*g, "unknown")) == pytest.approx(1)
    return {i: pytest.approx(sum(math.log10(p(g)) for g in grams(w))) for i, w in tok.items()}


def test_trigram_scores_follow_the_definition(spark):
    words = "the of and a to in is you that it he was for on are".split()
    rows = [(i, " ".join(words[(i * k * k + k) % 15] for k in range(i % 40))) for i in range(150)]
    rows += [(201, ""), (202, "The OF unseen Wörter Ä ä"), (204, "a " * 3000), (205, "the of the and"), (206, "the of it"), (207, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "false as held_out", "text")
    train = docs.where("doc_id not in (202, 206, 30)").select("text")
    want = brute_trigrams(rows, {202, 206, 30})
    for options, chunk in (({}, 1000), ({"shard_bytes": 512, "chunk_tokens": 100}, 50)):
        model = ngram_lm.train(train, order=3, **options)
        got = {r.doc_id: r.score for r in ngram_lm.score(docs.repartition(3), model, chunk_tokens=chunk).collect()}
        assert got == want
    assert ngram_lm.score(docs, ngram_lm.train(train.limit(0), order=3)).count() == len(rows)
    with pytest.raises(ValueError):
        ngram_lm.train(train, order=4)


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.train_and_score(empty).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ngram_lm.train_and_score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b", 1.0, True), (1, None, 2.0, False), (1, None, 2.0, False)]
    got = ngram_lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean")).collect()
    assert len(got) == 3 and all(math.isfinite(r.score) for r in got)


def test_discounts_are_defined_everywhere():
    assert ngram_lm.discounts([0, 0, 0, 0]) == (0.5, 0.5, 0.5)
    assert all(0 < d <= k + 1 for n in ([5, 0, 0, 0], [1, 9, 9, 9], [100, 10, 3, 1]) for k, d in enumerate(ngram_lm.discounts(n)))
