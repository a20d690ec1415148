import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavelattice.llm import decontaminate, html_extract, licenses, packing, pii, quality, sharding, store
from wavelattice.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# Sharding


@pytest.mark.parametrize("n,shards,block", [(1000, 24, 3), (7, 24, 2), (300, 1, 5), (0, 3, None)])
def test_shards_are_balanced_and_slots_gapless(spark, n, shards, block):
    docs = frame(spark, [(i, f"t{i}") for i in range(n)]).repartition(5)
    got = sharding.shuffle_into_shards(docs, shards, seed=3, blocks_per_shard=block).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert not n or max(sizes) - min(sizes) <= 1


def test_matrix_rows_have_the_given_sums():
    parts, blocks = np.array([5, 0, 9, 100, 1]), np.array([40, 40, 35])
    rows = np.stack([sharding.matrix_row(parts, blocks, p, 8) for p in range(5)])
    assert (rows.sum(axis=1) == parts).all() and (rows.sum(axis=0) == blocks).all() and (rows >= 0).all()


def test_shuffle_is_uniform():
    """Mean and variance of a cell over many seeds are those of the hypergeometric law."""
    cells = [sharding.matrix_row(np.array([30, 50, 20]), np.array([25, 75]), 1, s)[0] for s in range(3000)]
    mean = 50 * 25 / 100
    assert abs(np.mean(cells) - mean) < 0.2
    assert abs(np.var(cells) - mean * 0.75 * (50 / 99)) < 0.4


def test_large_populations():
    rng = np.random.default_rng(1)
    draws = [sharding._hypergeometric(rng, 6 * 10**9, 4 * 10**9, 1000) for _ in range(3000)]
    assert abs(np.mean(draws) - 600) < 2 and abs(np.std(draws) - 15.5) < 1


def test_log_factorials_and_close_decisions(monkeypatch):
    import decimal

    with decimal.localcontext(sharding._DIGITS):
        for n in (0, 1, 5, 9999, 10_000, 10_007):
            product = 1
            for k in range(2, n + 1):
                product *= k
            assert abs(sharding._log_factorial(n) - decimal.Decimal(product).ln()) < decimal.Decimal("1e-45")
    # The sampler above the limit follows the law: exact probabilities of a small population.
    monkeypatch.setattr(sharding, "LIMIT", 1)
    rng = np.random.default_rng(2)
    draws = np.bincount([sharding._hypergeometric(rng, 9, 6, 7) for _ in range(20_000)], minlength=8) / 20_000
    want = [math.comb(9, k) * math.comb(6, 7 - k) / math.comb(15, 7) for k in range(8)]
    assert np.abs(draws - want).max() < 0.012


def test_large_splits_change_nothing(monkeypatch):
    parts, blocks = np.array([5, 0, 9, 100, 1, 40, 45]), np.array([80, 60, 60])
    rows = [sharding.matrix_row(parts, blocks, p, 8).tolist() for p in range(7)]
    monkeypatch.setattr(sharding, "LIMIT", 50)
    known = sharding.large_splits(parts, blocks, 8)
    rows2 = [sharding.matrix_row(parts, blocks, p, 8, known).tolist() for p in range(7)]
    assert known and np.sum(rows2, axis=0).tolist() == blocks.tolist() and np.sum(rows2, axis=1).tolist() == parts.tolist() == np.sum(rows, axis=1).tolist()


def test_all_arrangements_are_equally_likely(spark):
    """Four rows in two partitions: each of the 24 orders, over many seeds of the whole algorithm by hand."""
    counts = Counter()
    for seed in range(6000):
        parts, blocks = np.array([1, 3]), np.array([2, 2])
        order, first = [[], []], 0
        for p, n in enumerate(parts):
            rng = np.random.default_rng([seed, p, 7])
            to = rng.permutation(np.repeat(np.arange(2), sharding.matrix_row(parts, blocks, p, seed)))
            keys = rng.integers(0, 2**62, n)
            for i in range(n):
                order[to[i]].append((keys[i], first + i))
            first += n
        counts[tuple(r for b in order for _, r in sorted(b))] += 1
    assert len(counts) == 24 and max(counts.values()) < 330 and min(counts.values()) > 180


def test_shuffle_does_not_depend_on_batches_or_names(spark):
    docs = frame(spark, [(i, f"t{i}", i % 3, None, 7) for i in range(500)], "doc_id long, _start string, _at int, block string, sent int").repartition(4)
    path = store.materialise(docs, "test")
    got = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = sharding.shuffle_into_shards(path, 5, seed=1)
        assert out.columns == [*docs.columns, "shard", "slot"]
        got.append(sorted(map(tuple, out.select("doc_id", "_start", "shard", "slot").collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and all(r[1] == f"t{r[0]}" for r in got[0])


def test_shuffle_edges(spark):
    rows = [(1, None, 9), (1, None, 9), (None, "", 9)]
    got = sharding.shuffle_into_shards(frame(spark, rows, "doc_id long, text string, shard int"), 2).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1] and {r.shard for r in got} == {0, 1}


# Personal data

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
)


def test_base_spans_equal_plain_matching(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "x.y+z@d-e.f.g", "@", "a@b", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234.5678", "+1 2", "é", " ", "\n", "word", ".", "-", "7"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(400, None), (401, "a@b.c " * 4000)]
    got = {r.doc_id: r for r in pii.digest(pii.find_spans(frame(spark, rows))).collect()}
    for i, text in rows:
        found = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m[0]))
        assert got[i].base_sha256 == hashlib.sha256(",".join(s[2] for s in found).encode()).hexdigest(), text
        assert {s[2] for s in found} <= set(got[i].spans.split(","))
        assert got[i].n_ip == sum(s[1] == 1 for s in found)


def test_checksums_and_context(spark):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    found = {s[0]: s for s in pii.spans("IBAN GB82 WEST 1234 5698 7654 32, SSN 536-22-8726")}
    assert found["iban"][3] > 0.9 and found["ssn"]
    assert not pii.spans("part 536-22-8726") and not pii.spans("")
    near, far = pii.spans("call +1 415 555 0100")[0][3], pii.spans("build +1 415 555 0100")[0][3]
    assert near > far
    docs = frame(spark, [(1, "mail a@b.co now"), (2, None)])
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["mail [EMAIL] now", None]
    assert pii.digest(pii.find_spans(frame(spark, []))).collect() == []


def test_ibans_end_where_their_country_says():
    german = "DE89 3704 0044 0532 0130 00"
    for tail in ("", " BIC COBADEFFXXX", " 4711", f" {german}", ",", "."):
        found = [s for s in pii.spans(f"IBAN {german}{tail}") if s[0] == "iban"]
        assert found[0][1:3] == (5, 5 + len(german)) and len(found) == 1 + (tail[1:] == german)
    for text in (german + "X", "X" + german, german[:-1] + "1", "ZZ89 3704 0044 0532 0130 00", german[:-3]):
        assert not [s for s in pii.spans("IBAN " + text) if s[0] == "iban"]
    plain = lambda s: pii.mod97(s)
    rng = random.Random(1)
    for _ in range(2000):  # every start and every country's length, by brute force
        text = "".join(rng.choice(["DE", "NO", "89", "3704", "0044", " ", "X", "9386011117947"]) for _ in range(12))
        want, done = [], 0
        for i in range(len(text)):
            size = pii.IBAN_LENGTHS.get(text[i : i + 2])
            if not size or i < done or i and text[i - 1].isalnum() or not re.fullmatch("[0-9]{2}", text[i + 2 : i + 4]):
                continue
            end = next((j for j in range(i + 4, len(text) + 1) if len(text[i:j].replace(" ", "")) == size), None)
            if end and "  " not in text[i:end] and not (end < len(text) and text[end].isalnum()) and plain(text[i:end].replace(" ", "")):
                want.append((i, end))
                done = end
        assert [s[1:3] for s in pii.spans(text) if s[0] == "iban"] == want, text


def test_social_security_numbers_by_brute_force():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["536-22-8726", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "-", "1", " ", " ssn ", "social security ", "x" * 60]) for _ in range(4))
        want = []
        for i in range(len(text)):
            s = text[i : i + 11]
            if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s) and not re.match("[0-9-]", text[i - 1 : i]) and not re.match("[0-9-]", text[i + 11 : i + 12]):
                near = re.search(r"\b(ssn|social security)\b", text[max(0, i - 48) : i + 11 + 48])
                if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" and near:
                    want.append((i, i + 11))
        assert [s[1:3] for s in pii.spans(text) if s[0] == "ssn"] == want, text


@pytest.mark.parametrize("unit", ["1", "1.", "1.2.", "1-", "+1 ", "a@", "a@b", "a.", "AB12 ", "123-45-", "DE89", "x"])
def test_a_megabyte_of_one_pattern_is_read_in_linear_time(unit):
    started = time.time()
    pii.spans(unit * (1_000_000 // len(unit)))
    assert time.time() - started < 20


# Decontamination


def brute_leaks(docs, items):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = set()
    for d, text in docs:
        w = tok(text)
        for i, item in items:
            v = tok(item)
            for shift in range(-len(v), len(w)):
                s = best = 0
                for j, x in enumerate(v):
                    s = max(0, s + (1 if 0 <= shift + j < len(w) and w[shift + j] == x else -2))
                    best = max(best, s)
                if best >= decontaminate.MIN_SCORE:
                    out.add((d, i))
    return out


def test_leaks_with_replaced_words(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(16, 50)))) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for i in range(80):
        body = text(rng.randint(0, 60))
        if i % 2:
            words = rng.choice(items[:12])[1].split()
            for k in range(5, len(words), rng.choice([6, 9, 40])):
                words[k] = "changed"
            body = body + words[: rng.choice([8, 14, 99])] + text(rng.randint(0, 20))
        docs.append((i, rng.choice(["{}", "! {} ?"]).format(", ".join(body).upper() if i % 3 else " ".join(body))))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[0][1])]
    got = decontaminate.find_leaks(frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string"))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    want = brute_leaks([d for d in docs if d[0] is not None], items)
    whole = {(d, i) for d, i in want if d is not None}
    assert pairs <= whole and len(pairs) >= 0.9 * len(whole)
    assert {(102, 0)} <= pairs
    kept = decontaminate.remove_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {d[0] for d in docs} - {d for d, _ in pairs}


def test_short_items_with_a_fifth_of_the_words_replaced(spark):
    rng = random.Random(9)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items, docs = [], []
    for i in range(300):
        n, r = rng.choice([(10, 1), (12, 2), (14, 2), (16, 3), (18, 3), (20, 4), (25, 5)])
        item = text(n)
        copy = list(item)
        for k in rng.sample(range(n), r):
            copy[k] = "changed"
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(text(rng.randint(0, 30)) + copy + text(rng.randint(0, 30)))))
        docs.append((1000 + i, " ".join(text(9) + item[: n // 2] + text(9))))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert len({(i, i) for i in range(300)} & got) >= 0.98 * 300
    assert {p for p in got if p[0] != p[1]} <= {(1000 + i, i) for i, t in items if len(t.split()) // 2 >= decontaminate.MIN_SCORE}


def test_items_shorter_than_a_mask_are_found_whole(spark):
    items = [(1, "Who wrote the first novel?"), (2, "a b c d e f g h i"), (3, "yes"), (4, "c d"), (5, "who wrote")]
    docs = [(1, "Q: who wrote, the first novel"), (2, "who wrote the second novel"), (3, "a b c d e f g h i"), (4, "Yes. yes"), (5, "c"), (6, None), (7, "b c d x c d"), (None, "yes")]
    got = decontaminate.find_leaks(frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string")).collect()
    want = {(1, 1, 1, 5, 1), (1, 5, 1, 2, 1), (2, 5, 0, 2, 1), (3, 2, 0, 9, 1), (3, 4, 2, 2, 1), (4, 3, 0, 1, 2), (7, 4, 1, 2, 2)}
    assert {(r.doc_id, r.item_id, r.first_word, r.n_words, r.n_places) for r in got} == want and len(got) == len(want)
    assert all(r.score == r.n_equal == r.item_words == r.n_words for r in got)
    kept = decontaminate.remove_leaks(frame(spark, docs), frame(spark, items[:2], "item_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {2, 4, 5, 6, 7, None}


def test_leaks_of_empty_tables(spark):
    none = frame(spark, [])
    items = frame(spark, [(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert decontaminate.find_leaks(none, items).collect() == []
    assert decontaminate.find_leaks(frame(spark, [(1, "a b c")]), items.limit(0)).collect() == []


def test_leaks_are_the_same_when_seeds_are_shuffled(spark, monkeypatch):
    rng = random.Random(10)
    text = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(3, 30)))) for i in range(40)]
    docs = [(i, " ".join(text(20) + (items[i % 40][1].split() if i % 3 else []) + text(5)), i) for i in range(120)]
    got = []
    for rows in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        found = decontaminate.find_leaks(frame(spark, docs, "doc_id long, text string, _leak_id int"), frame(spark, items, "item_id long, text string"))
        got.append(sorted(map(tuple, found.collect())))
    assert got[0] == got[1] and len(got[0]) >= 80
    kept = decontaminate.remove_leaks(frame(spark, docs, "doc_id long, text string, _leak_id int"), frame(spark, items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(120) if i not in {g[0] for g in got[0]}}


def test_leaks_stay_native(spark):
    docs = frame(spark, [(1, "a b c d e f g h i j k l m")])
    plan = decontaminate.find_leaks(docs, frame(spark, [(1, "a b c d e f g h i j k l m")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Pages


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<html><body><article><h1>T</h1><p>One,\n two<p><b>Three<br>four</article><footer>f</footer>", "T\nOne, two\nThree four"),
        ("<body><div class='sidebar'><p>Buy, now, this, that</p></div><div id=content><p>Long words, here &lt;3.</p><ul><li>a<li>b</ul></div>", "Long words, here <3.\na\nb"),
        ("<body><main><p>Keep.</p><form><p>no</p></form><script>var t='</p>'</script><div class='comments'><p>bad</p></div><p>Also.</p></main>", "Keep.\nAlso."),
        ("<article><p>a&#233;&nbsp;b</p><!-- <p>x</p> --><aside>no</aside></article>", "aé b"),
        ("<body><div class='wrap has-sidebar'><article class=post><p>In, here.</p><figure><figcaption>cap</figcaption></figure></article><div id=comments><article class='comment-body'><h2>Re</h2><p>No, no, no, no.</p></article></div></div>", "In, here.\ncap"),
        ("<body><div class='cookie-notice'><p>We use cookies, as all do, here.</p></div><div class=story><h1>T</h1><p>Text, and more.</p></div><section class='reader-comments'><p>Me, too, and me, and her.</p></section>", "T\nText, and more."),
        ("<body><div role=dialog><p>cookies, all of them, forever</p></div><article><p>x</p></article>", "x"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_points_choose_the_container_inside_an_article():
    text = "Words, of the, larger, section, one, two, three, four, five, six."
    body = f"<h1>T</h1><div class=body><p>{text}</p><p>{text}</p></div><p>Short <a href=x>link</a> at the end.</p>"
    menu = "<div>" + "".join(f"<a href={i}>menu entry</a> " for i in range(20)) + "</div>"
    assert html_extract.main_text(f"<body><article>{body}{menu}</article></body>") == f"T\n{text}\n{text}\nShort link at the end."
    for name in ("rating", "legal"):
        assert html_extract.main_text(f"<article><p>{text}</p><div class={name}><p>{text}</p></div></article>") == f"{text}\n{text}"
    assert html_extract.main_text("<article><p>Some, text.</p><figure><figcaption>one</figcaption><figcaption>two</figcaption></figure></article>") == "Some, text.\none\ntwo"


def test_trees_agree_with_plain_reading():
    """Random well-formed articles: the text of all their blocks, in order, however they are nested."""
    rng = random.Random(4)
    for _ in range(300):
        blocks = [", ".join(rng.choice(["alpha", "béta", "gamma &amp; co", "x < y"]) for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 8))]
        html = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<blockquote>{}</blockquote>", "<p><b>{}</b><br></p>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>"]).format(b) for b in blocks)
        noise = ["<nav><ul><li><a href=/>Home, and, more</a></ul></nav>", "<!-- <p>no</p> -->", "<script>'<p>no</p>'</script>", "<footer>no, no, no</footer>", "<div class='ad'>buy, now</div>"]
        page = "<!DOCTYPE html><html><body>" + "".join(rng.sample(noise, 3)) + rng.choice(["<article>{}</article>", "<main><div>{}</div></main>"]).format(html) + "".join(rng.sample(noise, 3))
        assert html_extract.main_text(page) == "\n".join(b.replace("&amp;", "&") for b in blocks), page


@pytest.mark.parametrize("unit", ["<a", "<a ", "<a '", '<a b="', "<div>", "<div>x", "<b>", "<i></b>", "<td><i></b>", "<li>", "<p>x", "<option>", "<!--", "<!", "</p>", "<", "&", "<script>", "<li><i>", "<table><td>"])
def test_a_megabyte_of_broken_markup_is_read_in_linear_time(unit):
    started = time.time()
    html_extract.main_text(unit * (1_000_000 // len(unit)))
    html_extract.main_text(unit * (500_000 // len(unit)) + "'>")
    assert time.time() - started < 60


def test_siblings_of_the_best_container_stay():
    long, short = "Words, of the, larger, section, one, two, three, four, five, six.", "Other, real, paragraph, of the page, too."
    two = f"<section><p>{long}</p></section><section><p>{short}</p></section>"
    want = f"{long}\n{short}"
    assert html_extract.main_text(f"<body><div>{two}</div></body>") == want
    assert html_extract.main_text("<body>" + two.replace("<section>", "<div><section>").replace("</section>", "</section></div>") + "</body>") == want
    for block in ("<ul><li>a</ul>", "<table><tr><td>a</table>", "<pre>a</pre>", "<blockquote>a</blockquote>", "<dl><dd>a</dl>"):
        assert html_extract.main_text(f"<body><div><section><p>{long}</p></section>{block}</div></body>") == f"{long}\na"
    assert html_extract.main_text(f"<body><div><section><p>{long}</p></section><ul><li><a href=x>link</a></ul></div></body>") == long


def test_pages_with_nulls_and_other_columns(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (2, "v", "<p>" * 3000 + "deep" + "<div>" * 3000, "z")]
    got = html_extract.extract(frame(spark, rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "a"), (1, ""), (2, "deep")]


# Packing


def test_pieces_equal_whole_encoding(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "Hello, World! it's 42x", "ÄÖÜ straße ÉCOLE", "á ́b  x İI Σας", "<|endoftext|> x <|ENDOFTEXT|>", "日本語 テスト!!", "tab\tnew\nline  two", "word " * 5000, "don't I'LL 's", "...", "a,. b.., " + "x" * 3000 + "., y", "q" * 64 + " " + "q" * 65 + ","]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = defaultdict(list)
    for r in packing.tokenise(frame(spark, list(enumerate(texts))), tokenizer_path()).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted(got[i]) == want, text


def test_packing_is_complete_and_tight(spark):
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, 101, 400), [100] * 20]).tolist()
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "uid long, length long")
    got = packing.pack(pieces, capacity=100, district_pieces=120).collect()
    assert sorted(r.uid for r in got) == list(range(len(lengths)))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= 1.06 * -(-sum(lengths) // 100)


def test_genetic_steps_keep_packings_valid():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 60, 300)
    a = packing.best_fit(lengths, np.full(300, -1), 64)
    b = packing._renumber(packing.mutate(lengths, a, 64, rng))
    child = packing.crossover(lengths, packing._renumber(a), b, 64, rng)
    for x in (a, b, child):
        assert (x >= 0).all() and packing.fills(lengths, x).max() <= 64
    best = packing.evolve(lengths, [], 64, [1])[0]
    assert packing.fitness(lengths, best, 64) >= packing.fitness(lengths, packing._renumber(a), 64)


def test_crossovers_beat_best_fit_where_few_pieces_fill_a_bin():
    """Bins that exactly three pieces fill: best fit alone wastes bins, the islands save some of them."""
    rng = np.random.default_rng(12)
    a = rng.integers(380, 491, 60)
    b = rng.integers(250, (1000 - a) // 2)
    lengths = np.concatenate([a, b, 1000 - a - b])
    plain = int(packing.best_fit(lengths, np.full(180, -1), 1000).max()) + 1
    best, islands = plain, [[], []]
    for epoch in range(6):
        islands = [packing.evolve(lengths, pool, 1000, [epoch, i], 12, 60) for i, pool in enumerate(islands)]
        islands = [[islands[1 - i][0], *islands[i][:-1]] for i in range(2)]
        best = min(best, *(int(p[0].max()) + 1 for p in islands))
    assert best < plain and packing.fills(lengths, islands[0][0]).max() <= 1000


def test_long_chunks_are_not_cached():
    encode = packing.ChunkEncoder(tokenizer_path(), cache_bytes=20_000)
    for i in range(300):
        encode(f"word{i} a{i}b " + "x" * 5000)
        assert max(map(len, encode.cache)) <= packing.LONG_CHUNK and encode.used <= 21_000


def test_packing_edges(spark):
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).collect() == []
    got = packing.pack_documents(frame(spark, [(1, None), (1, None), (None, "a")]), tokenizer_path()).collect()
    assert sorted(r.length for r in got) == [1, 1, 2] and len({r.sequence_id for r in got}) == 1


# Licences


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(3)
    words = ["mit", "MIT", "license", "License", "apache", "general", "public", "x", "ä", "7", "-", "_"]
    rows = [(i, rng.choice(["", " ", "("]) + rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "---"), (303, "mit license " * 500)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        spots, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            spots += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels))), text
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_are_found_where_they_lie(spark):
    rows = [
        (1, "Some code. Released under the MIT License."),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "A story about a license to drive and a public library."),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ] + [(10 + i, "nothing of the kind is here at all") for i in range(30)]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1] == "mit,mit-license" and got[2] == "cc-by-nc-4.0" and got[3] == "gpl,gpl-3.0" and got[4] == "" and got[5] == "mit-license"


def brute_labels(rows):
    """Every template at every alignment, scored with the same rare words, without an index."""
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    texts = [tok(t) for _, t in rows]
    found = Counter(w for t in texts for w in set(t))
    postings = defaultdict(list)
    for word, idf, template, position, weight in licenses.rare_postings(len(rows), found):
        postings[template].append((word, idf, position, weight))
    out = {}
    for (i, _), text in zip(rows, texts, strict=True):
        labels = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(text)} "}
        for t, (label, wording, phrases) in enumerate(licenses.TEMPLATES):
            size = len(wording.split())
            for start in range(-size, len(text)):
                hits = [x for x in postings[t] if 0 <= start + x[2] < len(text) and text[start + x[2]] == x[0]]
                stretch = f" {' '.join(text[max(start, 0) : max(start + size, 0)])} "
                if len(hits) >= 2 and sum(x[1] for x in hits) >= licenses.MIN_WEIGHT * hits[0][3] and all(f" {p} " in stretch for p in phrases):
                    labels.add(label)
        out[i] = ",".join(sorted(labels))
    return out


def test_labels_by_brute_force(spark):
    rng = random.Random(11)
    filler = [f"w{i}" for i in range(50)] + ["license", "the", "of", "software", "copyright", "version", "2", "0"]
    rows = []
    for i in range(150):
        body = [rng.choice(filler) for _ in range(rng.randint(0, 30))]
        if i % 3:
            body += rng.choice(licenses.PARAGRAPHS)[1].split() if i % 2 else f"SPDX-License-Identifier: {rng.choice(licenses.SPDX)}".split()
            if i % 5 == 0:
                del body[rng.randrange(len(body))]
        rows.append((i, " ".join(body + [rng.choice(filler) for _ in range(rng.randint(0, 10))])))
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == brute_labels(rows)
    assert sum(bool(v) for v in got.values()) > 80


def test_every_full_template_is_found(spark):
    rows = list(enumerate(text for _, text, _ in licenses.PARAGRAPHS)) + [(1000 + i, f"// SPDX-License-Identifier: {x}") for i, x in enumerate(licenses.SPDX)]
    rows += [(2000 + i, f"clean text number {i} about a software license") for i in range(200)]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(label in got[i] for i, (label, _, _) in enumerate(licenses.PARAGRAPHS))
    assert all(label in got[1000 + i] for i, (label, _, _) in enumerate(licenses.TEMPLATES[len(licenses.PARAGRAPHS) :]))
    assert all(got[2000 + i] == [""] for i in range(200))


def test_licenses_stay_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_license_edges(spark):
    assert licenses.scan(frame(spark, [])).collect() == []
    got = licenses.scan(frame(spark, [(None, "MIT License", "z"), (None, "MIT License", "z")], "doc_id long, text string, labels string")).collect()
    assert [r.base_labels for r in got] == ["mit", "mit"]


# Quality


def test_held_out_accuracy_and_calibration(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: rng.choice([good().upper(), good().replace(" ", " ### "), "spam " * 60])
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(800)] + [(900, None), (901, "")]
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(800)] + [(900, 1), (5, 0), (6, None)]
    got = quality.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(got) == 802 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_features_by_plain_loops(spark):
    """Context sums and pooled features, token by token."""
    texts = ["Hello, World 42!", "hello world", "", "a", "Ünïcode ABC abc 7,5 -- x" * 3, "one two one two"]
    places, signs = quality.index_vectors()

    def words(text):
        out = []
        for token in re.findall(r"[A-Za-z\u0080-\uffff]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0d\u0080-\uffff]+", text):
            raw = np.frombuffer(token.encode(), np.uint8)
            bucket, shape, _ = quality.tokens(raw, np.array([0, len(raw)]))
            kind = 0 if token[0].isalpha() or token[0] > "\x7f" else 1 if token[0].isdigit() else 2
            caps = [c for c in token if "A" <= c <= "Z"]
            size = len(token.encode())
            style = 0 if not caps else 1 if len(caps) == 1 and token[0] == caps[0] else 3 if len(caps) == size else 2
            assert shape.tolist() == [kind * 32 + style * 8 + min(size, 8) - 1], token
            out.append((int(bucket[0]), int(shape[0])))
        return out

    context = np.zeros((quality.BUCKETS, quality.DIMS))
    for text in texts:
        w = words(text)
        for (a, sa), (b, sb) in zip(w, w[1:]):
            for x, y in ((a, b), (b, a), (sa, sb), (sb, sa)):
                context[x, places[y]] += signs[y]
    context -= context.mean(axis=0)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    context = context / np.where(norm > 0, norm, 1)
    vectors = quality.word_vectors(frame(spark, list(enumerate(texts))).select("text"))
    assert np.abs(vectors[:, quality.DIMS :] - context).max() < 1e-5
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        got = quality.pooled(*quality.tokens(raw, np.array([0, len(raw)])), vectors)[0]
        w = words(text)
        means = [np.mean([vectors[x[k]] for x in w], axis=0) if w else np.zeros(2 * quality.DIMS) for k in (0, 1)]
        extra = [len({x[0] for x in w}) / max(len(w), 1), np.log1p(len(w)), np.linalg.norm(means[0][: quality.DIMS]), np.linalg.norm(means[1][: quality.DIMS])]
        assert np.abs(got - np.concatenate([*means, extra])).max() < 1e-5, text


def test_a_network_by_plain_loops():
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(size=4), rng.random(4) + 0.5, rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), 0.2, 1.7)
    for x in rng.normal(size=(20, 4)):
        hidden = [max(0.0, sum((x[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(4)) + net.b1[j]) for j in range(3)]
        want = 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature))
        assert abs(net.probabilities(x[None])[0] - want) < 1e-12


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(frame(spark, [(1, "a"), (None, None)]), labels).collect()} == {0.5}
    assert quality.classify(frame(spark, []), labels).collect() == []


def test_gradients_fit_a_separable_problem():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.fit(x, y)
    assert ((net.probabilities(x) > 0.5) == y).mean() > 0.9 and net.temperature > 0


def test_counter_of_names_is_stable():
    from wavelattice.llm import queries

    numbers = Counter(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert numbers == Counter(range(1, 11))
