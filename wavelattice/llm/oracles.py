"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from wavelattice.llm import decontaminate, licenses

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x20\x09-\x0D]+') AS t FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
g AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN g USING (doc_id)
"""

OP4 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {LETTERS}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op6() -> str:
    """Alignments that share a seed, scored by prefix sums; short items by whole windows."""
    split = rf"string_split_regex(lower(text), '{decontaminate.SEPARATORS}')"

    def places(table: str, ident: str) -> str:
        out = []
        for m, mask in enumerate(decontaminate.MASKS):
            key = ", ".join(f"w[p + {k + 1}]" for k, c in enumerate(mask) if c == "1")
            out.append(f"SELECT {ident}, p AS place, {m} AS mask, array_to_string([{key}], chr(31)) AS seed FROM (SELECT *, unnest(range(len(w) - {len(mask) - 1})) AS p FROM {table} WHERE len(w) >= {len(mask)})")
        return " UNION ALL ".join(out)

    short = " UNION ALL ".join(
        f"SELECT doc_id, p AS place, array_to_string(w[p + 1:p + {n}], chr(31)) AS s, {n} AS n FROM (SELECT *, unnest(range(len(w) - {n - 1})) AS p FROM t WHERE len(w) >= {n}) WHERE {n} IN (SELECT len(w) FROM i)"
        for n in range(1, decontaminate.SPAN)
    )
    return f"""
WITH t AS (SELECT doc_id, {split} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, w FROM (SELECT item_id, list_filter({split}, lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
long AS (SELECT * FROM i WHERE len(w) >= {decontaminate.SPAN}),
ds AS ({places("t", "doc_id")}),
its AS ({places("long", "item_id")}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.place - its.place AS shift FROM ds JOIN its USING (mask, seed)),
pos AS (SELECT doc_id, item_id, shift, len(b.w) AS size, unnest(range(len(b.w))) AS j, a.w AS dw, b.w AS iw FROM hits JOIN t a USING (doc_id) JOIN long b USING (item_id)),
e AS (SELECT doc_id, item_id, shift, size, j, shift + j >= 0 AND shift + j < len(dw) AND dw[shift + j + 1] = iw[j + 1] AS e FROM pos),
s AS (SELECT *, CASE WHEN e THEN 1 ELSE -2 END AS v, sum(CASE WHEN e THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS s FROM e),
m AS (SELECT *, s - v AS before, min(s - v) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS low FROM s),
k AS (SELECT *, max(CASE WHEN before = low THEN j END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS lo FROM m),
b AS (SELECT doc_id, item_id, shift, any_value(size) AS size, max(s - low) AS score, arg_min(lo, (low - s, j)) AS lo, arg_min(j, (low - s, j)) + 1 AS hi, count(*) FILTER (WHERE e) AS equal FROM k GROUP BY ALL),
f AS (SELECT b.*, (SELECT count(*) FROM e WHERE e.doc_id = b.doc_id AND e.item_id = b.item_id AND e.shift = b.shift AND e.e AND e.j >= b.lo AND e.j < b.hi) AS n_equal FROM b
  WHERE score >= {decontaminate.MIN_SCORE} OR equal > {decontaminate.MIN_SHARE} * size),
o AS (SELECT doc_id, item_id, score, shift + lo AS first_word, hi - lo AS n_words, n_equal, size AS item_words, count(*) OVER (PARTITION BY doc_id, item_id) AS n_places,
  row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, shift + lo, hi - lo DESC, n_equal DESC) AS r FROM f),
sw AS ({short}),
so AS (SELECT doc_id, item_id, n, min(place) AS first_word, count(*) AS n_places FROM sw JOIN i ON len(i.w) = n AND array_to_string(i.w, chr(31)) = s GROUP BY ALL)
SELECT doc_id, item_id, CAST(score AS BIGINT) AS score, CAST(first_word AS BIGINT) AS first_word, CAST(n_words AS BIGINT) AS n_words, n_equal, CAST(item_words AS BIGINT) AS item_words, n_places FROM o WHERE r = 1
UNION ALL SELECT doc_id, item_id, CAST(n AS BIGINT), CAST(first_word AS BIGINT), CAST(n AS BIGINT), CAST(n AS BIGINT), CAST(n AS BIGINT), n_places FROM so
"""


def op10() -> str:
    """The rare-token index as joins over all word places."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({t}, {p}, {quoted(w)})" for t, (_, wording, _) in enumerate(licenses.TEMPLATES) for p, w in enumerate(wording.split()))
    shapes = ", ".join(
        f"({t}, {quoted(label)}, {len(wording.split())}, [{', '.join(quoted(f' {p} ') for p in phrases)}])" for t, (label, wording, phrases) in enumerate(licenses.TEMPLATES)
    )
    base = " UNION ALL ".join(
        f"SELECT doc_id, p, {quoted(label)} AS label FROM pl WHERE {' AND '.join(f'w[p + {k + 1}] = {quoted(x)}' for k, x in enumerate(phrase.split()))}" for phrase, label in licenses.BASE
    )
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {LETTERS}), '{licenses.SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
pl AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
tw(template, position, word) AS (VALUES {listed}),
ts(template, label, size, phrases) AS (VALUES {shapes}),
n AS (SELECT count(*) AS total FROM d),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, w[p + 1] AS word FROM pl) WHERE word IN (SELECT word FROM tw) GROUP BY word),
rk AS (SELECT template, word, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY template ORDER BY coalesce(df, 0), word) AS r FROM (SELECT DISTINCT template, word FROM tw) LEFT JOIN df USING (word)),
few AS (SELECT *, count(*) FILTER (WHERE r <= {licenses.RARE_WORDS} AND df <= {licenses.MAX_SHARE} * total) OVER (PARTITION BY template) AS n_rare FROM rk, n),
rare AS (SELECT template, word, ln((total + 1) / (df + 1)) + 1e-6 AS idf FROM few WHERE CASE WHEN n_rare >= 2 THEN r <= {licenses.RARE_WORDS} AND df <= {licenses.MAX_SHARE} * total ELSE r <= 2 END),
post AS (SELECT template, position, word, idf, sum(idf) OVER (PARTITION BY template) AS weight FROM tw JOIN rare USING (template, word)),
v AS (SELECT DISTINCT doc_id, template, p - position AS start, position, idf, weight FROM pl JOIN post ON w[p + 1] = word),
st AS (SELECT doc_id, template, start, sum(idf) AS got, any_value(weight) AS weight, count(*) AS n FROM v GROUP BY ALL),
c AS (SELECT doc_id, label, got / weight AS share, phrases, ' ' || array_to_string(w[greatest(start, 0) + 1:start + size], ' ') || ' ' AS stretch
  FROM st JOIN ts USING (template) JOIN d USING (doc_id) WHERE n >= 2 AND got >= {licenses.MIN_WEIGHT} * weight),
ok AS (SELECT doc_id, label, share FROM c WHERE len(list_filter(phrases, lambda x: NOT contains(stretch, x))) = 0),
bs AS ({base}),
bg AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bs GROUP BY doc_id),
mg AS (SELECT doc_id, max(share) AS share, count(*) AS n_aligned FROM ok GROUP BY doc_id),
lg AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bs UNION ALL SELECT doc_id, label FROM ok) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(CASE WHEN share IS NOT NULL THEN least(share, 1.0) WHEN n_base > 0 THEN 0.5 ELSE 0.0 END, 6) AS score, coalesce(n_aligned, 0) AS n_aligned
FROM d LEFT JOIN bg USING (doc_id) LEFT JOIN mg USING (doc_id) LEFT JOIN lg USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4, "op6_decontamination": op6(), "op9_near_duplicates": OP9, "op10_license_scan": op10()}
