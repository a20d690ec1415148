"""The training-data queries with an oracle, against DuckDB on the smallest tables and on planted rows."""

import random

import duckdb
import pytest

from wavelattice.llm import licenses, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """Documents with benchmark passages, some with replaced words, and with licence texts."""
    folder, rng = tmp_path_factory.mktemp("planted"), random.Random(21)
    words = [f"w{i}" for i in range(400)] + ["license", "the", "MIT", "public"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([3, 5, 9, 10, 14, 20, 40])))) for i in range(40)] + [(90, None), (91, ""), (92, "--")]
    docs = []
    for i in range(300):
        body = text(rng.randint(0, 60))
        if i % 2:
            copy = items[rng.randrange(40)][1].split()
            for k in range(len(copy)):
                copy[k] = copy[k] if rng.random() > 0.08 else "changed"
            body += copy + text(rng.randint(0, 9))
        if i % 3 == 0:
            body += rng.choice(licenses.PARAGRAPHS)[1].split()
        docs.append((i, rng.choice(["{}", "({})", " {}."]).format(" ".join(body))))
    docs += [(1000, None), (1001, ""), (1002, items[3][1])]
    c = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        c.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
        c.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("where", ["sf", "planted"])
def test_query_equals_oracle(spark, planted, name, where):
    folder = SF if where == "sf" else planted
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = queries.queries()[name](spark, folder), c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(str(r[k]) for k in columns) for r in got.collect()]
    at = [want.columns.index(k) for k in columns]
    assert sorted(rows) == sorted(tuple(str(r[k]) for k in at) for r in want.fetchall())
    assert where == "sf" or rows
