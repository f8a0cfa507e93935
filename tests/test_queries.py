"""Every query of the library against its SQL in DuckDB on sf0.001."""

import duckdb
import pytest

from lumenfold.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings events benchmark conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    theirs = duck.execute(ORACLE[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    plain = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(tuple(r) for r in ours.select(*names).collect()) == plain(theirs.fetchall())
