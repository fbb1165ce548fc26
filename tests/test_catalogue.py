import math

import duckdb
import pytest

from tallyloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(names), sorted(([value(r[k]) for k in order] for r in rows), key=str)


#: Minutes long: whole analyses, and statistics of tables whose kinds of columns others have too.
LONG = {"promoted_types", "reconciled", *(f"field_stats_{t}" for t in catalogue.COLUMNS if t not in ("labels", "events", "conversations"))}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - LONG))
def test_query(spark, db, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    if name in catalogue.SQL:
        want = db.execute(catalogue.SQL[name])
        names = [d[0] for d in want.description]
        assert got == comparable(want.fetchall(), names)
    else:
        assert got[1]
