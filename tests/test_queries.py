"""Each query against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from sieveline import queries as Q
from sieveline.operators import inference as I
from sieveline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    if name not in ORACLES:
        assert got
        return
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_image_index_reads_every_part(spark, db):
    name = "replace(p_name, ' ', '_') || p_partkey // 2"
    by_name = db.execute(f"SELECT lower({name}), count(DISTINCT p_brand) FROM part GROUP BY ALL").fetchall()
    got = {r.key for r in QUERIES["image_index"](spark, SF).collect()}
    assert got == {n + end for n, brands in by_name if brands == 1 for end in ("", ".jpg")}
    assert any(brands > 1 for _, brands in by_name)


def test_bootstrap_custom_has_all_draws(spark):
    sums = I.group_sums(Q._scored(spark, SF), [])
    want = I.bootstrap_interval(sums, I.hashed_weights(sums, Q.ITERATIONS), "sample_f1").first()
    got = QUERIES["bootstrap_custom"](spark, SF).first()
    assert (got.ci_lower, got.ci_upper) == pytest.approx((want.ci_lower, want.ci_upper), abs=1e-8)


def test_token_mask_keeps_short_turns(spark, db):
    turns, short = db.execute("SELECT count(*), count(*) FILTER (len(string_split(text, ' ')) < CASE WHEN role = 'assistant' THEN 2 ELSE 4 END) FROM conversations").fetchone()
    masks = [r.mask for r in QUERIES["token_mask"](spark, SF).collect()]
    assert short > 0 and (len(masks), masks.count(None)) == (turns, short)
