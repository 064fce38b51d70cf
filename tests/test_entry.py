import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = "nodes_by_type illegal_edges snapshot_checks blast_radius_size preserved anchors as_of_assumptions chunk_spans assertive_spans resolve_names unresolved_names cosine_pairs flat_cost median_hops health_signals ledger_verify evidence_dedup event_sessions p4_found p4_nested".split()


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 70 and {"p4_found", "p4_nested"} <= set(q)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    got = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(map(repr, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.fetchall())))
    rows = df.select(*cols).collect()
    assert sorted(map(repr, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows))) == want


def test_cut_tables_are_swept(spark):
    import os

    from lattica import session

    df = session.cut(spark.range(3).toDF("id"))
    path = df._lattica_path.removeprefix("file:")
    assert os.path.isdir(path) and session.sweep(spark) >= 1 and not os.path.exists(path) and session.sweep(spark) == 0
