"""w09_training_curves against its SQL on missing values and on runs with equal best values."""

import duckdb
import pytest

from grouploom.plans import registry


def both(spark, path):
    con = duckdb.connect()
    # on one thread arg_max meets the epochs in their order; on more, equal values come in any
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from '{path}/events.parquet'")
    found = con.execute(registry.oracle_sql()["w09_training_curves"])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=lambda r: (r[0] is None, r[0]))
    got = registry.queries()["w09_training_curves"](spark, str(path)).select(*names).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0])), want


@pytest.mark.parametrize("missing", ["value", "props", "ts"])
def test_missing_values_are_as_in_sql(spark, tmp_path, missing):
    rows = """select range as event_id, timestamp '2024-01-01' + to_seconds(range // 3) as ts, range % 6 as user_id, 'view' as event_type,
        round(sin(range) * 100, 2) as value, '{"k": ' || (range * 37 % 101) || '}' as props from range(120)"""
    # run 0 lacks every value, run 1 its last ones, run 2 one of five
    gone = "user_id = 0 or (user_id = 1 and event_id > 60) or (user_id = 2 and event_id % 5 = 0)"
    duckdb.sql(f"copy (select * replace (case when not ({gone}) then {missing} end as {missing}) from ({rows})) to '{tmp_path}/events.parquet'")
    got, want = both(spark, tmp_path)
    assert got == want


def test_of_equal_values_the_first_epoch(spark, tmp_path):
    duckdb.sql(f"copy (select event_id + c * 1000 as event_id, ts, user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet', range(6) t(c)) to '{tmp_path}/events.parquet'")
    got, want = both(spark, tmp_path)
    assert got == want
