"""Daily quantiles are given for every product with a recorded day, also for those too short for a model."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small tables, with events of three short products: 1 day, 30 days, and 61 days with few windows recorded."""
    out = tmp_path_factory.mktemp("short")
    for f in os.listdir(SF):
        if f != "events.parquet":
            os.symlink(f"{SF}/{f}", out / f)
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM '{SF}/events.parquet' UNION ALL BY NAME
      SELECT event_type, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT)) AS ts, (d * 7 % 11)::DOUBLE AS value FROM (VALUES ('one', 1, 1), ('month', 30, 1), ('sparse', 61, 3)) t(event_type, n, step), range(n) r(d) WHERE d % step = 0)
      TO '{out}/events.parquet' (FORMAT parquet)""")
    return str(out)


def test_no_product_is_left_out(spark, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = {(s, d): q for s, d, q in con.execute(entry.oracle_sql()["sku_daily_quantiles"]).fetchall()}
    got = {(r.sku, r.date): r.quantiles for r in entry.queries()["sku_daily_quantiles"](spark, folder).collect()}
    recorded = {s for s, in con.execute("SELECT DISTINCT event_type FROM events").fetchall()}
    assert {"one", "month", "sparse"} <= recorded <= {s for s, _ in got}
    assert all(sum(k[0] == s for k in got) == 14 for s in ("one", "month", "sparse"))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert {tuple(q) for (s, _), q in got.items() if s == "one"} == {(0.0,) * 7}
