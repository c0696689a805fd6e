"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from lithoscan import registry

SF = "/root/testdata/sf0.001"
CHEAP = ["off_grid", "notch", "min_spacing_full", "eol_spacing", "min_enclosure_rect", "density_sliding", "min_area", "mos_devices", "parallel_reduce", "multiple_drivers", "derived_xor", "missing_tie", "pex_coupling", "pex_interlayer", "tile_merge"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part", "customer", "supplier", "nation", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted(map(tuple, df.select(*cols).collect())) == want and want


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["rule_id", "kind", "layer", "measured", "limit", "x", "y"]
