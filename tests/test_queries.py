"""Each registered telemetry query against its SQL."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from heliograph.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda x: "null" if x is None or x is pd.NA or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(map(tuple, frame.map(cell).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        assert _normal(got) == _normal(con.execute(ORACLES[name]).df())
