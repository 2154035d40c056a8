"""Every registered panel query against its SQL, and that the others return rows."""

import pytest

from compare import duck, rows
from tapewright.jobs.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck(sf).sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert list(got.columns)
