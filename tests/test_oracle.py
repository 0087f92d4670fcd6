"""Every registered query against its SQL on the smallest tables; the rest must give rows."""

import pytest
from compare import connect, diff

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# thirty days hold too few bars per key at this size for a fit or a bootstrap to be required to give rows
MAY_BE_EMPTY = {"hmm_fit_grid", "hmm_rolling", "hmm_decode", "seed_stability", "current_regime", "sink_model_snapshot", "block_bootstrap"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert diff(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
