"""The queries that may be empty on the smallest tables give rows on the next larger ones."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["hmm_fit_grid", "hmm_rolling", "hmm_decode", "seed_stability", "current_regime", "sink_model_snapshot", "block_bootstrap"])
def test_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
