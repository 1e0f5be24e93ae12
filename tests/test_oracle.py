"""A cross-section of the registered queries against DuckDB at the smallest scale.

``python tests/compare.py 0.01`` runs all of them.
"""

import os

import pytest

import __spark_entry__ as contract
from barloom.plans import registry
from tests.compare import ROOT, check, duck

SF = f"{ROOT}/sf0.001"
SAMPLE = """w08_score_signals s16_materialised_screens j01_mtf_confluence a02_sector_rotation j12_adjusted_prices u10_successor_map
w22_composite_rank w29_stable_universe w24_debounced_regime w25_three_state_regime a05_market_internals j16_fundamentals_as_of
j29_fundamental_frame w38_round_trips a16_turnover_split a09_trade_metrics a22_grouped_stats a27_gini a11_relative_metrics
a35_overfit_probability t09_rebalance_plan a39_scorecard r01_tumbling_bars r05_guarded_append""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    msg, _, _ = check(spark, con, SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert msg.startswith("ok"), msg


def test_every_query_of_the_library_has_sql():
    assert set(registry.QUERIES) == set(registry.oracles())
