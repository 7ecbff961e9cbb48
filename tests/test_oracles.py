"""A cross-section of the registered queries against their SQL on the smallest tables."""

import pytest

from tests.helpers import oracle_rows, rows_of
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
SOME = [
    "forward_maxdd", "label_coverage", "expanding_z", "rolling_acf", "days_since_max", "first_release", "known_on", "asof_align", "splice_series", "fill_missing", "screen_columns",
    "threshold_crashes", "normal_days", "confusion", "calibration_summary", "backtest", "fold_metrics", "gate_reason", "log_odds_pool", "fit_bins", "roc_alarm", "upsert_rows", "stream_roc_alarm",
    "rolling", "rolling_skew", "rolling_corr", "build_features", "drawdown_episodes", "live_base_rate", "dominant_driver", "isotonic_calibrate", "tune_gate", "mahalanobis_score", "analog_top_n", "stream_base_rate", "stream_upsert",
]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, name):
    df = registry.QUERIES[name](spark, SF)
    want, names = oracle_rows(registry.SQL[name], SF)
    assert sorted(names) == sorted(df.columns)
    got = rows_of([r.asDict() for r in df.collect()], sorted(names))
    assert len(got) == len(want)
    for a, b in zip(got, rows_of(want, sorted(names))):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))


def test_every_oracle_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
