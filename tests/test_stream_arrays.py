"""Bars of one symbol become features as arrays, without a table for each step."""

import numpy as np
import pandas as pd

from barloom.streaming.features import FIELDS, feature_arrays, trailing_features


def test_arrays_equal_windows_taken_one_by_one():
    rng = np.random.default_rng(3)
    high, low, close, volume, amount = rng.uniform(1, 9, (5, 60))
    volume[20:45] = 0
    amount[5:40] = 7
    high[30:55] = low[30:55] = 2
    found = feature_arrays(high, low, close, volume, amount)
    table = trailing_features(pd.DataFrame(dict(zip(FIELDS[1:], (high, low, close, volume, amount)))))
    for i in range(20, 60):
        w = slice(i - 19, i + 1)
        mean, std = amount[w].mean(), amount[w].std()
        top, bottom = high[w].max(), low[w].min()
        want = {"ret_20d": close[i] / close[i - 20] - 1,
                "vol_ratio_20d": volume[i] / volume[w].mean() if volume[w].mean() > 0 else 1.0,
                "amount_z_20d": (amount[i] - mean) / std if std > 0 else 0.0,
                "close_to_high_20d": close[i] / top,
                "range_position_20d": (close[i] - bottom) / (top - bottom) if top > bottom else 0.5}
        for name, value in want.items():
            assert np.isclose(found[name][i], value) and np.isclose(table[name][i], value), name
    assert np.isnan(found["ret_5d"][:5]).all() and len(found["ret_1d"]) == 60
