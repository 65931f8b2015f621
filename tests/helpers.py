import numpy as np
import pandas as pd


def random_bars(n=700, seed=0, pair="A", gaps=0.1):
    """Hourly random-walk bars with gaps."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    df = pd.DataFrame({
        "pair": pair, "interval": "1h", "open_time": pd.date_range("2020-01-01", periods=n, freq="h"),
        "open": close, "high": close * 1.01, "low": close * 0.99, "close": close,
        "volume": rng.uniform(1, 10, n), "taker_buy_base": rng.uniform(0, 1, n),
    })
    return df[rng.uniform(size=n) >= gaps].reset_index(drop=True)
