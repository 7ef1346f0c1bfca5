"""Comparison of a Spark result with rows from elsewhere, regardless of order."""

import math


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    return str(x) if type(x).__name__ in ("Timestamp", "datetime64") else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    found = [tuple(None if v is None or v != v else plain(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
