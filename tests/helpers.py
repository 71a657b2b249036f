import datetime as dt
import math

import pandas as pd

START = dt.datetime(2024, 1, 1)


def at(hours=0.0, days=0):
    return START + dt.timedelta(days=days, hours=hours)


def values(df, *columns, order=None):
    """Rows as tuples: along a column, or sorted with missing values last."""
    rows = (df.orderBy(order) if order else df).collect()
    out = [tuple(row[c] for c in columns) for row in rows]
    return out if order else sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def normal(df: pd.DataFrame):
    """Comparable form of a result, whatever its row and column order."""
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                cells.append("~")
            elif isinstance(v, bool):
                cells.append(str(int(v)))
            elif isinstance(v, float):
                cells.append(repr(v + 0.0))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)
