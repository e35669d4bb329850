"""Rows of a Spark result and of its SQL in a common form."""

import math
import warnings

import numpy as np


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(plain, r)) for r in zip(*(table[n].to_pylist() for n in names), strict=True))


def same_rows(df, con, sql):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        expected = con.execute(sql).to_arrow_table()
    assert rows(df.toArrow()) == rows(expected)
