"""The characters by which two strings differ."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def removals(a: str, b: str) -> tuple[str, str]:
    """The fewest characters to take from a and from b so that the same string is left of both."""
    x, y = np.array(list(a)), np.array(list(b))
    common = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)  # of the ends of both, from i and j on
    for i in range(len(a) - 1, -1, -1):
        row = np.where(y == x[i], common[i + 1, 1:] + 1, common[i + 1, :-1])
        common[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    left: list[str] = []
    right: list[str] = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif common[i + 1, j] >= common[i, j + 1]:
            left.append(a[i])
            i += 1
        else:
            right.append(b[j])
            j += 1
    return "".join(left) + a[i:], "".join(right) + b[j:]


def difference(a: Column | str, b: Column | str) -> Column:
    """struct(removed, added), the ``removals`` of two columns of short strings; a null counts as empty. A pair's table has the product of their lengths."""

    @F.pandas_udf("struct<removed:string,added:string>")
    def told(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([removals(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["removed", "added"])

    return told(a, b)
