"""Line differences of versions: the shortest script of kept, added and dropped lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCRIPT = "array<struct<op: string, line: string>>"


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Halves a and finds where b parts, so that space is that of a line of lengths."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if j - i == 1:
            if len(at := np.flatnonzero(b[k:m] == a[i])):
                out.append((i, k + int(at[0])))
            continue
        mid = (i + j) // 2
        cut = k + int((_row(a[i:mid], b[k:m]) + _row(a[mid:j][::-1], b[k:m][::-1])[::-1]).argmax())
        todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return sorted(out)


def script(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """(keep | drop | add, line) in order; drops come before adds where both stand."""
    known = {line: i for i, line in enumerate(dict.fromkeys([*before, *after]))}
    a, b = (np.array([known[x] for x in lines], np.int64) for lines in (before, after))
    out, i, k = [], 0, 0
    for x, y in [*common(a, b), (len(before), len(after))]:
        out += [("drop", line) for line in before[i:x]] + [("add", line) for line in after[k:y]]
        if x < len(before):
            out.append(("keep", before[x]))
        i, k = x + 1, y + 1
    return out


def version_scripts(versions: DataFrame, key: str) -> DataFrame:
    """key, version_number and script: how each version (content) comes of the one before it, the first of nothing. Null content has no line, blank content one blank line."""
    lines = F.when(F.col("content").isNotNull(), F.split("content", "\n")).otherwise(F.array().cast("array<string>"))
    before = F.lag("lines").over(Window.partitionBy(key).orderBy("version_number"))
    pairs = versions.withColumn("lines", lines).withColumn("before", F.coalesce(before, F.array().cast("array<string>")))

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": op, "line": line} for op, line in script(list(x), list(y))] for x, y in zip(a, b, strict=True)], dtype=object)

    return pairs.select(key, "version_number", F.pandas_udf(run, SCRIPT)("before", "lines").alias("script"))


def rebuilt(script_: str = "script"):
    """The version that a script leads to, as text."""
    kept = F.filter(script_, lambda s: s["op"] != "drop")
    return F.array_join(F.transform(kept, lambda s: s["line"]), "\n")
