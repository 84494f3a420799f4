"""A list of revoked tokens as keyed state whose entries go by themselves.

Revocations and requests are one stream. A token's state are the spans of time in
which it is revoked; the state store drops them when their time to live is over, so
the list is as long as the tokens that were revoked within one lifetime, not as all
that ever were. What has expired by a request's own time doesn't count, whether the
store has dropped it yet or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end) in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(s for s in spans if s[0] < s[1]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class _Listed(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getValueState("spans", "starts array<long>, ends array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(zip(*self.spans.get())) if self.spans.exists() else []
        new, asked = [], []
        for pdf in rows:
            on = pdf["until"].notna()
            new += list(zip(pdf["at"][on].astype("int64").tolist(), pdf["until"][on].astype("int64").tolist()))
            asked.append(pdf[~on])
        if new:
            known = merged(known + new)
            self.spans.update(([a for a, _ in known], [b for _, b in known]))
        for pdf in asked:
            if len(pdf):
                listed = [any(a <= t < b for a, b in known) for t in pdf["at"].tolist()]
                yield pd.DataFrame({"token": key[0], "request": pdf["request"].to_numpy(), "at": pdf["at"].to_numpy(), "listed": listed})

    def close(self) -> None:
        pass


def requests_checked(revoked: DataFrame, requests: DataFrame, lifetime_seconds: int) -> DataFrame:
    """token, request, at and listed of each request, by what the stream has told so far and in the same batch.

    revoked: token, at and until (microseconds; until is when the token would have expired anyway); requests: token,
    request, at. lifetime_seconds: the longest that a token lives, after which its state goes. Needs the RocksDB
    state store. Null tokens are one token; a request that comes before its token's revocation does isn't listed.
    """
    none = F.lit(None).cast("long")
    types = dict(requests.dtypes)
    both = revoked.select("token", "at", "until", F.lit(None).cast(types["request"]).alias("request")).unionByName(requests.select("token", "at", none.alias("until"), "request"))
    schema = f"token {types['token']}, request {types['request']}, at long, listed boolean"
    return both.groupBy("token").transformWithStateInPandas(_Listed(1000 * lifetime_seconds), schema, "Append", "ProcessingTime")
