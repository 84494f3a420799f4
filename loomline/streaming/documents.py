"""The states of documents as they are told on a stream: pending, processing, then completed or failed, once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.ingest import COMPLETED, FAILED, PENDING, PROCESSING

#: How far on a document is; what ends it has no next.
STEPS = {PENDING: 0, PROCESSING: 1, COMPLETED: 2, FAILED: 2}


def outcomes(told: DataFrame, stuck_seconds: int, late: str = "10 minutes", remember_seconds: int = 86_400) -> DataFrame:
    """doc_id, status, error_message, at and steps (states seen before) of each document that ended.

    told: event_id, doc_id, status (one of STEPS), error_message, at (timestamp). An event that comes again within
    `late` is dropped by its id; one for a document that has ended changes nothing for remember_seconds after. A
    document that was told of but hasn't moved on for stuck_seconds, by the watermark, fails. Of states told out of
    order the furthest counts; an unknown status, a null document or time is left out.
    """
    micros = F.unix_micros("at")
    once = told.filter(F.col("status").isin(*STEPS) & F.col("doc_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    kind = dict(told.dtypes)["doc_id"]
    out = f"doc_id {kind}, status string, error_message string, at timestamp, steps int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at_step, since, seen, over = state.get if state.exists else (-1, 0, 0, False)
        rows = []

        def ended(status: str, message: str | None, at: int) -> None:
            rows.append((key[0], status, message, pd.Timestamp(at, unit="us"), seen))

        if state.hasTimedOut:
            if over:
                state.remove()
                return
            since, over = since + stuck_seconds * 1_000_000, True
            ended(FAILED, f"no news for {stuck_seconds} seconds in {PENDING if at_step == 0 else PROCESSING}", since)
        else:
            events = sorted((int(m), STEPS[s], s, e) for pdf in batches for m, s, e in zip(pdf["micros"], pdf["status"], pdf["error_message"], strict=True))
            for at, to, status, message in events:
                if over or to <= at_step:
                    continue
                at_step, since, over = to, max(at, since), to == 2
                if over:
                    ended(status, message, at)
                else:
                    seen += 1
        state.update((at_step, since, seen, over))
        wait = remember_seconds if over else stuck_seconds
        state.setTimeoutTimestamp(max(since // 1000 + 1000 * wait, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "status", "error_message", "at", "steps"])

    keyed = once.select("doc_id", "status", "error_message", micros.alias("micros"), "at").groupBy("doc_id")
    return keyed.applyInPandasWithState(step, out, "at_step int, since long, seen int, over boolean", "append", "EventTimeTimeout")
