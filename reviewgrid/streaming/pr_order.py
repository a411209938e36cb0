"""Order and redelivery across micro-batches.

A PR's events can arrive late, out of order and more than once. ``newest_events`` lets an
event through if no newer one of its PR came through before, whatever batch that was in:

* a delivery id counts once (``dropDuplicatesWithinWatermark``); a redelivery is known
  again within ``horizon`` of the newest event;
* the state of a PR is the time and id of its newest event. Of a batch's events only the
  newest goes out, and only if it is newer than that state;
* once the watermark has passed a PR's newest event its state is dropped: whatever Spark
  still accepts for it is newer, so dropping it changes no result, and the state holds
  only the PRs of the last ``horizon``.

An event that arrives more than ``horizon`` behind the newest one is late and is not
reviewed; ``horizon`` is how long the files of the intake can be delayed, not how long a PR
may rest. Events without an id count as different if anything else in them differs, and as
oldest among those of the same time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package

NO_ID = -(1 << 63)
STATE = "at bigint, id bigint"
OUT = "repo string, pr_number int, at bigint, id bigint, action string, commit_sha string"


def newest_of_pr(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One PR in one batch: its newest event, if it is newer than all before."""
    if state.hasTimedOut:
        state.remove()
        return
    best = tuple(state.get) if state.exists else None
    out = None
    for pdf in batches:
        for at, event_id, action, sha in zip(pdf["at"], pdf["id"], pdf["action"], pdf["commit_sha"]):
            if best is None or (int(at), int(event_id)) > best:
                best, out = (int(at), int(event_id)), (action, sha)
    if best is None:
        return
    state.update(best)
    state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + 1)
    if out is not None:
        yield pd.DataFrame({"repo": [key[0]], "pr_number": [key[1]], "at": [best[0]], "id": [best[1]],
                            "action": [out[0]], "commit_sha": [out[1]]})


def newest_events(accepted: DataFrame, horizon: str = "7 days") -> DataFrame:
    """A stream of accepted events (T1) -> those that call for a review, in the same columns."""
    ship_package(accepted.sparkSession)
    fields = ["repo", "pr_number", "commit_sha", "action", "received_at"]
    delivery = F.coalesce(F.col("delivery_id").cast("string"),
                          F.concat_ws("/", F.lit("none"), *[F.col(c).cast("string") for c in fields]))
    once = (accepted.withColumn("_delivery", delivery).withWatermark("received_at", horizon)
            .dropDuplicatesWithinWatermark(["_delivery"]))
    keyed = once.select("repo", "pr_number", "received_at", F.unix_micros("received_at").alias("at"),
                        F.coalesce("delivery_id", F.lit(NO_ID)).alias("id"), "action", "commit_sha")
    new = keyed.groupBy("repo", "pr_number").applyInPandasWithState(
        newest_of_pr, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return new.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("delivery_id"),
                      F.timestamp_micros("at").alias("received_at"), "action", "repo", "pr_number", "commit_sha")
