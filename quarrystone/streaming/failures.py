"""Failed attempts of an address in the time before each attempt, over a stream.

The same cut as in batches: an attempt is asked in its period and, if it counts, lent to the
next one. The state of a key and period is the sorted times of its counted attempts; it ends
when the watermark has passed the period's end.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrystone.operators.sliding import MICROS

OUT = "attempt_id long, key string, at timestamp, n_before long"


def preceding(stream: DataFrame, counted: Column, seconds: int, late: str = "2 days") -> DataFrame:
    """(attempt_id, key, at, n_before) of ``stream`` (attempt_id, key, at), told when the attempt arrives.

    Attempts that arrive in the order of their times are told what a batch tells; what comes
    later counts for the attempts that follow. Attempts without a key or time aren't told.
    """
    span = seconds * MICROS
    micros = F.unix_micros("at")
    marked = stream.withWatermark("at", late).where("key IS NOT NULL AND at IS NOT NULL").withColumn("counted", F.coalesce(counted, F.lit(False)))
    lent = marked.withColumn("lent", F.explode(F.array(F.lit(0), F.lit(1)))).where("lent = 0 OR counted").withColumn("period", F.floor(micros / span) + F.col("lent"))

    def told(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        micro = rows["at"].astype("datetime64[us]").astype("int64")
        rows = rows.assign(micro=micro).sort_values("micro", kind="stable")
        # attempts of one time count for each other: first all of them are noted
        for m in rows.loc[rows["counted"], "micro"]:
            insort(times, int(m))
        asked = rows[rows["lent"] == 0]
        n = [bisect_right(times, int(m)) - bisect_left(times, int(m) - span) for m in asked["micro"]]
        state.update((times,))
        end = (int(key[1]) + 1) * span // 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"attempt_id": asked["attempt_id"], "key": asked["key"], "at": asked["at"], "n_before": n})

    return lent.groupBy("key", "period").applyInPandasWithState(told, OUT, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
