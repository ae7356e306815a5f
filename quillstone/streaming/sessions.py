"""Conversations as streams: the last messages of each are kept as state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.context import history

COLUMNS = ["conv_id", "turn", "role", "text"]


def with_history(turns: DataFrame, n_turns: int, idle_ms: int | None = 30 * 60 * 1000) -> DataFrame:
    """conv_id, turn, role, text, history: the 2 n_turns messages before each, oldest first, as `role: text`.

    turns: conv_id, turn, role, text, a stream or a table. Of a stream, state holds the last 2 n_turns messages of a conversation and
    no more; it is forgotten after idle_ms without a message (None: never), and a conversation that goes on later begins anew. A stream
    that forgets has micro-batches for ever, also without data, so the trigger availableNow doesn't end it. Messages of a micro-batch are put in order of their turns; one that comes late has the messages before it that are still held. Null roles
    and texts leave their part of a message out, as in a table.
    """
    if not turns.isStreaming:
        return history(turns.select(COLUMNS), n_turns)
    keep = 2 * n_turns

    def follow(key: tuple[object], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        own = pd.concat(list(parts)).sort_values("turn", kind="stable")
        out = []
        for turn, role, text, message in own[["turn", "role", "text", "message"]].itertuples(index=False):
            before = [m for t, m in held if t < turn]
            out.append((key[0], turn, role, text, before[-keep:]))
            held = sorted([*held, (turn, message)], key=lambda x: x[0])[-keep:]
        state.update(([int(t) for t, _ in held], [m for _, m in held]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[*COLUMNS, "history"])

    kinds = dict(turns.dtypes)
    rows = turns.filter("turn IS NOT NULL").select(*COLUMNS, F.concat_ws(": ", "role", "text").alias("message"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in COLUMNS) + ", history array<string>"
    return rows.groupBy("conv_id").applyInPandasWithState(follow, schema, "turns array<long>, messages array<string>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
