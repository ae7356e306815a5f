"""Conversation state against the window over a table."""

import time

from quillstone.streaming.sessions import with_history

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, tmp_path, batches, n, idle_ms=None, pause=0.0):
    """All rows that a stream gives out over micro-batches of the given rows."""
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        stream = with_history(spark.readStream.schema(SCHEMA).parquet(arrivals), n, idle_ms)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**{"availableNow" if idle_ms is None else "once": True}).start().awaitTermination()
        time.sleep(pause)
    return sorted((r["conv_id"], r["turn"], r["role"], r["text"], tuple(r["history"])) for r in spark.read.parquet(out).collect())


def test_stream_like_a_table(spark, tmp_path):
    rows = [(c, t, [None, "user", "assistant"][t % 3], None if (c + t) % 5 == 0 else f"{c}/{t}") for c in range(6) for t in range(9)]
    batches = [[r for r in rows if r[1] < 2][::-1], [r for r in rows if 2 <= r[1] < 7][::-1], [r for r in rows if r[1] >= 7]]
    table = with_history(spark.createDataFrame(rows, SCHEMA), 2)
    want = sorted((r["conv_id"], r["turn"], r["role"], r["text"], tuple(r["history"])) for r in table.collect())
    assert str(run(spark, tmp_path, batches, 2)) == str(want)


def test_a_late_message_and_what_state_holds(spark, tmp_path):
    got = run(spark, tmp_path, [[(1, t, "u", str(t)) for t in (0, 1, 2, 4, 5)], [(1, 3, "u", "3"), (1, 6, "u", "6")]], 1)
    own = {r[1]: r[4] for r in got}
    assert own[5] == ("u: 2", "u: 4") and own[6] == ("u: 4", "u: 5")
    assert own[3] == ()  # turns 1 and 2 have been forgotten


def test_an_idle_conversation_begins_anew(spark, tmp_path):
    got = run(spark, tmp_path, [[(1, 0, "u", "a"), (2, 0, "u", "x")], [(2, 1, "u", "y")], [(1, 1, "u", "b")]], 1, idle_ms=1, pause=0.2)
    own = {(r[0], r[1]): r[4] for r in got}
    assert own[1, 1] == ()
