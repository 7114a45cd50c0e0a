"""State of chat sessions is kept in blocks: what is asked of the store does not grow with the sessions of a block."""

from datetime import datetime, timedelta

import pandas as pd

from colloq.streaming import chat


class _Store:
    """A state store in memory that counts what it is asked for."""

    def __init__(self):
        self.value, self.timers, self.asked = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.asked += 1
        self.timers.append(timer)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _rows(*rows):
    return iter([pd.DataFrame(rows, columns=["session", "number", "at", "moment", "text"])])


def _said(session, number, minute, text=None):
    return session, number, pd.Timestamp(0) + pd.Timedelta(minutes=minute), minute * 60_000_000, text or f"m{number}"


def _answered(history, rows, minute, key=0):
    out = pd.concat(list(history.handleInputRows((key,), rows, _Clock(minute * 60_000))))
    return list(map(tuple, out[["session", "number", "turn", "context"]].itertuples(index=False)))


def test_a_block_asks_the_store_once_for_all_its_sessions():
    store, history = _Store(), chat.History(datetime(2020, 1, 1), timedelta(minutes=30))
    history.init(store)
    assert _answered(history, _rows(*[_said(s, s, s) for s in range(20)]), 0) == [(s, s, 1, "") for s in range(20)]
    assert store.asked == 2 and store.timers == [49 * 60_000 + 1]
    # at minute 40 sessions 0 to 9 have passed their pause; 12 goes on, 3 begins anew, 15 is reset
    got = _answered(history, _rows(_said(12, 30, 41), _said(3, 31, 41), _said(15, 32, 41, chat.RESET), _said(15, 33, 42)), 40)
    assert got == [(3, 31, 1, ""), (12, 30, 2, "m12"), (15, 33, 1, "")]
    assert store.value[0] == [3, *range(10, 20)] and store.timers == [72 * 60_000 + 1]
    history.handleExpiredTimer((0,), None, None).__next__()
    assert not store.exists()


def test_long_contexts_are_sent_in_parts_and_a_nameless_session_stays_one(monkeypatch):
    monkeypatch.setattr(chat, "SENT", 5)
    store, history = _Store(), chat.History(datetime(2020, 1, 1), timedelta(minutes=30))
    history.init(store)
    parts = list(history.handleInputRows((None,), _rows(*[_said(0, n, n) for n in range(5)]), _Clock(0)))
    assert len(parts) > 1
    every = pd.concat([p for p in parts if len(p)])
    assert every["turn"].tolist() == [1, 2, 3, 4, 5] and every["session"].isna().all() and every["context"].tolist()[-1] == "m0\nm1\nm2\nm3"


def test_sessions_of_one_block_and_of_several_in_a_stream(spark, tmp_path):
    """Sessions that are null, negative or beyond a double's whole numbers, in three runs of a stream."""
    big, start, at = (1 << 60) + 1, datetime(2020, 1, 1), datetime(2024, 5, 1, 12)
    names = [None, -1, 0, 1, 31, 32, big, big + 1]
    rows = [(s, 100 * k + n, at + timedelta(minutes=k * 20 + n), f"m{n}") for k in range(3) for n, s in enumerate(names)]
    schema = "session bigint, number bigint, at timestamp, text string"
    for k in range(3):
        spark.createDataFrame(rows[k * 8 : k * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        chat.run(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out"), start)
    got = {tuple(r) for r in spark.read.schema(chat.TURN).parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in chat.turns(spark.createDataFrame(rows, schema), start).collect()} and len(got) == 24
