"""Stateful streams: practice sessions with a fixed lifetime, and requests that a cache sees once.

A session begins with a user's first answer and is valid for an hour from then, however busy it is,
so it is no session window (which a busy user would keep open).  Each user's answers wait in the
state until the watermark has passed the end of their session: then no earlier answer can come, and
the session is scored and leaves.  The state of a user holds what came within an hour and the
allowed lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds of a session (DAT-02).
LIFETIME = 3_600_000
SESSIONS = "user string, started long, answers long, questions long, correct long"
_STATE = "at array<long>, question array<string>, correct array<boolean>"


def split_sessions(answers: list[tuple[int, str, bool]], lifetime: int = LIFETIME) -> list[list[tuple[int, str, bool]]]:
    """Answers in order of time, cut where one comes when the session before has ended."""
    out: list[list[tuple[int, str, bool]]] = []
    for a in sorted(answers):
        if out and a[0] - out[-1][0][0] < lifetime:
            out[-1].append(a)
        else:
            out.append([a])
    return out


def scored(session: list[tuple[int, str, bool]]) -> tuple[int, int, int, int]:
    """CLI-07: (start, answers, questions, correct): the first answer to a question counts."""
    first: dict[str, bool] = {}
    for _, question, correct in session:
        first.setdefault(question, correct)
    return session[0][0], len(session), len(first), sum(first.values())


def practice_sessions(answers: DataFrame, at: str, user: str, question: str, correct: str, late: str = "2 hours", lifetime: int = LIFETIME) -> DataFrame:
    """DAT-02, CLI-07: (user, started, answers, questions, correct) of each session, once it has ended for good.

    Answers that come later than ``late`` behind the latest one are dropped by the engine.  ``started``
    is in milliseconds.  Rows with a null user or time have no session.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for p in parts:
                held += zip(p["at"].tolist(), p["question"].tolist(), p["correct"].tolist(), strict=True)
        done, sure = [], state.getCurrentWatermarkMs()
        sessions = split_sessions(held, lifetime)
        while sessions and sessions[0][0][0] + lifetime < sure:
            done.append((key[0], *scored(sessions.pop(0))))
        left = [a for s in sessions for a in s]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            state.setTimeoutTimestamp(left[0][0] + lifetime)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in SESSIONS.split(", ")])

    rows = answers.where(F.col(user).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = rows.select(F.col(user).cast("string").alias("user"), F.unix_millis(at).alias("at"), F.coalesce(F.col(question).cast("string"), F.lit("")).alias("question"), F.coalesce(correct, F.lit(False)).alias("correct"), F.col(at).alias("_time"))
    return rows.groupBy("user").applyInPandasWithState(run, SESSIONS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_requests(requests: DataFrame, at: str, *key: str, within: str = "7 days") -> DataFrame:
    """SNK-13, SRC-16: requests whose key hasn't come within that time before: what a download cache has to fetch."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark(list(key))


def to_the_end(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what has arrived and stop; the checkpoint makes a later run go on behind it."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
