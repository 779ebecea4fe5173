"""Conversation sessions: a batch replay, and keyed state of a stream.

The state of a session is its turn count and its last messages. The time-out of idle sessions is an addition of this
engine; without one, sessions live as long as the query's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.dialogue import summary

KEEP, WINDOW, WIDTH = 20, 6, 120
OUT = "session_id string, turn_index long, n_messages int, summary string"


def replay(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each message (role, text): the summary of the messages up to it and the number kept so far."""
    last = Window.partitionBy(key).orderBy(order).rowsBetween(-(WINDOW - 1), Window.currentRow)
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    heard = F.collect_list(F.struct(F.col("role"), F.col("text").alias("content"))).over(last)
    return messages.select(key, order, summary(heard).alias("summary"), F.least(at, F.lit(KEEP)).alias("n_kept"), F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy(key).orderBy(order)).alias("turn_index"))


def said(messages: list[dict]) -> str:
    """The summary of a list of messages."""
    out = []
    for m in messages[-WINDOW:]:
        text = " ".join(str(m.get("content") or "").split())
        if text:
            out.append(f"{m.get('role') or 'unknown'}: {text[:WIDTH]}")
    return "\n".join(out)


def advance(state: tuple[int, str] | None, turns: list[tuple[str, str]]) -> tuple[int, str]:
    """(turn_index, messages as JSON) after some (question, answer) turns."""
    index, held = (state[0], json.loads(state[1])) if state else (0, [])
    for question, answer in turns:
        held += [{"role": "user", "content": question}, {"role": "assistant", "content": answer}]
        index += 1
    return index, json.dumps(held[-KEEP:], ensure_ascii=False)


def track(turns: DataFrame, idle: str | None = None) -> DataFrame:
    """Streaming sessions of turns (session_id, turn, question, answer): one row for each session that a batch touched."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("turn")
        new = advance(state.get if state.exists else None, list(zip(rows["question"], rows["answer"])))
        state.update(new)
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        held = json.loads(new[1])
        yield pd.DataFrame([(key[0], new[0], len(held), said(held))], columns=["session_id", "turn_index", "n_messages", "summary"])

    return turns.groupBy("session_id").applyInPandasWithState(update, OUT, "turn_index long, messages string", "update", "ProcessingTimeTimeout" if idle else "NoTimeout")
