"""Streams: incremental ingest (D2), redacted question log (G12), conversations with bounded state (T-3, T-4)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanternq.operators import guardrails, sessions


def redacted_log(questions: DataFrame, text: str = "question") -> DataFrame:
    """G12 over a stream or a table: the text column without personal data, and what was removed."""
    clean, counts = guardrails.redact(F.col(text))
    return questions.withColumns({f"n_{k}": v for k, v in counts.items()}).withColumn(text, clean)


def ingest(documents: DataFrame, add: Callable[[DataFrame], object], checkpoint: str):
    """D2 as a stream: every micro-batch of documents is upserted by ``add`` (such as ``Engine.add_documents``). Content
    ids make a replayed batch harmless."""
    return documents.writeStream.foreachBatch(lambda batch, _: add(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latencies(events: DataFrame, time: str, value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means per event-time window; rows later than the watermark are dropped by the stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def conversations(turns: DataFrame, ttl: str | None = "1 hour") -> DataFrame:
    """T-3, T-4 as a stream: ``session_id, turn, question`` to ``session_id, turn, question, rewritten, rule``. The state
    of a session is its last six turns; a session that is silent for ``ttl`` is forgotten. With a ``ttl`` the stream never
    comes to an end of its own, as silence is noticed by the clock: use ``ttl=None`` with a one-off trigger."""
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else 0
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for t in rows.itertuples(index=False):
            text, rule = sessions.rewrite(t.question or "", memory)
            out.append((key[0], t.turn, t.question, text, rule))
            memory = [*memory[-(sessions.MEMORY - 1) :], sessions.remembered(t.question or "", text)]
        state.update((json.dumps(memory),))
        if millis:
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["session_id", "turn", "question", "rewritten", "rule"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    schema = f"session_id {kinds['session_id']}, turn {kinds['turn']}, question string, rewritten string, rule string"
    return turns.groupBy("session_id").applyInPandasWithState(fold, schema, "memory string", "append", timeout)
