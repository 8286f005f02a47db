"""Streamed responses put together while their chunks still arrive.

Of each request its chunks are kept until the end marker and everything before it
are there, then a small tombstone that counts what still comes. A request that
nothing came for in ``lifetime`` of event time is closed: what there is comes out
once, as incomplete. Requests share states by hash, because a call of Python for
each of them costs far more than its few chunks. The result of a request does not depend on the order in
which its chunks arrive within that time, and equals the batch operator's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.operators.chatlog import parse_chunks

RESPONSE, LATE = "response", "late"
RESULT = "request_id string, kind string, response string, n_chunks bigint, n_malformed bigint, complete boolean, n_late bigint"
_STATE = "requests string"
BUCKETS = 4096


def reassemble_stream(chunks: DataFrame, *, event_time: str = "ts", delay: str = "1 minute", lifetime: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``kind`` response, one per request, and of ``kind`` late for requests that got chunks after that.

    ``chunks`` is a stream of ``request_id, seq, raw`` with the time each chunk
    was sent; chunks are numbered 0, 1, 2, ... A response comes out as soon as
    it is whole and readable, else when event time has passed its last chunk by
    ``lifetime``. Of copies of one number a readable one counts, as long as the
    response is not out. ``n_late`` counts chunks that came later; those behind
    the watermark (``delay``) are not seen at all, only counted by Spark.

    A state holds the open requests of one of ``buckets``. Take so many that one
    bucket fits a task; the number stays as it is as long as a checkpoint.
    """
    span = int(pd.Timedelta(lifetime).total_seconds() * 1000)

    def response(name: str | None, parts: dict[int, tuple], end_at: int | None, complete: bool) -> tuple:
        live = [parts[seq] for seq in sorted(parts) if end_at is None or seq < end_at]
        good = [text for rank, text in live if rank == 0]
        n_bad = sum(rank == 1 for rank, _ in live)
        return name, RESPONSE, "".join(good), len(good), n_bad, complete, 0

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        # Of a request: its parts, the end marker's number, the latest time, whether it is out, late chunks, when it is due.
        requests = {name: [{seq: (rank, text) for seq, rank, text in parts}, *rest]
                    for name, parts, *rest in (json.loads(state.get[0]) if state.exists else [])}
        rows, touched = [], set()
        for frame in frames if not state.hasTimedOut else ():
            columns = [frame[c].tolist() for c in ("request_id", "seq", "bad", "end", "content", "at")]
            for name, seq, bad, end, content, at in zip(*columns):
                r = requests.get(name)
                if r is None:
                    r = requests[name] = [{}, None, 0, False, 0, 0]
                touched.add(name)
                r[2] = max(r[2], at)
                if r[3]:
                    r[4] += 1
                elif end:
                    r[1] = seq if r[1] is None else min(r[1], seq)
                else:
                    # Of copies a readable one counts, then a broken one, then an empty one.
                    part, parts = (1 if bad else 0 if content else 2, content), r[0]
                    parts[seq] = min(parts.get(seq, part), part)
        for name in touched:
            r = requests[name]
            parts, end_at = r[0], r[1]
            if not r[3] and end_at is not None and all(seq in parts and parts[seq][0] != 1 for seq in range(end_at)):
                rows.append(response(name, parts, end_at, True))
                r[0], r[3] = {}, True
            r[5] = max(r[2], now) + span
        for name in [n for n, r in requests.items() if r[5] < now and n not in touched]:
            parts, end_at, _, out, n_late, _ = requests.pop(name)
            if not out:
                whole = end_at is not None and not any(rank == 1 for seq, (rank, _) in parts.items() if seq < end_at)
                rows.append(response(name, parts, end_at, whole))
            elif n_late:
                rows.append((name, LATE, None, None, None, None, n_late))
        if requests:
            state.update((json.dumps([[n, [(seq, *p) for seq, p in r[0].items()], *r[1:]] for n, r in requests.items()]),))
            state.setTimeoutTimestamp(max(min(r[5] for r in requests.values()), now + 1))
        elif state.exists:
            state.remove()
        if rows:
            columns = ["request_id", "kind", "response", "n_chunks", "n_malformed", "complete", "n_late"]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"n_chunks": "Int64", "n_malformed": "Int64", "complete": "boolean", "n_late": "int64"})

    parsed = parse_chunks(chunks, event_time).withColumn("at", F.unix_millis(F.col(event_time))).withColumn("request_id", F.col("request_id").cast("string"))
    parsed = parsed.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(buckets)))
    return parsed.withWatermark(event_time, delay).groupBy("bucket").applyInPandasWithState(
        update, RESULT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
