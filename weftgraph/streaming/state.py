"""Streams with keyed state: change batches by the capped gap, and deltas that have become whole.

State is what is still open: the changes of a watch's open batch (and those that came ahead of the watermark), and the
chunk numbers of a shard's newest generation. Chunks themselves stay in their log. A query goes on from its checkpoint
after a loss, and what a lost micro-batch gave is given again under the same number. ``maxFilesPerTrigger`` and its kin
on the source bound what a micro-batch takes in.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.streaming.changes import coalesce_changes

SHARD = ["parser_id", "workspace_id"]


def closed(pending: list[list], settled: int, gap: int, cap: int) -> tuple[list[list], list[list]]:
    """(rows of batches that nothing can join any more, each with its batch's first time in front; the other rows) of rows
    in the order of their times, which come first. No row up to ``settled`` can follow any more."""
    out, at = [], 0
    while at < len(pending) and pending[at][0] <= settled:
        first = last = pending[at][0]
        end = at
        while end < len(pending) and pending[end][0] <= min(settled, last + gap, first + cap):
            last = pending[end][0]
            end += 1
        follows = end < len(pending) and pending[end][0] <= settled
        if not follows and settled < min(last + gap, first + cap):
            break
        out += [[first, *row] for row in pending[at:end]]
        at = end
    return out, pending[at:]


def capped_batches(changes: DataFrame, gap: int, cap: int, late: str = "10 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """A stream of changes (seq, ts, path, change_type, and the keys) with ``batch`` as micro_batch gives it, by ``gap`` and
    ``cap`` in microseconds, for each watch (keys; none: all is one). A batch comes whole, in one micro-batch, once the
    watermark (``late`` behind the latest ts) has passed its end; changes that are later than that are dropped. The rule
    is sequential within a watch, whose state is its open batch."""
    watch = list(keys) or ["_watch"]
    rows = changes.withWatermark("ts", late)
    rows = rows if keys else rows.withColumn("_watch", F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in watch) + ", batch bigint, us bigint, seq bigint, path string, change_type string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = json.loads(state.get[0]) if state.exists else []
        for x in frames:
            pending += [list(r) for r in zip(*(x[c].tolist() for c in ("us", "seq", "path", "change_type")), strict=True)]
        pending.sort(key=lambda r: r[:2])
        now = state.getCurrentWatermarkMs()
        out, pending = closed(pending, now * 1000, gap, cap)
        if pending:
            state.update((json.dumps(pending),))
            state.setTimeoutTimestamp(max(now + 1, (pending[0][0] + min(gap, cap)) // 1000))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["batch", "us", "seq", "path", "change_type"])
            for name, value in reversed(list(zip(watch, key, strict=True))):
                frame.insert(0, name, value)
            yield frame

    rows = rows.select("ts", *watch, F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("seq"), "path", "change_type")
    out = rows.groupBy(*watch).applyInPandasWithState(step, shape, "pending string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*keys, "batch", F.timestamp_micros("us").alias("ts"), "seq", "path", "change_type")


def follow_batches(batched: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, keys: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Start a stream of capped_batches that hands the net changes of each closed batch to apply(changes, micro-batch id);
    ``control`` tells which of them are rescans."""

    def each(df: DataFrame, n: int) -> None:
        apply(coalesce_changes(df, keys), n)

    return batched.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def advance(state: dict, rows: Iterable[tuple[int, int, int, bool]]) -> tuple[dict, list[tuple[int, int]]]:
    """(state, (generation, request) of deltas that these chunks make whole) of chunks (generation, request, number, last).
    A newer generation, even unfinished, discards older ones. A delta is whole once its last chunk and all before it, from
    0 on, have come, in whatever order and however often."""
    whole = []
    for generation, request, number, last in rows:
        if generation < state.get("generation", generation):
            continue
        if generation > state.get("generation", generation - 1):
            state = {"generation": generation, "requests": {}}
            whole = []
        seen = state["requests"].setdefault(str(request), {"numbers": [], "size": None, "given": False})
        if seen["given"]:
            continue
        if number not in seen["numbers"]:
            seen["numbers"].append(number)
        if last:
            seen["size"] = number + 1
        if seen["size"] == len(seen["numbers"]):
            seen.update(numbers=[], given=True)
            whole.append((generation, request))
    return state, whole


def whole_deltas(chunks: DataFrame) -> DataFrame:
    """(parser_id, workspace_id, generation, request_id) of a stream of chunks, once each delta is whole."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {}
        rows = [r for x in frames for r in zip(*(x[c].tolist() for c in ("generation", "request_id", "chunk_ord", "last")), strict=True)]
        now, whole = advance(now, rows)
        state.update((json.dumps(now),))
        if whole:
            yield pd.DataFrame([(*key, *x) for x in whole], columns=[*SHARD, "generation", "request_id"])

    rows = chunks.select(*SHARD, "generation", F.col("request_id").cast("bigint").alias("request_id"), "chunk_ord", F.coalesce("is_last_for_request", F.lit(False)).alias("last"))
    return rows.groupBy(*SHARD).applyInPandasWithState(step, "parser_id string, workspace_id string, generation bigint, request_id bigint", "seen string", "append", GroupStateTimeout.NoTimeout)


def follow_deltas(chunks: DataFrame, log: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that hands the chunks of deltas that have become whole to apply(chunks, micro-batch id). They are read
    from their log, a table of the same chunks, so state holds no facts, whatever the size of a delta."""

    def each(df: DataFrame, n: int) -> None:
        whole = df.persist()
        if not whole.isEmpty():
            apply(log().join(whole, [*SHARD, "generation", "request_id"], "left_semi"), n)
        whole.unpersist()

    return whole_deltas(chunks).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
