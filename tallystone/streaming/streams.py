"""Structured Streaming forms of the stateful operators.

Watched chains, token buckets and deduplication give the rows that the batch forms give, however a stream is cut into
batches (a token bucket's rows have to come in order). Windows and sessions leave out what comes behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallystone.operators.chains import GENESIS, chain_blocks
from tallystone.session import share_package


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """``events`` files as a stream, with the time zone that watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rolling_rates(events: DataFrame, width: str = "300 seconds", slide: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts, errors and mean of each sliding window and type; rows later than the watermark are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key inside the watermark (insert, on conflict do nothing)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys])


def token_bucket(events: DataFrame, key: str, order: str, tick: str, cost: str, capacity: int, refill: int) -> DataFrame:
    """Key, order and whether each row was accepted; the bucket lives in the state store. Rows of a batch are put in order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values(order)  # a key's rows of one micro-batch
        accepted = []
        for t, c in zip(rows[tick], rows[cost], strict=True):
            t, c = int(t), int(c)
            if at is not None and t < at:
                accepted.append("tick_regression")
                continue
            tokens = min(capacity, tokens + (0 if at is None else (t - at) * refill))
            at = t
            accepted.append("yes" if tokens >= c else "no")
            tokens -= c if tokens >= c else 0
        state.update((tokens, at))
        yield pd.DataFrame({key: rows[key], order: rows[order], "accepted": accepted})

    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in (key, order))
    return events.groupBy(key).applyInPandasWithState(step, f"{kinds}, accepted string", "tokens long, tick long", "append", GroupStateTimeout.NoTimeout)


class _Watcher(StatefulProcessor):
    """The last height and hash of a chain, whether it is frozen, and the blocks that came before their turn."""

    def __init__(self, slack: int, patience_ms: int | None):
        self.slack, self.patience_ms = slack, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "height long, hash string, frozen boolean")
        self.early = handle.getMapState("early", "height long", "hash string, previous string, own_fault string")

    def _judge(self, chain: tuple, blocks: dict[int, tuple], out_of_patience: bool) -> Iterator[pd.DataFrame]:
        height, before, frozen = self.last.get() if self.last.exists() else (-1, GENESIS, False)
        out = []
        if not frozen:
            held = {h[0]: tuple(v) for h, v in self.early.iterator()}
            blocks = {h: b for h, b in (held | blocks).items() if h > height}  # a block that was judged may be delivered again
            most = max(blocks, default=height)
            for h in sorted(blocks):
                if h != height + 1 and most < height + 1 + self.slack and not out_of_patience:
                    break  # the blocks between may still come
                own, previous, fault = blocks[h]
                expected = actual = None
                if fault is None and h != height + 1:
                    fault, expected, actual = "HEIGHT_GAP", str(height + 1), str(h)
                elif fault is None and previous != before:
                    fault, expected, actual = "CHAIN_BREAK", before, previous
                out.append((*chain, h, fault, expected, actual))
                height, before, frozen = h, own, fault is not None
                if frozen:
                    break
            waiting = {} if frozen else {h: b for h, b in blocks.items() if h > height}
            for h in held.keys() - waiting.keys():
                self.early.removeKey((h,))
            for h in waiting.keys() - held.keys():
                self.early.updateValue((h,), waiting[h])
            self.last.update((height, before, frozen))
            self.waits = bool(waiting)
        else:
            self.waits = False
        yield pd.DataFrame(out, columns=["chain", "height", "fault", "expected", "actual"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        none = lambda v: None if pd.isna(v) else v
        new = {int(h): (none(a), none(b), none(c)) for frame in rows for h, a, b, c in zip(frame["height"], frame["hash"], frame["previous"], frame["own_fault"], strict=True)}
        yield from self._judge(key, new, False)
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            if self.waits:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judge(key, {}, True)


def watched(blocks: DataFrame, slack: int = 64, patience_ms: int | None = None) -> DataFrame:
    """The rows of ``chains.watched_blocks`` of a stream of blocks, whatever batches they come in.

    A chain's last height and hash and whether it is frozen live in the state store. Blocks may come before their turn:
    they wait there until the ones between have come. These count as missing once a block ``slack`` heights on has come,
    so at most ``slack`` blocks of a chain wait, or, with ``patience_ms``, once no block of the chain came for so long.
    Rows of a height that was judged are ignored. The state store must be one with column families (RocksDB).
    """
    share_package(blocks.sparkSession)
    rows = blocks.select("chain", F.col("height").cast("long").alias("height"), "hash", "previous", "own_fault")
    kind = rows.schema["chain"].dataType.simpleString()
    timed = "ProcessingTime" if patience_ms is not None else "None"
    return rows.groupBy("chain").transformWithStateInPandas(_Watcher(slack, patience_ms), f"chain {kind}, height long, fault string, expected string, actual string", "Append", timed)


def watch_chain(lines: DataFrame, on_break, checkpoint: str, slack: int = 1):
    """Follow chain lines (chain, seq from 0, line, prev_hash) and hand each chain's first break to ``on_break(batch_id, rows)``.

    Rows have chain, seq, fault, expected and actual. Lines are taken to come in order, batch after batch; where they
    don't, ``slack`` says how far one may run ahead.
    """
    found = watched(chain_blocks(lines), slack).withColumnRenamed("height", "seq")
    writer = found.writeStream.foreachBatch(lambda batch, batch_id: on_break(batch_id, batch.where("fault IS NOT NULL")))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
