"""Operators on streams: buffers, count windows, taps.

Streams have no order across keys, so every operator takes a key.  Within a
micro-batch a key's rows are put in the order of a column first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.checks import positive
from tessera.plans.session import shared_folder


def session_buffer(stream: DataFrame, time: str, value: str, max_age: str, key: str, watermark: str = "1 minute") -> DataFrame:
    """key, start, end, items: values gathered until none has come for ``max_age`` (every value starts the wait anew)."""
    w = F.session_window(F.col(time), max_age)
    entry = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    out = stream.withWatermark(time, watermark).groupBy(w.alias("w"), key).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["v"]).alias("items"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "items")


def _arrived(rows: Iterator[pd.DataFrame], order: str, value: str) -> list:
    """A key's new values in this batch, in order, as Python values."""
    fresh = pd.concat(list(rows)).sort_values(order, kind="stable")
    return [v.item() if hasattr(v, "item") else v for v in fresh[value]]


def _own(stream: DataFrame, *columns: str) -> DataFrame:
    return stream.select(*dict.fromkeys(columns))


def buffer(stream: DataFrame, key: str, order: str, value: str, size: int, idle_ms: int | None = None) -> DataFrame:
    """key, items: lists of ``size`` values of a key; with idle_ms also shorter ones after a pause of that time.

    The state of a key is fewer than ``size`` values; every arrival starts the
    wait anew.
    """
    positive(size, "size")
    kinds = dict(stream.dtypes)

    def run(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            if held:
                yield pd.DataFrame({key: [k[0]], "items": [held]})
            return
        values = held + _arrived(rows, order, value)
        full = len(values) // size * size
        rest = values[full:]
        if rest:
            state.update((rest,))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        if full:
            yield pd.DataFrame({key: [k[0]] * (full // size), "items": [values[i : i + size] for i in range(0, full, size)]})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return _own(stream, key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, items array<{kinds[value]}>", f"held array<{kinds[value]}>", "append", timeout)


def window(stream: DataFrame, key: str, order: str, value: str, size: int, step: int = 1) -> DataFrame:
    """key, start, items: sliding windows of ``size`` values of a key each ``step`` values; the state is one window."""
    positive(size, "size")
    positive(step, "step")
    kinds = dict(stream.dtypes)

    def run(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, start, skip = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        values, out = held + _arrived(rows, order, value), []
        drop = min(skip, len(values))
        values, skip = values[drop:], skip - drop
        while not skip and len(values) >= size:
            out.append((k[0], start, values[:size]))
            drop = min(step, len(values))
            values, skip, start = values[drop:], step - drop, start + step
        state.update((values, start, skip))
        if out:
            yield pd.DataFrame(out, columns=[key, "start", "items"])

    return _own(stream, key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, start long, items array<{kinds[value]}>", f"held array<{kinds[value]}>, start long, skip long", "append", GroupStateTimeout.NoTimeout)


def flat_map(stream: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """A row for each item of an array made from each row."""
    return stream.withColumn(name, F.explode(items))


def where_type(stream: DataFrame, variant: str, kind: str) -> DataFrame:
    """The rows whose variant value is of a type, as that type."""
    value = F.try_variant_get(F.col(variant), "$", kind)
    return stream.withColumn(variant, value).where(F.col(variant).isNotNull())


class Tap(StreamingQueryListener):
    """Calls back as queries begin, go on, idle and end; add it to a session's streams while it is wanted."""

    def __init__(self, on_start=None, on_progress=None, on_idle=None, on_end=None, on_error=None):
        self._start, self._progress, self._idle, self._end, self._error = on_start, on_progress, on_idle, on_end, on_error

    def onQueryStarted(self, event) -> None:
        if self._start:
            self._start(event)

    def onQueryProgress(self, event) -> None:
        if self._progress:
            self._progress(event.progress)

    def onQueryIdle(self, event) -> None:
        if self._idle:
            self._idle(event)

    def onQueryTerminated(self, event) -> None:
        call = self._error if event.exception else self._end
        if call:
            call(event)


def tap(stream: DataFrame, on_batch: Callable[[DataFrame, int], None] | None = None, metrics: dict[str, Column] | None = None, name: str = "tap") -> DataFrame | Callable:
    """Observes a stream without changing it.

    With metrics, the frame reports them to query listeners (such as `Tap`) for
    each batch; with on_batch, returns the function for ``foreachBatch`` that
    calls it.
    """
    if metrics:
        return stream.observe(name, *[c.alias(k) for k, c in metrics.items()])

    def call(batch: DataFrame, number: int) -> None:
        if on_batch:
            on_batch(batch, number)

    return call


def run_to_end(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a bounded stream to its end into Parquet files, by default in the shared folder, and reads them.

    In complete mode each batch takes the place of the one before.
    """
    spark = stream.sparkSession
    at = folder or f"{shared_folder(spark)}/tessera-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{at}/rows")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
