"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of bytes other than space and \x09-\x0D. `bytes.split()` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the named columns, found by exact spelling.

    Columns whose names differ only in case, or repeat, would be ambiguous to
    Spark's resolver; they are addressed by place here.  ``renamed`` maps an
    output name to an input name.
    """
    wanted = {n: n for n in names} | renamed
    missing = [n for n in wanted.values() if n not in df.columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r} in {df.columns}")
    placed = df.toDF(*[f"_p{i}" for i in range(len(df.columns))])
    return placed.select(*[F.col(f"_p{df.columns.index(old)}").alias(new) for new, old in wanted.items()])


def by_place(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column], list[Column]]:
    """The frame with columns named by place, a function from a name to its column, and the columns under their names.

    For operators that pass all columns through, some of which may differ only in case.
    """
    names = df.columns
    places = [f"_p{i}" for i in range(len(names))]

    def at(name: str) -> Column:
        if name not in names:
            raise ValueError(f"no column {name!r} in {names}")
        return F.col(places[names.index(name)])

    return df.toDF(*places), at, [F.col(p).alias(n) for p, n in zip(places, names)]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or where unset (tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        live = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = live.get() if live.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and return a frame that reads it.

    Cuts the lineage: losing executors later costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


#: Tables written in the scopes that are open, the innermost last.
_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what `materialise` wrote within it.

    Gives a function that writes a result which outlives the scope (and belongs
    to the scope around it, if there is one).
    """
    _SCOPES.append([])
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(materialise(df))
        return kept[-1]

    try:
        yield keep
    finally:
        written = _SCOPES.pop()
        for df in written:
            if not any(df is k for k in kept):
                discard(df)
        if _SCOPES:
            _SCOPES[-1].extend(kept)


def discard(df: DataFrame | None) -> None:
    """Delete what `materialise` wrote for a frame that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], Iterable[Sequence]]], schema: str) -> DataFrame:
    """Arrow map over column lists.

    ``make()`` runs once for each task and returns a function from the input
    columns of a batch (Python lists) to the output columns (lists or arrays).
    Rows go through in bounded pieces, so memory follows one piece and not the
    partition.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if step is None:
                step = make()
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out = step([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, target)], schema=target)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, kept for a bounded number of short ones."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[word] = h
        return h


def hash_fraction(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone, for choosing a bounded sample."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def spread_ranks(df: DataFrame, group: list[str], order: list[str], measure: Column, out: str, chunk: Column) -> DataFrame:
    """Exclusive running sum of ``measure`` in each group, in the order (chunk, order).

    ``chunk`` is a column of the frame's rows that rises with the wanted order.
    A group is never gathered in one task: rows are windowed within (group,
    chunk), and only the chunks' sums are windowed within the group.
    """
    rows = df.withColumn("_chunk", chunk).withColumn("_m", measure.cast("long"))
    inner = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_chunk").agg(F.sum("_m").alias("_s"))
    outer = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_offset"))
    inside = rows.withColumn("_in", F.coalesce(F.sum("_m").over(inner), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_chunk") == F.col("_c")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return inside.join(offsets, cond, "inner").withColumn(out, F.col("_in") + F.col("_offset")).drop("_chunk", "_m", "_in", "_offset", "_c", *[f"_g{i}" for i in range(len(group))])
