"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, components.

Equal vectors of a label are one class before anything is compared.  A class is
coded once: its signs in all tables, packed.  Classes meet in the tables' buckets
with these codes only; a class is sent on to a bucket with its vector if some
pair there can be near by the number of signs that differ and shares no earlier
table's bucket.  There pairs are judged by their cosines in double precision, and
counted without being written out: a bucket sends on its members' link counts and
one link for each member to the smallest of its local component, so what leaves a
bucket is never more than its rows.  Large buckets are dealt as pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import materialise, pick, scope
from tessera.llm.components import components

#: Probability at most which a pair exactly at the threshold shares no bucket.
MISS = 0.002
#: Signs that a pair at the threshold may differ in, in standard deviations above their mean: 1 of 10^9 pairs differs in more.
DEVIATIONS = 6
#: Signs of a code at least.
LEAST_SIGNS = 256
#: Classes of the largest label that a bucket holds on average, were they spread evenly.
IN_BUCKET = 64
#: Rows of a block; a bucket of more rows is dealt as pairs of blocks.
BLOCK = 1024
#: Rows of large-bucket sizes, and of classes to be read again, that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_CLASSES = 20_000, 500_000
_BUCKET = ("label", "dim", "t", "code", "i", "j")


def hash_plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): buckets of some tens of rows if vectors were spread evenly, and enough tables for MISS."""
    bits = max(6, math.ceil(math.log2(max(rows, 2) / IN_BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree)))


def most_signs(count: int, threshold: float) -> int:
    """Signs of ``count`` in which a pair at the threshold differs at most."""
    p = math.acos(threshold) / math.pi
    return math.ceil(count * p + DEVIATIONS * math.sqrt(count * p * (1 - p)))


def planes(dim: int, count: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((count, dim))


def matrices(vectors):
    """(places, matrix) of an Arrow list column's vectors, a matrix for each length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, values[start[at][:, None] + np.arange(dim)]


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, by way of their largest components, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): the codes held by packed signs."""
    flat = np.unpackbits(signs, axis=1, count=bits * tables).reshape(len(signs), tables, bits)
    return flat.astype(np.int64) @ (1 << np.arange(bits))


def _local(labels: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Smallest label reachable inside a bucket, by repeated minima over the link matrix."""
    big = np.iinfo(np.int64).max
    while True:
        low = np.minimum(labels, np.where(near, labels[None, :], big).min(axis=1))
        if (low == labels).all():
            return low
        labels = low


def _by_bucket(batches, names):
    """Arrow tables of whole buckets, one after another, of rows sorted by bucket."""
    import pyarrow as pa

    def key(row):
        return tuple(row.column(c)[0].as_py() for c in names)

    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in names:
            values = batch.column(c).to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            k = key(part) if a == 0 else None  # only a batch's first bucket can go on from the one before
            if held and not (a == 0 and k == at):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
        at = key(held[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Compares vectors with equal, non-null labels (and equal lengths).  Vectors
    that are null, empty, zero, or hold null or non-finite components link with
    nothing: 0 links, a component of their own.  Repeated rows of a vec_id are
    vectors like any other and give a row each.  A null vec_id is larger than
    all others; a component of such rows only has a null id and is kept.  Other
    columns are ignored, whatever their names.
    """
    with scope() as keep:
        return keep(_near_vectors(vectors, threshold, block))


def _near_vectors(vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    own = pick(vectors, "vec_id", "embedding", "label")
    kind = dict(own.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    if kind not in ("float", "double"):
        kind, own = "double", own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    fit = F.coalesce(finite & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False))) & F.col("label").isNotNull(), F.lit(False))
    zero = F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))  # -0.0 and 0.0 are equal
    marked = own.select("vec_id", "label", F.when(fit, zero).alias("v"))
    # Equal vectors have equal pairs of 64-bit hashes.
    source = marked.select("vec_id", "label", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(17), "v").alias("h2")).where("v is not null")
    same = ("label", "dim", "h1", "h2")
    classes = materialise(source.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    bits, tables = hash_plan(largest, threshold)
    coded = materialise(_coded(_vectors(source, classes), bits, tables).join(classes.select("cls", "label", "dim"), "cls"))
    links = materialise(_links(source, classes, coded, bits, tables, threshold, block))
    comp = components(links.where("b is not null").select("a", "b"))
    degree = links.groupBy("a").agg(F.sum("n").alias("others"))
    placed = classes.join(degree, F.col("cls") == F.col("a"), "left").join(comp, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls"))
    placed = materialise(placed.select(*[F.col(c).alias(f"_{c}") for c in same], "rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "comp"))
    lowest = placed.groupBy(F.col("comp").alias("_c")).agg(F.min("rep").alias("low"))
    known = placed.join(lowest, F.col("comp") == F.col("_c")).select(*[f"_{c}" for c in same], "n_links", "low")
    every = marked.select("vec_id", "label", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(17), "v").alias("h2"), F.col("v").isNotNull().alias("fit"))
    met = every.join(known, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("fit"), "left")
    out = met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("fit"), F.col("low")).otherwise(F.col("vec_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _vectors(source: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, v) of the classes, from the source's rows: vectors are shuffled only if the classes are too many to broadcast."""
    wanted = classes.select("cls", "rep", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("label").alias("_label"))
    if classes.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    met = source.join(wanted, F.col("vec_id").eqNullSafe(F.col("rep")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("label") == F.col("_label")))
    return met.select("cls", "v")


def _coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(cls, signs): the packed signs of the classes' vectors; the tables' codes are their first bits."""
    count = max(LEAST_SIGNS, bits * tables)

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            out = [b""] * batch.num_rows
            for at, x in matrices(batch.column(1)):
                signs = np.packbits(unit(x) @ planes(x.shape[1], count).T > 0, axis=1)
                for k, one in zip(at.tolist(), signs):
                    out[k] = one.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["cls", "signs"])

    return vectors.mapInArrow(coded, "cls long, signs binary").dropDuplicates(["cls"])  # repeated rows


def _links(source: DataFrame, classes: DataFrame, coded: DataFrame, bits: int, tables: int, threshold: float, block: int) -> DataFrame:
    """(a, b, n): parts of class a's links to others, and a class of its local component or null."""
    kind = dict(coded.dtypes)["label"]
    most = most_signs(max(LEAST_SIGNS, bits * tables), threshold)

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            codes = _codes(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1), bits, tables)
            at = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            t = pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows))
            taken = batch.take(at)
            yield pa.RecordBatch.from_arrays([*taken.columns, t, pa.array(codes.ravel())], names=["cls", "signs", "label", "dim", "t", "code"])

    rows = coded.select("cls", "signs", "label", "dim").mapInArrow(spread, f"cls long, signs binary, label {kind}, dim int, t int, code long")
    large = materialise(rows.groupBy("label", "dim", "t", "code").agg(F.count("*").alias("size")).where(F.col("size") > block).select(*[F.col(c).alias(f"_{c}") for c in _BUCKET[:4]], F.ceil(F.col("size") / block).alias("blocks")))
    few = large.count() <= BROADCAST_ROWS
    on = F.lit(True)
    for c in _BUCKET[:4]:
        on = on & (F.col(c) == F.col(f"_{c}"))
    met = rows.join(F.broadcast(large) if few else large, on, "left")
    met = met.withColumn("mine", F.pmod(F.xxhash64("cls"), F.coalesce("blocks", F.lit(1)))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    met = met.select("label", "dim", "t", "code", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "signs")
    dealt = met.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)

    def meeting(table):
        """(codes, pairs that may be judged in this bucket) of a table's rows."""
        signs = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        may = np.ones((len(signs), len(signs)), bool)
        np.fill_diagonal(may, False)
        if table.column("i")[0] != table.column("j")[0]:  # pairs inside a block are judged where it meets itself
            mine = table.column("mine").to_numpy()
            may &= mine[:, None] != mine[None, :]
        codes = _codes(signs, bits, tables)
        for t in range(table.column("t")[0].as_py()):  # judged in an earlier table
            may &= codes[:, None, t] != codes[None, :, t]
        return signs, may

    def candidates(batches):
        """The rows of a bucket that have a pair to be judged in it."""
        import pyarrow as pa

        for table in _by_bucket(batches, _BUCKET):
            if table.num_rows < 2:
                continue
            signs, may = meeting(table)
            some = np.zeros(len(signs), bool)
            for a in range(0, len(signs), 256):
                apart = np.bitwise_count(signs[a : a + 256, None] ^ signs[None]).sum(axis=2, dtype=np.int32)
                some[a : a + 256] = (may[a : a + 256] & (apart <= most)).any(axis=1)
            if some.any():
                kept = table.filter(pa.array(some)).combine_chunks()
                yield from kept.select([*_BUCKET, "mine", "cls", "signs"]).to_batches()

    found = materialise(dealt.mapInArrow(candidates, f"label {kind}, dim int, t int, code long, i long, j long, mine long, cls long, signs binary"))
    wanted = materialise(classes.join(found.select(F.col("cls").alias("_w")).distinct(), F.col("cls") == F.col("_w"), "left_semi"))
    vectors = _vectors(source, wanted).select(F.col("cls").alias("_v"), "v").dropDuplicates(["_v"])
    counted = found.join(classes.select(F.col("cls").alias("_n"), "n"), F.col("cls") == F.col("_n"))
    whole = counted.join(vectors, F.col("cls") == F.col("_v")).select(*_BUCKET, "mine", "cls", "signs", "n", "v")
    whole = whole.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)

    def judged(batches):
        """Counts and local links of each bucket, or of each pair of its blocks."""
        import pyarrow as pa

        for table in _by_bucket(batches, _BUCKET):
            if table.num_rows < 2:
                continue
            _, may = meeting(table)
            (_, x), *_ = matrices(table.column("v").chunk(0))
            x = unit(x)
            near = (x @ x.T >= threshold) & may
            if not near.any():
                continue
            count = near @ table.column("n").to_numpy()
            cls = table.column("cls").to_numpy()
            low = _local(cls, near)
            at = np.flatnonzero(count)
            other = pa.array(low[at], mask=low[at] == cls[at])
            yield pa.RecordBatch.from_arrays([pa.array(cls[at]), other, pa.array(count[at])], names=["a", "b", "n"])

    return whole.mapInArrow(judged, "a long, b long, n long")
