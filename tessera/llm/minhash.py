"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature has SLOTS minima of its shingles' hashes, BITS bits of each.
Two texts are compared if their signatures differ in at most MOST_DIFFERENT
slots.  The signature is split in CHUNKS chunks: by the pigeonhole principle one
chunk then differs in at most MOST_DIFFERENT // CHUNKS slots, so each chunk is
indexed once for every set of slots that may be in error, and all pairs under
the distance share a key.  Links are confirmed on the full shingle sets.

Texts with equal sets are one class.  Classes that share a key are first linked
to the key's smallest class; what these links leave apart is then compared pair
by pair, so a group of copies costs a link a member and not a link a pair.  Of
those pairs only such are confirmed as can reach the similarity at all: sizes
and bit maps of the sets give bounds that hold for certain, so no pair under the
distance is lost.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import WordHashes, discard, map_rows, materialise, pick, scope
from tessera.llm.components import components

SHINGLE = 5
SLOTS, BITS, CHUNKS = 30, 16, 6
#: At a similarity of 0.75 a slot differs with a probability of 0.25: more than 17 of 30 differ in 5 of 100,000 pairs.
MOST_DIFFERENT = 17
PER_CHUNK = SLOTS // CHUNKS
IN_ERROR = MOST_DIFFERENT // CHUNKS
#: Bits of a set's map: the power of two from eight times its size on, within these. Maps of long texts are
#: fuller and let more pairs through to the confirmation; they lose none.
LEAST_MAP, MOST_MAP = 64, 1 << 15
#: Rows of a block; a bucket of more rows is dealt as pairs of blocks.
BLOCK = 1024
BROADCAST_ROWS = 20_000
#: Ids of candidates (8 bytes each) that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of texts that are signed together (a longer text alone), pairs compared together, rows held together.
TOGETHER, PAIRS, ROWS = 1 << 20, 200_000, 20_000

_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(SHINGLE)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingled(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` words from each place on."""
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += _mixed(h[i : i + n] + np.uint64(i)) * _POWERS[i]
    return _mixed(total)


def shingles(texts: list[bytes | None], words: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): sorted distinct 64-bit hashes of each text's five-word shingles, one text after another.

    A text with fewer words has one shingle of all of them, one without words none.
    """
    runs = [t.lower().split() if t else [] for t in texts]
    count = np.array([len(r) for r in runs], np.int64)
    h = np.fromiter(map(words.__getitem__, chain.from_iterable(runs)), np.uint64, int(count.sum()))
    first = np.cumsum(count) - count
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint64)
    place = np.arange(len(out)) - np.repeat(start, size) + np.repeat(first, size)
    full = np.repeat(count >= SHINGLE, size)
    if full.any():
        out[full] = _shingled(h, SHINGLE)[place[full]]
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        out[start[i]] = _shingled(h[first[i] : first[i] + count[i]], int(count[i]))[0]
    for a, b in zip(start.tolist(), (start + size).tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[start[size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[start + size] - kept[start]


def signatures(found: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(sets, SLOTS): the low BITS bits of each set's minima; ``start`` are the places of sets that are not empty."""
    out = np.empty((len(start), SLOTS), "<u2")
    for k in range(SLOTS):
        out[:, k] = np.minimum.reduceat(found * _SEEDS[k], start) & np.uint64(0xFFFF)
    return out


def bit_map(found: np.ndarray) -> bytes:
    """A set's map: a bit for each remainder of its hashes."""
    bits = min(MOST_MAP, max(LEAST_MAP, 1 << (8 * len(found) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[found & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def can_reach(x: int, x_bits: int, nx: int, y: int, y_bits: int, ny: int, percent: int) -> bool:
    """Whether sets with these maps (as numbers) and sizes can be so similar.

    A bit of one map that the other lacks stands for an element that the other
    lacks; a larger map is folded to the smaller one's bits, for which that holds too.
    """
    while x_bits > y_bits:
        x_bits >>= 1
        x = (x >> x_bits) | (x & ((1 << x_bits) - 1))
    while y_bits > x_bits:
        y_bits >>= 1
        y = (y >> y_bits) | (y & ((1 << y_bits) - 1))
    common = min(nx - (x & ~y).bit_count(), ny - (y & ~x).bit_count())
    return common * (100 + percent) >= percent * (nx + ny)


def keys(sig: np.ndarray) -> np.ndarray:
    """The index keys of signatures (n, SLOTS): for each chunk, its slots without each set of slots in error."""
    out = []
    chunked = sig.astype(np.uint64).reshape(len(sig), CHUNKS, PER_CHUNK)
    for c in range(CHUNKS):
        for e, kept in enumerate(combinations(range(PER_CHUNK), PER_CHUNK - IN_ERROR)):
            h = np.full(len(sig), c * 1000 + e + 1, np.uint64)
            for s in kept:
                h = _mixed((h << np.uint64(1)) + chunked[:, c, s] * _POWERS[1])
            out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def _together(texts: list[bytes | None]):
    """Bounds of parts of the texts with TOGETHER bytes at most, or of one text."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held + n > TOGETHER and i > start:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def _identities(found: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set that is not empty."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.add.reduceat(found, start).view(np.int64), np.add.reduceat(_mixed(found ^ _POWERS[2]), start).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1, h2 (the set's identity) and sig of every whole text; sig is null for an empty set."""

    def make():
        words = WordHashes()

        def step(cols):
            n, h1, h2, sig = [], [], [], []
            for a, b in _together(cols[2]):
                found, size = shingles(cols[2][a:b], words)
                some = np.flatnonzero(size)
                start = (np.cumsum(size) - size)[some]
                one, two = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                one[some], two[some] = _identities(found, start)
                made = [None] * (b - a)
                if len(some):
                    for i, s in zip(some, signatures(found, start)):
                        made[i] = s.tobytes()
                n.append(size)
                h1.append(one)
                h2.append(two)
                sig += made
            if not sig:
                return [[]] * 6
            return cols[0], cols[1], np.concatenate(n), np.concatenate(h1), np.concatenate(h2), sig

        return step

    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return map_rows(rows, make, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary")


def _again(docs: DataFrame, classes: DataFrame, wanted: DataFrame, make_value, kind: str) -> DataFrame:
    """(id, s): a value of the full shingle sets of the wanted classes, read again from a text of each.

    A class's text is found by its doc_id and the set's identity, as texts may
    share a doc_id.
    """

    def make():
        words = WordHashes()

        def step(cols):
            n, h1, h2, values = [], [], [], []
            for a, b in _together(cols[1]):
                found, size = shingles(cols[1][a:b], words)
                end = np.cumsum(size)
                some = np.flatnonzero(size)
                one, two = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                one[some], two[some] = _identities(found, (end - size)[some])
                n += size.tolist()
                h1 += one.tolist()
                h2 += two.tolist()
                values += [make_value(found[e - k : e]) for e, k in zip(end.tolist(), size.tolist())]
            return cols[0], n, h1, h2, values

        return step

    ids = classes.join(wanted.select(F.col("id").alias("_w")).distinct(), F.col("id") == F.col("_w"), "left_semi").select("id", "rep", "n", "h1", "h2")
    ids = materialise(ids)
    if ids.count() <= BROADCAST_IDS:  # else the texts are shuffled
        ids = F.broadcast(ids)
    texts = pick(docs, "doc_id", "text").where("text is not null")
    rows = texts.join(ids.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    again = map_rows(rows.select("doc_id", F.col("text").cast("binary").alias("text")), make, f"doc_id long, _n long, _h1 long, _h2 long, s {kind}")
    met = again.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return met.select("id", "s").dropDuplicates(["id"])  # repeated rows


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    sets = materialise(_again(docs, classes, ids, lambda s: s.view(np.int64), "array<bigint>"))
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b")
    found = materialise(met.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))
    discard(sets)
    return found


def _expanded(classes: DataFrame) -> DataFrame:
    """(key, ids of classes): every key of every class."""

    def make():
        def step(cols):
            if not cols[0]:
                return [], []
            sig = np.frombuffer(b"".join(cols[1]), "<u2").reshape(-1, SLOTS)
            k = keys(sig)
            return np.repeat(np.array(cols[0], np.int64), k.shape[1]), k.ravel()

        return step

    return map_rows(classes.select("id", "sig"), make, "id long, key long")


def _within(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' sizes allow the similarity and whose signatures lie within the distance."""

    def make():
        def step(cols):
            if not cols[0]:
                return [], []
            x, y = (np.frombuffer(b"".join(c), "<u2").reshape(-1, SLOTS) for c in cols[2:])
            ok = np.flatnonzero((x != y).sum(axis=1) <= MOST_DIFFERENT)
            return [cols[0][k] for k in ok], [cols[1][k] for k in ok]

        return step

    x = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    met = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return map_rows(met.select("a", "b", "sa", "sb"), make, "a long, b long")


def _closest(ids, comp, n, sig, percent: int):
    """(a, b): a forest of smallest distances over a bucket's components, by Prim's algorithm."""
    far = SLOTS + 1
    best, parent = np.full(len(ids), far), np.full(len(ids), -1)
    open_ = np.ones(len(ids), bool)
    for _ in range(len(ids)):
        v = int(np.where(open_, best, far + 1).argmin())
        open_[v] = False
        if 0 < best[v] <= MOST_DIFFERENT + 1:  # 0 stands for one component, others are raised by 1
            yield int(ids[parent[v]]), int(ids[v])
        d = (sig != sig[v]).sum(axis=1) + 1
        d[100 * np.minimum(n, n[v]) < percent * np.maximum(n, n[v])] = far
        d[comp == comp[v]] = 0
        nearer = open_ & (d < best)
        best[nearer], parent[nearer] = d[nearer], v


def _forests(held: dict, percent: int):
    """(a, b) of the forests of whole buckets."""
    bounds = np.flatnonzero(np.diff(held["bucket"], prepend=-1)).tolist()
    for a, b in zip(bounds, [*bounds[1:], len(held["bucket"])]):
        if b - a > 1 and (held["comp"][a:b] != held["comp"][a]).any():
            yield from _closest(*(held[c][a:b] for c in ("id", "comp", "n", "sig")), percent)


def _all_apart(held: dict, percent: int):
    """(a, b): all pairs of whole buckets in different components, within the distance, that can reach the similarity.

    Each pair where its first shared key is.
    """
    order = np.lexsort((held["n"], held["bucket"]))
    bucket, key, same, mine, ids, comp, n, sig = (held[c][order] for c in ("bucket", "key", "same", "mine", "id", "comp", "n", "sig"))
    own = keys(sig)
    maps: dict[int, int] = {}

    def as_number(k: int) -> int:
        if k not in maps:
            maps[k] = int.from_bytes(held["s"][order[k]], "little")
        return maps[k]

    reach = n * 100 // percent
    most = int(reach.max()) + 1
    end = np.searchsorted(bucket * most + n, bucket * most + reach, side="right")
    count = end - np.arange(len(n)) - 1
    until = np.cumsum(count)
    at = 0
    while at < len(n):
        before = int(until[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(until, before + PAIRS, side="right")))
        x = np.repeat(np.arange(at, stop), count[at:stop])
        y = np.arange(len(x)) - np.repeat(until[at:stop] - count[at:stop] - before, count[at:stop]) + x + 1
        at = stop
        ok = (comp[x] != comp[y]) & (same[x] | (mine[x] != mine[y]))
        x, y = x[ok], y[ok]
        ok = np.count_nonzero(sig[x] != sig[y], axis=1) <= MOST_DIFFERENT
        x, y = x[ok], y[ok]
        for k in range(0, len(x), PAIRS // 20):  # a pair's keys take 60 times its other numbers
            u, v = x[k : k + PAIRS // 20], y[k : k + PAIRS // 20]
            first = (own[u] == own[v]).argmax(axis=1)
            ok = own[u, first] == key[u]
            for a, b in zip(u[ok].tolist(), v[ok].tolist()):
                if can_reach(as_number(a), 8 * len(held["s"][order[a]]), int(n[a]), as_number(b), 8 * len(held["s"][order[b]]), int(n[b]), percent):
                    yield int(ids[a]), int(ids[b])


def _apart(rows: DataFrame, percent: int, closest: bool, block: int) -> DataFrame:
    """(a, b): pairs of a bucket that lie in different components, within the distance.

    ``rows``: key, id, comp, n, sig and, for all pairs, the bit map s.  With ``closest`` only a spanning forest of
    each bucket; else all, each written where its first shared key is.  A bucket
    of more than ``block`` rows is dealt as pairs of blocks, for the forest as
    blocks with their neighbours.
    """
    large = materialise(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > block).select(F.col("key").alias("_k"), F.ceil(F.col("c") / block).alias("blocks")))
    few = large.count() <= BROADCAST_ROWS
    spread = rows.join(F.broadcast(large) if few else large, F.col("key") == F.col("_k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    if closest:
        others = F.array_distinct(F.array("mine", (F.col("mine") + 1) % F.col("blocks"), F.pmod(F.col("mine") - 1, F.col("blocks"))))
    spread = spread.withColumn("other", F.explode(others))
    numbers = ("key", "i", "j", "mine", "id", "comp", "n")
    spread = spread.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "comp", "n", "sig", *([] if closest else ["s"]))
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        import pyarrow as pa

        def settle(table):
            held = {c: table.column(c).to_numpy() for c in numbers}
            held["bucket"] = np.cumsum(_new_bucket(held))
            held["same"] = held["i"] == held["j"]
            held["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, SLOTS)
            if closest:
                return _forests(held, percent)
            held["s"] = table.column("s").to_pylist()
            return _all_apart(held, percent)

        def _new_bucket(held):
            return np.concatenate([[False], (held["key"][1:] != held["key"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])])

        def whole_buckets():
            held, count = [], 0
            for batch in batches:
                for start in range(0, batch.num_rows, 4000):
                    held.append(batch.slice(start, 4000))
                    count += held[-1].num_rows
                    if count < ROWS:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks()
                    last = np.flatnonzero(_new_bucket({c: table.column(c).to_numpy() for c in ("key", "i", "j")}))
                    if len(last):
                        yield table.slice(0, int(last[-1]))
                        table = table.slice(int(last[-1]))
                    held, count = table.to_batches(), table.num_rows
            if count:
                yield pa.Table.from_batches(held).combine_chunks()

        def flush(out):
            a, b = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        out = []
        for table in whole_buckets():
            for a, b in settle(table):
                out.append((a, b) if a < b else (b, a))
                if len(out) >= 5000:
                    yield flush(out)
                    out = []
        if out:
            yield flush(out)

    return dealt.mapInArrow(run, "a long, b long")


def near_documents(docs: DataFrame, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash of every document.

    Links documents with 100 * intersection >= percent * union of their sets;
    null, empty and wordless texts have no shingles and link with nothing.
    Repeated rows link with each other, and the row of the smallest doc_id is
    kept (its repeats too, as they share that id).  Rows that share a doc_id but
    not the text are documents of their own.  A null doc_id is larger than all
    others: a group of such rows only has a null component_id, and all of them
    are kept.  text_hash (xxhash64 of the text) tells rows of one doc_id apart.
    Other columns are ignored, whatever their names.
    """
    with scope() as keep:
        return keep(_near_documents(docs, percent, block))


def _near_documents(docs: DataFrame, percent: int, block: int) -> DataFrame:
    rows = materialise(sketches(docs))
    grouped = rows.where("sig is not null").groupBy(F.col("n_shingles").alias("n"), "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialise(grouped.withColumn("id", F.monotonically_increasing_id()))
    index = _expanded(classes)
    shared = index.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low")).where("c > 1").select(F.col("key").alias("k"), "low")
    members = materialise(index.join(shared, F.col("key") == F.col("k")).select("key", "id", "low"))
    # First each class with the smallest of its buckets, then the closest across what is still apart.
    close = members.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    seen = materialise(_within(close, classes, percent))
    links = _confirmed(docs, classes, seen, percent)
    for closest in (True, False):
        comp = materialise(components(links))
        placed = members.join(comp, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"))
        signed = classes.select(F.col("id").alias("i"), "n", "sig")
        rest = materialise(placed.join(mixed, F.col("key") == F.col("k"), "left_semi").join(signed, F.col("id") == F.col("i")).select("key", "id", "comp", "n", "sig"))
        if not closest:
            rest = rest.join(materialise(_again(docs, classes, rest.select("id"), bit_map, "binary")), "id")
        found = materialise(_apart(rest, percent, closest, block).distinct().join(seen, ["a", "b"], "left_anti"))
        links = links.unionAll(_confirmed(docs, classes, found, percent))
        seen = seen.unionAll(found)
    placed = materialise(classes.join(components(links), F.col("id") == F.col("node"), "left").select("rep", F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("component", "id").alias("comp")))
    lowest = placed.groupBy(F.col("comp").alias("_c")).agg(F.min("rep").alias("low"))
    known = placed.join(lowest, F.col("comp") == F.col("_c")).select("_n", "_h1", "_h2", "low")
    out = rows.join(known, (F.col("n_shingles") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("sig").isNotNull(), "left")
    component = F.when(F.col("sig").isNotNull(), F.col("low")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
