"""Best-two-fit packing of token sequences.

Piece lengths are whole numbers up to the sequence length, so packing is planned
on their histogram, which has at most that many rows whatever the corpus, and
carried out by joining each piece's rank among those of its length to the plan.
Bins are filled greedily with the longest piece that fits; then the bin's
smallest piece gives way to two unpacked ones when they fill the gap more
tightly.  A bin's pattern is repeated for as long as the histogram lasts, so the
plan's size depends on the number of lengths and not on the number of pieces.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._shared import map_rows, materialise, pick, spread_ranks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of a generation of a worker's cache.
CACHE_ENTRIES = 500_000
_LE = array("I", [1]).tobytes()[0] == 1


def _packed(ids) -> bytes:
    a = array("I", ids)
    if not _LE:
        a.byteswap()
    return a.tobytes()


class Recent(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, bound: int, longest: int = 64):
        super().__init__()
        self._make, self._bound, self._longest, self._old = make, bound, longest, {}

    def __missing__(self, key: bytes):
        got = self._old.get(key)
        if got is None:
            got = self._make(key)
        if len(key) <= self._longest:
            if len(self) >= self._bound:
                self._old = dict(self)
                self.clear()
            self[key] = got
        return got


class ByteEncoder:
    """Token ids, as little-endian unsigned 32-bit numbers, of a byte-level BPE file.

    A space before a character other than white space always starts a pre-token
    of this family, so a text is cut at its spaces and the pieces' ids are kept
    in a bounded cache.  Texts with white space after a space, with special
    strings or with white space outside ASCII go to the tokenizer whole.
    """

    _ODD = tuple(b" " + c for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + (b"<|", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")

    #: ASCII marks other than the apostrophe, which may start a pre-token of letters.
    _MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, bound: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(path)
        self._all.no_truncation()
        self._all.no_padding()
        self._model = self._all.model
        # The family's printable stand-ins for bytes: visible Latin-1 characters stay, the rest follow from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self._shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}
        # Ids of runs after a space, and of runs at the start of a line or after letters.
        self._cache = Recent(lambda run: self._ids(run, b" "), bound)
        self._bare = Recent(lambda run: self._ids(run, b""), bound // 4)
        self._newline = self.whole(b"\n")

    def whole(self, text: bytes) -> bytes:
        return _packed(self._all.encode(text.decode(), add_special_tokens=False).ids)

    def _ids(self, run: bytes, before: bytes) -> bytes:
        """Ids of a run without spaces, cut further where a pre-token surely ends."""
        known = self._cache if before else self._bare
        head, mark, tail = run.partition(b"\n")
        if mark and head and tail and not head[-1:].isspace() and not tail[:1].isspace():  # one line feed between others
            return known[head] + self._newline + self._bare[tail]
        word = run.rstrip(self._MARKS)
        text = word.decode(errors="replace")
        if text.isalpha() and max(text) < "\u0250":
            if len(word) < len(run):  # letters, then marks
                return known[word] + self._bare[run[len(word) :]]
            return _packed([t.id for t in self._model.tokenize((before + word).decode("latin-1").translate(self._shown))])
        return self.whole(before + run)

    def __call__(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if text[-1:] == b" " or any(odd in text for odd in self._ODD):
            return self.whole(text)
        first, *rest = text.split(b" ")
        return (self._bare[first] if first else b"") + b"".join(map(self._cache.__getitem__, rest))


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text; with their ids (packed bytes) if asked for."""
    own = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    end = _packed([end_id])

    def make():
        encode = ByteEncoder(tokenizer)

        def step(cols):
            out = [[] for _ in range(6)]
            for doc_id, text in zip(*cols):
                ids = encode(text) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    own_ids = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(own_ids), own_ids)):
                        column.append(value)
            return out if with_ids else out[:5]

        return step

    return map_rows(own, make, PIECES + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths in a bin) that use up the histogram, by best-two-fit."""
    left = {k: int(v) for k, v in histogram.items() if v > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: dict[int, int] = {}
        free = lambda k: left[k] - used.get(k, 0)
        gap, filled = size, []
        at = len(lengths)
        while gap and (at := bisect_right(lengths, gap, 0, at)):  # greedy: the longest that fits, again and again
            k = lengths[at - 1]
            n = min(free(k), gap // k)
            if n:
                filled += [k] * n
                used[k] = used.get(k, 0) + n
                gap -= k * n
            at -= 1
        if gap and filled:  # the smallest gives way to two that fit its place and the gap more tightly
            small = filled[-1]
            room, best = small + gap, (small, None)
            hi = bisect_right(lengths, room) - 1
            lo = 0
            while lo <= hi:
                a, b = lengths[lo], lengths[hi]
                if a + b > room:
                    hi -= 1
                    continue
                two = free(a) > 1 if a == b else free(a) > 0 and free(b) > 0
                if two and a + b > best[0]:
                    best = (a + b, (a, b))
                    if a + b == room:
                        break
                if free(b) <= 0:
                    hi -= 1
                else:
                    lo += 1
            if best[1]:
                filled.pop()
                used[small] -= 1
                for k in best[1]:
                    used[k] = used.get(k, 0) + 1
                    insort(filled, k)
                filled.sort(reverse=True)
        times = min(left[k] // n for k, n in used.items() if n)
        out.append((times, filled))
        for k, n in used.items():
            left[k] -= n * times
        if any(not left[k] for k in used):
            lengths = [k for k in lengths if left[k]]
    return out


def plan_rows(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, place among equals in the bin and step, offset) runs.

    Rank r of a length in a run [lo, lo+times) of one place of a bin's pattern
    goes to sequence first + (r - lo) at that place's offset.
    """
    taken: dict[int, int] = {}
    sequence, rows = 0, []
    for times, filled in plan(histogram, size):
        offset = 0
        for k in filled:
            lo = taken.get(k, 0)
            rows.append((k, lo, lo + times, sequence, offset))
            taken[k] = lo + times
            offset += k
        sequence += times
    return rows


def pack(cut_pieces: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces with sequence_id and offset: gapless, at most ``size`` tokens in a sequence.

    Needs doc_id, piece and length (1 to ``size``); keeps other columns.  Ties
    are broken by doc_id and piece; equal rows share their places in any order.
    An empty input gives an empty result.
    """
    spark = cut_pieces.sparkSession
    kept = materialise(cut_pieces)
    histogram = {r[0]: r[1] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    total = sum(histogram.values())
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_len", "_lo", "_hi", "_seq", "_off")])
    runs = spark.createDataFrame(plan_rows(histogram, size), schema)
    # Ranks: an equal share of each length falls to each chunk of keys, a few thousand pieces wide.
    chunks = max(1, min(1 << 20, total // 4000))
    chunk = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks))
    ranked = spread_ranks(kept, ["length"], ["doc_id", "piece"], F.lit(1), "_rank", chunk)
    # Runs of a length are consecutive in rank: meet in cells of 2^k ranks, then compare.
    cell = max(12, (total // 20000).bit_length())
    spread = runs.withColumn("_cell", F.explode(F.sequence(F.shiftright("_lo", cell), F.shiftright(F.col("_hi") - 1, cell))))
    met = ranked.withColumn("_cell0", F.shiftright("_rank", cell)).join(
        F.broadcast(spread) if len(histogram) <= size else spread,
        (F.col("length") == F.col("_len")) & (F.col("_cell0") == F.col("_cell")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")),
    )
    return met.select(*cut_pieces.columns, (F.col("_seq") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), F.col("_off").alias("offset"))
