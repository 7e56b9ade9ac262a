"""Token counts by a two-tier lookup of pre-token lengths.

Tier one is a table of the corpus's most frequent pre-tokens, built from
mergeable frequency summaries of *all* rows and broadcast; its size is bounded
by ``hot_entries``.  Tier two is each worker's bounded cache of what the table
lacks, filled through the tokenizer itself.  Pre-tokens are never shuffled: the
summaries travel as one row for each task.

A pre-token here is a run between ASCII white space.  The tokenizer drops white
space and never joins text across it, so the counts of the runs add up to the
count of the text, special strings included (they hold no white space).
"""

from __future__ import annotations

import pickle
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import map_rows, pick

#: Entries of the broadcast table and of each summary: a fixed bound, about 8 MB.
HOT_ENTRIES = 65536
SUMMARY_ENTRIES = 16384
#: Entries of a worker's cache before it starts over.
CACHE_ENTRIES = 400_000


def runs(text: bytes | None) -> list[bytes]:
    """The pre-tokens, in lower case where that is the tokenizer's own first step.

    Special strings are matched before lower-casing, so a text that could hold
    (or, lower-cased, come to hold) one is left as it is.
    """
    if not text:
        return []
    return (text if b"<|" in text else text.lower()).split()


def merge_summary(into: Counter, more, capacity: int) -> Counter:
    """Misra-Gries merge: add, then subtract the (capacity+1)-th count and drop what falls to 0."""
    into.update(more)
    if len(into) > capacity:
        cut = sorted(into.values(), reverse=True)[capacity]
        into = Counter({k: v - cut for k, v in into.items() if v > cut})
    return into


def _summaries(docs: DataFrame) -> DataFrame:
    """One row for each task: its pickled summary, keyed for a two-level merge."""

    def run(batches):
        import pyarrow as pa

        kept: Counter = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                fresh: Counter = Counter()
                for text in batch.column(0).slice(start, 2000).to_pylist():
                    fresh.update(runs(text))
                kept = merge_summary(kept, fresh, SUMMARY_ENTRIES)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(kept))], pa.binary())], names=["summary"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "summary binary")


def _merged(summaries: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kept: Counter = Counter()
        for batch in batches:
            for one in batch.column(0):
                kept = merge_summary(kept, pickle.loads(one.as_py()), SUMMARY_ENTRIES)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(kept))], pa.binary())], names=["summary"])

    return summaries.mapInArrow(run, "summary binary")


def frequent_runs(docs: DataFrame, entries: int = HOT_ENTRIES) -> list[bytes]:
    """The most frequent pre-tokens of the whole corpus.

    Summaries of all tasks are merged on the executors down to at most sixteen
    bounded rows, which alone reach the driver.
    """
    kept: Counter = Counter()
    for row in _merged(_summaries(docs).repartition(16)).toLocalIterator():
        kept = merge_summary(kept, pickle.loads(bytes(row[0])), entries)
    return [k for k, _ in sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:entries]]


class Lengths(dict):
    """Lengths of pre-tokens: the hot table, and besides it two bounded generations of what was asked for."""

    def __init__(self, hot: dict[bytes, int], encode_length, bound: int = CACHE_ENTRIES):
        super().__init__(hot)
        self._hot, self._length, self._bound, self._old = hot, encode_length, bound, {}

    def __missing__(self, run: bytes) -> int:
        n = self._old.get(run)
        if n is None:
            n = self._length(run.decode())
        if len(run) <= 64:
            if len(self) >= self._bound + len(self._hot):
                self._old = dict(self)
                self.clear()
                self.update(self._hot)
            self[run] = n
        return n


def load(path: str):
    """A function from a text to its number of tokens, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    bare = model.model.tokenize

    def length(text: str) -> int:
        if text.isascii() and text.isalpha() and text.islower():  # a single pre-token, its bytes standing for themselves
            return len(bare(text))
        return len(model.encode(text, add_special_tokens=False).ids)

    return length


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, entries: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    ``tokenizer`` is a file whose model drops white space and keeps words apart
    (word-level BPE).  A null text counts as empty: 0 bytes, 0 tokens, not over
    the limit.  Repeated rows give repeated rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = pick(docs, "doc_id", "text")
    words = frequent_runs(own, entries)
    length = load(tokenizer)
    hot = spark.sparkContext.broadcast({w: length(w.decode()) for w in words})

    def make():
        lengths = Lengths(hot.value, load(tokenizer))
        get = lengths.__getitem__

        def step(cols):
            ids, texts = cols
            counts = [sum(map(get, runs(t))) for t in texts]
            return ids, [len(t) if t else 0 for t in texts], counts, [n > limit for n in counts]

        return step

    rows = own.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
