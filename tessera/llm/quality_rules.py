"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document.  The ledger keeps the measurements
and one bit for each failed rule; policies are versioned sets of rules applied
to the stored bits, and ablations are bitwise aggregations of them, so neither
reads a text again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import map_rows, pick

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_POINTS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_top_word long"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the list."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + size - max(i, until)
            until = i + size
    return covered


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    ascii_upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    ascii_lower = len(text) - len(text.translate(None, bytes(range(97, 123))))
    return (
        len(words),
        len(text.translate(None, _NOT_POINTS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        ascii_upper,
        ascii_upper + ascii_lower,
        max(Counter(words).values(), default=0),
    )


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    """All rules; a bit keeps its meaning for ever. New rules take new bits."""
    c = F.col
    made = [
        ("too_few_words", c("n_words") < 10),
        ("repeated_windows", 100 * c("n_repeat_words") > 20 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("repeated_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        ("capitals", 2 * c("n_upper") > c("n_letters")),
        ("word_length", (c("word_chars") > 20 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        ("one_word", (c("n_words") >= 10) & (3 * c("n_top_word") > c("n_words"))),
    ]
    return [Rule(i, name, fails) for i, (name, fails) in enumerate(made)]


#: Versioned policies: the rules that reject. `base` comes first in each.
POLICIES = {
    1: ("too_few_words", "repeated_windows"),
    2: ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "capitals", "word_length", "one_word"),
}


def mask(names) -> int:
    return sum(1 << r.bit for r in rules() if r.name in names)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed`` bits of every whole text.

    A null or empty text has only zeros and fails ``too_few_words``.  Repeated
    rows give repeated rows; other columns are ignored.
    """
    own = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))

    def make():
        def step(cols):
            ids, texts = cols
            return [ids, *map(list, zip(*map(measure, texts)))] if texts else [[] for _ in range(10)]

        return step

    rows = map_rows(own, make, LEDGER)
    bits = [F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("failed", total.cast("long"))


def apply_policy(entries: DataFrame, version: int = 2) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame, version: int = 2) -> DataFrame:
    """For each rule of a policy: documents it rejects, and those that it alone rejects.

    One pass over the ledger's bits: counts by distinct bit pattern (at most
    2^rules rows after the map-side combine), then a row for each rule.
    """
    used = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])))
    patterns = entries.groupBy(used.alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in rules() if r.name in POLICIES[version]])
    each = patterns.select("bits", "n", F.explode(named).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(hit & (F.bit_count("bits") == 1), F.col("n")).otherwise(0)).alias("rejected_alone"),
    )
