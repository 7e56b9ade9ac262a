"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words.  The piece
probabilities are fitted by expectation-maximisation (forward-backward) on the
words of a bounded, keyed sample of each language's training rows.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import by_place, crc_mod, hash_fraction, map_rows, pick

#: Training rows that the fit sees at most, in expectation: in a language, and in all.
PER_LANGUAGE, IN_ALL = 300, 3000
ROUNDS = 3
CACHE_ENTRIES, CACHE_BYTES = 150_000, 1 << 25
FLOOR = 1e-9
#: Letters up to which a word's probability surely stays above the smallest number; longer words are rescaled at each letter.
UNSCALED = 24

# A letter, and the letters and marks that follow it.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_START = "▁"


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of letters and marks, in lower case; a word's first may carry the start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if piece == _START or regex.fullmatch(r"[\p{L}\p{M}]+", piece.removeprefix(_START)):
            found.add(piece)
    return sorted(found)


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters, each with the start mark."""
    return [_START + run for run in _LETTERS.findall(text.lower())] if text else []


class Segmenter:
    """Numbers of pieces in words: index len(pieces) is a single unknown letter, the next no piece.

    Pieces and the words' substrings meet by a 64-bit hash of their code points.
    """

    _STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        hashes = np.zeros(len(pieces), np.uint64)
        for i, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = ((h + ord(c) + 1) * int(self._STEP)) % (1 << 64)
                h ^= h >> 29
            hashes[i] = h
        self._order = np.append(np.argsort(hashes), self.none).astype(np.int32)
        self._hashes = np.append(np.sort(hashes), np.uint64(0))
        self._n = len(pieces)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._hashes[: self._n], h)
        return np.where(self._hashes[at] == h, self._order[at], np.int32(self.none))

    def ids(self, group: list[str], n: int) -> np.ndarray:
        """(words, n, longest): the piece that starts at each place with each length."""
        points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(group), n).astype(np.uint64) + np.uint64(1)
        out = np.full((len(group), n, min(self.longest, n)), self.none, np.int32)
        h = np.zeros((len(group), n), np.uint64)
        for k in range(out.shape[2]):
            h = (h[:, : n - k] + points[:, k:]) * self._STEP
            h ^= h >> np.uint64(29)
            out[:, : n - k, k] = self._find(h)
        out[:, :, 0] = np.where(out[:, :, 0] == self.none, self.unknown, out[:, :, 0])
        return out

    def by_length(self, found: list[str]):
        """(length, places of words of it), a bounded number of letters together."""
        groups: dict[int, list[int]] = {}
        for at, w in enumerate(found):
            groups.setdefault(len(w), []).append(at)
        for n, at in groups.items():
            step = max(1, min(4096, 100_000 // n))
            for k in range(0, len(at), step):
                yield n, at[k : k + step]


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(words, languages): log-probabilities of the words, summed over all their segmentations. p: (pieces + 2, languages).

    Only the sums of prefixes that a piece can still continue are kept.
    """
    m, n, longest = ids.shape
    ahead = np.zeros((m, longest + 1, p.shape[1]))  # sums of the prefixes that end at this letter and the next ones
    ahead[:, 0] = 1
    logs = np.zeros((m, p.shape[1]))
    for i in range(n):
        if n > UNSCALED:
            scale = ahead.max(axis=1)
            ahead /= scale[:, None]
            logs += np.log(scale)
        k = min(longest, n - i)
        here = ahead[:, :1] * p[ids[:, i, :k]]
        ahead[:, :-1] = ahead[:, 1:]
        ahead[:, -1] = 0
        ahead[:, :k] += here
    return logs + np.log(ahead[:, 0])


def _expected(ids: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected numbers of pieces in the words, for one language, by logarithms forward and backward."""
    m, n, longest = ids.shape
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    before, after = np.full((m, n + 1), -np.inf), np.full((m, n + 1), -np.inf)
    before[:, 0] = after[:, n] = 0
    for i in range(n):
        k = min(longest, n - i)
        before[:, i + 1 : i + 1 + k] = np.logaddexp(before[:, i + 1 : i + 1 + k], before[:, i : i + 1] + logs[ids[:, i, :k]])
    counts = np.zeros(len(p))
    for i in range(n - 1, -1, -1):
        k = min(longest, n - i)
        each = logs[ids[:, i, :k]] + after[:, i + 1 : i + 1 + k]
        after[:, i] = np.logaddexp.reduce(each, axis=1)
        share = np.exp(each + before[:, i : i + 1] - before[:, n:]) * weight[:, None]
        counts += np.bincount(ids[:, i, :k].ravel(), share.ravel(), minlength=len(p))
    return counts


class Model:
    def __init__(self, pieces: list[str], languages: list[str], seen: dict[str, tuple[list[str], np.ndarray]]):
        self.pieces, self.languages = pieces, languages
        segment = Segmenter(pieces)
        size = len(pieces) + 2
        table = np.empty((size, len(languages)))
        for column, lang in enumerate(languages):
            found, n = seen[lang]
            groups = [(segment.ids([found[i] for i in at], length), n[at]) for length, at in segment.by_length(found)]
            counts = np.ones(size)  # from the pieces' plain occurrences
            for ids, weight in groups:
                counts += np.bincount(ids.ravel(), np.broadcast_to(weight[:, None, None], ids.shape).ravel().astype(float), minlength=size)
            p = self._normed(counts)
            for _ in range(ROUNDS):
                counts = np.full(size, 0.1)
                for ids, weight in groups:
                    counts += _expected(ids, weight, p)
                p = self._normed(counts)
            table[:, column] = p
        self.table = table

    def _normed(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.copy()
        counts[-1] = 0
        p = np.maximum(counts / counts.sum(), FLOOR)
        p[-1] = 0
        return p


class Scorer:
    """Log-probabilities of runs of non-space bytes, for each language, kept for a bounded number of runs."""

    def __init__(self, model: Model):
        self.model, self.segment = model, Segmenter(model.pieces)
        self._reset()

    def _reset(self):
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1))  # the last column counts the letters' runs
        self.used = self.held = 0

    def _learn(self, runs: list[bytes]) -> None:
        found, owner = [], []
        for k, run in enumerate(runs):
            for w in words(run.decode(errors="replace")):
                found.append(w)
                owner.append(k)
        logs = np.zeros((len(found), self.rows.shape[1]))
        for n, at in self.segment.by_length(found):
            ids = self.segment.ids([found[i] for i in at], n)
            logs[at, :-1] = forward(ids, self.model.table)
        logs[:, -1] = 1
        need = self.used + len(runs)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, len(self.rows)), self.rows.shape[1]))])
        np.add.at(self.rows, self.used + np.array(owner, np.int64), logs)
        self.at.update(zip(runs, range(self.used, need)))
        self.used = need
        self.held += sum(map(len, runs))

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        lang, score = [], []
        for start in range(0, len(texts), 200):
            part = [(t.lower().split() if t else []) for t in texts[start : start + 200]]
            new = list(set().union(*part) - self.at.keys())
            if self.used and (self.used + len(new) > CACHE_ENTRIES or self.held > CACHE_BYTES):
                self._reset()
                new = list(set().union(*part))
            if new:
                self._learn(new)
            for runs in part:
                total = self.rows[np.fromiter(map(self.at.__getitem__, runs), np.int64, len(runs))].sum(axis=0)
                if not total[-1] or not self.model.languages:
                    lang.append("und")
                    score.append(0.0)
                    continue
                odds = np.exp(total[:-1] - total[:-1].max())
                best = int(odds.argmax())
                lang.append(self.model.languages[best])
                score.append(float(odds[best] / odds.sum()))
        return lang, score


def fit(docs: DataFrame, vocabulary_path: str, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Learns from text and lang of rows whose crc32(doc_id) mod 4 is not 2.

    The rows of each language are counted over all documents; about
    ``per_language`` of each (fewer where there are many languages) are chosen by
    a hash of the key, and only their words reach the driver.
    """
    own = pick(docs, "doc_id", "lang", "text")
    train = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for a language
    if not sizes:
        return Model([], [], {})
    most = max(1, min(per_language, in_all // len(sizes)))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, most / n)))])
    chosen = train.where(hash_fraction(F.col("doc_id"), 2) < F.element_at(share, F.col("lang"))).select("lang", F.col("text"))

    def make():
        def step(cols):
            from collections import Counter

            seen: dict[str, Counter] = {}
            for lang, text in zip(*cols):
                seen.setdefault(lang, Counter()).update(words(text))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            return list(zip(*rows)) if rows else [[], [], []]

        return step

    counted = map_rows(chosen, make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    seen: dict[str, tuple[list[str], list[int]]] = {}
    for lang, word, n in sorted(zip(*(got.column(i).to_pylist() for i in range(3)))):
        found = seen.setdefault(lang, ([], []))
        found[0].append(word)
        found[1].append(n)
    return Model(vocabulary(vocabulary_path), sorted(seen), {k: (w, np.array(n, float)) for k, (w, n) in seen.items()})


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    ``und`` with score 0 where the text is null or has no letter (or nothing was
    learned); else the likeliest language and its share of the probability.
    Repeated rows give repeated rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary by languages

    def make():
        scorer = Scorer(shared.value)

        def step(cols):
            lang, score = scorer(cols[1])
            return cols[0], cols[2], lang, score

        return step

    rows = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def confident(docs: DataFrame, model: Model, sure: float) -> DataFrame:
    """The rows of ``docs``, in all their columns, whose likeliest language has ``sure`` of the probability.

    Texts that are null or have no letter go.  A filter in place: nothing is
    joined back, repeated rows and other columns, whatever their names, pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    placed, _, back = by_place(docs)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # few texts at a time as Python's own
                part = batch.slice(start, 500)
                lang, score = scorer(part.column(place).cast(pa.binary()).to_pylist())
                yield part.filter(pa.array([one != "und" and s >= sure for one, s in zip(lang, score)], pa.bool_()))

    return placed.mapInArrow(run, placed.schema).select(*back)
