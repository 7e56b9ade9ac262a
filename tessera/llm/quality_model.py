"""A quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed: of one to three bytes, and of one and
two words.  Each is scaled by its class log-count ratio, and a linear hinge-loss
model is fitted to the scaled vectors by dual coordinate descent; a logistic link
through held-in margins turns margins into scores.  The model is fitted on a
bounded, keyed sample of labelled rows (``sample`` rows of FIT_BYTES at most),
the scores cover every whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import WordHashes, crc_mod, hash_fraction, map_rows, materialise, pick

#: Labelled rows that the fit sees at most, in expectation, chosen by a hash of the key; and bytes of such a row's text.
SAMPLE, FIT_BYTES = 5000, 1 << 16
#: Hashed n-grams are told apart by so many bits.
SPACE_BITS = 20
SPACE = 1 << SPACE_BITS
_A, _LONG = np.uint32(2654435761), np.uint64(0x9E3779B97F4A7C15)
_SHIFT, _LONG_SHIFT = np.uint32(32 - SPACE_BITS), np.uint64(64 - SPACE_BITS)


def ngrams(text: bytes | None, words: dict) -> np.ndarray:
    """The hashed n-grams in a text, as sorted distinct numbers below SPACE.  ``words`` gives words' hashes."""
    if not text:
        return np.empty(0, np.int32)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    # The number of bytes stands above them, so that grams of different lengths differ.
    grams = np.concatenate([b | np.uint32(1 << 24), two | np.uint32(2 << 24), three | np.uint32(3 << 24)]) * _A >> _SHIFT
    run = text.lower().split()
    h = np.fromiter(map(words.__getitem__, run), np.uint64, len(run)) * _LONG
    pairs = (h[:-1] ^ (h[1:] >> np.uint64(7))) * _LONG
    return np.unique(np.concatenate([grams, (h >> _LONG_SHIFT).astype(np.uint32), (pairs >> _LONG_SHIFT).astype(np.uint32)])).astype(np.int32)


def labelled(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, sample: int, seed: int, longest: int | None = None) -> DataFrame:
    """(k, text, y): a keyed sample of about ``sample`` labelled rows outside the held-out fold, written once.

    The labels' size is counted, not collected; the sample's keys are bounded by
    ``sample`` and may therefore be broadcast to the texts.  A key labelled more
    than once has its largest label.  k follows from key and text alone: what
    depends on an order of the rows takes that of k.  With ``longest`` only
    texts of so many bytes.
    """
    known = pick(labels, "doc_id", y=target).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    n = known.count()
    chosen = known.where(hash_fraction(F.col("doc_id"), seed) < F.lit(min(1.0, sample / max(n, 1)))).groupBy(F.col("doc_id").alias("_k")).agg(F.max("y").alias("y"))
    own = pick(docs, "doc_id", "text")
    if longest:
        own = own.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    met = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_k"))
    return materialise(met.select(F.xxhash64("doc_id", "text", F.lit(seed)).alias("k"), F.col("text").cast("binary").alias("text"), F.col("y").cast("int").alias("y")))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: float = 1.0, epochs: int = 15, seed: int = 5) -> np.ndarray:
    """Weights (dim) of an L2-regularised hinge-loss model over sparse rows (index, value), by dual coordinate descent."""
    w, alpha = np.zeros(dim), np.zeros(len(rows))
    square = np.array([float((v * v).sum()) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            if square[i] == 0:
                continue
            gradient = y[i] * float(w[at] @ value) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * value
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_link(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic curve through margins and 0/1 labels, by Newton's method."""
    hit = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y == 1, *hit)
    scale = float(np.abs(margin).mean()) or 1.0  # unit-free steps
    x = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (t - p) - 1e-6 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


class NbSvm:
    """A margin is the sum of the weights of a text's n-grams, each times its log-count ratio, over the ratios' norm, plus a bias.

    gain (weight times ratio) and square (of the ratio) hold that for every n-gram.
    """

    def __init__(self, found: list[np.ndarray], y: np.ndarray):
        y = np.asarray(y)
        if len(y) == 0 or y.min() == y.max():  # one class: its share, smoothed
            self.gain, self.square, self.bias = np.zeros(SPACE, np.float32), np.ones(SPACE, np.float32), 0.0
            share = (y.sum() + 1) / (len(y) + 2)
            self.slope, self.shift = 0.0, float(np.log(share / (1 - share)))
            return
        # Margins for the link come from models that did not see the row.
        fold, margins = np.arange(len(y)) % 3, np.zeros(len(y))
        for k in range(3):
            part = np.flatnonzero(fold != k)
            if y[part].min() == y[part].max():
                continue
            self._fit([found[i] for i in part], y[part])
            for i in np.flatnonzero(fold == k):
                margins[i] = self.margin(found[i])
        self._fit(found, y)
        self.slope, self.shift = logistic_link(margins, y)

    @staticmethod
    def ratios(found, y) -> np.ndarray:
        """Log-count ratios of the n-grams: shares of the classes' rows that hold them, smoothed by one."""
        counts = [np.bincount(np.concatenate([f for f, label in zip(found, y) if (label == 1) == positive]), minlength=SPACE) + 1.0 for positive in (False, True)]
        return np.log(counts[1] / ((y == 1).sum() + 2)) - np.log(counts[0] / ((y != 1).sum() + 2))

    def _fit(self, found, y):
        ratio = self.ratios(found, y)

        def scaled(f):
            v = ratio[f]
            return v / (np.sqrt((v * v).sum()) or 1.0)

        w = dual_descent([(np.append(f, SPACE), np.append(scaled(f), 1.0)) for f in found], np.where(y == 1, 1.0, -1.0), SPACE + 1)
        self.gain, self.square, self.bias = (w[:SPACE] * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(w[SPACE])

    def margin(self, f: np.ndarray) -> float:
        norm = np.sqrt(self.square[f].sum(dtype=np.float64))
        return float(self.gain[f].sum(dtype=np.float64) / norm) + self.bias if norm else self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NbSvm:
    """Learns ``quality`` from rows whose crc32(doc_id) mod 5 is not 0."""

    def make():
        words = WordHashes()

        def step(cols):
            return cols[0], [ngrams(t, words) for t in cols[1]], cols[2]

        return step

    rows = map_rows(labelled(docs, labels, "quality", 5, 0, sample, 6, FIT_BYTES), make, "k long, f array<int>, y int")
    got = rows.toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    return NbSvm([f.values.to_numpy() for f in got.column("f")], got.column("y").to_numpy())


def quality_scores(docs: DataFrame, model: NbSvm, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts get the model's score of no features.  Repeated rows
    give repeated rows; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of SPACE numbers

    def make():
        m, words = shared.value, WordHashes()

        def step(cols):
            scores = [m.score(ngrams(t, words)) for t in cols[1]]
            return cols[0], cols[2], scores, [int(s >= threshold) for s in scores]

        return step

    rows = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")
