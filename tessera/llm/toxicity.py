"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

The lexicon is learned from the labelled sample by log-odds of document counts
and completed by a short fixed list.  Features are densities of the lexicon in
plain and in obfuscated spelling, its distance to second-person words, capitals,
punctuation and obfuscation rates.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import crc_mod, map_rows, pick
from tessera.llm.quality_model import labelled

#: Labelled rows that the fit sees at most, in expectation; chosen by a hash of the key.
SAMPLE = 8000
#: Toxic texts of the sample that a word of the lexicon is in at least: so the sample bounds the lexicon.
LEAST_TEXTS = 5

# Insults of everyday use and second-person words of four languages.
INSULTS = "idiot stupid moron loser scum trash pathetic worthless disgusting clown dumb jerk imbecile idiota estupido imbécile connard idioten dumm"
SECOND = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes ti tus vosotros"
# Characters that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""}

_PLAIN = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-*_]){2,}[^\W\d_](?!\w)")
_UPPER, _SHOUTED = regex.compile(r"\p{Lu}"), regex.compile(r"\b\p{Lu}{3,}\b")
_ASCII_UPPER = bytes(range(65, 91))
_TABLE = str.maketrans(STAND_INS)
_SECOND = frozenset(SECOND.split())
_INSULTS = frozenset(INSULTS.split())
_HIDING = "0123456789@$*"
_NOT_HIDING = {ord(c): None for c in _HIDING}

FEATURES = ("hits", "hit_rate", "strong_rate", "distinct", "weight", "hidden", "hidden_rate", "second_rate", "near", "near_strong", "capitals", "capital_words", "marks", "exclaims", "stars", "odd_words", "repeats", "log_words")


def hidden_words(text: str) -> tuple[list[str], int]:
    """Words read through stand-ins and spacing (w0rd, w*rd, w.o.r.d, w o r d), and how many mix letters with stand-ins."""
    found, odd = [], 0
    if len(text.translate(_NOT_HIDING)) < len(text):
        for w in text.split():
            if any(c in w for c in _HIDING) and any(map(str.isalpha, w)):
                odd += 1
                found.append(w.strip(".,;:!?\"'()").lower().translate(_TABLE))
    found += [re.sub(r"[^\w]|_", "", m.group()).lower() for m in _SPACED.finditer(text)]
    return found, odd


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The FEATURES of a whole text; zeros for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    words = _PLAIN.findall(text.lower())
    n, kinds = max(1, len(words)), set(words)
    known = kinds & lexicon.keys()
    hits = [(i, w) for i, w in enumerate(words) if w in known] if known else []
    strong = [i for i, w in hits if lexicon[w] >= 3 or w in _INSULTS]
    spelled, odd = hidden_words(text)
    hidden = [w for w in spelled if w in lexicon or w in _INSULTS]
    second = [i for i, w in enumerate(words) if w in _SECOND] if kinds & _SECOND else []
    near = near_strong = 0
    if second and hits:
        at = np.array(second)
        for i, w in hits:
            k = int(np.searchsorted(at, i))
            gap = min(abs(int(at[j]) - i) for j in (k - 1, k) if 0 <= j < len(at))
            near += gap <= 5
            near_strong += gap <= 5 and lexicon[w] >= 3
    letters = sum(map(len, words)) or 1
    raw = text.encode()
    upper = len(raw) - len(raw.translate(None, _ASCII_UPPER)) if len(raw) == len(text) else len(_UPPER.findall(text))
    marks = len(raw) - len(raw.translate(None, b"!?.,;:"))
    exclaims = raw.count(b"!")
    stars = len(raw) - len(raw.translate(None, b"*#@$%"))
    shouted = len(_SHOUTED.findall(text)) if upper > 2 else 0
    return [
        float(len(hits)), len(hits) / n, len(strong) / n, float(len(known)), sum(lexicon[w] for _, w in hits), float(len(hidden)), len(hidden) / n, len(second) / n,
        float(near), float(near_strong), upper / letters, shouted / n, marks / n, exclaims / n, stars / n, odd / n, 1 - len(kinds) / n, float(np.log1p(len(words))),
    ]


def learn_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Words by log-odds of their document counts (word, in toxic, in clean): all that surely tell; the fixed list always counts."""
    found = {w: 3.0 for w in _INSULTS}
    for word, t, c in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        sure = odds - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))  # lower bound of its interval
        if t >= LEAST_TEXTS and sure > 1:
            found[word] = float(odds)
    return found


class Trees:
    """Boosted regression trees on quantile bins, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: int = 8):
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, 33)[1:-1])) if len(col) else np.empty(0) for col in x.T]
        binned = self._bins(x)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start, self.rate, self.trees = float(np.log(share / (1 - share))), rate, []
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: dict[int, tuple] = {}
            node = np.zeros(len(y), int)
            for at in range(2**depth - 1):
                rows = np.flatnonzero(node == at)
                split = self._best(binned[rows], g[rows], h[rows], least) if len(rows) >= 2 * least else None
                if split:
                    tree[at] = split
                    node[rows] = 2 * at + 1 + (binned[rows, split[0]] > split[1])
            leaves = {int(k): float(g[node == k].sum() / (h[node == k].sum() + 1)) for k in np.unique(node)}
            self.trees.append((tree, leaves, depth))
            f += rate * np.array([leaves[k] for k in node])

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, col, side="left") for e, col in zip(self.edges, x.T)], axis=1) if len(x) else np.empty((0, len(self.edges)), int)

    @staticmethod
    def _best(b, g, h, least):
        best, total_g, total_h = (1e-6, None), g.sum(), h.sum()
        base = total_g**2 / (total_h + 1)
        for k in range(b.shape[1]):
            cg, ch, cn = (np.cumsum(np.bincount(b[:, k], w, minlength=33))[:-1] for w in (g, h, np.ones(len(g))))
            gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - base
            gain[(cn < least) | (len(g) - cn < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (k, at))
        return best[1]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        f = np.full(len(x), self.start)
        for tree, leaves, depth in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(depth):
                for at, (k, cut) in tree.items():
                    rows = node == at
                    if rows.any():
                        node[rows] = 2 * at + 1 + (b[rows, k] > cut)
            f += self.rate * np.array([leaves.get(int(k), 0.0) for k in node])
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, values) of the rising step function closest to y over x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, last x
    for xi, yi in zip(x[order], y[order]):
        blocks.append([float(yi), 1.0, float(xi)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][2] == blocks[-1][2]):
            m, n, last = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * n) / (blocks[-1][1] + n), blocks[-1][1] + n, last]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray):
        self.lexicon = lexicon
        self.trees = Trees(x, y)
        if len(y):  # calibrated on scores of trees that did not see the row
            fold, raw = np.arange(len(y)) % 3, np.zeros(len(y))
            for k in range(3):
                raw[fold == k] = Trees(x[fold != k], y[fold != k]).raw(x[fold == k])
            self.points, self.values = isotonic(raw, y.astype(float))
        else:
            self.points, self.values = np.array([0.0]), np.array([0.5])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(x), self.points, self.values), 0.0, 1.0) if len(x) else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns ``toxic`` from rows whose crc32(doc_id) mod 4 is not 2."""
    rows = labelled(docs, labels, "toxic", 4, 2, sample, 8).select(F.col("text").cast("string").alias("text"), F.when(F.col("y") == 1, 1).otherwise(0).alias("y"), "k")

    def counted():
        def step(cols):
            seen = [Counter(), Counter()]
            n = [0, 0]
            for text, y in zip(*cols[:2]):
                n[y] += 1
                seen[y].update({w.lower() for w in _PLAIN.findall(text or "")})
            words = list(seen[0] | seen[1])
            return ["", *words], [n[1], *(seen[1][w] for w in words)], [n[0], *(seen[0][w] for w in words)]

        return step

    # Words found in too few toxic texts cannot enter the lexicon and never reach the driver.
    sums = map_rows(rows, counted, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    got = sums.where(f"t >= {LEAST_TEXTS} or word = ''").toArrow().to_pylist()
    whole = next((r for r in got if r["word"] == ""), {"t": 0, "c": 0})
    lexicon = learn_lexicon([(r["word"], r["t"], r["c"]) for r in got if r["word"]], whole["t"], whole["c"])

    def dense():
        def step(cols):
            return [features(t, lexicon) for t in cols[0]], cols[1], cols[2]

        return step

    table = map_rows(rows, dense, "x array<double>, y int, k long").toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return Model(lexicon, x, np.array(table.column("y").to_pylist(), int))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null and empty texts get the score of zero features.  Repeated rows give
    repeated rows; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded lexicon and trees

    def make():
        m = shared.value

        def step(cols):
            x = np.array([features(t, m.lexicon) for t in cols[1]], float).reshape(-1, len(FEATURES))
            scores = m.scores(x)
            return cols[0], cols[2], scores, (scores >= threshold).astype(np.int32)

        return step

    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")
