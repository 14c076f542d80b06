"""Toxicity of documents: boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon (general insults, and words and stems that labelled toxic texts
prefer), their nearness to the second person, capitals, punctuation and obfuscation. The labelled rows
are dealt in three: the lexicon is learned on the first part, the trees on the second, the calibration
on the third.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.quality import sample

#: Labelled rows of each class that the model is fitted on, at most. Fitting needs one machine.
FIT_ROWS = 2_500
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
STEMS = (4, 5, 6)
#: Log odds from which a word or stem belongs to the lexicon; documents that must have it.
ODDS, LEAST = 2.0, 3
NEAR, WINDOW = 3, 40
FEATURES = ("words", "hits", "distinct", "weight", "strongest", "densest", "insults", "insults_second_person", "hits_second_person", "capitals", "shouts", "marks", "obfuscated", "obfuscated_insults")
# General insults, and forms of the second person in English, French, German and Spanish.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers trash garbage worthless pathetic disgusting scum clown fool dumb jerk ugly freak imbecile abruti connard crétin débile dummkopf trottel versager abschaum idiota estúpido imbécil basura inútil".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tú vos usted ustedes su".split())
_TOKEN = re.compile(r"[@$]?[^\W_]+(?:[@$!*.\-_]+[^\W_]+)*")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_PLAIN = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_][\d@$!*.\-_]+[^\W\d_]|[@$][^\W\d_]{2}")
_LETTER = np.array([chr(i).isalpha() and i < 128 or i >= 128 for i in range(256)])
_ODD_BYTE = np.array([chr(i) in "0123456789@$!*.-_" for i in range(256)])
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})


def tokens(text: str) -> list[str]:
    return _PLAIN.findall(text.lower())


def plain(token: str) -> str:
    """A token without its disguise."""
    return token.translate(_LEET)


def learn_lexicon(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Words, and stems ending in ``-``, that toxic texts prefer, with their log odds."""
    seen = {0: Counter(), 1: Counter()}
    size = Counter(y for _, y in rows)
    for text, y in rows:
        own = set(tokens(text))
        seen[y].update(own | {f"{w[:n]}-" for w in own for n in STEMS if len(w) > n})
    out = {}
    for term, n in seen[1].items():
        odds = np.log((n + 0.5) / (size[1] + 1)) - np.log((seen[0][term] + 0.5) / (size[0] + 1))
        if n >= LEAST and odds >= ODDS:
            out[term] = float(odds)
    return out


class Lexicon:
    """Weights of words, with the weights of all words met so far kept for the next text."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def _weigh(self, word: str) -> float:
        own = [self.weights.get(word, 0.0), 4.0 if word in INSULTS else 0.0]
        return max(own + [self.weights.get(f"{word[:n]}-", 0.0) for n in STEMS if len(word) > n])

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        got = list(map(self.known.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.known[words[i]] = self._weigh(words[i])
        return np.array(got, np.float64)


def _signs(text: str) -> tuple[int, bool, bool]:
    """Capitals in a text, whether three stand together, and whether a sign or digit can stand inside a word."""
    b = np.frombuffer(text.encode(), np.uint8)
    upper = (b >= 65) & (b <= 90)
    accented = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)
    letter, odd = _LETTER[b], _ODD_BYTE[b]
    inside = (odd[1:-1] & letter[:-2] & (letter | odd)[2:]).any() or (odd[:-1] & letter[1:]).any()
    return int(upper.sum() + accented.sum()), bool((upper[2:] & upper[1:-1] & upper[:-2]).any() or accented.any()), bool(inside)


def features(text: str, weigh: Lexicon) -> list[float]:
    """The values of FEATURES for a text; all 0 for an empty one."""
    words = tokens(text)
    n = max(len(words), 1)
    weights = weigh(words)
    capitals, loud, disguised = _signs(text)
    at = np.flatnonzero(weights)
    hits = [words[i] for i in at]
    insults = [i for i in at if words[i] in INSULTS]
    second = {i for i, w in enumerate(words) if w in SECOND_PERSON} if len(at) else set()
    close = lambda i: any(j in second for j in range(i - NEAR, i + NEAR + 1))
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    width = min(WINDOW, len(words))
    densest = float((sums[width:] - sums[: len(sums) - width]).max()) / width if width else 0.0
    odd = [t for t in _TOKEN.findall(text) if not t.isalpha() and _ODD.search(t)] if disguised else []
    hidden = sum(plain(t.lower()) in INSULTS for t in odd)
    letters = sum(map(len, words)) or 1
    shouts = len(_SHOUT.findall(text)) if loud else 0
    return [
        float(np.log1p(len(words))), len(at) / n, len(set(hits)) / n, float(weights.sum()) / n, float(weights.max(initial=0.0)), densest,
        len(insults) / n, sum(map(close, insults)) / n, sum(map(close, at)) / n, capitals / letters, shouts / n,
        (text.count("!") + text.count("?")) / n, len(odd) / n, hidden / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the logit; node i has children 2i+1 and 2i+2."""

    start: float
    column: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        each = np.arange(len(x))
        for column, cut, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[each, column[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over binned columns."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    prior = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(prior / (1 - prior)))
    logit = np.full(len(y), start)
    columns, values, leaves = [], [], []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node, column, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for i in range(inner):
            own = np.flatnonzero(node == i)
            best = (1e-6, 0, np.inf, 0)
            g, h = grad[own].sum(), hess[own].sum()
            for j, c in enumerate(cuts):
                if not len(own) or not len(c):
                    continue
                left_g = np.cumsum(np.bincount(binned[own, j], grad[own], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[own, j], hess[own], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                gain[(left_h < 0.5) | (h - left_h < 0.5)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, c[k], k)
            _, column[i], cut[i], k = best
            right = binned[own, column[i]] > k if np.isfinite(cut[i]) else np.zeros(len(own), bool)
            node[own] = 2 * i + 1 + right
        place = node - inner
        leaf = -RATE * np.bincount(place, grad, inner + 1) / (np.bincount(place, hess, inner + 1) + 1)
        logit += leaf[place]
        columns.append(column), values.append(cut), leaves.append(leaf)
    return Trees(start, np.array(columns), np.array(values), np.array(leaves))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots and non-decreasing values to interpolate between."""
    at, where = np.unique(x, return_inverse=True)
    sums, weights = np.bincount(where, y * weight), np.bincount(where, weight)
    blocks: list[list[float]] = []  # weighted sum, weight, first x, last x
    for s, w, v in zip(sums, weights, at, strict=True):
        blocks.append([s, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return knots, values


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts, weigh: Lexicon) -> np.ndarray:
        x = np.array([features(t, weigh) for t in texts]).reshape(-1, len(FEATURES))
        raw = np.zeros(len(x)) if self.trees is None else self.trees(x)
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def fit(rows: list[tuple[str, int]], sizes: dict[int, int]) -> Model:
    """Trains on (text, label) rows; ``sizes`` of the classes set the prior of the calibrated scores."""
    if len({y for _, y in rows}) < 2:
        share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
        return Model({}, None, np.zeros(1), np.array([share]))
    third = [zlib.crc32(t.encode()) % 10 for t, _ in rows]
    parts = [[r for r, k in zip(rows, third, strict=True) if k in ks] for ks in ((0, 1, 2, 3), (4, 5, 6), (7, 8, 9))]
    if any(len({y for _, y in p}) < 2 for p in parts):
        parts = [rows] * 3
    lexicon = learn_lexicon(parts[0])
    weigh = Lexicon(lexicon)
    x, y = zip(*((np.array([features(t, weigh) for t, _ in p]), np.array([v for _, v in p], float)) for p in parts[1:]), strict=True)
    trees = boost(x[0], y[0])
    here = Counter(y[1])
    weight = np.array([sizes[int(v)] / here[v] for v in y[1]])
    knots, values = isotonic(trees(x[1]), y[1], weight)
    return Model(lexicon, trees, knots, values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(text, ...)`` with ``score``; a column of that name is replaced, others pass through."""
    rest = [c for c in docs.columns if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weigh = Lexicon(shared.value.lexicon)
        for batch in batches:
            scores = shared.value.score((t.as_py() or "" for t in batch.column("text")), weigh)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*rest, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), "score double"])
    return docs.select(*rest).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, text, score)`` for each row of ``docs``, learned from ``labels(doc_id, label)``.

    score, 0 to 1, is the calibrated likelihood of label 1. Only the text is an input. The model is
    fitted on at most ``per_class`` labelled documents of each class, none longer than ``quality.FIT_BYTES``;
    with so few that a part of them lacks a class, all parts are the same rows and the calibration rests on
    scores of training. Null texts count as empty; labels that are null or neither 0 nor 1 are left out; without labels of both classes all scores are the
    share of label 1. Repeated rows are scored alike; an empty table stays empty.
    """
    return score(docs.select("doc_id", "text"), fit(*sample(docs, labels, per_class)))
