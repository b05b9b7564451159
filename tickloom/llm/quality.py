"""Quality by a linear-chain conditional random field over lines (operator 1).

Every line is good or bad. Its potential is linear in binned measures of the line and of both neighbours, and
neighbouring labels have a transition weight. Documents are labelled, not lines: training starts with every line under its
document's label and then gives lines of bad documents that look good by their own marginal the good label. A
document's quality is the mean of its lines' good marginals (forward-backward), weighted by length, mapped by a
logistic curve so that the best border on unseen rows of the sample falls on BORDER.

Defined results: null and empty texts have no lines and get the score of a document all of whose lines are bad;
without labelled rows of both kinds every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import bounded_batches
from tickloom.llm.labelled import sample
from tickloom.llm.toxicity import _LANGUAGE
from tickloom.llm.worker import give_back, lean

#: Most labelled rows that are learned from.
SAMPLE = 6_000
BINS, ROUNDS, STEPS, BORDER = 8, 3, 120, 0.3
#: Lines times documents that the forward-backward pass holds at a time.
CELLS = 250_000
MEASURES = ("chars", "words", "word length", "upper", "digits", "symbols", "pipes", "symbol runs", "exclamations", "distinct", "repeats", "function words", "same line", "stops")

# Classes of the code points of the first two planes; all others are letters here.
UPPER, DIGIT, SYMBOL, PIPE, EXCLAIM, STOP, BLANK = 1, 2, 3, 4, 5, 6, 7
_CLASS = np.zeros(0x20000, np.uint8)
for _c in range(len(_CLASS)):
    _s = chr(_c)
    _CLASS[_c] = BLANK if _s.isspace() else UPPER if _s.isupper() else DIGIT if _s.isdigit() else PIPE if _s == "|" else EXCLAIM if _s == "!" else STOP if _s in ".,;:?" else 0 if _s.isalpha() else SYMBOL


def measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x measures, length of each line); lines without visible text don't count."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, len(MEASURES)), np.float32), np.zeros(0)
    n = np.array([len(x) for x in lines])
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(code, len(_CLASS) - 1)]
    kind[code >= len(_CLASS)] = 0
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    odd = (kind == SYMBOL) | (kind == EXCLAIM)
    runs = odd.copy()
    runs[1:] &= odd[:-1]
    runs[starts] = False
    out = np.empty((len(lines), len(MEASURES)), np.float32)
    words = np.empty(len(lines))
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    for i, x in enumerate(lines):
        w = x.split()
        words[i] = len(w)
        out[i, 9] = len(set(w)) / len(w)
        out[i, 10] = sum(map(str.__eq__, w, w[1:])) / len(w)
        out[i, 11] = sum(map(_LANGUAGE.__contains__, w)) / len(w)
        out[i, 12] = seen[x]
    letters = np.maximum(1, count((kind == 0) | (kind == UPPER)))
    out[:, 0], out[:, 1], out[:, 2] = n, words, n / words
    out[:, 3], out[:, 4], out[:, 5] = count(kind == UPPER) / letters, count(kind == DIGIT) / n, count(kind == SYMBOL) / n
    out[:, 6], out[:, 7], out[:, 8] = count(kind == PIPE) / words, count(runs) / words, count(kind == EXCLAIM) / words
    out[:, 13] = count(kind == STOP) / words
    return out, n.astype(float)


@dataclass
class Crf:
    edges: np.ndarray  # measures x (BINS - 1)
    own: np.ndarray = field(default_factory=lambda: np.zeros((3, len(MEASURES), BINS)))  # of the line before, the line, the line after
    bias: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of every line, a first and a last one
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: float = 1.0
    shift: float = 0.0

    def binned(self, m: np.ndarray) -> np.ndarray:
        return (m[:, :, None] > self.edges[None]).sum(2)

    def potentials(self, bins: np.ndarray) -> np.ndarray:
        """Of good over bad, for each line of one document."""
        parts = [self.own[k][np.arange(len(MEASURES)), bins].sum(1) for k in range(3)]
        s = parts[1] + self.bias[0]
        s[1:] += parts[0][:-1]
        s[:-1] += parts[2][1:]
        s[0] += self.bias[1]
        s[-1] += self.bias[2]
        return s

    def marginals(self, scores: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Good marginal of each line, and the summed pair marginals; documents run side by side, line by line."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(order)
        pairs, at = np.zeros((2, 2)), 0
        while at < len(order):  # side by side as far as CELLS goes, so one very long document runs alone
            side = order[at : at + max(1, CELLS // max(1, len(scores[order[at]])))]
            pairs += self._side(scores, side, out)
            at += len(side)
        return out, pairs

    def _side(self, scores: list[np.ndarray], order: list[int], out: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(scores[i]) for i in order])
        longest = size[0]
        s = np.zeros((longest, len(order)))
        for c, i in enumerate(order):
            s[: size[c], c] = scores[i]
        live = [int((size > t).sum()) for t in range(longest + 1)]
        e = self.trans
        fwd = np.empty((longest, len(order), 2))
        fwd[0, :, 0], fwd[0, :, 1] = 0, s[0]
        for t in range(1, longest):
            k = live[t]
            fwd[t, :k] = np.logaddexp(fwd[t - 1, :k, 0, None] + e[0], fwd[t - 1, :k, 1, None] + e[1])
            fwd[t, :k, 1] += s[t, :k]
        back = np.zeros((longest, len(order), 2))
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            ahead = back[t + 1, :k].copy()
            ahead[:, 1] += s[t + 1, :k]
            back[t, :k] = np.logaddexp(ahead[:, 0, None] + e[:, 0], ahead[:, 1, None] + e[:, 1])
            joint = fwd[t, :k, :, None] + e[None] + ahead[:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            joint = np.exp(joint)
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        d = fwd + back
        good = 1 / (1 + np.exp(np.clip(d[:, :, 0] - d[:, :, 1], -50, 50)))
        for c, i in enumerate(order):
            out[i] = good[: size[c], c]
        return pairs

    def quality(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Score of each text, and the good marginals of its lines."""
        found = [measures(t) for t in texts]
        full = [i for i, (m, _) in enumerate(found) if len(m)]
        good, _ = self.marginals([self.potentials(self.binned(found[i][0])) for i in full])
        mean = np.zeros(len(texts))
        lines = [np.zeros(0)] * len(texts)
        for i, g in zip(full, good, strict=True):
            mean[i], lines[i] = np.average(g, weights=found[i][1]), g
        return self.score(mean), lines

    def score(self, mean: np.ndarray) -> np.ndarray:
        z = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale * np.log(z / (1 - z)) + self.shift)))


def _optimise(crf: Crf, bins: list[np.ndarray], labels: list[np.ndarray], weight: np.ndarray, steps: int) -> None:
    """Adam on the weighted negative log-likelihood of the line labels, over all documents at once."""
    params = {"own": crf.own, "bias": crf.bias, "trans": crf.trans}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    idx = np.arange(len(MEASURES))
    w = np.concatenate([np.full(len(b), x) for b, x in zip(bins, weight, strict=True)])
    flat = np.concatenate(bins)
    ends = np.cumsum([len(b) for b in bins])
    first, last = np.concatenate([[0], ends[:-1]]), ends - 1
    before, after = np.ones(len(flat), bool), np.ones(len(flat), bool)
    before[first] = after[last] = False
    y = np.concatenate(labels)
    seen = np.zeros((2, 2))
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        seen[a, b] = (before[1:] & (y[:-1] == a) & (y[1:] == b)).sum()
    cells = [np.zeros((len(MEASURES), BINS)) for _ in range(3)]
    total = w.sum()
    for t in range(1, steps + 1):
        good, pairs = crf.marginals([crf.potentials(b) for b in bins])
        g = (np.concatenate(good) - y) * w
        for k, rows, res in ((1, flat, g), (0, flat[:-1][before[1:]], g[1:][before[1:]]), (2, flat[1:][after[:-1]], g[:-1][after[:-1]])):
            cells[k][:] = 0
            np.add.at(cells[k], (np.broadcast_to(idx, rows.shape), rows), res[:, None])
        grads = {"own": np.stack(cells) / total + 1e-4 * crf.own, "bias": np.array([g.sum(), g[first].sum(), g[last].sum()]) / total, "trans": (pairs - seen) / max(1, before.sum()) + 1e-3 * crf.trans}
        for k, v in params.items():
            m, s = state[k]
            m[:] = 0.9 * m + 0.1 * grads[k]
            s[:] = 0.99 * s + 0.01 * grads[k] ** 2
            v -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)


def train(rows: list[tuple[str, int]]) -> Crf | None:
    """Fits on four fifths of the rows; the last fifth sets the border."""
    y = np.array([r[1] for r in rows])
    if not len(rows) or y.min() == y.max():
        return None
    found = [measures(t) for t, _ in rows]
    every = np.concatenate([m for m, _ in found if len(m)])
    edges = np.stack([np.quantile(every[:, k], np.linspace(0.02, 0.98, BINS - 1)) for k in range(len(MEASURES))])
    for k in range(len(MEASURES)):  # for measures that are mostly one value, the other values' range
        if edges[k, 0] == edges[k, -2]:
            rest = every[every[:, k] != np.median(every[:, k]), k]
            if len(rest):
                edges[k] = np.quantile(np.concatenate([rest, [np.median(every[:, k])]]), np.linspace(0, 0.9, BINS - 1))
    crf = Crf(edges)
    fit = [i for i in range(len(rows)) if i % 5 and len(found[i][0])]
    check = [i for i in range(len(rows)) if i % 5 == 0]
    bins = [crf.binned(found[i][0]) for i in fit]
    lines = [np.full(len(b), y[i]) for b, i in zip(bins, fit, strict=True)]
    share = max(1e-3, np.mean([y[i] for i in fit]))
    weight = np.array([(0.5 / share if y[i] else 0.5 / (1 - share)) / max(1, len(b)) ** 0.5 for b, i in zip(bins, fit, strict=True)])
    for k in range(ROUNDS):
        _optimise(crf, bins, lines, weight, STEPS)
        if k + 1 < ROUNDS:
            good, _ = crf.marginals([crf.potentials(b) for b in bins])
            for j, i in enumerate(fit):
                if not y[i]:
                    lines[j] = (good[j] > 0.5).astype(int)
                    lines[j][np.argmin(good[j])] = 0  # a bad document has a bad line
    z = crf.quality([rows[i][0] for i in check])[0]
    z, yc = np.log(z / (1 - z)), y[check]
    border = _border(z, yc)
    crf.scale = 1.0
    crf.shift = float(np.log(BORDER / (1 - BORDER)) - border)
    return crf


def _border(z: np.ndarray, y: np.ndarray) -> float:
    """Border with the best balanced accuracy, in the middle of the widest equally good stretch."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(z)
    zs, ys = z[order], y[order]
    below = np.concatenate([[0], np.cumsum(ys == 0)[:-1]]) / (ys == 0).sum()
    above = ys[::-1].cumsum()[::-1] / ys.sum()
    gain = below + above
    gaps = np.where(gain >= gain.max() - 1e-12, zs - np.concatenate([[zs[0] - 1], zs[:-1]]), -1)
    i = int(gaps.argmax())
    return float(zs[i] - gaps[i] / 2)


def quality(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", *, lines: bool = False) -> DataFrame:
    """Per row of docs: its id, score (0 to 1) and, if asked for, the good marginals of its lines with visible text."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    if model is None:
        return docs.selectExpr(f"`{id_col}`", "cast(1 as double) score", "cast(null as array<double>) good")
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                score, good = held.value.quality([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array([g if lines else None for g in good], pa.list_(pa.float64()))], names=["id", "score", "good"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(run), f"id {kind}, score double, good array<double>").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Crf | None:
    model = train(sample(docs, labels, label, most))
    give_back()
    return model
