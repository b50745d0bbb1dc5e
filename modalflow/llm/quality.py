"""Operator 7: quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features again and
again; each step fits a tree of at most three leaves to one feature's gradient
histogram and adds it to that feature's lookup table. Then the pairs with the
largest remaining gain get two-way tables in the same way, from trees of depth two.
A score is a sum of table cells, read by vectorised bin numbers.

The fit takes at most `rows` labelled documents of at most 64 KB (parameters); every
whole text, however long, is scored where it is read, without a shuffle.

Defined results: a null or empty text has the features of an empty one and is
scored by them; if training rows hold one class only, the score is its share (0.5
without rows); repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import crc_mod, labelled_sample

MODULUS, HELD_OUT = 3, 1
BINS, COARSE, PAIRS = 32, 8, 6
FEATURES = (
    "log_bytes", "log_words", "word_len", "upper", "digit", "symbol", "exclaim", "stop", "non_ascii", "letter",
    "distinct_words", "top_word", "log_lines", "line_len", "repeated_lines", "odd_ends", "title_words", "entropy", "distinct_pairs", "long_words", "short_words", "blank",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~|<>{}[]=+_\\/", np.uint8)
_ENDS = frozenset(b"#$%&*@^~|<>{}[]=+_\\/!")


def features(raw: bytes) -> list[float]:
    n = len(raw)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    p = h[h > 0] / max(1, n)
    lens = list(map(len, words))
    m = max(1, n)
    return [
        np.log1p(n), np.log1p(len(words)), sum(lens) / k, upper / max(1, upper + lower), h[48:58].sum() / m, h[_SYMBOLS].sum() / m,
        h[33] / m, (h[46] + h[44]) / m, h[128:].sum() / m, (upper + lower) / m,
        len(seen) / k, max(seen.values(), default=0) / k, np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), sum(w[-1] in _ENDS for w in words) / k, sum(map(bytes.istitle, words)) / k,
        float(-(p * np.log2(p)).sum()), len(set(zip(words, words[1:], strict=False))) / max(1, k - 1),
        sum(x > 12 for x in lens) / k, sum(x <= 3 for x in lens) / k, (h[32] + h[10] + h[9] + h[13]) / m,
    ]


@dataclass
class Model:
    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(cut, x[:, j], side="right")]
        coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
        for a, b, t in self.pairs:
            out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher"))


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _leaf(g: np.ndarray, h: np.ndarray, lam: float) -> float:
    return -g.sum() / (h.sum() + lam)


def _stump(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    """A tree of at most three leaves over ordered bins."""
    edges = [0, len(g)]
    for _ in range(2):
        gain, k, a = max((*_best_cut(g[a:b], h[a:b], lam), a) for a, b in zip(edges, edges[1:], strict=False))
        if gain <= 1e-9:
            break
        edges = sorted({*edges, a + k})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = _leaf(g[a:b], h[a:b], lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """A cut of the first axis, then a cut of the second on either side: gain and table."""
    best, table = 0.0, np.zeros_like(g)
    for k in range(1, g.shape[0]):
        gain, t = 0.0, np.zeros_like(g)
        for rows in (slice(0, k), slice(k, None)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            got, at = _best_cut(gs, hs, lam)
            gain += got + gs.sum() ** 2 / (hs.sum() + lam)
            t[rows, :at], t[rows, at:] = _leaf(gs[:at], hs[:at], lam), _leaf(gs[at:], hs[at:], lam)
        gain -= g.sum() ** 2 / (h.sum() + lam)
        if gain > best:
            best, table = gain, t
    return best, table


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.1, lam: float = 2.0) -> Model:
    n = len(y)
    share = float(y.mean()) if n else 0.5
    model = Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if not 0 < share < 1 or not n:
        return model
    model.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_cuts = [_cuts(x[:, j], COARSE) for j in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    f = np.full(n, model.bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = gradient()
            step = rate * _stump(np.bincount(at[j], g, len(t)), np.bincount(at[j], h, len(t)), lam)
            t += step
            f += step[at[j]]
    g, h = gradient()
    ranked = []
    for a in range(x.shape[1]):
        for b in range(a):
            shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
            cell = coarse[a] * shape[1] + coarse[b]
            gain, _ = _pair_tree(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), lam)
            ranked.append((-gain, a, b, cell, shape))
    ranked.sort(key=lambda r: r[:3])
    model.pairs = [(a, b, np.zeros(shape)) for _, a, b, _, shape in ranked[:PAIRS]]
    for _ in range(pair_rounds):
        for (_, _, _, cell, shape), (_, _, t) in zip(ranked, model.pairs, strict=False):
            g, h = gradient()
            _, step = _pair_tree(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), lam)
            t += rate * step
            f += rate * step.ravel()[cell]
    return model


def fit(documents: DataFrame, labels: DataFrame, rows: int = 6000) -> Model:
    _, texts, y = labelled_sample(documents, labels, "quality", MODULUS, HELD_OUT, rows)
    x = np.array([features(t.encode()) for t in texts]).reshape(-1, len(FEATURES))
    return train(x, y)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features((t or "").encode()) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels)).select(
        "doc_id", (crc_mod("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
