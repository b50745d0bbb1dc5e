"""Operator 3: toxicity by weak supervision.

Voters fire on a text or abstain: one per lexicon entry (words and word beginnings
that training labels mark as toxic, after a short list of fixed ones), and one per
pattern. A generative label model with a latent class estimates by EM how often each
voter fires in either class and, through a maximum spanning tree of conditional
mutual information, how voters depend on one another. A linear classifier then
learns the posterior labels, and its scale is set on the training labels.

The fit takes at most `rows` labelled documents of at most 64 KB (parameters); every
whole text, however long, is scored where it is read, without a shuffle.

Defined results: a null or empty text is scored as one on which no voter fires; if
no training row is toxic or none is clean, the score is the share of toxic rows (0
without rows); repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import LOWER_ALNUM, crc_mod, labelled_sample, parts

MODULUS, HELD_OUT = 5, 0
PREFIXES = (4, 6)
#: Insults that are voters even if no training row holds them.
SEED_LEXICON = (b"bastard", b"clown", b"disgusting", b"idiot", b"imbecile", b"loser", b"moron", b"pathetic", b"scum", b"stupid", b"trash", b"worthless")
#: Pattern voters.
PATTERNS = (
    re.compile(rb"[!?]{3}"),
    re.compile(rb"\byou(?: are|'re)? (?:a |an |such )?(?:\w+ )?(?:idiot|moron|loser|clown|scum|trash)", re.I),
    re.compile(rb"\b(?:shut up|go away|get lost|hate you)\b", re.I),
    re.compile(rb"(?:\b[A-Z]{4,}\b\W+){4}"),
)


#: So much evidence (G) lets about one in a million chance entries pass.
LEAST_EVIDENCE = 24.0


@dataclass
class Model:
    """Lexicon entries (marked by length of beginning, 0: the word), and the linear scorer over voters and hit counts."""

    lexicon: dict[tuple[int, bytes], int]
    weights: np.ndarray
    bias: float

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weights + self.bias, -40, 40)))


Keys = dict[int, dict[bytes, int]]


def lexicon_keys(lexicon: dict[tuple[int, bytes], int]) -> Keys:
    """Entries by length of beginning."""
    return {n: {w: k for (x, w), k in lexicon.items() if x == n} for n in (0, *PREFIXES)}


def _hits(raw: bytes, by: Keys) -> tuple[Counter, int]:
    """Occurrences of each entry, and the number of words."""
    words = raw.translate(LOWER_ALNUM).split()
    found: Counter = Counter()
    distinct = set(words)
    matched = {}
    for n, keys in by.items():
        if n == 0:
            for w in distinct & keys.keys():
                matched.setdefault(w, []).append(keys[w])
        elif keys and not keys.keys().isdisjoint({w[:n] for w in distinct}):
            for w in distinct:
                if (k := keys.get(w[:n])) is not None and len(w) > n:
                    matched.setdefault(w, []).append(k)
    if matched:
        for w in words:
            for k in matched.get(w, ()):
                found[k] += 1
        found[-1] = sum(w in matched for w in words)
        found[-2] = len(matched)
    return found, len(words)


def votes(texts: list[bytes], lexicon: dict[tuple[int, bytes], int]) -> np.ndarray:
    """One column per lexicon entry and pattern, then log counts: all hits, distinct hits, hits in a hundred words."""
    n = len(lexicon)
    by = lexicon_keys(lexicon)
    out = np.zeros((len(texts), n + len(PATTERNS) + 6))
    for r, raw in enumerate(texts):
        found, size = _hits(raw, by)
        for k, c in found.items():
            if k >= 0:
                out[r, k] = c > 0
        for j, p in enumerate(PATTERNS):
            out[r, n + j] = p.search(raw) is not None
        every, distinct = found[-1], found[-2]
        out[r, n + len(PATTERNS) :] = np.log1p(every), np.log1p(distinct), np.log1p(100 * every / max(1, size)), distinct >= 2, distinct >= 3, every == 0
    return out


def mine_lexicon(texts: list[bytes], y: np.ndarray, most: int = 96) -> dict[tuple[int, bytes], int]:
    """Entries whose presence marks toxic texts, strongest first; of entries on the same texts the shortest beginning counts."""
    def entries(raw: bytes) -> set[tuple[int, bytes]]:
        distinct = set(raw.translate(LOWER_ALNUM).split())
        return {(0, w) for w in distinct} | {(n, w[:n]) for n in PREFIXES for w in distinct if len(w) > n}

    toxic = Counter(e for raw, t in zip(texts, y, strict=True) if t for e in entries(raw))
    at = {e: [] for e, n in toxic.items() if n >= max(2, 0.01 * y.sum())}
    for i, raw in enumerate(texts):
        for e in entries(raw) & at.keys():
            at[e].append(i)
    pos, neg = y.sum(), (1 - y).sum()
    ranked = []
    for e, rows in at.items():
        p = y[rows].sum()
        if p / len(rows) > pos / (pos + neg):
            odds = np.log((p + 0.5) / (pos + 1)) - np.log((len(rows) - p + 0.5) / (neg + 1))
            if odds > 2.5 and _evidence(p, len(rows), pos, pos + neg) > LEAST_EVIDENCE:
                ranked.append((-odds * np.sqrt(p), -p, e))
    chosen: dict[tuple[int, bytes], int] = {}
    taken: set[tuple] = set()
    for _, _, e in sorted(ranked):
        rows = tuple(at[e])
        if rows not in taken and len(chosen) < most:
            taken.add(rows)
            chosen[e] = len(chosen)
    for w in SEED_LEXICON:
        chosen.setdefault((0, w), len(chosen))
    return chosen


def _evidence(p: float, n: float, pos: float, total: float) -> float:
    """Likelihood ratio statistic (G) of p toxic texts among n that hold an entry."""
    cells = ((p, n * pos / total), (n - p, n * (total - pos) / total), (pos - p, (total - n) * pos / total), (total - pos - n + p, (total - n) * (total - pos) / total))
    return 2 * sum(o * np.log(o / e) for o, e in cells if o > 0)


def label_model(x: np.ndarray, start: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of the latent class from binary votes, by EM over a tree of voters."""
    q = np.stack([1 - start, start])
    n, m = x.shape
    parent = np.full(m, -1)
    for step in range(rounds):
        both = np.stack([(x * w[:, None]).T @ x for w in q]) + 0.25
        total = q.sum(1)[:, None, None] + 1.0
        one = np.stack([w @ x for w in q]) + 0.5
        if step in (0, rounds // 2):
            parent = _tree(both, one, total)
        safe = np.where(parent < 0, 0, parent)
        p11 = both[:, safe, np.arange(m)] / (one[:, safe] + 0.5)
        p01 = (one - both[:, safe, np.arange(m)] + 0.25) / (total[:, :, 0] - one[:, safe] + 0.5)
        free = one / total[:, :, 0]
        fires = np.where(parent < 0, 1.0, x[:, safe])
        logp = np.zeros((2, n))
        for c in (0, 1):
            p = np.clip(np.where(parent < 0, free[c], np.where(fires > 0, p11[c], p01[c])), 1e-4, 1 - 1e-4)
            logp[c] = (x * np.log(p) + (1 - x) * np.log1p(-p)).sum(1) + np.log(q[c].mean() + 1e-6)
        q = np.exp(logp - np.logaddexp(logp[0], logp[1]))
    return q[1]


def _tree(both: np.ndarray, one: np.ndarray, total: np.ndarray, least: float = 0.002) -> np.ndarray:
    """Parents in the maximum spanning forest of conditional mutual information; edges under `least` are no dependence."""
    m = one.shape[1]
    n = total.sum()
    info = np.zeros((m, m))
    for c in (0, 1):
        t = total[c, 0, 0]
        pi, pj, pij = one[c][:, None] / t, one[c][None, :] / t, both[c] / t
        for a, b, ab in ((pi, pj, pij), (1 - pi, pj, pj - pij), (pi, 1 - pj, pi - pij), (1 - pi, 1 - pj, 1 - pi - pj + pij)):
            ab = np.maximum(ab, 1e-9)
            info += t / n * ab * np.log(ab / np.maximum(a * b, 1e-9))
    np.fill_diagonal(info, -1)
    parent, best, link = np.full(m, -1), info[0].copy(), np.zeros(m, int)
    left = set(range(1, m))
    while left:
        k = max(left, key=lambda j: best[j])
        left.remove(k)
        parent[k] = link[k] if best[k] >= least else -1
        closer = info[k] > best
        best[closer], link[closer] = info[k][closer], k
    return parent


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton steps for a linear scorer of soft labels."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, rows: int = 8000) -> Model:
    _, texts, y = labelled_sample(documents, labels, "toxic", MODULUS, HELD_OUT, rows)
    raw = [t.encode() for t in texts]
    lexicon = mine_lexicon(raw, y) if 0 < y.sum() < len(y) else {(0, w): k for k, w in enumerate(SEED_LEXICON)}
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        bias = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Model(lexicon, np.zeros(len(lexicon) + len(PATTERNS) + 6), float(bias))
    x = votes(raw, lexicon)
    binary = np.delete(x, range(len(lexicon) + len(PATTERNS), len(lexicon) + len(PATTERNS) + 3), axis=1)
    distinct = np.expm1(x[:, len(lexicon) + len(PATTERNS) + 1])
    posterior = label_model(binary, np.where(distinct >= 2, 0.9, np.where(distinct >= 1, 0.3, 0.02)))
    weights, bias = _logistic(x, posterior, l2=0.5)
    raw_score = x @ weights + bias
    # The scale, and what two, three or no distinct hits are worth, come from the labels themselves.
    marks = [x.shape[1] - 3, x.shape[1] - 2, x.shape[1] - 1]
    scale, shift = _logistic(np.column_stack([raw_score, x[:, marks]]), y, l2=0.05)
    weights = weights * scale[0]
    weights[marks] += scale[1:]
    return Model(lexicon, weights, bias * scale[0] + shift)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_hits (words that lexicon voters fire on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(model.lexicon) + len(PATTERNS)
        for b in parts(batches):
            v = votes([(t or "").encode() for t in b.column("text").to_pylist()], model.lexicon)
            n = np.rint(np.expm1(v[:, at])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(v)), pa.array(n)], ["doc_id", "score", "n_hits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_hits long")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels)).select(
        "doc_id", (crc_mod("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits",
    )


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents` that score under 0.5, with all their columns, in one narrow pass."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            v = votes([(t or "").encode() for t in b.column(at).to_pylist()], model.lexicon)
            yield b.filter(pa.array(model.score(v) < 0.5))

    return documents.mapInArrow(run, documents.schema)
