"""Operator 10: language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A document is parsed
greedily into the longest pieces that the automaton knows (a byte it doesn't know
is a piece of its own); the language whose automaton needs the fewest pieces per
byte wins. Texts are lower-cased, runs of ASCII characters that are no letters
become one space, and the parse restarts every BLOCK bytes, for all languages
alike, so that long texts are parsed in bounded memory and many blocks advance
together as NumPy arrays.

The fit takes about `bytes_per_lang` bytes of each language from at most `rows_per_lang`
labelled documents, chosen by hash order; of each an even share, from a place that a hash
chooses, so that a long text teaches as well as a short one and headers that texts share
teach no more than the rest. Both are parameters of the fit; a worker's tables grow with
the number of languages. Every whole text, however long, is scored.

Defined results: `und` with score 0 if the text is null or has no letter, or if no
row teaches a language; a tie goes to the language that sorts first; repeated rows
are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalflow.llm.common import LOWER_ALNUM, crc_mod

BLOCK = 1024
MODULUS, HELD_OUT = 4, 2
_DIGITS = bytes(32 if 48 <= c <= 57 else LOWER_ALNUM[c] for c in range(256))
_SPACES = re.compile(rb" +")

_models: dict[bytes, tuple] = {}


def fold(text: str) -> bytes:
    return _SPACES.sub(b" ", text.lower().encode().translate(_DIGITS)).strip(b" ")


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of `text`; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def _tables(samples: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(class of each byte, one step table over all languages' states, start states, classes).

    An entry is twice the next state, plus one where a piece ends before this byte.
    """
    key = hashlib.sha256(repr(samples).encode()).digest()
    if key not in _models:
        seen = sorted(set(b"".join(s for _, s in samples)))
        cls = np.full(256, len(seen), np.int32)
        cls[seen] = np.arange(len(seen))
        width = len(seen) + 1
        parts, starts, base = [], [], 0
        for _, sample in samples:
            nexts = suffix_automaton(sample)
            # Where no transition goes on, a piece ends and the next one starts; an unknown byte leads to a state that only ends pieces.
            unknown = base + len(nexts)
            restart = np.full(width, 2 * unknown + 1, np.int32)
            for c, q in nexts[0].items():
                restart[cls[c]] = 2 * (base + q) + 1
            step = np.repeat(restart[None, :], len(nexts) + 1, axis=0)
            step[0] -= 1
            at = np.array([(i, cls[c], base + q) for i, n in enumerate(nexts) for c, q in n.items()], np.int64).reshape(-1, 3)
            step[at[:, 0], at[:, 1]] = 2 * at[:, 2]
            starts.append(base)
            base += len(nexts) + 1
            parts.append(step)
        _models.clear()
        _models[key] = (cls, np.concatenate(parts).ravel(), np.array(starts, np.int32), width)
    return _models[key]


def pieces(folded: list[bytes], samples: list[tuple[str, bytes]]) -> np.ndarray:
    """Pieces of each text by each language's automaton."""
    cls, step, starts, width = _tables(samples)
    n_lang = len(starts)
    out = np.zeros((len(folded), n_lang), np.int64)
    cut = [(i, t[k : k + BLOCK]) for i, t in enumerate(folded) for k in range(0, len(t), BLOCK)]
    cut.sort(key=lambda x: -len(x[1]))
    for s in range(0, len(cut), 4096):
        part = cut[s : s + 4096]
        lens = np.array([len(t) for _, t in part])
        m = np.zeros((len(part), lens[0]), np.uint8)
        for r, (_, t) in enumerate(part):
            m[r, : len(t)] = np.frombuffer(t, np.uint8)
        codes = np.ascontiguousarray(cls[m].T)
        state = np.repeat(starts[None, :], len(part), axis=0)
        count = np.ones((len(part), n_lang), np.int32)
        alive = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # texts longer than the place
        for k in range(lens[0]):
            a = alive[k]
            e = step[state[:a] * width + codes[k, :a, None]]
            count[:a] += e & 1
            state[:a] = e >> 1
        np.add.at(out, [i for i, _ in part], count)
    return out


def fit(documents: DataFrame, rows_per_lang: int = 100, bytes_per_lang: int = 40_000) -> list[tuple[str, bytes]]:
    """(language, folded sample) for each language that the training rows name."""
    train = documents.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", MODULUS) != HELD_OUT)
    )
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []

    def by_lang(value) -> F.Column:
        return F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, value(n))))[F.col("lang")]

    # Each language's rows below a hash bound, so that about twice the rows wanted are read by no sort at all.
    scale = 1 << 30
    share = {k: bytes_per_lang // min(rows_per_lang, n) for k, n in sizes.items()}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    length = 2 * by_lang(lambda n: bytes_per_lang // min(rows_per_lang, n))
    start = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - length + 1))
    some = train.where(h < by_lang(lambda n: min(scale, 2 * rows_per_lang * scale // n))).select(
        "lang", "doc_id", h.alias("h"), F.substring(F.col("text"), start.cast("int"), length.cast("int")).alias("piece")
    ).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "piece"))
    rows = some.withColumn("rank", rank).where(F.col("rank") <= rows_per_lang).orderBy("lang", "rank").collect()
    return [
        (lang, b" ".join(fold(r["piece"])[: share[lang]] for r in rows if r["lang"] == lang))
        for lang in sorted(sizes)
    ]


def predict(documents: DataFrame, samples: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, n_pieces (of the winning language)."""
    langs = [x for x, _ in samples]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                c = b.slice(s, 1024)
                texts = [t or "" for t in c.column("text").to_pylist()]
                some = [bool(samples) and any(map(str.isalpha, t)) for t in texts]
                folded = [fold(t) if ok else b"" for t, ok in zip(texts, some, strict=True)]
                pred, score, best = [], [], []
                n = pieces(folded, samples) if samples else np.zeros((len(texts), 1))
                for ok, f, row in zip(some, folded, n, strict=True):
                    k = int(row.argmin())
                    rate = row / max(1, len(f))
                    p = np.exp(-(rate - rate[k]) * min(len(f), 400))
                    pred.append(langs[k] if ok else "und")
                    score.append(float(1 / p.sum()) if ok else 0.0)
                    best.append(int(row[k]) if ok else 0)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.int64())], ["doc_id", "lang_pred", "score", "n_pieces"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_pieces long")


def digest(documents: DataFrame) -> DataFrame:
    return predict(documents, fit(documents)).select(
        "doc_id", (crc_mod("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "n_pieces"
    )
