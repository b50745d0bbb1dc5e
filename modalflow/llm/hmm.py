"""Operator 8: scoring by a hidden Markov language model.

Exact counts of all training tokens come first, combined in each task before the
shuffle. Words that occur LEAST times and make up at least `head` of all tokens (so at most
1 / head words) are symbols of their own; all other words share the symbol TAIL, inside which a word's
probability follows its smoothed count; END closes every text. Latent states are
trained by Baum-Welch: each task adds up the expected counts of its texts, blocks of
states by symbols are summed in two steps, and the new parameters come from the sums.
A bounded sample of texts only gives the starting point; every round goes over all
training texts. A text's likelihood is exact: the scaled forward recursion over its
symbols, with texts of like length advancing together.

The probability of words outside the head needs their counts; those travel by a join
on the word, not to the driver, and no such word has more than a `head` share of rows.

Defined results: a null text counts as empty and has the end as its one token; an
unknown word has count 0; without training rows N is 0 and every base score is 0;
rows that share a doc_id are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import LOWER_SPACE, Scratch, crc_mod, ordered_by_hash

MODULUS, HELD_OUT = 10, 0
STATES, ROUNDS = 8, 2
HEAD, LEAST = 1e-6, 10
SAMPLE_ROWS, SAMPLE_ROUNDS = 500, 12
SYMBOLS = 4096
GROUP = 250_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_SPACE).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        r = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"])
        found.clear()
        return r

    for b in batches:
        for t in b.column("text").to_pylist():
            found.update(tokens(t))
            if len(found) > 400_000:
                yield out()
    yield out()


@dataclass
class Model:
    """start (K), step (K, K), emit (symbols, K); symbols: head words, TAIL, END."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts by falling length, in groups of about GROUP symbols."""
    order = np.argsort(-lengths, kind="stable")
    size = np.cumsum(lengths[order])
    cut = np.searchsorted(size, np.arange(GROUP, size[-1] + GROUP, GROUP)) + 1 if len(size) else []
    at = 0
    for c in cut:
        c = min(int(c), len(order))
        if c > at:
            yield order[at:c]
            at = c


def _grid(texts: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by place (places, texts), and the number of texts longer than each place."""
    lens = np.array([len(texts[r]) for r in rows])
    grid = np.zeros((len(rows), lens[0]), np.int32)
    for k, r in enumerate(rows):
        grid[k, : lens[k]] = texts[r]
    return np.ascontiguousarray(grid.T), np.searchsorted(-lens, -np.arange(lens[0]), side="left")


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each symbol sequence."""
    out = np.zeros(len(texts))
    for rows in groups(np.array([len(t) for t in texts], np.int64)):
        grid, alive = _grid(texts, rows)
        total = np.zeros(len(rows))
        a = np.repeat(model.start[None], len(rows), 0)
        for t in range(len(grid)):
            n = alive[t]
            a = (a[:n] @ model.step if t else a[:n]) * model.emit[grid[t, :n]]
            c = a.sum(1)
            total[:n] += np.log10(c)
            a /= c[:, None]
        out[rows] = total
    return out


def expect(model: Model, texts: list[np.ndarray], into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Add the texts' expected starts, steps and emissions; returns their log likelihood."""
    starts, steps, emits = into
    k = len(model.start)
    likelihood = 0.0
    back = model.step.T.copy()
    for rows in groups(np.array([len(t) for t in texts], np.int64)):
        grid, alive = _grid(texts, rows)
        place = np.concatenate([[0], np.cumsum(alive)])
        alpha = np.empty((place[-1], k))
        scale = np.empty(place[-1])
        a = np.repeat(model.start[None], len(rows), 0)
        for t in range(len(grid)):
            n = alive[t]
            a = (a[:n] @ model.step if t else a[:n]) * model.emit[grid[t, :n]]
            c = a.sum(1)
            a /= c[:, None]
            alpha[place[t] : place[t + 1]] = a
            scale[place[t] : place[t + 1]] = c
        likelihood += float(np.log(scale).sum())
        b = np.ones((0, k))
        for t in range(len(grid) - 1, -1, -1):
            n, s = alive[t], slice(place[t], place[t + 1])
            if len(b) < n:
                b = np.concatenate([b, np.ones((n - len(b), k))])
            gamma = alpha[s] * b
            eb = b * model.emit[grid[t, :n]] / scale[s, None]
            if t:
                steps += alpha[place[t - 1] : place[t - 1] + n].T @ eb
            else:
                starts += gamma.sum(0)
            alpha[s] = gamma
            b = eb @ back
        symbols = np.concatenate([grid[t, : alive[t]] for t in range(len(grid))])
        for j in range(k):
            emits[:, j] += np.bincount(symbols, alpha[:, j], len(emits))
    return likelihood


def maximise(model: Model, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, prior: np.ndarray, mass: float = 2.0) -> Model:
    """Parameters from expected counts; emissions are drawn to the overall frequencies by `mass` tokens a symbol."""
    k = len(model.start)
    step = (steps * model.step) + 0.5
    emit = emits + mass * len(prior) * prior[:, None]
    return Model((starts + 0.5) / (starts.sum() + 0.5 * k), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _symbols(texts: list[str | None], ids: dict[bytes, int]) -> list[np.ndarray]:
    tail, end = len(ids), len(ids) + 1
    get = ids.get
    return [np.array([*(get(w, tail) for w in tokens(t)), end], np.int32) for t in texts]


_vocabularies: dict[str, dict[bytes, int]] = {}


def _ids(shared) -> dict[bytes, int]:
    """The broadcast vocabulary as a dictionary, built once per Python worker."""
    if shared.value[0] not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[shared.value[0]] = {w: i for i, w in enumerate(shared.value[1])}
    return _vocabularies[shared.value[0]]


def _expectations(vocabulary, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids = model.value, _ids(vocabulary)
        into = (np.zeros(len(m.start)), np.zeros_like(m.step), np.zeros_like(m.emit))
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                expect(m, _symbols(b.column("text").slice(s, 2000).to_pylist(), ids), into)
        flat = {-2: into[0], -1: into[1].ravel(), **{k: into[2][k : k + SYMBOLS].ravel() for k in range(0, len(into[2]), SYMBOLS)}}
        salt = zlib.crc32(into[1].tobytes()) % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat.keys(), pa.int64()), pa.array([salt] * len(flat), pa.int64()), pa.array([v.tobytes() for v in flat.values()], pa.binary())], ["block", "salt", "sums"]
        )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
            v = np.frombuffer(v)
            held[k] = held[k] + v if k in held else v
    yield pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.int64()), pa.array([0] * len(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["block", "salt", "sums"]
    )


def baum_welch_round(train: DataFrame, vocabulary, model: Model, prior: np.ndarray) -> Model:
    """One round over all of train(text)."""
    sc = train.sparkSession.sparkContext
    shared = sc.broadcast(model)
    kind = "block long, salt long, sums binary"
    parts = train.select("text").mapInArrow(_expectations(vocabulary, shared), kind)
    sums = parts.repartition(F.col("block"), F.col("salt")).mapInArrow(_add, kind).repartition(F.col("block")).mapInArrow(_add, kind)
    got = {r["block"]: np.frombuffer(r["sums"]) for r in sums.collect()}
    k = len(model.start)
    emits = np.concatenate([got[b] for b in sorted(got) if b >= 0]).reshape(-1, k) if got else np.zeros_like(model.emit)
    shared.unpersist()
    if not got:
        return model
    return maximise(model, got[-2], got[-1].reshape(k, k), emits, prior)


def _scored(vocabulary, model, logp: np.ndarray):
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_base", pa.float64()), ("symbols", pa.float64()),
        ("tail", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids = model.value, _ids(vocabulary)
        lp = logp.value
        tail = len(ids)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                c = b.slice(s, 2000)
                texts = c.column("text").to_pylist()
                seq = _symbols(texts, ids)
                out: tuple[list, ...] = ([], [], [], [])
                for t, q in zip(texts, seq, strict=True):
                    rare = q == tail
                    out[0].append(len(q))
                    out[1].append(int(len(q) - rare.sum()))
                    out[2].append(float(lp[q[~rare]].sum()))
                    words = tokens(t)
                    out[3].append([{"word": w, "tf": n} for w, n in Counter(words[i] for i in np.flatnonzero(rare)).items()])
                yield pa.RecordBatch.from_arrays(
                    [c.column("row"), c.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(forward(m, seq)), pa.array(out[3], schema.field("tail").type)],
                    schema=schema,
                )

    return run


def score(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: float = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    train = docs.where(F.coalesce(crc_mod("doc_id", MODULUS) != HELD_OUT, F.lit(False)))
    counts = scratch.save(train.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = train.count()
    total, distinct = words + ends, types + (ends > 0)
    top = counts.where(F.col("c") >= max(LEAST, head * total)).orderBy(F.desc("c"), "word").collect()
    vocabulary = sc.broadcast((uuid.uuid4().hex, [bytes(r["word"]) for r in top]))
    ids = {w: i for i, w in enumerate(vocabulary.value[1])}
    in_head = sum(r["c"] for r in top)
    count = np.array([*(r["c"] for r in top), words - in_head, ends], float)
    prior = (count + 0.1) / (count + 0.1).sum()
    all_mass = total + 0.1 * (distinct + 1)
    tail_mass = words - in_head + 0.1 * (types - len(top) + 1)
    logp = np.log10(np.maximum(count, 0) + 0.1) - np.log10(all_mass)
    if not ends:
        logp[:] = 0.0

    start = train.where(F.octet_length("text") <= 1 << 15).select("doc_id").orderBy(*ordered_by_hash("doc_id")).limit(SAMPLE_ROWS)
    sample = _symbols([r["text"] for r in docs.join(F.broadcast(start.distinct()), "doc_id").orderBy("doc_id").collect()], ids)
    rng = np.random.default_rng(11)
    emit = prior[:, None] * np.exp(0.5 * rng.standard_normal((len(prior), states)))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), emit / emit.sum(0))
    for _ in range(SAMPLE_ROUNDS if sample else 0):
        into = (np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit))
        expect(model, sample, into)
        model = maximise(model, *into, prior)
    for _ in range(rounds if ends else 0):
        model = baum_welch_round(train, vocabulary, model, prior)

    by_row = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    kind = "row long, doc_id long, n_tokens long, head_known long, head_base double, symbols double, tail array<struct<word:binary,tf:int>>"
    scored = scratch.save(by_row.mapInArrow(_scored(vocabulary, sc.broadcast(model), sc.broadcast(logp)), kind), "scored")
    rare = (
        scored.select("row", F.explode("tail").alias("x")).select("row", "x.word", "x.tf")
        .join(counts.where(F.col("c") < max(LEAST, head * total)), "word", "left")
        .groupBy("row").agg(
            F.sum("tf").alias("n_tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"),
        )
    )
    n_tail = F.coalesce("n_tail", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0))
    if not ends:
        base, known = F.lit(0.0), F.lit(0).cast("long")
    else:
        base = F.col("head_base") + logs - n_tail * float(np.log10(all_mass))
        known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    return scored.drop("tail").join(rare, "row", "left").select(
        "doc_id", (crc_mod("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("symbols") + logs - n_tail * float(np.log10(tail_mass))).alias("score"),
    )
