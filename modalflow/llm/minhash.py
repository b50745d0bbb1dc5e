"""Operator 9: MinHash near-dedup with an LSH forest.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Documents
of equal word sequences form one class, so copies cost one row each. A class has 128
MinHash values, of which each of 32 orders takes twelve, beginning with four of its
own. Each order is sorted as a whole: ranges of the sorted rows are the tasks, so a
region (classes that share the first four values), however large, is split among many.

1. Longest-common-prefix neighbours. The rows next to a class in an order share the
   longest prefix with it: up to twelve values deep in a crowded region, four in a
   sparse one. The NEAR neighbours of the deepest prefixes, over all orders, are a
   class's first candidates, which joins groups of near copies at a cost in proportion
   to their members.
2. The rest, without loss. Where a region still holds members of several components,
   all pairs of different components are compared by their 128 values, in blocks of
   members; a pair counts in the first order that it shares. Members that resemble
   another component's take their full sets to the same blocks, and are confirmed there.

So pairs never travel, only members. A region of many sets that are much alike but not
linked still costs a comparison for each pair of them, in blocks that many tasks share.
Two sets of similarity 0.75 miss each other in all 32 orders with probability
(1 - 0.75 ** 4) ** 32, 5e-6, and agree in fewer than 71 of 128 values about as rarely.
Every link is confirmed on the full sets.

Defined results: a null text or one without words is linked with nothing; with fewer
than five words the sequence is the one shingle; rows that share a doc_id are one
document for links, and each row comes back; a null doc_id is linked with nothing,
has a null component and is kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import LOWER_SPACE, Scratch, blocks, mix64, parts, prefix_hash, span_hash, word_block
from modalflow.llm.components import connected_components

N_HASHES, ORDERS, LEAD = 128, 32, 4
SHINGLE = 5
PERCENT = 75
#: Values of an order that follow its lead and tell how deep neighbours agree.
TAIL = 8
#: First candidates of a class.
NEAR = 3
#: Of the 128 values, so many agree at a similarity of 0.75 but for about once in 200,000.
AGREE = 71
#: Members of a block: an eighth of the region between these bounds, and about so many bytes.
BLOCK, BLOCK_SETS = (256, 2048), 8 << 20
#: Tasks that share the members of one region in a join.
SALTS = 8

_rng = np.random.default_rng(20240101)
_MUL = (_rng.integers(0, 1 << 32, N_HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_block(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of all texts, number of shingles of each text)."""
    buf, starts, ends, count = word_block(texts, LOWER_SPACE)
    words = span_hash(prefix_hash(buf), starts, ends)
    if not len(words):
        return words, np.zeros(len(texts), np.int64)
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    total = int(shingles.sum())
    at = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(total)
    width = np.minimum(np.repeat(count, shingles), n)
    h = np.zeros(total, np.uint64)
    last = len(words) - 1
    for k in range(n):
        nxt = mix64(h * _STEP + words[np.minimum(at + k, last)])
        h = np.where(k < width, nxt, h) if k and (width < n).any() else nxt
    return h, shingles


def signatures(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """MinHash values, one row per text that has shingles."""
    start = (np.cumsum(shingles) - shingles)[shingles > 0]
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), N_HASHES), np.uint32)
    for k in range(N_HASHES):
        out[:, k] = np.minimum.reduceat(low * _MUL[k] + _ADD[k], start)
    return out


def sort_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lead, tail) of each class (row) in each order (column): the first four values, 16 bits each, and the next eight, 8 bits each."""
    v = sig.astype(np.uint64)
    at = LEAD * np.arange(ORDERS)
    lead, tail = np.zeros((2, len(sig), ORDERS), np.uint64)
    for d in range(LEAD):
        lead = lead << np.uint64(16) | v[:, (at + d) % N_HASHES] & np.uint64(0xFFFF)
    for d in range(LEAD, LEAD + TAIL):
        tail = tail << np.uint64(8) | v[:, (at + d) % N_HASHES] & np.uint64(0xFF)
    return lead.view(np.int64), tail.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        for at, part in blocks(texts):
            h, shingles = shingle_block(part)
            owner = np.repeat(np.arange(len(part)), shingles)
            order = np.lexsort((h, owner))
            ho, oo = h[order], owner[order]
            new = np.ones(len(ho), bool)
            new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
            size = np.bincount(oo[new], minlength=len(part)) if len(ho) else np.zeros(len(part), np.int64)
            keys = [hashlib.md5(b" ".join(t.translate(LOWER_SPACE).split())).digest() if n else None for t, n in zip(part, shingles.tolist(), strict=True)]
            sig = np.zeros((len(part), N_HASHES), np.uint32)
            if len(h):
                sig[shingles > 0] = signatures(h, shingles)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, len(part)), pa.array(size.astype(np.int64)), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "n_shingles", "key", "sig"],
            )


def _signatures(column: pa.Array, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, N_HASHES)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        if b.num_rows:
            lead, tail = sort_keys(_signatures(b.column("sig")))
            rep = np.repeat(b.column("rep").to_numpy(), ORDERS)
            ord_ = np.tile(np.arange(ORDERS, dtype=np.int32), len(lead))
            yield pa.RecordBatch.from_arrays([pa.array(ord_), pa.array(lead.ravel()), pa.array(tail.ravel()), pa.array(rep)], ["ord", "lead", "tail", "rep"])


def _depth(tail: np.ndarray) -> np.ndarray:
    """Values that adjacent rows of one lead share."""
    x = (tail[1:] ^ tail[:-1]).view(np.uint64)
    return LEAD + sum(((x >> np.uint64(64 - 8 * k)) == 0 for k in range(1, TAIL)), np.zeros(len(x), np.int32)) + (x == 0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted rows of one task, those that share their lead with a neighbour, and the task's first and last row."""

    def out(ord_, lead, tail, rep, first, last) -> pa.RecordBatch:
        same = (ord_[1:] == ord_[:-1]) & (lead[1:] == lead[:-1])
        depth = np.where(same, _depth(tail), 0)
        before, after = np.concatenate([[0], depth]), np.concatenate([depth, [0]])
        keep = (before > 0) | (after > 0)
        keep[0] |= first
        keep[-1] |= last
        lo, hi = (0 if first else 1), (len(rep) if last else len(rep) - 1)
        keep[:lo] = keep[hi:] = False
        prev, nxt = np.concatenate([rep[:1], rep[:-1]]), np.concatenate([rep[1:], rep[-1:]])
        return pa.RecordBatch.from_arrays(
            [pa.array(v[keep]) for v in (ord_, lead, rep, prev, before.astype(np.int32), nxt, after.astype(np.int32))],
            ["ord", "lead", "rep", "prev", "prev_depth", "next", "next_depth"],
        )

    held: list[np.ndarray] | None = None
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(c).to_numpy() for c in ("ord", "lead", "tail", "rep")]
        if held is not None:
            # The last two rows of what came before: one that lacks its next neighbour, and its previous one.
            new = [np.concatenate([h, v]) for h, v in zip(held, new, strict=True)]
        if len(new[0]) > 1:
            yield out(*new, first, False)
            first = False
            held = [v[-2:] for v in new]
        else:
            held = new
    if held is not None:
        yield out(*held, first, True)


def regions(classes: DataFrame) -> DataFrame:
    """ord, lead, rep and its neighbours in the sorted order with the depths of the prefixes that they share."""
    rows = classes.select("rep", "sig").mapInArrow(_deal, "ord int, lead long, tail long, rep long")
    by = ["ord", "lead", "tail", "rep"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _neighbours, "ord int, lead long, rep long, prev long, prev_depth int, next long, next_depth int"
    )


def _resemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for b in parts(batches):
        if b.num_rows:
            keep = (_signatures(b.column("sig_a"), np.uint16) == _signatures(b.column("sig_b"), np.uint16)).sum(1) >= AGREE
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low 16 bits of each MinHash value: what agrees in full agrees here."""
    for b in parts(batches):
        if b.num_rows:
            sig = _signatures(b.column("sig")).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array([s.tobytes() for s in sig], pa.binary())], ["rep", "n", "sig"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch and full set (sorted 64-bit hashes) of each text that has words."""
    for b in parts(batches):
        texts = [t.encode() for t in b.column("text").to_pylist()]
        for at, part in blocks(texts):
            h, n = shingle_block(part)
            some = np.flatnonzero(n)
            if len(some):
                sig = signatures(h, n).astype(np.uint16)
                sets = [np.unique(x).tobytes() for x in np.split(h, np.cumsum(n)[:-1]) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep").take(pa.array(at + some)), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(sets, pa.binary())], ["rep", "sig", "of_set"]
                )


def _sets(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    out = []
    for _, part in blocks(raw):
        h, n = shingle_block(part)
        out += [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 256):
            c = b.slice(s, 256)
            left, right = c.column("text_a").to_pylist(), c.column("text_b").to_pylist()
            distinct = {t: None for t in (*left, *right)}
            sets = dict(zip(distinct, _sets(list(distinct)), strict=True))
            keep = []
            for t, u in zip(left, right, strict=True):
                x, y = sets[t], sets[u]
                small = 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small else 0
                keep.append(small and both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.column(k).filter(pa.array(keep, pa.bool_())) for k in ("a", "b")], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts(rep, text)."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_confirm, "a long, b long")


def profile(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (of the word sequence, null without words), sig."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_profile, "doc_id long, n_shingles long, key binary, sig binary")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `documents`."""
    scratch = Scratch(documents.sparkSession)
    rows = scratch.save(profile(documents), "profile")
    known = rows.where("key is not null and doc_id is not null")
    classes = scratch.save(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), "classes")
    docs = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").where("doc_id is not null and text is not null")

    member = scratch.save(regions(classes), "member")
    sketch = scratch.save(classes.join(member.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "sig").mapInArrow(_sketch, "rep long, n long, sig binary"), "sketch")
    pairs = _nearest(member)
    alike = scratch.save(
        pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sketch.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .mapInArrow(_resemble, "a long, b long").distinct(), "alike",
    )
    # The ids are joined in sorted order at every size, as they grow with the texts.
    ids = alike.select(F.col("a").alias("rep")).unionByName(alike.select(F.col("b").alias("rep"))).distinct().hint("merge")
    texts = scratch.save(docs.join(ids, "rep", "left_semi"), "texts")
    links = scratch.save(confirmed(alike, texts), "links")
    scratch.free(texts, alike)
    comps = connected_components(links, scratch)

    size = sketch.groupBy("rep").agg((8 * F.sum("n")).alias("bytes"))
    named = size.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "bytes", F.coalesce("comp", "rep").alias("comp"))
    labelled = scratch.save(member.select("ord", "lead", "rep").join(named, "rep"), "labelled")
    scratch.free(member)
    small = labelled.withColumn("bytes", F.lit(2 * N_HASHES).cast("long"))
    open_ = scratch.save(
        _by_cell(_explode(_cells(small).join(sketch.drop("n"), "rep"), "sig"), _alike, "ord int, lead long, rep long").distinct(), "open"
    )
    if open_.limit(1).count():
        found = labelled.join(open_, ["ord", "lead", "rep"], "left_semi")
        sets = docs.join(open_.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInArrow(_full, "rep long, sig binary, of_set binary")
        more = scratch.save(_by_cell(_explode(_cells(found).join(sets, "rep"), "sig", "of_set"), _linked, "a long, b long").distinct(), "joined")
        # Components join components: a graph of few nodes.
        whole = connected_components(more, scratch).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
        comps = (
            comps.unionByName(whole.select(F.col("comp").alias("node"), "comp")).distinct()
            .join(whole, "comp", "left").groupBy("node").agg(F.min(F.coalesce("whole", "comp")).alias("comp"))
        )
    scratch.free(labelled, sketch, open_)

    of_key = classes.select("key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("component"))
    return (
        rows.select("doc_id", "n_shingles", "key").join(of_key, "key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _nearest(member: DataFrame) -> DataFrame:
    """a < b: each class with the neighbours of its deepest prefixes over all orders, those that are neighbours in most orders first."""
    both = F.array(F.struct(F.col("prev").alias("by"), F.col("prev_depth").alias("depth")), F.struct(F.col("next").alias("by"), F.col("next_depth").alias("depth")))
    near = F.sort_array(F.collect_list(F.struct("depth", "by")), False)
    return (
        member.select("rep", F.explode(both).alias("x")).select("rep", "x.*").where("depth > 0 and by <> rep")
        .groupBy("rep", "by").agg(F.sum("depth").alias("depth")).groupBy("rep").agg(F.slice(near, 1, NEAR).alias("near"))
        .select("rep", F.explode("near.by").alias("by"))
        .select(F.least("rep", "by").alias("a"), F.greatest("rep", "by").alias("b")).distinct()
    )


def _cells(members: DataFrame) -> DataFrame:
    """rep, of: the cells of each member (ord, lead, rep, comp, bytes) of a region that holds several components.

    The largest component of a region and the other members are dealt into blocks; a
    cell holds two blocks, and no cell is needed for two blocks of the largest component.
    """
    n, top = F.col("n"), F.col("top.c")
    size = F.least(F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), n / 8)), F.greatest(F.lit(1), F.floor(BLOCK_SETS * n / F.col("bytes"))))
    region = (
        members.groupBy("ord", "lead", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes")).groupBy("ord", "lead")
        .agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"), F.sum("bytes").alias("bytes")).where(n > top)
        .withColumn("size", size)
        # A region of one block needs no second one.
        .select(
            "ord", "lead", F.col("top.comp").alias("main"), F.when(n <= F.col("size"), 0).otherwise(F.ceil(top / F.col("size"))).cast("int").alias("m"),
            F.when(n <= F.col("size"), 1).otherwise(F.ceil((n - top) / F.col("size"))).cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        )
    )
    m, o, block, dealt = F.col("m"), F.col("o"), F.col("block"), F.xxhash64("rep")
    others = F.transform(F.sequence(m, m + o - 1), lambda j: F.struct(F.least(block, j).alias("x"), F.greatest(block, j).alias("y")))
    mains = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: i < m), lambda i: F.struct(i.alias("x"), block.alias("y")))
    return (
        members.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(SALTS)).cast("int")).join(region, ["ord", "lead", "salt"])
        .withColumn("block", F.when((F.col("comp") == F.col("main")) & (m > 0), F.pmod(dealt, m)).otherwise(m + F.pmod(dealt, o)).cast("int"))
        .withColumn("cells", F.when(block < m, others).otherwise(F.concat(mains, others)))
        .groupBy("rep").agg(F.collect_list(F.struct("ord", "lead", "comp", "block", "cells")).alias("of"))
    )


def _explode(members: DataFrame, *carried: str) -> DataFrame:
    """One row for each cell of a member: what it carries meets its cells once."""
    return (
        members.select("rep", *carried, F.explode("of").alias("of")).select("rep", *carried, "of.*")
        .select("rep", *carried, "ord", "lead", "comp", "block", F.explode("cells").alias("cell")).select("rep", *carried, "ord", "lead", "comp", "block", "cell.*")
    )


def _by_cell(rows: DataFrame, of_cell, schema: str) -> DataFrame:
    """of_cell(ord, lead, x, y, columns) over the rows of each cell, which lie together in one task."""
    names = schema.replace(" int", "").replace(" long", "").split(", ")
    cell = ["ord", "lead", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None

        def out() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 or held and held[0].num_rows > 1:
                t = pa.Table.from_batches(held)
                got = of_cell(*now, {c: t.column(c) for c in t.column_names if c not in cell})
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays(got, names)

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in cell])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for s, e in itertools.pairwise([0, *cut.tolist(), b.num_rows]):
                if (key := tuple(keys[:, s].tolist())) != now:
                    yield from out()
                    held, now = [], key
                held.append(b.slice(s, e - s))
        yield from out()

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, schema)


def _pairs(order: int, x: int, y: int, of: dict[str, pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, values that agree) of pairs of different components that agree often enough and share no earlier order."""
    comp, block = of["comp"].to_numpy(), of["block"].to_numpy()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    out = comp[left][:, None] == comp[right]
    if x == y:
        out |= np.tri(len(left), dtype=bool)
    if out.all():
        return (np.zeros(0, np.int64),) * 3
    sig = _signatures(of["sig"], np.uint16)
    u, v = np.ascontiguousarray(sig[left].T), np.ascontiguousarray(sig[right].T)
    agree = np.zeros((len(left), len(right)), np.uint8)
    for o in range(ORDERS):
        shared = np.ones(agree.shape, bool)
        for k in range(o * LEAD, (o + 1) * LEAD):
            same = u[k][:, None] == v[k]
            agree += same
            shared &= same
        if o < order:
            out |= shared
    agree[out] = 0
    i, j = np.nonzero(agree >= AGREE)
    return left[i], right[j], agree[i, j]


def _alike(order: int, lead: int, x: int, y: int, of: dict[str, pa.ChunkedArray]) -> list[pa.Array]:
    """Members of a cell that resemble one of another component."""
    i, j, _ = _pairs(order, x, y, of)
    rep = np.unique(of["rep"].to_numpy()[np.concatenate([i, j])])
    return [pa.array([order] * len(rep), pa.int32()), pa.array([lead] * len(rep), pa.int64()), pa.array(rep, pa.int64())]


def _linked(order: int, lead: int, x: int, y: int, of: dict[str, pa.ChunkedArray]) -> list[pa.Array]:
    """Pairs of components that links of a cell join: the pairs that resemble each other most come first, and none that is joined by then."""
    i, j, agree = _pairs(order, x, y, of)
    comp = of["comp"].to_pylist()
    raw = of["of_set"].to_pylist() if len(i) else []
    root = {c: c for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    a, b = [], []
    for least, most in ((112, 129), (96, 112), (84, 96), (AGREE, 84)):
        now = (agree >= least) & (agree < most)
        if not now.any():
            continue
        rows, cut = np.unique(i[now], return_index=True)  # pairs come sorted by their first row
        for r, with_ in zip(rows.tolist(), np.split(j[now], cut[1:]), strict=True):
            own_root = find(comp[r])
            others = [k for k in with_.tolist() if find(comp[k]) != own_root]
            if not others:
                continue
            own = np.frombuffer(raw[r], np.uint64)
            sizes = np.array([len(raw[k]) // 8 for k in others])
            every = np.frombuffer(b"".join([raw[k] for k in others]), np.uint64)
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            for k in np.flatnonzero(100 * both >= PERCENT * (len(own) + sizes - both)).tolist():
                p, q = find(comp[r]), find(comp[others[k]])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(min(p, q))
                    b.append(max(p, q))
    return [pa.array(a, pa.int64()), pa.array(b, pa.int64())]


def keep_first(documents: DataFrame, **kw) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all columns."""
    drop = near_duplicates(documents, **kw).where(~F.col("kept")).select("doc_id").distinct()
    return documents.join(drop, "doc_id", "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""
