"""Operator 5: embedding near-dedup by dual traversal of cover trees.

Vectors are brought to length one; a cosine of at least t is then a distance of at
most sqrt(2 - 2 t). Vectors of one label are dealt to the nearest of that label's
pivots (a bounded sample) and packed into blocks of at most `block` vectors, so a
label with a third of all rows becomes many blocks. A block's cover tree has nested
levels whose radii halve; every node keeps the radius that really covers what is
below it. Pairs of blocks, then pairs of nodes, are pruned where centre distance
minus both radii exceeds the bound, and counted whole where centre distance plus
both radii is under it; leaves are compared by their cosines in double precision.
A task returns counts and a spanning forest of links, never the pairs themselves, so
a group of thousands of copies costs rows in proportion to its vectors.

Only the pivots (one per `block` rows, at most `pivots` per label and 4096 in all) are broadcast.

Defined results: a vector that is null, empty, zero or has a null or non-finite
component, or whose label is null, has no links; vectors of unlike lengths are not
linked; a null vec_id has no links, a null component and is kept; each row counts as
a vector, so rows that share a vec_id link with one another and their links are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import Scratch, ordered_by_hash
from modalflow.llm.components import connected_components

BLOCK, PIVOTS, ALL_PIVOTS = 1024, 32, 4096
LEAF = 48
EPS = 1e-9


class CoverTree:
    """Nested levels over the rows of `x`; nodes are slices of `order`.

    `levels[k]` holds (centres, radii, first, stop, children first, children stop): the
    arrays of all nodes of level k, in the order of their rows.
    """

    def __init__(self, x: np.ndarray):
        self.levels: list[dict[str, np.ndarray]] = []
        order = np.arange(len(x))
        start, stop = np.array([0]), np.array([len(x)])
        radius = 2.0
        while True:
            centre = order[start]
            cover = np.array([np.sqrt(np.maximum(0, 2 - 2 * (x[order[a:b]] @ x[c]))).max() for a, b, c in zip(start, stop, centre, strict=True)])
            self.levels.append({"centre": centre, "radius": cover + EPS, "start": start, "stop": stop})
            radius /= 2
            split = (stop - start > LEAF) & (cover > EPS)
            if not split.any() or radius < 1e-3:
                break
            first, s2, e2 = [], [], []
            for a, b, go in zip(start.tolist(), stop.tolist(), split.tolist(), strict=True):
                first.append(len(s2))
                if not go:
                    s2.append(a)
                    e2.append(b)
                    continue
                rows = order[a:b]
                left = np.arange(len(rows))
                groups = []
                while len(left):
                    d = np.sqrt(np.maximum(0, 2 - 2 * (x[rows[left]] @ x[rows[left[0]]])))
                    groups.append(left[d <= radius])
                    left = left[d > radius]
                at = a
                # Nodes far smaller than a leaf stay together: one loose node of this level holds them.
                tight = [g for g in groups if len(g) >= 8]
                loose = [g for g in groups if len(g) < 8]
                for k in range(0, len(loose), LEAF):
                    tight.append(np.concatenate(loose[k : k + LEAF]))
                new = []
                for g in tight:
                    new.append(rows[g])
                    s2.append(at)
                    at += len(g)
                    e2.append(at)
                order[a:b] = np.concatenate(new)
            first.append(len(s2))
            self.levels[-1]["first"] = np.array(first)
            start, stop = np.array(s2), np.array(e2)
        self.order = order
        self.x = x


def _links(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, least: float) -> np.ndarray:
    """Whether each pair's cosine in double precision is at least `least`."""
    cos = x @ y.T
    out = cos >= least
    i, j = np.nonzero(np.abs(cos - least) < 1e-12)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        u, v = raw_x[a], raw_y[b]
        out[a, b] = float(u @ v) / (np.sqrt(float(u @ u)) * np.sqrt(float(v @ v))) >= least
    return out


def traverse(p: CoverTree, q: CoverTree, raw_p: np.ndarray, raw_q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of p in q, of q in p, and row pairs that connect whatever is linked."""
    bound = np.sqrt(max(0.0, 2 - 2 * least))
    same = p is q
    n_p, n_q = np.zeros(len(p.x), np.int64), np.zeros(len(q.x), np.int64)
    edges: list[tuple[int, int]] = []
    stack = [(0, 0, 0, 0)]
    while stack:
        lp, a, lq, b = stack.pop()
        u, v = p.levels[lp], q.levels[lq]
        rows, cols = p.order[u["start"][a] : u["stop"][a]], q.order[v["start"][b] : v["stop"][b]]
        d = float(np.sqrt(max(0.0, 2 - 2 * float(p.x[u["centre"][a]] @ q.x[v["centre"][b]]))))
        ru, rv = u["radius"][a], v["radius"][b]
        if d - ru - rv > bound + EPS:
            continue
        if d + ru + rv < bound - EPS:
            n_p[rows] += len(cols)
            n_q[cols] += len(rows)
            edges += [(r, cols[0]) for r in rows.tolist()] + [(rows[0], c) for c in cols.tolist()]
            continue
        fine_u = "first" in u and len(rows) > LEAF
        fine_v = "first" in v and len(cols) > LEAF
        # Trees that nothing prunes (few vectors to a node) are compared as one matrix.
        if not (fine_u or fine_v) or (fine_u and not _tight(p, lp, a, bound)) or (fine_v and not _tight(q, lq, b, bound)):
            hit = _links(p.x[rows], q.x[cols], raw_p[rows], raw_q[cols], least)
            n_p[rows] += hit.sum(1)
            n_q[cols] += hit.sum(0)
            if same:
                hit &= rows[:, None] != cols[None, :]
            edges += _forest(hit, rows, cols)
        elif fine_u and (not fine_v or ru >= rv):
            stack += [(lp + 1, k, lq, b) for k in range(u["first"][a], u["first"][a + 1])]
        else:
            stack += [(lp, a, lq + 1, k) for k in range(v["first"][b], v["first"][b + 1])]
    if same:
        n_p -= 1  # a vector is no link of its own
    return n_p, n_q, edges


def _tight(t: CoverTree, level: int, node: int, bound: float) -> bool:
    """Whether a node's children are small enough for bounds to decide anything."""
    u = t.levels[level]
    a, b = u["first"][node], u["first"][node + 1]
    below = t.levels[level + 1]
    size = below["stop"][a:b] - below["start"][a:b]
    return bool(((below["radius"][a:b] < 1.0) * size).sum() * 4 >= size.sum())


def _forest(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same rows and columns as all links in `hit`."""
    out: list[tuple[int, int]] = []
    todo = hit.any(1)
    while todo.any():
        r = int(todo.argmax())
        seen_r, seen_c = np.zeros(len(rows), bool), np.zeros(len(cols), bool)
        new = np.zeros(len(rows), bool)
        new[r] = True
        while new.any():
            seen_r |= new
            at = np.flatnonzero(new)
            cols_new = np.flatnonzero(hit[at].any(0) & ~seen_c)
            if not len(cols_new):
                break
            out += zip(rows[at[hit[at][:, cols_new].argmax(0)]].tolist(), cols[cols_new].tolist(), strict=True)
            seen_c[cols_new] = True
            new = hit[:, cols_new].any(1) & ~seen_r
            at = np.flatnonzero(new)
            out += zip(rows[at].tolist(), cols[cols_new[hit[at][:, cols_new].argmax(1)]].tolist(), strict=True)
        todo &= ~seen_r
    return out


def _pack(pivots: dict, block: int):
    """Rows to blocks: one row per block with ids, raw vectors, the pivot's cell and the block's own covering ball."""
    schema = pa.schema([("grp", pa.string()), ("cell", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[int, np.ndarray]]] = {}

        def out(key: tuple[str, int]) -> pa.RecordBatch:
            got = held.pop(key)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([np.array([i for i, _ in got], np.int64).tobytes()], pa.binary()), pa.array([np.array([v for _, v in got], np.float64).tobytes()], pa.binary()), pa.array([len(got)], pa.int64())],
                schema=schema,
            )

        for b in batches:
            by: dict[str, list[tuple[int, np.ndarray]]] = {}
            for i, label, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding"), strict=True):
                x = np.array([np.nan if e is None else e for e in v.as_py()], np.float64)
                if len(x) and np.isfinite(x).all() and 0 < float(x @ x) < np.inf:
                    by.setdefault(f"{label}/{len(x)}", []).append((i, x))
            for grp, got in by.items():
                x = np.array([v / np.sqrt(v @ v) for _, v in got])
                cells = (x @ pivots[grp].T).argmax(1) if grp in pivots else np.zeros(len(x), int)
                for (i, v), c in zip(got, cells.tolist(), strict=True):
                    rows = held.setdefault((grp, c), [])
                    rows.append((i, v))
                    if len(rows) >= block:
                        yield out((grp, c))
        for key in list(held):
            yield out(key)

    return run


def _merge(block: int):
    """Blocks of a cell that arrive in one task become blocks of at most `block` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out(key, ids, raw):
            x = raw / np.sqrt((raw * raw).sum(1))[:, None]
            mean = x.mean(0)
            mean /= max(np.sqrt(mean @ mean), 1e-300)
            radius = float(np.sqrt(np.maximum(0, 2 - 2 * (x @ mean))).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([int(ids.min())], pa.int64()), pa.array([hashlib.md5(ids.tobytes() + raw.tobytes()).hexdigest()]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([ids.tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary())],
                ["grp", "cell", "low", "name", "mean", "radius", "ids", "vectors"],
            )

        def flush(key, all_):
            ids, raw = (np.concatenate(z) for z in zip(*held[key], strict=True))
            order = np.lexsort((*raw.T[:1], ids))
            ids, raw = ids[order], raw[order]
            whole = len(ids) if all_ else len(ids) // block * block
            for k in range(0, whole, block):
                yield out(key, ids[k : k + block], raw[k : k + block])
            held[key] = [(ids[whole:], raw[whole:])]

        for b in batches:
            for grp, cell, ids, vec in zip(*(b.column(c).to_pylist() for c in ("grp", "cell", "ids", "vectors")), strict=True):
                i = np.frombuffer(ids, np.int64)
                rows = held.setdefault((grp, cell), [])
                rows.append((i, np.frombuffer(vec, np.float64).reshape(len(i), -1)))
                if sum(len(r[0]) for r in rows) >= 4 * block:
                    yield from flush((grp, cell), False)
        for key in held:
            yield from flush(key, True)

    return run


def _compare(least: float):
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[bytes, bytes], tuple[CoverTree, np.ndarray, np.ndarray]] = {}

        def tree(ids: bytes, vec: bytes):
            if (ids, vec) not in trees:
                if len(trees) > 16:
                    trees.clear()
                i = np.frombuffer(ids, np.int64)
                raw = np.frombuffer(vec, np.float64).reshape(len(i), -1)
                trees[ids, vec] = (CoverTree(raw / np.sqrt((raw * raw).sum(1))[:, None]), raw, i)
            return trees[ids, vec]

        for b in batches:
            for ia, va, ib, vb, same in zip(*(b.column(c).to_pylist() for c in ("ids_a", "vec_a", "ids_b", "vec_b", "same")), strict=True):
                p, raw_p, ids_p = tree(ia, va)
                q, raw_q, ids_q = (p, raw_p, ids_p) if same else tree(ib, vb)
                n_p, n_q, edges = traverse(p, q, raw_p, raw_q, least)
                e = np.array(edges, np.int64).reshape(-1, 2)
                vec, n, to = [ids_p[n_p > 0]], [n_p[n_p > 0]], [ids_p[n_p > 0]]
                if not same:
                    vec, n, to = [*vec, ids_q[n_q > 0]], [*n, n_q[n_q > 0]], [*to, ids_q[n_q > 0]]
                a, c = ids_p[e[:, 0]], ids_q[e[:, 1]]
                keep = a != c
                pairs = np.unique(np.stack([a[keep], c[keep]], 1), axis=0)
                vec, n, to = [*vec, pairs[:, 0]], [*n, np.zeros(len(pairs), np.int64)], [*to, pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (vec, n, to)], schema=schema)

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.98, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `embeddings`."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    usable = rows.where("vec_id is not null and embedding is not null and label is not null")
    labels = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(ALL_PIVOTS // pivots).collect()
    chosen: dict[str, list[list[float]]] = {}
    most = {r["label"]: min(pivots, 1 + r["n"] // block) for r in labels}
    if labels:
        # About twice the pivots wanted of each label, by hash bound; labels beyond the limit get one cell each.
        bound = F.create_map(*(F.lit(x) for r in labels for x in (r["label"], min(1 << 30, 2 * pivots * (1 << 30) // r["n"]))))
        sample = usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < bound[F.col("label")]).orderBy(*ordered_by_hash("vec_id")).limit(2 * ALL_PIVOTS)
        for r in sample.collect():
            v = np.array([np.nan if e is None else e for e in r["embedding"]], np.float64)
            if len(v) and np.isfinite(v).all() and 0 < v @ v < np.inf:
                got = chosen.setdefault(f"{r['label']}/{len(v)}", [])
                if len(got) < most[r["label"]]:
                    got.append((v / np.sqrt(v @ v)).tolist())
    cells = {g: np.array(v) for g, v in chosen.items()}
    packed = usable.mapInArrow(_pack(cells, block), "grp string, cell long, ids binary, vectors binary, n long")
    named = "grp string, cell long, low long, name string, mean array<double>, radius double, ids binary, vectors binary"
    packed = scratch.save(packed, "packed")
    # Full blocks stay where they are; only the rest of each task's cells meet, at most one block a task.
    rest = packed.where(F.col("n") < block).repartition(F.col("grp"), F.col("cell"))
    blocks = scratch.save(
        packed.where(F.col("n") >= block).mapInArrow(_merge(block), named).unionByName(rest.mapInArrow(_merge(block), named)), "blocks"
    )

    reach = float(np.sqrt(2 - 2 * least)) + EPS
    light = blocks.select("grp", "name", "mean", "radius")
    left = light.withColumnsRenamed({"name": "name_a", "mean": "mean_a", "radius": "radius_a"})
    right = light.withColumnsRenamed({"name": "name_b", "mean": "mean_b", "radius": "radius_b"})
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("mean_a", "mean_b", lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)))
    near = scratch.save(
        left.join(right, "grp").where(F.col("name_a") <= F.col("name_b")).where(apart - F.col("radius_a") - F.col("radius_b") <= reach).select("name_a", "name_b"), "near"
    )
    body = blocks.select("name", "ids", "vectors")
    work = (
        near.join(body.withColumnsRenamed({"name": "name_a", "ids": "ids_a", "vectors": "vec_a"}), "name_a")
        .join(body.withColumnsRenamed({"name": "name_b", "ids": "ids_b", "vectors": "vec_b"}), "name_b")
        .repartition(F.col("name_a"), F.col("name_b"))
        .select("ids_a", "vec_a", "ids_b", "vec_b", (F.col("name_a") == F.col("name_b")).alias("same"))
    )
    found = scratch.save(work.mapInArrow(_compare(least), "vec_id long, n long, to long"), "found")
    counts = found.where("n > 0").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.where("n = 0").select(F.col("vec_id").alias("a"), F.col("to").alias("b")), scratch)
    return (
        rows.select("vec_id").join(counts, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
u AS (SELECT * FROM v WHERE list_dot_product(x, x) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT t.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.component_id, t.vec_id = m.component_id AS kept
FROM embeddings t LEFT JOIN k ON k.a = t.vec_id JOIN m ON m.node = t.vec_id
"""
