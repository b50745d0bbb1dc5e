"""Operator 6: suffix-array dedup of byte strings that an earlier document holds.

A byte goes if a string of `length` bytes that covers it also starts in a document
with a smaller id. Suffixes are never all held at once. A cover sample of them is
chosen by content: of every `length` bytes, the K bytes with the least hash. It is a
difference cover for equal strings: two places with the same `length` bytes have a
sampled suffix at the same distance (residues modulo a fixed number would align only
places of one text). Sampled suffixes are dealt to buckets by their first K bytes and
sorted one bucket at a time, which bounds memory:

1. Each sampled suffix has a rank key, the hash of all that any string of `length`
   bytes around it can touch. Long ties are decided by that key alone: where an
   earlier document has the same key, every string around the sample is a repeat.
2. What remains are the ends of repeated passages: samples whose first K bytes, with
   half of the rest on either side, an earlier document shares too. Only there are the
   strings themselves dealt to buckets and sorted.

Both steps combine in the task that reads a text: of equal keys in one batch only those
of the least document travel, so a passage that a third of all documents hold costs a
row per batch and not per document. Keys are 64-bit hashes of the bytes. Rows that
share a doc_id are one document: they never remove from one another.

Defined results: null counts as empty; texts under `length` bytes lose nothing; a null
doc_id loses nothing and removes nothing; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import Scratch, blocks, mix64, powers, prefix_hash, span_hash

LENGTH = 50
K = 12
BUCKET_BYTES = 12 << 20
BATCH_BYTES = 12 << 20
_NONE = np.uint64(2**64 - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _sliding(v: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over v[i : i + width] for each i, by doubling."""
    k = 1
    while 2 * k <= width:
        v = pick(v[:-k], v[k:])
        k *= 2
    return pick(v[: len(v) - (width - k)], v[width - k :]) if k < width else v


class Block:
    """Texts side by side, with hashes of any span."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.sums = prefix_hash(self.buf)

    def samples(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the buffer) of the sampled suffixes."""
        n, width = len(self.buf), length - K + 1
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inverse = powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), n)
        h = mix64((self.sums[K:] - self.sums[:-K])[: n - K + 1] * inverse[: n - K + 1])
        for end in (self.start + self.size).tolist():  # strings do not cross texts
            h[max(0, end - K + 1) : end + 1] = _NONE
        low = _sliding(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero((_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h) & (h != _NONE))
        text = np.searchsorted(self.start, at, side="right") - 1
        keep = self.size[text] >= length
        return text[keep], at[keep]

    def around(self, text: np.ndarray, at: np.ndarray, left: int, right: int) -> np.ndarray:
        """Hash of the bytes from `left` before to `right` after the places, cut at the text's ends."""
        a = np.maximum(at - left, self.start[text])
        b = np.minimum(at + right, self.start[text] + self.size[text])
        return mix64(span_hash(self.sums, a, b) + (at - a).astype(np.uint64) * _ODD)


def _print16(h: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """16-bit fingerprints; 0 where there is nothing to share. They and the short keys only choose where to look closer."""
    return np.where(ok, np.maximum((h >> np.uint64(48)).astype(np.uint16), np.uint16(1)), np.uint16(0))


def _first_of(key: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal keys: (least document of each row's key, order that groups keys)."""
    order = np.lexsort((doc, *key[::-1]))
    new = np.ones(len(order), bool)
    for k in key:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    least = np.empty(len(order), doc.dtype)
    least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return least, order


#: Columns that travel as differences from one entry of a bucket to the next.
DELTAS = ("doc", "pos")


def _entries(name: str, raw: bytes, kind) -> np.ndarray:
    v = np.frombuffer(raw, kind)
    return np.cumsum(v.view(v.dtype.str.replace("u", "i")), dtype=v.dtype) if name in DELTAS else v


def _deal(bucket: np.ndarray, columns: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """One row per bucket, each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
    rows: dict[str, list] = {"bucket": [int(b[i]) for i in cut[:-1]]}
    for name, v in columns.items():
        v = v[order]
        if name in DELTAS:  # small numbers, which the shuffle's codec packs
            v = v.astype(np.int64 if name == "doc" else np.int32)
            step = np.diff(v, prepend=0)
            step[cut[:-1]] = v[cut[:-1]]
            v = step.astype(v.dtype)
        rows[name] = [v[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * len(rows["bucket"])), f.type) for f in schema], schema=schema)


MOVED = "kind int, bucket long, key binary, rank binary, side binary, doc binary, pos binary, text binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("key", "rank", "side", "doc", "pos", "text"))])


def _rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of a batch in parts of about BATCH_BYTES; rows of a null id are left out."""
    ids = b.column("doc_id").to_pylist()
    texts = [(t or "").encode() if i is not None else b"" for i, t in zip(ids, b.column("text").to_pylist(), strict=True)]
    for at, part in blocks(texts, BATCH_BYTES):
        some = [k for k in range(len(part)) if ids[at + k] is not None]
        yield np.array([ids[at + k] for k in some], np.int64), [part[k] for k in some]


def _sample(n_buckets: int, n_groups: int, length: int):
    """Kind 1: samples by bucket; kind 2: (doc, pos) where everything around a sample is a repeat, by group of documents."""
    half = (length - K + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _rows(b):
                got: list[tuple] = []
                for first, part in blocks(texts):
                    k = Block(part)
                    text, at = k.samples(length)
                    if len(at):
                        left, right = at - k.start[text], k.start[text] + k.size[text] - at
                        side = np.stack([
                            _print16(k.around(text, at, half, K), left >= half), _print16(k.around(text, at, 0, K + half), right >= K + half)
                        ], 1)
                        got.append((span_hash(k.sums, at, at + K), k.around(text, at, length - K, length), side, ids[first + text], left.astype(np.uint32)))
                if not got:
                    continue
                key, rank, side, doc, pos = (np.concatenate(x) for x in zip(*got, strict=True))
                least, _ = _first_of([key, rank], doc)
                yield from _settled(doc[doc > least], pos[doc > least], n_groups)
                go = doc == least
                yield _put(1, _deal((key[go] % np.uint64(n_buckets)).astype(np.int64), {"key": (key[go] >> np.uint64(32)).astype(np.uint32), "rank": (rank[go] >> np.uint64(32)).astype(np.uint32), "side": np.column_stack([side[go], (rank[go] & np.uint64(0xFFFF)).astype(np.uint16)]), "doc": doc[go], "pos": pos[go]}, _SCHEMA))

    return run


def _put(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
    return b.set_column(0, "kind", pa.array([kind] * b.num_rows, pa.int32()))


def _group_of(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix64(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _settled(doc: np.ndarray, pos: np.ndarray, n_groups: int, kind: int = 2, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(doc):
        yield _put(kind, _deal(_group_of(doc, n_groups), {"doc": doc, "pos": pos, **more}, _SCHEMA))


def _buckets(batches: Iterator[pa.RecordBatch], kind: int, columns: dict[str, tuple]) -> Iterator[dict[str, np.ndarray] | pa.RecordBatch]:
    """Arrays of one bucket after the other (rows come sorted by bucket); rows of another kind as they are."""
    held: list[dict] = []
    now = None

    def out() -> dict[str, np.ndarray]:
        return {c: np.concatenate([_entries(c, h[c], t).reshape(-1, *s) for h in held]) for c, (t, *s) in columns.items()}

    for b in batches:
        own = pc.equal(b.column("kind"), kind)
        if (other := b.filter(pc.invert(own))).num_rows:
            yield other
        for r in b.filter(own).to_pylist():
            if r["bucket"] != now and held:
                yield out()
                held = []
            now = r["bucket"]
            held.append(r)
    if held:
        yield out()


def _sort_samples(n_groups: int):
    """Samples of a bucket to repeats (kind 2) and to the ends of passages (kind 3: side tells which strings to look at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _buckets(batches, 1, {"key": (np.uint32,), "rank": (np.uint32,), "side": (np.uint16, 3), "doc": (np.int64,), "pos": (np.uint32,)}):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            # 48 bits of the rank travel; with the key's 32 and the bucket they tell strings apart.
            key, doc = x["key"], x["doc"]
            least, _ = _first_of([key, x["rank"], x["side"][:, 2]], doc)
            yield from _settled(doc[doc > least], x["pos"][doc > least], n_groups)
            open_ = np.flatnonzero(doc == least)
            look = np.zeros(len(open_), np.uint8)
            for bit in (0, 1):
                some = open_[x["side"][open_, bit] > 0]
                place = np.flatnonzero(x["side"][open_, bit] > 0)
                if len(some):
                    s = x["side"][some, bit]
                    low, order = _first_of([key[some], s], doc[some])
                    high = -_first_of([key[some], s], -doc[some])[0]
                    look[place[low < high]] |= 1 << bit
            go = look > 0
            yield from _settled(doc[open_[go]], x["pos"][open_[go]], n_groups, 3, side=look[go])

    return run


def _strings(n_buckets: int, n_groups: int, length: int):
    """The strings at the ends of passages, by bucket (kind 1), once the texts have met what is asked of them."""
    half = (length - K + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        texts: list[tuple[int, bytes]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            got = []
            for first, part in blocks([t for _, t in texts]):
                k = Block(part)
                for j in range(len(part)):
                    doc = texts[first + j][0]
                    for pos, side in wanted.get(doc, ()):
                        s = np.arange(length - K + 1)
                        ok = ((side[:, None] & 1) > 0) & (s >= half) | ((side[:, None] & 2) > 0) & (length - K - s >= half)
                        at = pos[:, None].astype(np.int64) - s
                        at = np.unique(at[ok & (at >= 0) & (at + length <= k.size[j])])
                        if len(at):
                            g = at + k.start[j]
                            got.append((span_hash(k.sums, g, g + length), np.full(len(at), doc), at.astype(np.uint32)))
            texts.clear()
            if got:
                key, doc, pos = (np.concatenate(x) for x in zip(*got, strict=True))
                least, _ = _first_of([key], doc)
                yield from _settled(doc[doc > least], pos[doc > least], n_groups, 4)
                go = doc == least
                yield _put(1, _deal((key[go] % np.uint64(n_buckets)).astype(np.int64), {"key": key[go], "doc": doc[go], "pos": pos[go]}, _SCHEMA))

        now = None
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now:
                    yield from out()
                    wanted, now, size = {}, r["bucket"], 0
                if r["kind"] == 3:
                    doc = _entries("doc", r["doc"], np.int64)
                    pos, side = _entries("pos", r["pos"], np.uint32), np.frombuffer(r["side"], np.uint8)
                    order = np.argsort(doc, kind="stable")
                    d = doc[order]
                    cut = np.flatnonzero(np.diff(d, prepend=d[0] - 1, append=d[-1] + 1))
                    for s, e in zip(cut[:-1], cut[1:], strict=True):
                        wanted.setdefault(int(d[s]), []).append((pos[order[s:e]], side[order[s:e]]))
                elif r["doc"] is not None and (doc := int(np.frombuffer(r["doc"], np.int64)[0])) in wanted:
                    texts.append((doc, r["text"]))
                    size += len(r["text"])
                    if size > BATCH_BYTES:
                        yield from out()
                        size = 0
        yield from out()

    return run


def _sort_strings(n_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _buckets(batches, 1, {"key": (np.uint64,), "doc": (np.int64,), "pos": (np.uint32,)}):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            least, _ = _first_of([x["key"]], x["doc"])
            late = x["doc"] > least
            yield from _settled(x["doc"][late], x["pos"][late], n_groups, 4)

    return run


def _cut(length: int):
    """Texts without what repeats; the rows of a group come with the places first."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list[tuple[int, np.ndarray]]] = {}
        now = None
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for r in b.to_pylist():
                if r["bucket"] != now:
                    places, now = {}, r["bucket"]
                if r["kind"] != 9:
                    doc, pos = _entries("doc", r["doc"], np.int64), _entries("pos", r["pos"], np.uint32)
                    order = np.argsort(doc, kind="stable")
                    d = doc[order]
                    cut = np.flatnonzero(np.diff(d, prepend=d[0] - 1, append=d[-1] + 1))
                    for s, e in zip(cut[:-1], cut[1:], strict=True):
                        places.setdefault(int(d[s]), []).append((r["kind"], pos[order[s:e]].astype(np.int64)))
                    continue
                doc, text = (None if r["doc"] is None else int(np.frombuffer(r["doc"], np.int64)[0])), r["text"]
                n = len(text)
                delta = np.zeros(n + 1, np.int32)
                for kind, pos in places.get(doc, ()) if n >= length else ():
                    # Of a sample (kind 2) all strings around it are repeats, of kind 4 the one that starts here.
                    np.add.at(delta, np.maximum(pos - (length - K), 0) if kind == 2 else pos, 1)
                    np.add.at(delta, np.minimum(pos + length, n), -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                for col, v in zip(out, (doc, n, edge[::2].tolist(), edge[1::2].tolist(), np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edge) else text), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, starts, stops (removed byte ranges), kept (remaining bytes)."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(16, -(-total // BUCKET_BYTES))
    by_bucket = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")

    settled = scratch.save(by_bucket(docs.mapInArrow(_sample(n, n, length), MOVED)).mapInArrow(_sort_samples(n), MOVED), "settled")
    _release(spark)
    texts = docs.select(
        F.lit(9).alias("kind"), "doc_id", F.col("text").cast("binary").alias("text")
    ).mapInArrow(_grouped(n), MOVED)
    strings = scratch.save(by_bucket(settled.where("kind = 3").unionByName(texts)).mapInArrow(_strings(n, n, length), MOVED), "strings")
    _release(spark)
    more = scratch.save(by_bucket(strings).mapInArrow(_sort_strings(n), MOVED), "more")
    scratch.free(strings)
    _release(spark)
    return by_bucket(settled.where("kind = 2").unionByName(more).unionByName(texts)).mapInArrow(
        _cut(length), "doc_id long, n_bytes long, starts array<long>, stops array<long>, kept binary"
    )


def _grouped(n: int):
    """Texts with the group of their id, as `_settled` deals places; a null id has group 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            group = _group_of(np.array([i or 0 for i in ids], np.int64), n)
            doc = [None if i is None else np.int64(i).tobytes() for i in ids]
            cols = {"kind": b.column("kind"), "bucket": pa.array(group), "doc": pa.array(doc, pa.binary()), "text": b.column("text")}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(b.num_rows, f.type)) for f in _SCHEMA], schema=_SCHEMA)

    return run


def _release(spark) -> None:
    """Let Spark drop the shuffle files of the steps that are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def digest(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return dedup(documents, length).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple[int | None, int, int, int, str]]:
    """The definition, for small inputs."""
    first: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        if i is not None:
            for k in range(len(t) - length + 1):
                s = t[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1 if i is not None else 0):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


#: The rows of `digest` for unique doc_ids. Strings are taken as hexadecimal digits from pieces of 1,000 bytes.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
p AS (SELECT doc_id, k * 1000 AS base, substr(h, k * 2000 + 1, 2098) AS c FROM n, unnest(range(0, (n_bytes + 999) // 1000)) AS r(k)),
s AS MATERIALIZED (SELECT doc_id, base + i AS pos, substr(c, 2 * i + 1, 100) AS w FROM p, unnest(range(0, least(1000, length(c) // 2 - 49))) AS r(i)),
m AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
x AS (SELECT s.doc_id, s.pos FROM s JOIN m ON s.w = m.w WHERE s.doc_id > m.first),
y AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM y),
g AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM z GROUP BY doc_id, run),
k AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS a, a AS b
  FROM (SELECT doc_id, a, b FROM g UNION ALL SELECT doc_id, n_bytes, n_bytes + 1 FROM n)),
c AS (SELECT k.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept, count(*) - 1 AS n_spans FROM k JOIN n ON n.doc_id = k.doc_id GROUP BY 1)
SELECT n.doc_id, n_bytes, n_bytes - length(kept) // 2 AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN c ON c.doc_id = n.doc_id
"""
