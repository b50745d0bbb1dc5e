"""Operator 2: benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are folded to words; every window of 13 words (or a
whole shorter item) becomes a pattern. All patterns form one automaton, and each
document is scanned once. A match's place in the folded text gives the words it
covers and, through the words' edges, byte offsets in the original text.

Patterns reach the tasks as broadcast text of a checked size: at most `block_bytes`,
as an automaton holds a node for about each byte of each window. A larger benchmark is
dealt into blocks by a hash of the item's text; each row goes through one block after
the other and takes along what the blocks before have found, so any number of blocks
gives the same rows, without a shuffle.

Defined results: a null or empty text has no words, no hits and is clean; an item
without words matches nothing; an item whose id is null is left out; items that
share an id count once; rows are judged one by one, also those that share a doc_id or
have none; very long texts are scanned whole; extra columns, of any name, are passed on.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from modalflow.llm.common import LOWER_ALNUM, Scratch, parts

WINDOW = 13

_automata: dict[bytes, tuple] = {}


def _folded(text: str | None) -> list[str]:
    """Words as latin-1 text: one character for each byte."""
    return [w for w in (text or "").encode().translate(LOWER_ALNUM).decode("latin-1").split(" ") if w]


def _automaton(items: list[tuple[str, str]], window: int):
    key = hashlib.sha256(repr((items, window)).encode()).digest()
    if key not in _automata:
        patterns: dict[str, set[str]] = defaultdict(set)
        size = {}
        for item_id, text in items:
            w = _folded(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                p = " " + " ".join(w[i : i + window]) + " "
                patterns[p].add(item_id)
                size[p] = len(w[i : i + window])
        a = ahocorasick.Automaton()
        for p, ids in patterns.items():
            a.add_word(p, (size[p], tuple(sorted(ids))))
        if patterns:
            a.make_automaton()
        _automata.clear()
        _automata[key] = (a, bool(patterns))
    return _automata[key]


FOUND = pa.struct([
    ("n_words", pa.int64()), ("hit_words", pa.list_(pa.int64())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string())),
])
_FOUND = "struct<n_words:long,hit_words:array<long>,spans:array<struct<start:long,stop:long>>,items:array<string>>"


def _scan(automaton, raw: bytes, before: dict | None) -> dict:
    """What the patterns hit in a folded text, with what earlier blocks have hit."""
    w = raw.split()  # of bytes, which keeps 0x85 and 0xA0
    line = f" {b' '.join(w).decode('latin-1')} "
    found = list(automaton.iter(line)) if automaton is not None and w else []
    if not found:
        return before or {"n_words": len(w), "hit_words": [], "spans": [], "items": []}
    blank = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    hit = np.zeros(len(w), bool)
    named: set[str] = set()
    if before:
        hit[before["hit_words"]] = True
        named.update(before["items"])
    for end, (n, of) in found:
        k = int(np.searchsorted(blank, end))
        hit[k - n : k] = True
        named.update(of)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.frombuffer(raw, np.uint8) != 32).view(np.int8), [0]])))
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    spans = [{"start": int(edge[2 * s]), "stop": int(edge[2 * e - 1])} for s, e in zip(runs[::2], runs[1::2], strict=True)]
    return {"n_words": len(w), "hit_words": np.flatnonzero(hit).tolist(), "spans": spans, "items": sorted(named)}


def _scanner(items: Broadcast, window: int, text_at: int, found_at: int | None):
    """Adds what was found to each row, or brings its column up to date."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, some = _automaton(items.value, window)
        for b in parts(batches):
            before = [None] * b.num_rows if found_at is None else b.column(found_at).to_pylist()
            out = [
                _scan(automaton if some else None, (t or "").encode().translate(LOWER_ALNUM), x)
                for t, x in zip(b.column(text_at).to_pylist(), before, strict=True)
            ]
            columns = [c for k, c in enumerate(b.columns) if k != found_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, FOUND)], [f"c{k}" for k in range(len(columns))] + ["found"])

    return scan


def scanned(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 1 << 20) -> tuple[DataFrame, list[str]]:
    """The rows of `documents` as columns c0, c1, ... and `found`; the names that those columns had."""
    spark = documents.sparkSession
    bench = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    names = documents.columns
    rows = documents.toDF(*(f"c{k}" for k in range(len(names))))
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), *StructType.fromDDL(f"found {_FOUND}")])
    scratch = Scratch(spark) if n > 1 else None
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        items = spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in part.collect()))
        before = rows
        rows = rows.mapInArrow(_scanner(items, window, names.index("text"), len(names) if k else None), schema)
        if k < n - 1:
            rows = scratch.save(rows, "scan")
            if k:
                scratch.free(before)
    return rows, names


def find(documents: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, hit_words (places of hit words), spans (their byte ranges in the
    original text), items (ids, sorted as text)."""
    rows, _ = scanned(documents.select(F.col("doc_id").cast("long"), "text"), benchmark, **kw)
    return rows.select(F.col("c0").alias("doc_id"), "found.*")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of `documents` whose texts are not contaminated, in one narrow pass a block."""
    rows, names = scanned(documents, benchmark, **kw)
    n_hit = F.size("found.hit_words").cast("long")
    bad = (n_hit > 0) & (20 * n_hit >= F.col("found.n_words"))
    return rows.where(~bad).drop("found").toDF(*names)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, p.item FROM g JOIN p ON g.win = p.win AND g.n = p.n),
h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
