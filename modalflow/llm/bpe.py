"""Operator 1: byte-level BPE encoding and decoding.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel,
each from its own start. Next to a seam both chunks have pre-token boundaries;
from the first boundary they have in common on, they agree (the pattern only
looks ahead), so the text is cut there and the pieces between such cuts are
encoded each on its own. Where an overlap has no common boundary the two chunks
stay one piece. A text of at most one chunk is a piece already and is encoded
where it is read, without a shuffle. Decoding concatenates the tokens' bytes.

Defined results: a null text counts as empty and an empty text has no tokens;
rows that share a doc_id are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalflow.llm.common import parts as in_parts

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: The pattern decides on a match from at most so many characters after its end.
LOOKAHEAD = 8

_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """Ranks and pattern, held once per Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        key = (ranks_path, pattern)
        if key not in _codecs:
            _codecs[key] = cls(*key)
        return _codecs[key]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def boundaries(self, chunk: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(chunk)]


def _ids(codec: Codec, text: str) -> bytes:
    return np.array(codec.encode(text), "<u4").tobytes()


def encode(
    documents: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False
) -> DataFrame:
    """doc_id, ids: the token ids of each row's text as little-endian uint32 bytes; with
    `decoded` also their bytes, decoded from the ids in the same pass.

    `overlap` is at least twice LOOKAHEAD and less than `chunk`. The memory of a task is
    bounded by one text and its ids.
    """
    if not 2 * LOOKAHEAD <= overlap < chunk:
        raise ValueError("2 * LOOKAHEAD <= overlap < chunk is needed")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fits = F.length("text") <= chunk + overlap

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for b in in_parts(batches):
            ids = [_ids(codec, t) for t in b.column("text").to_pylist()]
            more = [pa.array([codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), *more], ["doc_id", "ids", "decoded"][: 2 + decoded])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                row = hashlib.md5(f"{doc_id}\0{text}".encode()).digest()
                for k, at in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.binary()), pa.array([doc_id], b.schema.field("doc_id").type), pa.array([k], pa.int64()), pa.array([text[at : at + chunk + overlap]])],
                        ["row_id", "doc_id", "k", "part"],
                    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for b in batches:
            head, tail = [], []
            for part in b.column("part").to_pylist():
                at = codec.boundaries(part)
                head.append([x for x in at if x < overlap])
                tail.append([x - chunk for x in at if chunk <= x <= len(part) - LOOKAHEAD])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                [*b.schema.names, "head", "tail"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for b in batches:
            ids = []
            for r in b.select(["parts", "to"]).to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["k"])
                text = "".join([p["part"][:chunk] for p in parts[:-1]] + [parts[-1]["part"]])
                end = len(text) if r["to"] is None else chunk * len(parts) + r["to"]
                ids.append(_ids(codec, text[parts[0]["cut"] or 0 : end]))
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("doc_id"), b.column("piece"), pa.array(ids, pa.binary())],
                ["row_id", "doc_id", "piece", "ids"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    short = rows.where(fits).mapInArrow(whole, f"doc_id {kind}, ids binary" + ", decoded binary" * decoded)
    cut_at = rows.where(~fits).mapInArrow(cut, f"row_id binary, doc_id {kind}, k long, part string")
    # A repeated row has the same cuts and the same ids: its chunks count once and it comes back by its number of copies.
    chunks = cut_at.groupBy("row_id", "k").agg(
        F.first("doc_id").alias("doc_id"), F.first("part").alias("part"), F.count(F.lit(1)).alias("copies")
    )
    parts = chunks.select("row_id", "doc_id", "k", "part", "copies").mapInArrow(
        scan, f"row_id binary, doc_id {kind}, k long, part string, copies long, head array<long>, tail array<long>"
    )
    by_row = Window.partitionBy("row_id").orderBy("k")
    seams = parts.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(by_row)))).drop("head", "tail")
    grouped = (
        seams.withColumn("piece", F.count("cut").over(by_row))
        .withColumn("to", F.lead("cut").over(by_row))
        .groupBy("row_id", "piece")
        .agg(
            F.first("doc_id").alias("doc_id"), F.max("copies").alias("copies"),
            F.collect_list(F.struct("k", "part", "cut")).alias("parts"),
            F.max_by("to", "k").alias("to"),
        )
    )
    # Pieces are dealt anew, so that those of one long text are encoded by many tasks.
    pieces = grouped.repartition(F.col("row_id"), F.col("piece"))
    coded = pieces.select("row_id", "doc_id", "piece", "parts", "to").mapInArrow(
        join, f"row_id binary, doc_id {kind}, piece long, ids binary"
    )
    counts = chunks.where("k = 0").select("row_id", "copies")
    long = (
        coded.groupBy("row_id")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
        .join(counts, "row_id")
        .select("doc_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.explode(F.sequence(F.lit(1), "copies")))
        .drop("col")
    )
    return short.unionByName(decode(long, ranks_path, pattern) if decoded else long)


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: the concatenated bytes of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for b in in_parts(batches):
            out = [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digest(documents: DataFrame, ranks_path: str, pattern: str, **kw) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(documents, ranks_path, pattern, decoded=True, **kw).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
