"""Shared plumbing: scratch tables, NumPy text blocks, labelled samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in NumPy blocks of about this many bytes, which fit a CPU cache.
BLOCK_BYTES = 1 << 18

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower-cases A-Z and maps white space (0x20, 0x09-0x0D) to 0x20.
LOWER_SPACE = bytes(32 if c == 32 or 9 <= c <= 13 else _LOWER[c] for c in range(256))
#: Lower-cases A-Z and maps every ASCII byte but letters and digits to 0x20.
LOWER_ALNUM = bytes(
    c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in _LOWER
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the folder that the cluster shares.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local session
    that has none gets a temporary one. A table that is written and read again
    has no lineage, so a lost executor costs no more than the current step.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="modalflow-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = f"file://{folder}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.root = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[1])
            path.getFileSystem(conf).delete(path, True)


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; a null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def ordered_by_hash(column: str) -> list[F.Column]:
    return [F.xxhash64(column), F.col(column)]


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
    rows: int, max_bytes: int = 1 << 16,
) -> tuple[list[int], list[str], np.ndarray]:
    """At most `rows` labelled training texts of at most `max_bytes` bytes, by hash order.

    Only ids travel to the bounded sort; texts of the chosen rows alone reach the
    driver. Both bounds are parameters of the fit, not of the scoring.
    """
    train = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("y").isNotNull() & (crc_mod("doc_id", modulus) != held_out))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(*ordered_by_hash("doc_id")).limit(rows)
    )
    got = (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
        .join(F.broadcast(train), "doc_id")
        .toPandas().sort_values(["doc_id", "text"])
    )
    return got["doc_id"].tolist(), got["text"].tolist(), got["y"].to_numpy(dtype=float)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts, which bounds what a worker holds beside its input."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes together, with the index of the first."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        a = np.full(max(n, 2 * BLOCK_BYTES), base, np.uint64)
        a[0] = 1
        got = _powers[base] = np.multiply.accumulate(a)
        if n > 1 << 22:
            del _powers[base]
    return got[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] = sum of (byte + 1) * P ** position over s <= position < e."""
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(_P, len(buf)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal wherever the bytes are equal."""
    return mix64((s[end] - s[start]) * powers(_P_INV, len(s))[start])


def word_block(texts: list[bytes], fold: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, word starts, word ends, words of each text) of texts folded to 0x20-separated words."""
    buf = np.frombuffer(b" ".join(texts).translate(fold) + b" ", np.uint8)
    word = buf != 32
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, at)
    return buf, starts, ends, np.diff(upto, prepend=0)
