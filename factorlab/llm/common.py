"""Table access, shared intermediate tables and vectorised hashing for the corpus operators.

Kernels run inside Arrow tasks. Their modules are pickled by value, so workers need
neither this package on their path nor a shipped archive.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U64 = np.uint64
#: Odd multipliers of the rolling hashes; any odd value is invertible modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95


def by_value(module: str) -> None:
    """Pickle a kernel module's functions by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a fresh one of our own only where none is set and there is one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-corpus-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: While a table is written: its shuffle files go when the job ends, for the table stands in for them, and rows reach
#: Python in batches of a few megabytes, however long their texts are.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def writing(spark: SparkSession):
    """Settings of a job whose result is kept as a table; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpus/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a table's folder, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discarded(df: DataFrame) -> None:
    """Remove a table that `written` has given."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def unused(name: str, columns: list[str]) -> str:
    """`name`, lengthened until it is none of the columns in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession, factor: int = 2) -> int:
    """Number of chunks or buckets: a multiple of the session's shuffle partitions, which size the job."""
    return max(16, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces(size: int, each: int) -> int:
    """Number of chunks or buckets of about `each` bytes: what a task holds depends neither on the input's size nor on the session."""
    return max(16, -(-size // each))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(units: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of every run of k consecutive units: the same run hashes alike wherever it stands."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(k) if k <= 6 else ():
        acc = acc * U64(base) + units[i : i + n].astype(np.uint64, copy=False)
    if k > 6:
        prefix = np.empty(len(units) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum(units.astype(np.uint64, copy=False) * powers(base, len(units)), out=prefix[1:])
        inverse = pow(base, -1, 1 << 64)
        acc = (prefix[k:] - prefix[:n]) * powers(inverse, n)
    return mix(acc)


def pack_keys(keys: np.ndarray) -> bytes:
    """The upper 56 bits, byte by byte: the leading bytes of sorted keys compress away."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(7, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :7] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def separators(raw: np.ndarray) -> np.ndarray:
    """Mask of the bytes 0x20 and 0x09 to 0x0D."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-separators."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~separators(raw)
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a byte array."""
    starts, ends = word_spans(raw)
    prefix = np.empty(len(raw) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((raw.astype(np.uint64) + U64(1)) * powers(BYTE_BASE, len(raw)), out=prefix[1:])
    inverse = powers(pow(BYTE_BASE, -1, 1 << 64), len(raw) + 1)
    return starts, ends, mix((prefix[ends] - prefix[starts]) * inverse[starts])


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of given spans of a byte array: the same bytes hash alike wherever they stand."""
    prefix = np.empty(len(raw) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((raw.astype(np.uint64) + U64(1)) * powers(BYTE_BASE, len(raw)), out=prefix[1:])
    inverse = powers(pow(BYTE_BASE, -1, 1 << 64), len(raw) + 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def text_groups(texts: list[bytes], limit: int = 1 << 20):
    """Consecutive ranges [lo, hi) of texts of about `limit` bytes, at least one text each."""
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a newline after each as one byte array, and the end of each text in it."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return raw, ends


def as_bytes(column) -> list[bytes]:
    """An Arrow text column as UTF-8; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
