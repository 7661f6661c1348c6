"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are held as numpy arrays at one time.
SLICE_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Unset is an error on a cluster; a local master (tests,
    benches) gets /tmp/checkpoints."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return "/tmp/checkpoints"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet (by the session's compression, or ``codec``) into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the table behind a DataFrame of ``materialize`` that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def row_key(*cols: str) -> list[Column]:
    """Two never-null longs that identify the values of ``cols`` (a 128-bit content key): rows with equal values share
    it, which is what rows without a trustworthy id are joined back by."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(salt), *parts).alias(f"_k{i}") for i, salt in enumerate(("left", "right"))]


def per_batch(df: DataFrame, fn, schema: str) -> DataFrame:
    """Map slices of Arrow batches: ``fn(dict of column name -> list)`` returns a dict of lists in the order of
    ``schema``. A slice holds a bounded number of characters, or one row."""
    names = df.columns
    out = pa_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch):
                part = batch.slice(lo, hi - lo)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(got.values(), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def slices(batch: pa.RecordBatch):
    """(from, to) of runs of rows, cut where about SLICE_BYTES of text have come together."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(n, int(n * SLICE_BYTES / max(1, batch.nbytes))))
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


# -- hashing words with numpy ------------------------------------------------------------------------------------

#: Fixed odd multipliers of the polynomial hashes (any odd numbers do), one for each independent hash.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each values[start:end], from prefix sums of a polynomial."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(base))


class Words:
    """The words of a list of texts in numpy arrays: ``doc`` (text index of each word), ``first`` (index of the first
    word of each text, and one past the last), ``hash(base)``."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        self.bytes = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        white = (self.bytes == 32) | ((self.bytes >= 9) & (self.bytes <= 13))
        edge = np.diff(np.concatenate(([True], white)).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hash(self, base: int) -> np.ndarray:
        return range_hashes(self.bytes.astype(np.uint64) + np.uint64(1), self.start, self.end, base)

    def windows(self, k: int) -> np.ndarray:
        """Word index of every start of k consecutive words of one text."""
        n = len(self.doc)
        if n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
