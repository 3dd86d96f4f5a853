"""Shared helpers: durable intermediate tables, byte hashing and word finding with numpy."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

U64 = np.uint64
FULL = U64(0xFFFFFFFFFFFFFFFF)

# ---------------------------------------------------------------- durable intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent on one machine (tests) a temporary folder is made and set; executors
    elsewhere could not read it, so a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="netlytics-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{path}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the re-read of a file, never the recomputation of
    what went before.  Tables stay until :func:`clean` or the end of the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netlytics-llm/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application (results must have been written by then)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/netlytics-llm/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``: rows are counted by default, and texts can be long.  A smaller setting of the user's stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(key)) or 0) > BATCH_BYTES or not conf.get(key).isdigit():
        conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a common finaliser)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def digests(raw, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit BLAKE2 digests of byte spans [start, end); equality of texts is decided by these."""
    view, blake = memoryview(raw), hashlib.blake2b
    out = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    pairs = np.frombuffer(out, U64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_LONG = 64


def span_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time are mixed in; spans over ``_LONG`` bytes take half a digest."""
    if not len(start):
        return np.zeros(0, U64)
    padded = np.zeros(len(a) + 8, np.uint8)
    padded[: len(a)] = a
    eight = np.ndarray((len(a) + 1,), U64, buffer=padded, strides=(1,))
    size = end - start
    h = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(size <= _LONG)
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > _LONG)
    if len(long):
        h[long] = digests(a, start[long], end[long])[0]
    return h


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.RandomState(7).randint(1, 2**63 - 1, 256).astype(U64) * U64(2) + U64(1)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (the table grows as needed)."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0][0]) if _powers else 0)
        up, down = np.ones(size, U64), np.ones(size, U64)
        np.multiply.accumulate(np.full(size - 1, _BASE, U64), out=up[1:])
        np.multiply.accumulate(np.full(size - 1, pow(_BASE, -1, 2**64), U64), out=down[1:])
        _powers[:] = [(up, down)]
    return _powers[0][0][:n], _powers[0][1][:n]


def gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """A rolling hash of the ``gram`` bytes from each position on.

    Equal grams have equal hashes.  Different ones can, too (sums of powers modulo 2**64 have such texts),
    so these only choose where texts meet and never say that they are equal.
    """
    c = np.zeros(len(a) + 1, U64)
    up, down = powers(len(a) + 1)
    np.cumsum(byte_table()[a] * up[: len(a)], dtype=U64, out=c[1:])
    return mix((c[gram:] - c[: len(c) - gram]) * down[: len(c) - gram])


# ---------------------------------------------------------------- words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(value: object) -> bytes:
    """UTF-8 bytes of an Arrow string scalar; null is empty."""
    buffer = value.as_buffer() if value.is_valid else None
    return b"" if buffer is None else buffer


def lower_ascii(a: np.ndarray) -> np.ndarray:
    return _LOWER[a]


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without ``[\\x20\\x09-\\x0D]``."""
    inside = np.zeros(len(a) + 2, np.int8)
    np.logical_not(_SPACE[a], out=inside[1:-1], casting="unsafe")
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ---------------------------------------------------------------- samples to learn from


def labelled_sample(docs: DataFrame, known: DataFrame, *, id_col: str, text_col: str, max_labelled: int, max_bytes: int) -> DataFrame:
    """(text, label, id): whole texts of at most ``max_labelled`` ids of ``known`` (id, label), in the order of a hash of the ids, and of at most ``max_bytes`` together.

    Texts over a 64th of ``max_bytes`` come last, so that one very long text cannot take the place of all others.  Of rows that share an id the least text counts.
    """
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most max_labelled rows of two numbers
    rows = rows.groupBy("id").agg(F.min(F.struct("text", "label")).alias("one")).select("one.text", "one.label", F.xxhash64("id").alias("id"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = rows.select("id", size.alias("size"))
    order = Window.orderBy(F.col("size") > max_bytes // 64, "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # max_labelled pairs of numbers
    fit = sizes.withColumn("all", F.sum("size").over(order)).where(F.col("all") <= max_bytes).select("id")
    return rows.join(F.broadcast(fit), "id", "left_semi").select("text", "label", "id")


# ---------------------------------------------------------------- columns and rows


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def has_odd_ids(df: DataFrame, id_col: str) -> bool:
    """Whether some rows have no id or one that another row has, too."""
    return not df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("id IS NULL OR n > 1").isEmpty()


def with_rows(df: DataFrame, row: str, *, id_col: str, text_col: str, nulls_last: bool = True) -> tuple[DataFrame, bool]:
    """``df`` with a long ``row`` that differs in all rows and has the order of the ids, and whether it is the id itself.

    Distinct integers are taken as they are.  Other ids (of another type, absent, or shared by several rows) are
    sorted once, and the rows are written with their places, so that a row keeps its place if it is computed again.
    """
    if isinstance(df.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType) and not has_odd_ids(df, id_col):
        return df.withColumn(row, F.col(id_col).cast("long")), True
    order = F.col(id_col).asc_nulls_last() if nulls_last else F.col(id_col).asc_nulls_first()
    return materialize(df.orderBy(order, text_col).withColumn(row, F.monotonically_increasing_id()), "rows"), False
