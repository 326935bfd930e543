"""What the training-data operators share: reading, word hashing, shared tables and Arrow mapping.

Words are maximal runs of characters outside space and U+0009..U+000D. In UTF-8 these six separators are the very
bytes that ``bytes.split()`` splits at, and ``bytes.lower()`` changes A-Z only, so words are taken from the encoded text.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Entries that a worker's memo of words holds before it starts anew. It bounds memory; results don't depend on it.
MEMO = 400_000
#: Rows of an Arrow batch of whole texts.
BATCH = 1000
#: Bits in a row of a sieve, as bitmap_construct_agg makes them; bits of a sieve for each id, and rows it has at most (16 MB).
ROW, SIEVE_BITS, SIEVE_ROWS = 1 << 15, 64, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, so that no other column of the input can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


# --- tables in the folder that driver and executors share ---------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster, an error, as executors share no local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='docugrain-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the JVM ended before us: the cluster's own clean-up has it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docugrain-{uuid.uuid4().hex}/{name}"
    atexit.register(_forget, spark, path.rpartition("/")[0])
    return path


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes tables that cut wrote, once their last reader is done."""
    for t in tables:
        remove(t.sparkSession, t.written_at.rpartition("/")[0])


# --- rows by id, without a shuffle of what they carry ---------------------------------------------------------------


def sieve(ids: DataFrame) -> tuple[DataFrame, int]:
    """Bitmap of the hashed ids (long, one column, any may be repeated) in rows (sieve_row, sieve_bits), and its width. It is broadcast, so it has a bound; above that more rows of other ids pass."""
    id_col = ids.columns[0]
    n = ids.agg(F.approx_count_distinct(id_col)).first()[0]
    width = ROW * min(SIEVE_ROWS, 1 + SIEVE_BITS * n // ROW)
    place = F.pmod(F.xxhash64(id_col), F.lit(width).cast("long"))
    return ids.groupBy(F.floor(place / ROW).alias("sieve_row")).agg(F.bitmap_construct_agg(place % ROW).alias("sieve_bits")), width


def sifted(rows: DataFrame, id_col: str, by: tuple[DataFrame, int], held: bool = True) -> DataFrame:
    """Rows whose id the sieve may hold (all whose id it was made of, and a few others), or the rest of them, which it surely doesn't. No sieve holds null."""
    bits, width = by
    place = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(width).cast("long"))
    byte = F.conv(F.hex(F.substring("sieve_bits", F.floor(place % ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.col(id_col).isNotNull() & (F.getbit(byte, (place % 8).cast("int")) == 1), F.lit(False))
    out = rows.join(F.broadcast(bits), F.floor(place / ROW) == F.col("sieve_row"), "left")
    return out.where(found if held else ~found).drop("sieve_row", "sieve_bits")


# --- Arrow -------------------------------------------------------------------------------------------------------


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold ``BATCH`` rows at most, a smaller setting stays: a batch is held by Spark, on its way and by the worker. Results don't depend on it."""
    at = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(at)) <= BATCH:
        spark.conf.set(at, str(BATCH))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[dict] | dict]], schema: str) -> DataFrame:
    """mapInArrow over df. make() runs once in each task and returns a function from a batch to columns, as a dict."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                got = each(batch)
                yield pa.RecordBatch.from_arrays([_array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The column's strings, one at a time, so that a batch is never held twice."""
    for x in batch.column(column):
        yield x.as_py() or ""


# --- hashing -----------------------------------------------------------------------------------------------------


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def odd(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, size=n, dtype=U64) * U64(2) + U64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of so many words; one of the whole sequence where it is shorter, none where it is empty."""
    n = min(size, len(hashes))
    if not n:
        return hashes[:0]
    factors = odd(size, 5)
    total = hashes[: len(hashes) - n + 1] * factors[0]
    for k in range(1, n):
        total = total + hashes[k : len(hashes) - n + 1 + k] * factors[k]
    return mix(total + U64(n))
