"""Shared pieces of the corpus operators: scratch storage, texts in batches, token patterns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import ship

#: Rows that are handled together in a Python worker, so that its memory follows this and not the Arrow batch.
SLICE_ROWS = 256


def scratch_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: `spark.checkpoint.dir`, or a temp folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_sluice_scratch", None) or tempfile.mkdtemp(prefix="sluice-scratch-")
        spark.sparkContext._sluice_scratch = found
    return found if re.match(r"\w+:", found) else f"file://{found}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what `materialise` wrote for `df`, which nothing may read any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if not folder.toString().startswith(scratch_root(spark).replace("file://", "file:")) and not folder.toString().startswith(scratch_root(spark)):
            raise ValueError(f"{folder} is not a scratch table")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A key with more than this part of a table's rows is hot; there are fewer such keys than its inverse.
HOT_PART = 1 / 10_000


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], n: str, n_rows: int) -> DataFrame:
    """Inner join of `rows` with `one`, which has one row for each key and in column `n` the number of the key's rows, out
    of `n_rows`. Hot keys, of which there are fewer than 1 / HOT_PART whatever the table's size, are broadcast; the others
    are shuffled, and none of them has more than a ten-thousandth of the rows. `n` is dropped."""
    limit = max(1, int(n_rows * HOT_PART))
    hot, cold = one.where(F.col(n) > limit).drop(n), one.where(F.col(n) <= limit).drop(n)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return met.unionByName(rest)


#: What each module's functions keep in a worker between tasks: models and memos.
_KEPT: dict[str, dict] = {}


def kept_by(module: str) -> dict:
    """A dictionary for what a module keeps between tasks; a worker that is given another module's function empties it."""
    return _KEPT.setdefault(module, {})


def _alone(func: Callable, *args: object) -> Iterator[pa.RecordBatch]:
    """`func(*args)` in a worker without what functions of other modules kept, so that memory doesn't add up over the
    operators of an application, whose tasks take turns in the same workers."""
    stale = [kept for module, kept in _KEPT.items() if module != func.__module__ and kept]
    for kept in stale:
        kept.clear()
    if stale:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
        if trim is not None:
            trim(0)
    return func(*args)


def map_arrow(df: DataFrame, func: Callable, schema: str, *args: object, barrier: bool = False) -> DataFrame:
    """mapInArrow of the module-level `func(*args, batches)`; workers import it, so its module keeps state between tasks (`kept_by`)."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_alone, func, *args), schema, barrier)


def precedence(rows: DataFrame, key: str, row: str) -> Column:
    """By what rows of a group come first: the smallest key; null keys come last, rows of equal keys go by the hash of their columns."""
    plain = [f.name for f in rows.schema if f.name != row and not re.search(r"map<|variant", f.dataType.simpleString())]
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(*plain).alias("hash"), F.col(row).alias("row"))


def one_of_each(rows: DataFrame, group: str, row: str, key: str) -> DataFrame:
    """Of each group the row that comes first by `precedence`."""
    chosen = rows.groupBy(group).agg(F.min(precedence(rows.drop(group), key, row)).alias("_first")).select(F.col("_first.row").alias(row))
    return rows.join(chosen, row, "left_semi").drop(group, row)


#: Bits of a filter's bitmap (a row of 4 KB), bits for each value that a filter holds, and most bitmaps of a filter, 64 MB together.
BITMAP, BITS_EACH, MOST_BITMAPS = 32768, 16, 16384


def sift(rows: DataFrame, values: DataFrame, name: str, clear: bool = False) -> DataFrame:
    """The rows of which the value in `name` may be among `values` (a written table): all that are, and of others about one in 16; or,
    with `clear`, the rows that are not among them for certain, which are all the others.

    Spares wide rows a shuffle before an exact join. The filter has a hashed bit for each value. It is broadcast and has at most
    MOST_BITMAPS bitmaps; with more values it lets more rows through, and the join that follows does more, with the same result.
    Null values aren't among any.
    """
    bitmaps = min(MOST_BITMAPS, max(1, -(-values.count() * BITS_EACH // BITMAP)))
    slot = F.pmod(F.xxhash64(name, F.lit("sift")), F.lit(bitmaps * BITMAP)) + 1
    bits = values.select(F.bitmap_bucket_number(slot).alias("_bitmap"), F.bitmap_bit_position(slot).alias("_bit")).repartition("_bitmap")
    bits = bits.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    met = rows.withColumn("_bitmap", F.bitmap_bucket_number(slot)).withColumn("_bit", F.bitmap_bit_position(slot)).join(F.broadcast(bits), "_bitmap", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.expr("_bit % 8").cast("int"), F.lit(0))
    found = F.coalesce(F.call_function("bit_get", byte, may) == 1, F.lit(False)) & F.col(name).isNotNull()
    return met.where(~found if clear else found).drop("_bitmap", "_bit", "_bits")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class SharedModel:
    """A broadcast model with a name by which workers keep what they derive from it."""

    def __init__(self, spark: SparkSession, model: object):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.bid = self.broadcast._jbroadcast.id() if self.broadcast._jbroadcast is not None else id(model)

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "bid": self.bid}

    @property
    def value(self) -> object:
        return self.broadcast.value


#: The letters, digits and white space of Unicode below U+0250.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
#: A text with none of these has only characters that the classes above tell apart (U+2010 to U+205E, but for
#: the space characters there, are punctuation).
_BEYOND = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def narrow(text: str) -> bool:
    """Whether the explicit classes above describe every character of `text`."""
    return text.isascii() or not _BEYOND.search(text)


def explicit_pattern(pattern: str) -> re.Pattern:
    """`pattern` with Unicode classes spelt out, for the faster standard engine; right for narrow texts only."""
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"[\p{L}]", f"[{_L}]").replace(r"[\p{N}]", f"[{_N}]")
    spelt = spelt.replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]").replace(r"\S", f"[^{_S}]").replace(r"\s", f"[{_S}]")
    return re.compile(spelt)


class Splitter:
    """findall of a tokenizer's split pattern, by the faster engine where both agree."""

    def __init__(self, pattern: str):
        self.fast = explicit_pattern(pattern).findall
        self.full = regex.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if narrow(text) else self.full(text)
