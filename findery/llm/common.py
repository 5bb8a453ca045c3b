"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes to bytes: A-Z to a-z, everything ASCII but letters and digits to a space.
#: Bytes from 0x80 belong to words, so UTF-8 text can be cut without decoding it.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: Bytes to bytes: A-Z to a-z only.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="findery-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Rows of text in an Arrow batch, unless the session says otherwise: whole texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_ROWS rows where the session has Spark's default of 10,000.

    A batch stands in the memory of the executor and of its worker, more than once in each.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def stored_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/findery-{spark.sparkContext.applicationId}"


def discard_stored(spark: SparkSession) -> None:
    """Remove what this application has stored; results that are still to be read need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stored_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{stored_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Slots of a filter of bits, 64 bits each: one a key up to so many, which bounds what is broadcast.
MOST_SLOTS = 1 << 20


def bits_of(keys: DataFrame) -> tuple[DataFrame, int]:
    """(slot, bits) of a column of hashes h, and the number of slots."""
    slots = min(MOST_SLOTS, max(64, 1 << (keys.count() - 1).bit_length()))
    place = F.pmod("h", F.lit(slots)).alias("_slot")
    # the bit is taken from above the bits that choose the slot
    return stored(keys.groupBy(place).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(h, 24) & 63 as int)))").alias("_bits"))), slots


def among(rows: DataFrame, bits: tuple[DataFrame, int], inside: bool = True) -> DataFrame:
    """The rows whose hash h may be among the keys of the bits, which none of the keys' rows misses; or the others."""
    table, slots = bits
    joined = rows.join(F.broadcast(table), F.pmod("h", F.lit(slots)) == F.col("_slot"), "inner" if inside else "left")
    bit = F.expr("getbit(_bits, cast(shiftrightunsigned(h, 24) & 63 as int))")
    return joined.where(bit == 1 if inside else F.coalesce(bit, F.lit(0)) == 0).drop("_slot", "_bits")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression, so that lambdas don't evaluate it for each element."""
    return F.transform(F.array(value), body)[0]


def _trim() -> None:
    """Let the C library return free pages, where it has a call for it."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def releasing(run: Callable) -> Callable:
    """A function of Arrow batches that gives memory it no longer uses back when its task ends: workers live on."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, text_hash): whole rows as one struct, so that no column of theirs can clash with an operator's."""
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    return rows.select("row", F.col("row")[id_col].alias("doc"), F.xxhash64(text).alias("text_hash"))


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, the latter as UTF-8 bytes (null stays null)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("body"))


#: Elements that one fold of running() adds up; a fold copies what it has got at each step.
FOLDED = 64


def running(numbers: Column) -> Column:
    """The sums of an array of int up to each element, in two levels of folds, so that time is all but linear in its size."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    fold = lambda xs: F.aggregate(xs, start, add, lambda acc: acc["out"])

    def parts(xs: Column) -> Column:
        last = lambda k: F.least(F.size(xs), (k + 1) * FOLDED) - 1
        part = lambda k: F.transform(F.sequence(k * FOLDED, last(k)), lambda i: F.get(xs, i))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / FOLDED).cast("int")), lambda k: fold(part(k)))

    def joined(sums: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), fold(F.transform(sums, lambda s: F.element_at(s, -1))))
        return F.flatten(F.zip_with(sums, F.slice(before, 1, F.size(sums)), lambda s, b: F.transform(s, lambda x: x + b)))

    return let(numbers, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(parts(xs), joined)))


def match_spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,hit>> of the leftmost, non-overlapping, non-empty matches.

    start and end count code points, end exclusive. What lies between the matches gives their places,
    so that no Python is needed. Null text gives null.
    """
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def placed(hits: Column, gaps: Column) -> Column:
        steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.length(g) + F.length(h))
        span = lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit"))
        return F.zip_with(hits, running(steps), span)

    return let(
        F.regexp_extract_all(text, pat, F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, empty).otherwise(placed(hits, F.split(text, pat, -1))),
    )


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def kept_spans(text: Column, kind: str, rank: int, pattern: str, test: Callable[[Column], Column] | None = None) -> Column:
    """SPAN of the matches of one kind that pass the test on their text; null text gives null."""
    hits = match_spans(text, pattern)
    if test is not None:
        hits = F.filter(hits, lambda h: F.coalesce(test(h["hit"]), F.lit(False)))
    return F.transform(
        hits, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, by start and then rank, comma-joined."""
    ordered = F.array_sort(spans)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(ordered, text), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
