"""Session helpers and batch-vectorised text primitives shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. In local mode alone, where all run in one machine, a temporary one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


# A step's settings: texts go to Python in small batches, shuffle files go once the step's table is written, and tasks keep no more than a rank limit's rows of a group.
STEP = {
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextlib.contextmanager
def step_settings(spark: SparkSession):
    """STEP within, the session's own settings afterwards."""
    before = {k: spark.conf.get(k, None) for k in STEP}
    for k, v in STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, **figures: Column) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder, under STEP, and read it again. Rows are counted as they are written, and any aggregate in `figures` with them (see figure)."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with step_settings(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in figures.items())).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pointloom_path, out._pointloom_figures = path, seen.get
    return out


def figure(table: DataFrame, name: str = "rows"):
    """A figure of a table that materialize() wrote. A task that was run again may add to it once more: bounds by it hold, exact counts are not to be had of it."""
    return getattr(table, "_pointloom_figures", {}).get(name)


def rows_of(table: DataFrame) -> int:
    """An upper bound of the rows of a table that materialize() wrote; the count of any other."""
    seen = figure(table)
    return table.count() if seen is None else seen


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder, bucketed by key, so that steps which group or join by it exchange only the other side; and what deletes it."""
    spark = df.sparkSession
    name = f"pointloom_{uuid.uuid4().hex}"
    buckets = min(buckets, 50_000)
    path = f"{shared_dir(spark)}/{name}"
    with step_settings(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._pointloom_path = path

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        release(out)

    return out, drop


def release(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_pointloom_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


SMALL_ROWS = 1_000_000  # rows of a few numbers each: 8 to 40 MB


def sent(table: DataFrame) -> DataFrame:
    """A written table of few numbers a row, marked to be broadcast while it has at most SMALL_ROWS rows; beyond that the join exchanges both sides."""
    return F.broadcast(table) if rows_of(table) <= SMALL_ROWS else table


MAP_WORDS = 1 << 20  # words of a map of keys, of 64 bits each: about 40 MB where it is sent


def key_join(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """The rows whose `names` equal those of a row of `keys`, a written table (how: left_semi; nulls are equal), or the other rows (left_anti).

    Rows are not exchanged while the keys fit a broadcast. Beyond, a map of their hashes is sent, a bit for each, and only the rows
    whose bit is set meet the keys themselves.
    """
    other = keys.select(*(F.col(c).alias(f"{c}_") for c in names))
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names))
    if rows_of(keys) <= SMALL_ROWS:
        return rows.join(F.broadcast(other), same, how)
    h = f"xxhash64({', '.join(names)})"
    word, bit = F.expr(f"pmod({h}, {MAP_WORDS}L)"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, 58) as int))")
    bits = materialize(keys.select(word.alias("word_"), bit.alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_")))
    columns = [F.col(c) for c in rows.columns]
    marked = rows.select(*columns, word.alias("word_"), bit.alias("bit_")).join(F.broadcast(bits), "word_", "left")  # MAP_WORDS rows at most
    maybe = F.coalesce(F.col("bits_").bitwiseAND(F.col("bit_")) != 0, F.lit(False))
    met = marked.where(maybe).select(*columns).join(other, same, how)
    return met if how == "left_semi" else marked.where(~maybe).select(*columns).union(met)


HOT = 1000  # keys with more than this part of the rows are hot, so there are fewer than HOT of them


def hot_keys(counts: DataFrame, rows: str, keys: list[str]) -> DataFrame:
    """(keys, ways): those of `counts` that hold more than 1/HOT of the sum of `rows`, fewer than HOT by that, and into how many parts to deal each."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    return counts.where(F.col(rows) > max(HOT, total / HOT)).select(*keys, F.ceil(F.col(rows) * HOT / F.lit(float(max(1, total)))).cast("int").alias("ways"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: str) -> DataFrame:
    """Inner join of left and right by keys; a hot key (see hot_keys) of left is dealt by the column `spread`, its rows of right are repeated for each part."""
    hot = F.broadcast(hot)  # fewer than HOT rows
    ways = F.coalesce("ways_", F.lit(1))
    hot = hot.withColumnRenamed("ways", "ways_")
    many = left.join(hot, keys, "left").withColumn("salt_", F.pmod(F.xxhash64(spread), ways).cast("int")).drop("ways_")
    each = right.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways_")
    return many.join(each, [*keys, "salt_"]).drop("salt_")


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5; 0 is the held-out fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def docs_of(docs: DataFrame) -> DataFrame:
    """doc_id and text (null text: empty), other columns dropped."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def hashed(docs: DataFrame) -> DataFrame:
    """docs with _u and _v, the hashes of doc_id and text."""
    return docs.withColumn("_u", F.xxhash64("doc_id")).withColumn("_v", F.xxhash64("text"))


MARGIN = 4  # times the wanted share of hashes that is ranked


def least_hashes(docs: DataFrame, known: DataFrame, count: int, label: str) -> list[tuple]:
    """(text, label) of `count` distinct texts at most for each value of the label: those of `known` (_u, _v, label) with the least hashes.

    Hashes are uniform, so of a value's n distinct texts those below MARGIN * count / n of their range hold the least `count`; only these few are
    ranked, whatever a value's share of the rows. Should they be fewer than wanted, the range is widened. The texts of the chosen rows alone come to the driver.
    """
    first = materialize(known.groupBy("_v", label).agg(F.min("_u").alias("_u")))
    sizes = first.groupBy(label).agg(F.count("*").alias("_n"))
    margin = MARGIN
    while True:
        below = F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(float(margin * count)) / F.col("_n")) * F.lit(2.0**64)
        some = first.join(F.broadcast(sizes), label).where(F.col("_v") <= below)  # a row for each value
        rank = F.row_number().over(Window.partitionBy(label).orderBy("_v", "_u"))
        keys = materialize(some.withColumn("_rank", rank).where(F.col("_rank") <= count).select("_u", "_v", label, "_n"))
        short = keys.groupBy(label, "_n").count().where(F.col("count") < F.least(F.lit(count), F.col("_n"))).limit(1).count()
        if not short and rows_of(keys) or not rows_of(first):
            break
        release(keys)
        margin *= 8
    rows = hashed(docs.select("doc_id", "text")).join(F.broadcast(keys.drop("_n")), ["_u", "_v"]).select("_u", "_v", "text", label)  # keys: count rows at most for each value
    found = {(r["_v"], r[label]): r for r in rows.toLocalIterator()}
    release(first, keys)
    return [(found[k]["text"], found[k][label]) for k in sorted(found)]


# ---- batches ----------------------------------------------------------------

CHUNK_BYTES = 1 << 20


def row_chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges whose sizes add up to about limit; a larger row stands alone."""
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += int(s)
    if lo < len(sizes):
        yield lo, len(sizes)


def text_chunks(batches, limit: int = CHUNK_BYTES):
    """(Arrow rows, list of UTF-8 bytes) for pieces of about limit bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        raw = [x or b"" for x in batch.column("text").cast("binary").to_pylist()]
        for lo, hi in row_chunks(np.fromiter(map(len, raw), np.int64, len(raw)), limit):
            yield batch.slice(lo, hi - lo), raw[lo:hi]


# ---- hashing ----------------------------------------------------------------

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: exclusive-or shifts and multiplications."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Polynomial hash of any byte range of a buffer in constant time, modulo 2**64 with random byte values."""

    def __init__(self, seed: int):
        self.seed = seed
        with np.errstate(over="ignore"):
            self.values = mix(np.arange(1, 257, dtype=np.uint64) * _G + np.uint64(seed))
            self.base = mix(np.array([seed + 77], np.uint64))[0] | np.uint64(1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.pow = self.inv = np.ones(1, np.uint64)

    def __reduce__(self):
        return RollingHash, (self.seed,)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, CHUNK_BYTES)
            for name, b in (("pow", self.base), ("inv", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._powers(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.values[buf] * self.pow[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64) * _G)



@functools.cache
def RollingHash(seed: int) -> _Rolling:  # noqa: N802
    """One for each seed, so that powers are computed once in a process."""
    return _Rolling(seed)


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


class WordBatch:
    """Words of a list of texts: byte ranges start/end in buf, the text's index doc, first[d]:first[d+1] the words of text d.

    kind "space": maximal runs without blanks (0x20, 0x09-0x0D), A-Z in lower case. kind "letter": runs of
    ASCII letters and non-ASCII bytes.
    """

    def __init__(self, raw: list[bytes], kind: str = "space"):
        self.raw_len = np.fromiter(map(len, raw), np.int64, len(raw))
        self.buf = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        inside = ~_SPACES[self.buf] if kind == "space" else _LETTERS[self.buf]
        step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            step = np.concatenate([[0], step])
        self.start, self.end = step[0::2], step[1::2]
        self.text_at = np.concatenate([[0], np.cumsum(self.raw_len + 1)])
        self.first = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.count)

    def hashes(self, rolling: RollingHash) -> np.ndarray:
        return rolling.ranges(rolling.prefix(self.buf), self.start, self.end)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each place; the last n-1 places are missing."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * _G + words[k : k + len(out)] + np.uint64(k))
    return out
