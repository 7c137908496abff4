"""What the training-data operators share: words, checkpoints and small SQL expressions."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.shared import folder

#: White space that separates words; everything else belongs to a word.
SPACES = "\t\n\x0b\x0c\r "
LEAST_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text: runs of anything but space, tab, newline, VT, FF and CR; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACES[:-1]:  # replace() and a split by one character are several times as fast as translate() and a pattern
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bound(value: Column, then) -> Column:
    """then(value), with value computed once even where a lambda inside uses it for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def id_key(column: Column) -> Column:
    """A join key for an id: null counts as the smallest id."""
    return F.coalesce(column.cast("long"), F.lit(LEAST_ID))


def mixed(x: Column, seed: int) -> Column:
    """Two rounds of a linear congruence: 31 bits, the same in any SQL engine."""
    m = 1 << 31
    v = (F.pmod(x, F.lit(m)) * 1103515245 + (12345 + seed)) % m
    return (v.bitwiseXOR(F.shiftright(v, 15)) * 48271 + 11) % m


def mixed_sql(x: str, seed: int) -> str:
    m = 1 << 31
    v = f"(((({x}) % {m} + {m}) % {m} * 1103515245 + {12345 + seed}) % {m})"
    return f"((xor({v}, {v} >> 15) * 48271 + 11) % {m})"


_made: ContextVar[list | None] = ContextVar("made", default=None)
_collected = 0.0
#: Seconds after which the driver's JVM collects again.
COLLECT = 5


def saved(df: DataFrame, sweep: bool = False) -> DataFrame:
    """The rows, computed once and written as a table in the shared checkpoint folder; lineage ends there.

    The driver's JVM collects every COLLECT seconds, which keeps its heap small. With sweep it does so in any case, so that what was
    shuffled for the table is let go at once.
    """
    global _collected
    spark = df.sparkSession
    path = f"{folder(spark)}/slatewise-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    if sweep or time.monotonic() - _collected > COLLECT:
        # the cleaner drops the files of frames that the JVM has let go, some of which only a second collection finds
        for _ in range(2 if sweep else 1):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2 if sweep else 0)
        _collected = time.monotonic()
    out = spark.read.schema(schema).parquet(path)
    out.saved_at = path
    if _made.get() is not None:
        _made.get().append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of saved() whose last reader has been written."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def finished(make: Callable[[], DataFrame], sweep: bool = False) -> DataFrame:
    """saved(make()), and all other tables that saved() wrote for it deleted."""
    outer, made, done = _made.get(), [], None
    token = _made.set(made)
    try:
        done = saved(make(), sweep)
    finally:
        _made.reset(token)
        discard(*[t for t in made if t is not done])
    if outer is not None:
        outer.append(done)
    return done
