"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to n consecutive words, hashed into buckets. A bucket's gain is the
logarithm of its share in the target over its share in the corpus, a document's weight the mean gain of its
features. Documents are drawn without replacement by their weight and seeded Gumbel noise, the largest first.

A text of more than CHUNK bytes is cut at word boundaries into chunks that tasks take on their own: a
chunk owns the features that start in it and carries the n - 1 words after it, so that no feature is lost at a cut or
counted twice. Counts of buckets come from all chunks, and features and gains of chunks are summed by document.
Texts of one chunk are counted where they are read; only chunks of longer ones move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.llm.common import finished, saved, table
from slatewise.shipping import ship

#: Bytes of a chunk's own words, about.
CHUNK = 1 << 16
#: Texts read at a time.
AT_ONCE = 1000

#: Small letters for large ones, a space for all other ASCII but digits and small letters; bytes of other characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def chunks(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
    """(own, carried) words of each chunk of a text, separated by spaces."""
    plain = text.translate(_PLAIN)
    at = 0
    while at < len(plain) or at == 0:
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        carried = b" ".join(m.group() for m in islice(_WORD.finditer(plain, end), n - 1))
        yield plain[at:end], carried
        at = max(end, 1)


def hashes(own: bytes, carried: bytes, n: int) -> tuple[int, list[int]]:
    """Number of a chunk's own words, and the CRC-32 of each run of 1 to n words that starts with one of them."""
    mine = own.split()
    words = mine + carried.split()
    last = list(map(crc32, mine))
    out = list(last)
    for k in range(1, n):
        last = [crc32(b" " + w, h) for w, h in zip(words[k : k + len(mine)], last)]
        out += last
    return len(mine), out


def features(texts: DataFrame, n: int, buckets: int, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """row, columns, n_words, found (the bucket of each feature) of each chunk of texts, which has columns and text; written.

    row numbers the rows of texts; a row has as many rows here as its text has chunks, one at least. A null text has no words.
    """
    ship(texts.sparkSession)
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in columns)
    width = len(columns) + 1

    def record(rows, parts, numbers: list[int], counted: list[tuple[int, list[int]]], raw: list[tuple]) -> pa.RecordBatch:
        kept = rows.take(pa.array(numbers, pa.int64()))
        lists = pa.array([None if c is None else np.array(c[1], np.int64) % buckets for c in counted], pa.list_(pa.int32()))
        tail = [pa.array(parts, pa.int32()), pa.array([None if c is None else c[0] for c in counted], pa.int64()), lists]
        tail += [pa.array([None if r is None else r[k] for r in raw], pa.binary()) for k in (0, 1)]
        names = [*rows.schema.names[:width], "part", "n_words", "found", "own", "carried"]
        return pa.RecordBatch.from_arrays([*kept.columns[:width], *tail], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), AT_ONCE):
                rows, parts, numbers, counted, raw = batch.slice(at, AT_ONCE), [], [], [], []
                for k, text in enumerate(rows.column(width)):
                    whole = (text.as_py() or "").encode("utf-8", "replace")
                    single = len(whole) <= chunk
                    for part, (own, carried) in enumerate(chunks(whole, n, max(chunk, 1))):
                        parts.append(part)
                        numbers.append(k)
                        counted.append(hashes(own, carried, n) if single else None)
                        raw.append(None if single else (own, carried))
                        if len(raw) >= AT_ONCE:
                            yield record(rows, parts, numbers, counted, raw)
                            parts, numbers, counted, raw = [], [], [], []
                yield record(rows, parts, numbers, counted, raw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(width + 3).to_pylist(), batch.column(width + 4).to_pylist())
            yield record(batch, batch.column(width), list(range(batch.num_rows)), [hashes(o, c, n) for o, c in pairs], [None] * batch.num_rows)

    schema = f"row bigint, {kinds}, part int, n_words bigint, found array<int>, own binary, carried binary"
    head = [F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in columns], "text"]
    cut_up = saved(texts.select(*head).mapInArrow(cut, schema))
    long = cut_up.where("own IS NOT NULL").repartition("row", "part").mapInArrow(count, schema)
    return saved(cut_up.where("own IS NULL").unionByName(long).drop("own", "carried", "part"))


def bucket_counts(found: DataFrame) -> DataFrame:
    """bucket, n of features()."""
    return found.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket, from two tables of bucket_counts(). One row a bucket comes to the driver: buckets bounds them."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    side = lambda df, name: df.withColumnRenamed("n", name)
    joined = every.join(side(corpus, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left").fillna(0)
    rows = joined.select("bucket", "s", "t").toPandas().sort_values("bucket")
    s, t = rows["s"].to_numpy(np.float64), rows["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _floored(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(0)


def weighted(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs against the texts of target. See resampled()."""
    found = features(docs.select("doc_id", "text"), n, buckets, ["doc_id"], chunk)
    wanted = features(target.select(F.lit(0).alias("side"), "text"), n, buckets, ["side"], chunk)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(found), bucket_counts(wanted), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain.value[lists.values.to_numpy()[ends[0] : ends[-1]]])])[ends - ends[0]]
            columns = [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(np.diff(sums).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "n_features", "gain"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = found.mapInArrow(run, f"row bigint, doc_id {kind}, n_words bigint, n_features bigint, gain bigint")
    per = parts.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    return per.select("doc_id", "n_words", "n_features", _floored(F.col("gain"), F.col("n_features")).alias("weight"))


def noisy(weight: Column, doc_id: Column, seed: int) -> Column:
    """The weight with Gumbel noise, in thousandths, from the seed and the id; an id that is missing counts as the text null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.expr("-1000.0D") * F.log(-F.log((h + F.expr("0.5D")) / F.expr("4294967296.0D"))))


def resampled(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs, drawn towards the texts of target.

    Words are runs of digits, letters and all that isn't ASCII, A-Z lower-cased. Of the rows with at least
    least_words words the floored percentage with the highest scores is drawn: rank is 1, 2, 3... in falling score, ties
    to the smaller doc_id, those without an id first; null for rows that aren't drawn. Null texts have no features and
    weight 0. Rows that share an id are drawn on their own, and equal rows get ranks next to each other. Empty tables give
    no rows, or no gain from the target but for the corpus's own shares. Other columns are not looked at.

    Ranks need no sort of all rows: equal rows are counted, counts of scores (whole thousandths of a
    logarithm: some 100,000 values at most, whatever the table) say how many rows are above each, and rows of one score
    are numbered among themselves.
    """
    def counted() -> DataFrame:
        w = weighted(docs, target, n, buckets, chunk)
        score = noisy(F.col("weight"), F.col("doc_id"), seed).alias("score")
        scored = w.select("doc_id", "n_features", "weight", score, (F.col("n_words") >= least_words).alias("able"))
        return scored.groupBy("doc_id", "n_features", "weight", "score", "able").agg(F.count(F.lit(1)).alias("copies"))

    rows = finished(counted)
    able = rows.where("able")
    per = able.groupBy("score").agg(F.sum("copies").alias("here"))
    falling = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = per.select("score", F.coalesce(F.sum("here").over(falling), F.lit(0)).alias("above"), F.expr(f"{percent} * sum(here) OVER () DIV 100").alias("k"))
    drawn = saved(above.where("above < k"))
    lowest = drawn.agg(F.min("score")).first()[0]
    chosen = F.lit(False) if lowest is None else F.col("able") & (F.col("score") >= lowest)
    same = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.where(chosen).join(F.broadcast(drawn), "score").withColumn("above", F.col("above") + F.coalesce(F.sum("copies").over(same), F.lit(0)))
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("one")
    ranked = near.select("doc_id", "n_features", "weight", "score", "above", "k", each)
    place = F.col("above") + F.col("one")
    ranked = ranked.select("doc_id", "n_features", "weight", "score", F.when(place <= F.col("k"), place).alias("rank"))
    rest = rows.where(~chosen).select("doc_id", "n_features", "weight", "score", each)
    return ranked.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resampled() of all documents towards the texts of benchmark: single words, 10,000 buckets, 10 percent of those with 20 words."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of the 16 half bytes (reflected polynomial 0xEDB88320).
_NIBBLES = """0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108"""
_HASHED = """
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(trim(regexp_replace(hex(encode(word)), '(.)(.)', '\\2 \\1 ', 'g')), ' '), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, x: xor(c >> 4, halves[CAST(xor(c, x) & 15 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), nibbles"""
_WORDS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
OP11_SQL = f"""
WITH nibbles AS (SELECT [{_NIBBLES}]::BIGINT[] AS halves),
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
own AS (SELECT r, {_WORDS} AS word FROM rows), wanted AS (SELECT {_WORDS} AS word FROM benchmark),
words AS (SELECT word FROM own UNION ALL SELECT word FROM wanted),
hashed AS ({_HASHED}),
s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket
), per AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM own JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r
), weights AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features,
    CAST(coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight
  FROM rows LEFT JOIN per USING (r)
), scored AS (
  SELECT *, weight + CAST(floor(-1000::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
    + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weights
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, 10 * count(*) OVER () // 100 AS k FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
