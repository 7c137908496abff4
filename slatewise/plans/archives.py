"""Queries of archives: their bytes are put together from orders by SQL functions and read back by the archive reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.plans.fixtures import table
from slatewise.sources import archive


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), 2, "0")


def _varint(x: Column) -> Column:
    """Hex of a number below 2^35. Its bytes are put together as one number, whose first digit is 8 at least where there are several."""
    x = x.cast("bigint")

    def written(n: int) -> Column:
        out = F.shiftright(x, 7 * (n - 1))
        for i in range(n - 1):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(x, 7 * i).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128)), 8 * (n - 1 - i)))
        return F.hex(out)

    out = F.when(x < 1 << 7, F.lpad(F.hex(x), 2, "0"))
    for n in range(2, 5):
        out = out.when(x < 1 << 7 * n, written(n))
    return out.otherwise(written(5))


def _size(hexed: Column) -> Column:
    return F.shiftright(F.octet_length(hexed), 1)


def _tag(field: int, kind: int) -> Column:
    """A tag of one byte."""
    return F.lit(f"{field * 8 + kind:02X}")


def _number(field: int, x: Column) -> Column:
    return F.concat(_tag(field, 0), _varint(x))


def _sized(hexed: Column) -> Column:
    return _let(hexed, lambda h: F.concat(_varint(_size(h)), h))


def _message(field: int, hexed: Column) -> Column:
    return F.concat(_tag(field, 2), _sized(hexed))


def _archive(identifier: Column, kind: Column, payload: Column, *lists: Column) -> Column:
    """Hex of one archive: the length of its header, the header with one message, the payload."""

    def written(body: Column) -> Column:
        info = F.concat(_number(1, kind), _number(3, _size(body)), *lists)
        return F.concat(_sized(F.concat(_number(1, identifier), _message(2, info))), body)

    return _let(payload, written)


def _chunk(hexed: Column) -> Column:
    """Hex of a chunk of at most 65,536 bytes: a zero byte, a length, a Snappy block that is one literal."""

    def literal(n: Column) -> Column:
        return F.when(n <= 60, _byte((n - 1) * 4)).when(n <= 256, F.concat(F.lit("F0"), _byte(n - 1))).otherwise(F.concat(F.lit("F4"), _byte((n - 1) % 256), _byte(F.shiftright(n - 1, 8))))

    block = _let(hexed, lambda h: _let(_size(h).cast("bigint"), lambda n: F.concat(_varint(n), literal(n), h)))
    framed = lambda b: _let(_size(b).cast("bigint"), lambda m: F.concat(F.lit("00"), _byte(m % 256), _byte(F.shiftright(m, 8) % 256), _byte(F.shiftright(m, 16)), b))
    return _let(block, framed)


def _file(stream: Column) -> Column:
    """Bytes of a file whose stream is cut into two chunks, wherever that is."""
    half = lambda h: F.shiftleft(F.shiftright(F.octet_length(h), 2), 1)
    return F.unhex(_let(stream, lambda h: F.concat(_chunk(F.substring(h, F.lit(1), half(h))), _chunk(F.substring(h, half(h) + 1, F.octet_length(h))))))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Archives of orders in packages by customer: their suppliers are objects and their parts data files.

    Some files are templates, some are broken, and some orders are in an earlier file too, with other references.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that they aren't put together by bytes: rows are small and their work is not
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", "l_partkey").repartition(parts, "o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    per = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("lines"))
    each = orders.select("o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("package")).join(per, "o_orderkey")
    key = F.col("o_orderkey")
    each = each.withColumn("more", F.explode(F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    more = F.col("more")
    refs = lambda c, by: F.array_join(F.transform("lines", lambda x: _varint(x[c] + by)), "")
    payload = F.repeat(F.lit("AB"), (key % 40).cast("int"))
    file = _file(_archive(key, 5 + key % 3 + more, payload, _message(5, refs("l_suppkey", more)), _message(6, refs("l_partkey", 2 * more))))
    name = F.when(more == 1, "Index/A-").when(key % 7 == 0, "Index/TemplateSlide-").otherwise("Index/Slide-")
    broken = F.unhex(F.lit("01616263"))
    return each.select("package", F.concat(name, key, F.lit(".iwa")).alias("path"), F.when((more == 0) & (key % 11 == 0), broken).otherwise(file).alias("bytes"))


def archive_edges(spark: SparkSession, d: str) -> DataFrame:
    return archive.edges(archive.last_of_each(archive.decoded(_entries(spark, d))))


def archive_headers(spark: SparkSession, d: str) -> DataFrame:
    found = archive.last_of_each(archive.decoded(_entries(spark, d)))
    first = F.element_at("message_infos", 1)
    return found.select("package", "id", "is_template", F.size("message_infos").alias("messages"), first["type"].alias("type"), first["length"].alias("length"), F.hex("payload").alias("payload"))


def show_slides(spark: SparkSession, d: str) -> DataFrame:
    """Shows of customers that list their orders as slides."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("package")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("nodes"))
    tree = F.array_join(F.transform("nodes", lambda x: _message(2, _number(1, x))), "")
    document = _archive(F.lit(1), F.lit(2), _message(3, tree))
    return archive.slide_roots(archive.decoded(per.select("package", F.lit("Index/Document.iwa").alias("path"), _file(document).alias("bytes"))))


# an order counts as its main file says, as the earlier one says where that is broken, and not at all where there is none
_ORDERS = """o AS (SELECT o_orderkey AS k, CAST(o_custkey % 10 AS VARCHAR) AS package, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS more FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND (o_orderkey % 11 <> 0 OR o_orderkey % 5 = 0))"""

QUERIES = {
    "archive_edges": (archive_edges, f"""WITH {_ORDERS} SELECT package, 'object' AS kind, k AS src, l_suppkey + more AS dst FROM o JOIN lineitem ON k = l_orderkey
UNION ALL SELECT package, 'data', k, l_partkey + 2 * more FROM o JOIN lineitem ON k = l_orderkey"""),
    "archive_headers": (archive_headers, f"""WITH {_ORDERS} SELECT package, k AS id, k % 7 = 0 AND more = 0 AS is_template, CAST(1 AS INTEGER) AS messages, 5 + k % 3 + more AS type, k % 40 AS length, repeat('AB', CAST(k % 40 AS INTEGER)) AS payload FROM o"""),
    "show_slides": (show_slides, "SELECT CAST(o_custkey AS VARCHAR) AS package, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS slide_no, o_orderkey AS node FROM orders"),
}
