"""Archives of a source deck: chunk framing, Snappy blocks and protobuf messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import keyed
from slatewise.shipping import ship

MESSAGES = "array<struct<type: bigint, length: bigint, object_refs: array<bigint>, data_refs: array<bigint>>>"
ARCHIVES = f"id bigint, is_template boolean, message_infos {MESSAGES}, payload binary"
SHOW = 2


class Broken(ValueError):
    """Bytes that are no archive."""


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A varint and the place after it."""
    if at < len(data) and data[at] < 0x80:
        return data[at], at + 1
    value = shift = 0
    while True:
        if at >= len(data) or shift >= 64:
            raise Broken("varint")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message; types 0, 1, 2 and 5."""
    at, end = 0, len(data)
    while at < end:
        tag = data[at]
        at += 1
        if tag >= 0x80:
            tag, at = varint(data, at - 1)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            if at < end and data[at] < 0x80:
                value, at = data[at], at + 1
            else:
                value, at = varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            if at + n > end:
                raise Broken("fixed")
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        elif kind == 2:
            n, at = varint(data, at)
            if at + n > end:
                raise Broken("length")
            value, at = data[at : at + n], at + n
        else:
            raise Broken("wire type")
        yield number, kind, value


def packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            out.append(signed(value & 0xFFFFFFFFFFFFFFFF) if shift >= 56 else value)
            value = shift = 0
        else:
            shift += 7
            if shift >= 64:
                raise Broken("varint")
    if shift:
        raise Broken("varint")
    return out


_SNAPPY = pa.Codec("snappy")


def unsnappy(block: bytes) -> bytes:
    """A raw Snappy block's content; the block itself where it is none."""
    try:
        size, _ = varint(block, 0)
        return _SNAPPY.decompress(block, size, asbytes=True)
    except (Broken, pa.ArrowException, OSError, OverflowError, MemoryError, ValueError):
        return block


def unframed(data: bytes) -> bytes:
    """The stream in a file of chunks: a zero byte, a 3-byte length, a block."""
    out, at = [], 0
    while at < len(data):
        if data[at] != 0 or at + 4 > len(data):
            raise Broken("chunk")
        n = int.from_bytes(data[at + 1 : at + 4], "little")
        if at + 4 + n > len(data):
            raise Broken("chunk length")
        out.append(unsnappy(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return b"".join(out)


def message_info(data: bytes) -> tuple[int, int, list[int], list[int]]:
    kind = length = 0
    objects: list[int] = []
    refs: list[int] = []
    for number, wire, value in fields(data):
        if number == 1 and wire == 0:
            kind = value
        elif number == 3 and wire == 0:
            length = value
        elif number == 5 and wire == 2:
            objects = packed(value)  # the last one counts
        elif number == 6 and wire == 2:
            refs = packed(value)
    return kind, length, objects, refs


def archives_of(stream: bytes) -> list[tuple[int, list[tuple], bytes]]:
    """(id, messages, payload) of the archives of a stream; one that runs over its end stops the list."""
    out, at = [], 0
    try:
        while at < len(stream):
            n, at = varint(stream, at)
            if at + n > len(stream):
                break
            identifier, messages = 0, []
            for number, wire, value in fields(stream[at : at + n]):
                if number == 1 and wire == 0:
                    identifier = signed(value)
                elif number == 2 and wire == 2:
                    messages.append(message_info(value))
            at += n
            size = sum(m[1] for m in messages)
            if at + size > len(stream):
                break
            out.append((identifier, messages, stream[at : at + size]))
            at += size
    except Broken:
        pass
    return out


class _Found:
    """Archives on their way to a batch: messages and what they refer to are flat lists and the places where each one's end."""

    def __init__(self) -> None:
        self.of: list[int] = []
        self.size = 0
        self.position, self.id, self.payload, self.messages = [], [], [], [0]
        self.type, self.length, self.objects, self.object_ends, self.data, self.data_ends = [], [], [], [0], [], [0]

    def add(self, row: int, found: list[tuple[int, list[tuple], bytes]]) -> None:
        for position, (identifier, messages, payload) in enumerate(found):
            self.of.append(row)
            self.position.append(position)
            self.id.append(identifier)
            self.payload.append(payload)
            self.size += len(payload)
            for kind, length, objects, refs in messages:
                self.type.append(signed(kind))
                self.length.append(length)
                self.objects += objects
                self.object_ends.append(len(self.objects))
                self.data += refs
                self.data_ends.append(len(self.data))
            self.messages.append(len(self.type))

    def batch(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        long = lambda x: pa.array(x, pa.int64())
        listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        infos = pa.StructArray.from_arrays(
            [long(self.type), long(self.length), listed(self.object_ends, long(self.objects)), listed(self.data_ends, long(self.data))], ["type", "length", "object_refs", "data_refs"]
        )
        package, path, is_template = (rows.column(c).take(long(self.of)) for c in ("package", "path", "is_template"))
        columns = [package, path, pa.array(self.position, pa.int32()), long(self.id), is_template, listed(self.messages, infos), pa.array(self.payload, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["package", "path", "position", "id", "is_template", "message_infos", "payload"])


AT_ONCE = 1 << 26


def decoded(entries: DataFrame) -> DataFrame:
    """package, path, position in it and archives of the .iwa entries directly under Index/. A broken file has none. entries: package, path, bytes."""
    ship(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Found()
            for row, data in enumerate(batch.column("bytes")):
                try:
                    found.add(row, archives_of(unframed(data.as_py() or b"")))
                except Broken:
                    continue
                if found.size > AT_ONCE:
                    yield found.batch(batch)
                    found = _Found()
            if found.of:
                yield found.batch(batch)

    own = entries.where(F.col("path").rlike(r"(^|/)Index/[^/]*\.iwa$")).select(F.col("package").cast("string"), "path", S.is_template(S.basename(F.col("path"))).alias("is_template"), "bytes")
    return own.mapInArrow(run, f"package string, path string, position int, {ARCHIVES}")


def last_of_each(archives: DataFrame) -> DataFrame:
    """One archive of each package and id: the last one, by path and position; a template if any of them is one.

    Archives of one id are the files of a package that hold it, a few.
    """
    of_id = Window.partitionBy("package", "id")
    ranked = archives.withColumn("n", F.row_number().over(of_id.orderBy(F.desc("path"), F.desc("position")))).withColumn("is_template", F.max("is_template").over(of_id))
    return ranked.where("n = 1").select(archives.columns)


def object_edges(archives: DataFrame) -> DataFrame:
    """package, src, dst: the objects that an object's messages refer to."""
    return archives.select("package", F.col("id").alias("src"), F.explode(F.flatten(F.transform("message_infos", lambda m: m["object_refs"]))).alias("dst"))


def data_edges(archives: DataFrame) -> DataFrame:
    """package, obj, data_ref: the data files that an object's messages refer to."""
    return archives.select("package", F.col("id").alias("obj"), F.explode(F.flatten(F.transform("message_infos", lambda m: m["data_refs"]))).alias("data_ref"))


def edges(archives: DataFrame) -> DataFrame:
    """package, kind (object or data), src, dst: both kinds of edges in one pass."""
    refs = lambda kind, field: F.transform(F.flatten(F.transform("message_infos", lambda m: m[field])), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("dst")))
    each = archives.select("package", "id", F.concat(refs("object", "object_refs"), refs("data", "data_refs")).alias("refs"))
    return each.select("package", F.col("id").alias("src"), F.inline("refs")).select("package", "kind", "src", "dst")


def template_nodes(archives: DataFrame) -> DataFrame:
    return archives.where("is_template").select("package", F.col("id").alias("node"))


def data_files(entries: DataFrame) -> DataFrame:
    """package, filename, data_ref of the files directly under Data/; data_ref is null for a name without an id. entries: package, path."""
    own = entries.where(F.col("path").rlike(r"(^|/)Data/[^/]+$"))
    return own.select("package", S.basename(F.col("path")).alias("filename")).withColumn("data_ref", S.trailing_id(S.stem(F.col("filename")))).distinct()


def named_assets(sets: DataFrame, files: DataFrame) -> DataFrame:
    """package, filename, slides: slide sets by data_ref as those of files; refs without a file go, and of files with one ref the last name wins.

    sets: package, data_ref, slides. files: as data_files() gives them.
    """
    named = keyed.last_wins(files.where("data_ref IS NOT NULL"), ["package", "data_ref"], "filename")
    return sets.join(named, ["package", "data_ref"]).select("package", "filename", "slides")


def asset_listing(files: DataFrame, assets: DataFrame) -> DataFrame:
    """package, filename, object_id, slides of the image files of a source deck, previews left out. assets: as named_assets() gives them."""
    own = files.where(S.is_image(F.col("filename")) & ~S.is_preview(F.col("filename")))
    joined = own.join(assets.select("package", "filename", "slides"), ["package", "filename"], "left")
    slides = F.coalesce("slides", F.array().cast(assets.schema["slides"].dataType))
    return joined.select("package", "filename", F.coalesce(F.col("data_ref").cast("string"), F.lit("")).alias("object_id"), slides.alias("slides"))


def show_slides(payload: bytes) -> list[int]:
    """Slide ids of a show: field 3, in it the repeated field 2, in it field 1."""
    out = []
    for number, wire, tree in fields(payload):
        if number == 3 and wire == 2:
            for inner, kind, ref in fields(tree):
                if inner == 2 and kind == 2:
                    out += [signed(v) for n, w, v in fields(ref) if n == 1 and w == 0]
    return out


def is_show(message_infos: Column) -> Column:
    """Whether an archive's first message is a show."""
    return F.coalesce(F.try_element_at(message_infos, F.lit(1))["type"] == SHOW, F.lit(False))


def slide_roots(archives: DataFrame) -> DataFrame:
    """package, slide_no from 1, node of the slides of show archives (the first message is of type 2)."""
    ship(archives.sparkSession)
    shows = archives.where(is_show(F.col("message_infos"))).select("package", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for package, payload in zip(batch["package"], batch["payload"]):
                try:
                    rows += [(package, i + 1, node) for i, node in enumerate(show_slides(bytes(payload)))]
                except Broken:
                    continue
            yield pd.DataFrame(rows, columns=["package", "slide_no", "node"]).astype({"slide_no": "int32", "node": "int64"})

    return shows.mapInPandas(run, "package string, slide_no int, node bigint")
