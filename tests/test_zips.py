"""Zip files read by ranges and written with a commit."""

import io
import os
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from slatewise.sources import package, zips


def listed(path):
    with open(path, "rb") as f:
        return list(zips._listed(zips._central(f, os.path.getsize(path))))


def test_read_as_zipfile_reads(spark, tmp_path):
    r = random.Random(3)
    want = {}
    for k, packing in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", packing) as z:
            z.comment = b"a comment PK\x05\x06 in it" * k
            z.writestr("folder/", b"")
            for i in range(40):
                data = r.randbytes(r.randint(0, 3000)) * r.randint(0, 3)
                z.writestr(f"é/{i}.bin" if i % 2 else f"a{i}.xml", data)
                want[f"{k}.zip", f"é/{i}.bin" if i % 2 else f"a{i}.xml"] = data
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    got = package.entries(spark, f"{tmp_path}/*.zip").collect()
    assert {(x.package.rsplit("/", 1)[1], x.path): x.bytes for x in got} == want and not any(x.error for x in got)
    assert sorted(x.path for x in package.entries(spark, f"{tmp_path}/0.zip", r"^a1\d\.xml$").collect()) == [f"a{i}.xml" for i in range(10, 20, 2)]


def test_broken(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("good", b"x" * 50)
        z.writestr("bad", b"y" * 50)
        z.writestr("odd", b"z" * 5000, zipfile.ZIP_BZIP2)
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(raw.replace(b"y" * 50, b"y" * 49 + b"!"))
    (tmp_path / "cut.zip").write_bytes(raw[:-30])
    (tmp_path / "none.zip").write_bytes(b"")
    got = {(x.package.rsplit("/", 1)[1], x.path): (x.bytes, x.error) for x in package.entries(spark, f"{tmp_path}/*").collect()}
    assert got.pop(("a.zip", "good")) == (b"x" * 50, None)
    assert got == {("a.zip", "bad"): (None, "wrong bytes"), ("a.zip", "odd"): (None, "packed by method 12"), ("cut.zip", None): (None, "not a zip archive")}  # Spark lists no file without bytes


def test_large_package_is_read_in_part(spark, tmp_path):
    """3 GB of media in a file of holes, relationships after it; the media's bytes are neither there to be right nor read."""
    path, three = tmp_path / "large.pptx", 3 << 30
    data = b"<Relationships/>"
    packed = zlib.compress(data, wbits=-15)
    crc = zlib.crc32(data)
    with open(path, "wb") as f:
        f.write(zips.local_header(b"ppt/media/film.mp4", 1, three, three))
        f.seek(three, 1)
        at = f.tell()
        f.write(zips.local_header(b"ppt/slides/_rels/slide1.xml.rels", crc, len(packed), len(data)) + packed)
        end = f.tell()
        central = zips.central_entry(b"ppt/media/film.mp4", 1, three, three, 0) + zips.central_entry(b"ppt/slides/_rels/slide1.xml.rels", crc, len(packed), len(data), at)
        f.write(central + zips.ending(2, len(central), end))
    assert os.stat(path).st_blocks * 512 < 1 << 20
    [row] = package.entries(spark, str(path), r"\.rels$").collect()
    assert (row.path, bytes(row.bytes), row.error) == ("ppt/slides/_rels/slide1.xml.rels", data, None)
    [film] = package.entries(spark, str(path), r"\.mp4$").collect()
    assert film.bytes is None and "more than a row holds" in film.error
    assert [x[0] for x in listed(path)] == zipfile.ZipFile(path).namelist()


def test_places_beyond_4_gb(tmp_path):
    path, five = tmp_path / "x.zip", 5 << 30
    with open(path, "wb") as f:
        f.seek(five)
        f.write(zips.local_header(b"a", zlib.crc32(b"hi"), 4, 2) + zlib.compress(b"hi", wbits=-15))
        end = f.tell()
        central = zips.central_entry(b"a", zlib.crc32(b"hi"), 4, 2, five)
        f.write(central + zips.ending(1, len(central), end))
    [entry] = listed(path)
    assert entry == ("a", five, 4, 2, zlib.crc32(b"hi"), 8)
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        assert z.read("a") == b"hi" == zips._content(f, *entry[1:])
    many = zips.ending(70_000, 10, 20)
    assert struct.unpack_from("<Q", many, 32)[0] == 70_000


def test_sink(spark, tmp_path):
    rows = [(f"x/{k}.zip", f"{i}é.txt", bytes([i]) * (i * 1000 * k)) for k in range(4) for i in range(30)] + [("x/1.zip", None, b"z"), (None, "a", b"z"), ("x/9.zip", "null", None)]
    df = spark.createDataFrame(rows, "package string, path string, bytes binary").repartition(7)
    zips.write(df, str(tmp_path / "out"))
    zips.write(df.where("package = 'x/2.zip'"), str(tmp_path / "out"))  # replaces a file
    assert sorted(os.listdir(tmp_path / "out")) == ["0.zip", "1.zip", "2.zip", "3.zip", "9.zip"]
    for k in range(4):
        with zipfile.ZipFile(tmp_path / f"out/{k}.zip") as z:
            assert z.testzip() is None and z.namelist() == sorted(z.namelist())
            assert {n: z.read(n) for n in z.namelist()} == {p: b for q, p, b in rows if q == f"x/{k}.zip" and p}
    back = package.entries(spark, f"{tmp_path}/out/*").select(F.element_at(F.split("package", "/"), -1), "path", "bytes")
    assert {tuple(r) for r in back.collect()} == {(q.rsplit("/")[-1], p, b or b"") for q, p, b in rows if p and q}


def test_nothing_is_left_of_a_failed_write(spark, tmp_path):
    good = spark.createDataFrame([(f"{k}.zip", "a", b"x") for k in range(20)], "package string, path string, bytes binary")
    bad = good.withColumn("path", F.when(F.col("package") == "7.zip", F.raise_error(F.lit("no"))).otherwise(F.col("path")))
    with pytest.raises(Exception):
        zips.write(bad, str(tmp_path / "a"))
    same = spark.createDataFrame([("p/a.zip", "a", b"x"), ("q/a.zip", "b", b"y")], "package string, path string, bytes binary")
    with pytest.raises(Exception, match="one name"):
        zips.write(same, str(tmp_path / "b"))
    assert all(not os.path.isdir(tmp_path / d) or not os.listdir(tmp_path / d) for d in "ab")


def test_writer_holds_one_entry(tmp_path):
    """200 MB of entries pass through a writer that keeps their directory alone."""
    import tracemalloc
    from types import SimpleNamespace as Row

    block = os.urandom(1 << 20)
    rows = (Row(package="p", path=f"{i:04}", packed=bytes(block), crc=0, size=1 << 20) for i in range(200))
    writer = zips.ZipWriter(str(tmp_path))
    tracemalloc.start()
    done = writer.write(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    writer.commit([done, None])
    assert peak < 20 << 20 and len(listed(tmp_path / "p")) == 200 and os.path.getsize(tmp_path / "p") > 200 << 20


def test_in_memory_file_is_enough():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    assert [x[0] for x in zips._listed(zips._central(out, len(out.getvalue())))] == ["a"]
