"""Packages, archives and images that the test makes itself."""

import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest

from slatewise.operators import graph, patch
from slatewise.sources import archive, images, package, svg, zips

NS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def rels(*targets):
    return f"<Relationships {NS}>" + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def varint(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def one_archive(identifier, kind, objects=(), data=(), payload=b""):
    info = field(1, kind) + field(3, len(payload)) + field(5, b"".join(map(varint, objects))) + field(6, b"".join(map(varint, data)))
    header = field(1, identifier) + field(2, info)
    return varint(len(header)) + header + payload


def chunk(data, raw=False):
    block = data if raw else pa.compress(data, codec="snappy", asbytes=True)
    return b"\0" + len(block).to_bytes(3, "little") + block


@pytest.fixture(scope="module")
def deck(tmp_path_factory):
    folder = tmp_path_factory.mktemp("decks")
    with zipfile.ZipFile(folder / "a.pptx", "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="PNG" ContentType="image/png"/></Types>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels("../media/image1.png", "../media/image1.png", "../slideLayouts/x.xml"))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels("../media/image1.png", "../Media/image2.png", "../media/"))
        z.writestr("ppt/slideMasters/_rels/slideMaster1.xml.rels", rels("../media/logo.png", "../media/image2.png"))
        for n in ("image1.png", "image2.png", "logo.png", "orphan.png"):
            z.writestr(f"ppt/media/{n}", n)
    show = field(3, field(2, field(1, 10)) + field(2, field(1, 11)))
    with zipfile.ZipFile(folder / "a.key", "w") as z:
        z.writestr("Index/Document.iwa", chunk(one_archive(1, 2, payload=show) + one_archive(10, 5, [20, 30], [1])) + chunk(one_archive(20, 6, [10], [2]) + one_archive(11, 5, [20], [])))
        z.writestr("Index/TemplateSlide-1.iwa", chunk(one_archive(30, 5, [20], [3])))
        z.writestr("Index/Raw.iwa", chunk(one_archive(40, 7, data=[4]), raw=True))
        z.writestr("Index/Broken.iwa", b"\1abc")
    (folder / "no.zip").write_bytes(b"not a zip")
    return folder


def test_zip_entries(spark, deck):
    got = package.entries(spark, f"{deck}/*").collect()
    assert sum(r.path is not None for r in got) == 12 and [r.path for r in got if r.error] == [None]


def test_relationships_and_listing(spark, deck):
    parts = package.text(package.entries(spark, f"{deck}/a.pptx", r"\.(rels|xml)$"))
    media = package.slide_media(parts)
    assert sorted(map(tuple, media.select("slide_no", "filename").collect())) == [(1, "image1.png"), (1, "image1.png"), (2, "image1.png"), (2, "image2.png")]
    only = patch.master_only(package.master_media(parts), package.master_media(parts), media)
    assert [r.filename for r in only.collect()] == ["logo.png"]
    files = package.entries(spark, f"{deck}/a.pptx", "^ppt/media/").selectExpr("package", "element_at(split(path, '/'), -1) AS filename")
    listing = {r.filename: r.slides for r in patch.media_listing(files, media, only).collect()}
    assert listing == {"image1.png": [1, 1, 2], "image2.png": [2], "orphan.png": []}


def test_content_types_and_sink(spark, deck, tmp_path):
    parts = package.text(package.entries(spark, f"{deck}/a.pptx", r"\.(rels|xml)$"))
    needed = parts.selectExpr("package", "explode(array('png', 'svg')) AS ext")
    missing = patch.missing_content_types(needed, package.content_types(parts))
    assert [r.ext for r in missing.collect()] == ["svg"]
    whole = package.register_types(parts, missing).selectExpr("package", "path", "encode(xml, 'UTF-8') AS bytes")
    zips.write(whole, str(tmp_path))
    with zipfile.ZipFile(tmp_path / "a.pptx") as z:
        assert z.testzip() is None and z.read("[Content_Types].xml").endswith(b'<Default Extension="svg" ContentType="image/svg+xml"/></Types>') and len(z.namelist()) == 4


def test_archives(spark, deck):
    found = archive.decoded(package.entries(spark, f"{deck}/a.key")).cache()
    assert sorted((r.id, r.is_template) for r in found.collect()) == [(1, False), (10, False), (11, False), (20, False), (30, True), (40, False)]
    roots = archive.slide_roots(found)
    assert sorted(map(tuple, roots.select("slide_no", "node").collect())) == [(1, 10), (2, 11)]
    reached = graph.reachable(roots, archive.object_edges(found), archive.template_nodes(found))
    assert sorted(map(tuple, reached.select("slide_no", "node").collect())) == [(1, 10), (1, 20), (2, 10), (2, 11), (2, 20)]
    sets = graph.slide_assets(reached, archive.data_edges(found))
    assert {r.data_ref: r.slides for r in sets.collect()} == {1: [1, 2], 2: [1, 2]}


def test_wire_format():
    assert archive.varint(b"\xac\x02", 0) == (300, 2) and archive.packed(b"\x01\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01") == [1, -1]
    for broken in (b"\x80", b"\x80" * 10 + b"\x01", b"\x0a\x05a", b"\x0b"):
        with pytest.raises(archive.Broken):
            list(archive.fields(broken))
    assert archive.archives_of(one_archive(1, 2, payload=b"abc")[:-1]) == []


def png(rows):
    h, w = len(rows), len(rows[0])
    body = b"".join(b"\0" + bytes(x for px in r for x in px) for r in rows)
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    grey = [[(128, 128, 128, 255)] * 64] * 64
    half = [[(0, 0, 0, 255)] * 32 + [(255, 255, 255, 255)] * 32] * 64
    for name, rows in (("grey.png", grey), ("half.png", half), ("same.png", half)):
        (tmp_path / name).write_bytes(png(rows))
    (tmp_path / "v.svg").write_text("<svg/>")
    got = {r.filename: r for r in images.fingerprints(spark, str(tmp_path)).collect()}
    assert got["grey.png"].ahash == 0 and got["half.png"].ahash & 0xFF == 0xF0 and got["half.png"].phash == got["same.png"].phash
    assert got["v.svg"].error == "render failed" and got["v.svg"].size == 6 and (got["half.png"].width, got["half.png"].height) == (64, 64)
    assert [round(x, 3) for x in got["grey.png"].moments[:3]] == [0.502, 0.0, 0.0]


def test_patched_package(spark, deck, tmp_path):
    entries = package.entries(spark, f"{deck}/a.pptx").cache()
    name = entries.head().package
    plan = spark.createDataFrame([(name, 1, "image1.png", "image1_repl.svg")], "package string, seq int, old_name string, new_name string")
    media = spark.createDataFrame([(name, "image1_repl.svg", b"<svg/>")], "package string, new_name string, bytes binary")
    zips.write(patch.patched(entries, plan, media), f"file://{tmp_path}/out")
    with zipfile.ZipFile(tmp_path / "out/a.pptx") as z:
        assert z.read("ppt/media/image1_repl.svg") == b"<svg/>" and z.read("ppt/media/image1.png") == b"image1.png"
        assert z.read("ppt/slides/_rels/slide1.xml.rels").count(b"../media/image1_repl.svg") == 2
        assert b'Extension="svg"' in z.read("[Content_Types].xml")


def test_svg_metrics(spark):
    drawing = b'''<svg xmlns="http://www.w3.org/2000/svg" width="2.5CM" height="x" viewBox="0,0 10 20"><text transform="matrix(1 0 0 1 7.5 3)"> Hi <tspan>you</tspan></text>
<text><tspan x="4">late</tspan></text><text>no place</text><text transform="translate(-3, 1)" x="9">t</text><svg width="9"/></svg>'''
    rows = spark.createDataFrame([("a.svg", drawing), ("b.svg", b"<svg"), ("c.svg", None)], "filename string, bytes binary")
    [got] = svg.metrics(rows).collect()
    assert (got.width, got.width_unit, got.height, got.height_unit, got.vb_width, got.vb_height) == (2.5, "cm", 0.0, "x", 10.0, 20.0)
    assert [(t.x, t.content) for t in got.texts] == [(7.5, "Hi you"), (4.0, "late"), (-3.0, "t")]


def test_decks_stay_apart(spark, tmp_path):
    """Two decks with the same ids, slides and file names; nested archives and files are no part of a deck."""
    show = field(3, field(2, field(1, 10)))
    for name, refs, extra in (("a.key", [1], "Index/x/Nested.iwa"), ("b.key", [2], "Data/sub/deep-1.png")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("Index/Document.iwa", chunk(one_archive(1, 2, payload=show) + one_archive(10, 5, [20], []) + one_archive(20, 6, [], refs)))
            z.writestr(extra, chunk(one_archive(99, 2, payload=show)))
            for n in ("pic-1.png", "pic-2.svg", "pic-0001.pdf", "st-ab-9.png", "notes.txt", "plain.png"):
                z.writestr(f"Data/{n}", n)
    entries = package.entries(spark, f"{tmp_path}/*").cache()
    found = archive.decoded(entries).cache()
    assert found.where("id = 99").count() == 0
    roots = archive.slide_roots(found)
    assert roots.count() == 2
    sets = graph.slide_assets(graph.reachable(roots, archive.object_edges(found), archive.template_nodes(found)), archive.data_edges(found))
    files = archive.data_files(entries)
    got = {(r.package[-5:], r.filename): (r.object_id, r.slides) for r in archive.asset_listing(files, archive.named_assets(sets, files)).collect()}
    assert got == {
        ("a.key", "pic-1.png"): ("1", [1]), ("a.key", "pic-2.svg"): ("2", []), ("a.key", "pic-0001.pdf"): ("1", []), ("a.key", "plain.png"): ("", []),
        ("b.key", "pic-1.png"): ("1", []), ("b.key", "pic-2.svg"): ("2", [1]), ("b.key", "pic-0001.pdf"): ("1", []), ("b.key", "plain.png"): ("", []),
    }


def test_listing_of_two_packages(spark):
    files = spark.createDataFrame([("p", "b.png"), ("p", "a.png"), ("q", "a.png")], "package string, filename string")
    members = spark.createDataFrame([("p", "a.png", 3), ("p", "a.png", 1)], "package string, filename string, slide_no bigint")
    only = spark.createDataFrame([("q", "a.png")], "package string, filename string")
    assert [tuple(r) for r in patch.media_listing(files, members, only).collect()] == [("p", "a.png", [1, 3], False), ("p", "b.png", [], False)]


def test_large_picture():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    picture = rng.integers(0, 256, (2000, 3000, 4), dtype=np.uint8)
    picture[..., 3] = 255
    began = time.time()
    images.fingerprint(picture)
    assert time.time() - began < 20
    small = picture[:40, :60]
    want = small.reshape(8, 5, 12, 5, 4).mean(axis=(1, 3))
    assert np.allclose(images.resized(small, 8, 12), want, atol=1e-3)
