"""Plan of replacements and rewriting of package parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.functions.replacing import Replacer
from slatewise.shipping import ship
from slatewise.sources import package


def collision_names(rows: DataFrame) -> DataFrame:
    """rows with new_stem: stem_repl, stem_repl1, ... in order of seq. rows: stem, seq."""
    n = F.row_number().over(Window.partitionBy("stem").orderBy("seq")) - 1
    return rows.withColumn("new_stem", F.concat("stem", F.lit("_repl"), F.when(n == 0, "").otherwise(n.cast("string"))))


def plan(mapping: DataFrame, mode: str = "vector_in_place") -> DataFrame:
    """One row per replacement: seq, old and new file name, its source file, kind, mime type, url of a custom file; skipped items have none.

    A choice that is no candidate takes the first one; without candidates it is left out. Names that collide
    are numbered in plan order, by quality and then name, which seq carries on.
    """
    own = F.try_element_at(F.filter("candidates", lambda c: c["name"] == F.col("choice")), F.lit(1))
    url = F.col("custom_url") if "custom_url" in mapping.columns else F.lit(None).cast("string")
    name = F.when(url.isNotNull(), F.col("choice")).otherwise(F.coalesce(own, F.try_element_at("candidates", F.lit(1)))["name"])
    chosen = mapping.where("choice <> 'skip'").select("degraded", "ordinal", name.alias("name"), url.alias("url")).where("name IS NOT NULL")
    ext = S.extension(F.col("name"))
    rows = chosen.select(
        F.col("degraded").alias("old_name"),
        F.col("name").alias("source_name"),
        "url",
        S.replacement_kind(ext).alias("kind"),
        S.output_extension(ext, S.extension(F.col("degraded")), mode).alias("ext"),
        S.stem(F.col("degraded")).alias("stem"),
        F.struct("ordinal", "degraded").alias("seq"),
    )
    named = collision_names(rows)
    return named.select("seq", "old_name", F.concat("new_stem", F.lit("."), "ext").alias("new_name"), "source_name", "kind", S.mime_type(F.col("ext")).alias("mime"), "url")


def materialised(plan: DataFrame, files: DataFrame) -> DataFrame:
    """new_name, bytes, render_from of each replacement: what is copied has its source's bytes.

    plan: as plan() gives it. files: filename, bytes of the source deck and of custom files. A vector that becomes
    a bitmap isn't drawn here: it has no bytes, and render_from names the file to draw, the first PDF of an SVG's stem if there is one.
    """
    copied = (F.col("kind") == "raster") | (S.extension(F.col("new_name")) == F.col("kind"))
    first = files.where(S.extension(F.col("filename")) == "pdf").groupBy(S.strip_id(S.stem(F.col("filename"))).alias("drawn_stem")).agg(F.min("filename").alias("pdf"))
    own = plan.withColumn("copied", copied).withColumn("drawn_stem", F.when(~copied & (F.col("kind") == "svg"), S.strip_id(S.stem(F.col("source_name")))))
    joined = own.join(first, "drawn_stem", "left").join(files.select(F.col("filename").alias("source_name"), "bytes"), "source_name", "left")
    return joined.select("new_name", F.when(F.col("copied"), F.col("bytes")).alias("bytes"), F.when(~F.col("copied"), F.coalesce("pdf", "source_name")).alias("render_from"))


def rewrite(parts: DataFrame, replacements: DataFrame) -> DataFrame:
    """Package parts with every reference replaced, in plan order. parts: package, path, xml; replacements: package, seq, old, new.

    All replacements of a package are one automaton, made once in a worker, and a part is read once whatever their number
    (see replacing.Replacer). A part without xml stays without.
    """
    ship(parts.sparkSession)
    per = replacements.where("old IS NOT NULL AND new IS NOT NULL").groupBy("package").agg(F.sort_array(F.collect_list(F.struct("seq", "old", "new"))).alias("plan"))
    joined = parts.select("package", "path", "xml").join(per, "package").select("package", "path", "xml", F.transform("plan", lambda p: F.struct(p["old"], p["new"])).alias("plan"))
    others = parts.join(per, "package", "left_anti").select("package", "path", "xml")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, replacer = None, None
        for batch in batches:
            texts = []
            for package, xml, plan in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if replacer is None or package != here:
                    here, replacer = package, Replacer([tuple(p.values()) for p in plan.as_py()])
                texts.append(replacer(xml.as_py()) if xml.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["package", "path", "xml"])

    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in ("package", "path"))
    return joined.mapInArrow(run, f"{kinds}, xml string").unionByName(others)


def missing_content_types(needed: DataFrame, registered: DataFrame) -> DataFrame:
    """(package, ext) that a package uses and doesn't register."""
    return needed.select("package", "ext").distinct().join(registered, ["package", "ext"], "left_anti")


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in ("package", "filename") if c in rows.columns]


def media_listing(files: DataFrame, membership: DataFrame, master_only: DataFrame) -> DataFrame:
    """filename, slides, is_master_only of media files that are not on masters only, by name; a file on no slide has [].

    With a package column in all three, files of different packages stay apart.
    """
    keys = _keys(files)
    per = membership.groupBy(*keys).agg(F.sort_array(F.collect_list("slide_no")).alias("slides"))
    kept = files.select(*keys).distinct().join(master_only, keys, "left_anti")
    listed = kept.join(per, keys, "left").select(*keys, F.coalesce("slides", F.array().cast("array<bigint>")).alias("slides"), F.lit(False).alias("is_master_only"))
    return listed.orderBy(*keys)


def master_only(master: DataFrame, layout: DataFrame, content: DataFrame) -> DataFrame:
    """Media of masters and layouts that no slide uses. Each: filename, and package if there are several."""
    keys = _keys(master)
    return master.select(*keys).union(layout.select(*keys)).distinct().join(content.select(*keys), keys, "left_anti")


def references(plan: DataFrame) -> DataFrame:
    """package, seq, old, new: both ways in which a part refers to a media file. plan: package, seq, old_name, new_name."""
    ways = F.explode(F.array(F.lit("../media/"), F.lit("ppt/media/"))).alias("way")
    each = plan.select("package", "seq", "old_name", "new_name", ways)
    return each.select("package", F.struct("seq", F.col("way") != "../media/").alias("seq"), F.concat("way", "old_name").alias("old"), F.concat("way", "new_name").alias("new"))


def patched(entries: DataFrame, plan: DataFrame, media: DataFrame) -> DataFrame:
    """package, path, bytes of the patched packages: references rewritten, types registered, new files added; old files stay.

    entries: package, path, bytes. plan: package, seq, old_name, new_name. media: package, new_name, bytes.
    """
    is_xml = F.col("path").endswith(".xml") | F.col("path").endswith(".rels")
    parts = package.text(entries.where(is_xml).select("package", "path", "bytes"))
    needed = plan.select("package", S.extension(F.col("new_name")).alias("ext"))
    typed = package.register_types(parts, missing_content_types(needed, package.content_types(parts)))
    changed = rewrite(typed, references(plan)).select("package", "path", F.encode("xml", "UTF-8").alias("bytes"))
    added = media.select("package", F.concat(F.lit("ppt/media/"), "new_name").alias("path"), "bytes")
    return changed.unionByName(entries.where(~is_xml).select("package", "path", "bytes")).unionByName(added)
