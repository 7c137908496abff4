"""Office packages as tables: zip entries, relationship and content-type parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.sources import zips

SLIDE_RELS = r"ppt/slides/_rels/[^/]*\.rels$"


def entries(spark: SparkSession, files: str, wanted: str = "") -> DataFrame:
    """package, path, bytes, error of all entries of zip files at a path or pattern; wanted: a pattern that entry paths must match.

    Of entries that aren't wanted no bytes are read, and no file is read as a whole. A file that is no zip
    archive gives one row with an error and nothing else, a file without bytes none.
    """
    found = spark.read.format("binaryFile").load(files).select(F.col("path").alias("package"), "length")
    listed = zips.directory(found)
    return zips.contents(listed.where(F.col("path").isNull() | F.col("path").rlike(wanted)))


def text(parts: DataFrame) -> DataFrame:
    """Parts with their bytes as xml."""
    return parts.withColumn("xml", F.decode("bytes", "UTF-8")).drop("bytes")


def relationships(parts: DataFrame) -> DataFrame:
    """path, target of every direct Relationship of a .rels part. parts: path, xml."""
    targets = F.xpath(F.col("xml"), F.lit("/*/*[local-name()='Relationship']/@Target"))
    return parts.select(*[c for c in parts.columns if c != "xml"], F.explode(targets).alias("target"))


def slide_media(parts: DataFrame) -> DataFrame:
    """slide_no, filename for each media reference of slides, duplicates kept, and package where parts have it. parts: path, xml."""
    rels = relationships(parts.where(F.col("path").rlike(SLIDE_RELS)))
    found = rels.where(F.lower("target").contains("/media/"))
    package = [c for c in ("package",) if c in parts.columns]
    return found.select(*package, S.slide_number(F.col("path")).alias("slide_no"), S.basename(F.col("target")).alias("filename")).where("filename <> '' AND slide_no IS NOT NULL")


def master_media(parts: DataFrame) -> DataFrame:
    """filename, and package where parts have it, of media that masters or layouts refer to."""
    package = [c for c in ("package",) if c in parts.columns]
    rels = relationships(parts.where(F.col("path").rlike(r"ppt/(slideMasters|slideLayouts)/_rels/[^/]*\.rels$")))
    return rels.where(F.lower("target").contains("/media/")).select(*package, S.basename(F.col("target")).alias("filename")).where("filename <> ''").distinct()


def content_types(parts: DataFrame) -> DataFrame:
    """package, ext that [Content_Types].xml registers. parts: package, path, xml."""
    own = parts.where(F.col("path") == "[Content_Types].xml")
    found = F.xpath(F.col("xml"), F.lit("/*/*[local-name()='Default']/@Extension"))
    return own.select("package", F.explode(F.transform(found, F.lower)).alias("ext"))


def register_types(parts: DataFrame, missing: DataFrame) -> DataFrame:
    """[Content_Types].xml of each package with a Default for each missing ext."""
    added = missing.groupBy("package").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<Default Extension="'), "ext", F.lit('" ContentType="'), S.mime_type(F.col("ext")), F.lit('"/>')))), "").alias("added")
    )
    joined = parts.join(added, "package", "left")
    here = (F.col("path") == "[Content_Types].xml") & F.col("added").isNotNull()
    xml = F.when(here, F.concat(F.regexp_replace("xml", r"</(\w+:)?Types>\s*$", ""), "added", F.regexp_extract("xml", r"(</(?:\w+:)?Types>)\s*$", 1))).otherwise(F.col("xml"))
    return joined.select("package", "path", xml.alias("xml"))
