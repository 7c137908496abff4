"""Metrics of SVG drawings: sizes, viewBox and texts with their places."""

from __future__ import annotations

import re
import xml.sax
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.shipping import ship

METRICS = (
    "filename string, width double, width_unit string, height double, height_unit string, vb_width double, vb_height double,"
    " texts array<struct<x: double, content: string>>"
)
_LENGTH = re.compile(r"^\s*([0-9.-]*)(.*?)\s*$", re.S)
_MATRIX = re.compile(r"matrix\(([^)]*)\)")
_TRANSLATE = re.compile(r"translate\(([^)]*)\)")


def number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def length(text: str) -> tuple[float, str]:
    """Value and lower-case unit, px by default; a bad number is 0."""
    value, unit = _LENGTH.match(text).groups()
    return number(value) or 0.0, unit.lower() or "px"


def place(attrs) -> float | None:
    """x of a text: from matrix(), translate() or the attribute."""
    transform = attrs.get("transform", "")
    for pattern, at in ((_MATRIX, 4), (_TRANSLATE, 0)):
        if m := pattern.search(transform):
            parts = re.split(r"[,\s]+", m[1].strip())
            if len(parts) > at and (x := number(parts[at])) is not None:
                return x
    return number(attrs.get("x"))


class _Reader(xml.sax.ContentHandler):
    def __init__(self):
        super().__init__()
        self.size: list = [None] * 6
        self.texts: list[dict] = []
        self.root = True
        self.x: float | None = None
        self.parts: list[str] | None = None

    def startElement(self, name, attrs):
        name = name.rsplit(":", 1)[-1]
        if self.root and name == "svg":
            self.root = False
            for i, k in ((0, "width"), (2, "height")):
                if k in attrs:
                    self.size[i], self.size[i + 1] = length(attrs[k])
            box = [x for x in map(number, re.split(r"[,\s]+", attrs.get("viewBox", "").strip())) if x is not None]
            if len(box) >= 4:
                self.size[4], self.size[5] = box[2], box[3]
        elif name == "text":
            self.x, self.parts = place(attrs), []
        elif name == "tspan" and self.parts is not None and self.x is None:
            self.x = place(attrs)

    def characters(self, content):
        if self.parts is not None:
            self.parts.append(content)

    def endElement(self, name):
        if name.rsplit(":", 1)[-1] == "text" and self.parts is not None:
            content = "".join(self.parts).strip()
            if self.x is not None and content:
                self.texts.append({"x": self.x, "content": content})
            self.parts = None


def metrics(files: DataFrame) -> DataFrame:
    """A row per file that is readable as XML. files: filename, bytes."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["filename"], batch["bytes"]):
                reader = _Reader()
                try:
                    xml.sax.parseString(bytes(data), reader)
                except (xml.sax.SAXException, ValueError):
                    continue
                rows.append((name, *reader.size, reader.texts))
            yield pd.DataFrame(rows, columns=["filename", "width", "width_unit", "height", "height_unit", "vb_width", "vb_height", "texts"])

    return files.select("filename", "bytes").where(F.col("bytes").isNotNull()).mapInPandas(run, METRICS)
