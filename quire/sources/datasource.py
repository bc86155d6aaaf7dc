"""format("quire_pdf"): element rows of PDF files through Spark's Python data source interface.

Options: path (a file or folder every executor can open), table (texts, graphics, images or
annotations), detail, pattern (names looked at in a folder). `value` is the element's main part, `row` all of it
as JSON. A damaged file gives what was found before the damage and a row of kind `error`. For stores only Spark can read, use sources.reader, which goes through
Spark's own binary reader.
"""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

_BITS = {"texts": 1, "graphics": 2, "images": 4, "annotations": 8}
_SCHEMA = "path string, page int, ord int, kind string, value string, row string"


def _plain(x):
    return x.hex() if isinstance(x, bytes) else str(x)


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> "PdfReader":
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options):
        from quire.sources.reader import options_of

        self.path, self.pattern = options["path"], options.get("pattern", "*.[pP][dD][fF]")
        wanted = options.get("table", "texts")
        if wanted not in _BITS:
            raise ValueError(f"unknown table: {wanted}")
        self.table, self.only = wanted, None
        self.parse = options_of(_BITS[wanted], options.get("detail", "basic"))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            else:
                yield f

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, self.pattern))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in found if self.only in (None, p)] or [InputPartition(None)]

    def read(self, partition):
        from quire.kernel.rows import interpret

        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            found = interpret(f.read(), self.parse)
        show = {"texts": "unicode", "graphics": "paint", "images": "resource", "annotations": "subtype"}[self.table]
        for p in found["pages"]:
            for i, row in enumerate(p[self.table]):
                yield partition.value, p["page"], i, self.table, str(row[show]), json.dumps(row, default=_plain)
        if found["error"]:
            yield partition.value, found["error"]["page"], 0, "error", found["error"]["message"], json.dumps(found["error"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
