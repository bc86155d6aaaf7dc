"""PDF bytes -> parsed pages: the one place where the byte kernel runs."""

from __future__ import annotations

import gc
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..options import FULL, TEXT, Limits, ParseOptions

#: Pages, elements on them, and bytes of their files sent back to the JVM at once (a page with more goes alone).
PAGES, ELEMENTS, BYTES = 512, 4096, 1 << 20
#: Objects that may be left over before the collector looks at them.
LEFT = 50_000
#: Names looked at in a folder; a path to a file is read whatever its name.
PATTERN = "*.[pP][dD][fF]"


def options_of(content=0, detail=0, limits=None, glyphs=None) -> ParseOptions:
    """Checked options; raises before anything is read."""
    return ParseOptions(content, detail, limits or Limits(), glyphs).checked()


def batch_of(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    """RecordBatch.from_pylist(), which takes far longer over rows of plain values."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)


def _kernel(df: DataFrame, id_col: str, content_col: str, body: str, options: ParseOptions, make) -> DataFrame:
    """mapInArrow of make(bytes, options) -> rows, keyed by the id; a kernel failure is an error row, never a failed task."""
    key = T.StructField("doc_id", df.schema[id_col].dataType)
    out = T.StructType([key, *T.StructType.fromDDL(body).fields])
    arrow = to_arrow_schema(out)
    given = df.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("content"))

    def read(batch):
        pending, held, size = [], 0, 0
        ids, contents = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            doc, data = ids[i].as_py(), contents[i].as_py()
            size += len(data or b"")
            for row in make(data, options):
                pending.append({"doc_id": doc} | row)
                held += sum(len(v) for v in row.values() if isinstance(v, list))
                if len(pending) >= PAGES or held >= ELEMENTS or size >= BYTES:
                    yield batch_of(pending, arrow)
                    pending, held, size = [], 0, 0
        if pending:
            yield batch_of(pending, arrow)

    def run(batches):
        # rows are many small objects, none of which refers back to itself: the collector finds nothing among them and
        # would go over all of them again and again, so it runs for what is sent back, once that has left enough behind
        was = gc.isenabled()
        gc.freeze()
        gc.disable()
        try:
            for batch in batches:
                for rows in read(batch):
                    yield rows
                    if gc.get_count()[0] >= LEFT:
                        gc.collect()
        finally:
            gc.unfreeze()
            if was:
                gc.enable()

    return given.mapInArrow(run, out)


def _pages(data: bytes | None, options: ParseOptions):
    from ..kernel.rows import interpret

    if data is None:
        found = {"loaded": False, "error": {"class": "limit", "message": "no content: null, or above the file byte limit", "page": -1}, "pages": [], "content": options.content, "detail": options.detail}
    else:
        try:
            found = interpret(data, options)
        except Exception as e:  # noqa: BLE001  one damaged document must not end the job
            found = {"loaded": False, "length": len(data), "error": {"class": "internal", "message": f"{type(e).__name__}: {e}"[:500], "page": -1}, "pages": [], "content": options.content, "detail": options.detail}
    pages = found.pop("pages")
    return [{"page": -1, "file": found}, *pages]


def _structure(data: bytes | None, options: ParseOptions, keep_data: bool = False):
    from ..kernel.rows import structure

    if data is None:
        return [{"error": {"class": "limit", "message": "no content: null, or above the file byte limit", "page": -1}}]
    try:
        return [structure(data, options, keep_data)]
    except Exception as e:  # noqa: BLE001
        return [{"length": len(data), "error": {"class": "internal", "message": f"{type(e).__name__}: {e}"[:500], "page": -1}}]


def _page_tree(data: bytes | None, options: ParseOptions, depth: int):
    from ..kernel.rows import page_tree

    try:
        return page_tree(data or b"", options, depth)
    except Exception as e:  # noqa: BLE001
        return [{"page": 0, "error": f"{type(e).__name__}: {e}"[:500]}]


def _lines(data: bytes | None, options: ParseOptions, gap: float):
    from ..kernel.rows import lines

    try:
        return lines(data or b"", options, gap)
    except Exception:  # noqa: BLE001  no pages are known then, as in _pages
        return []


def _is_folder(spark: SparkSession, path) -> bool:
    """Whether path names a folder; wherever Spark can open it."""
    if not isinstance(path, str):
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def files(spark: SparkSession, path, options: ParseOptions, stream: bool = False, pattern: str = PATTERN) -> DataFrame:
    """path, content of the named file, or of every file of a folder that fits the pattern; content is null above the byte limit, and is then not read."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile")
    if stream or _is_folder(spark, path):
        reader = reader.option("pathGlobFilter", pattern)
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    found = reader.load(path)
    return found.select("path", F.when(F.col("length") <= options.limits.max_file_bytes, F.col("content")).alias("content"))


def parse(df: DataFrame, content=0, detail=0, limits=None, id_col: str = "doc_id", content_col: str = "content", glyphs: dict[str, str] | None = None) -> DataFrame:
    """Parsed rows of a binary column: per document one row with page = -1 and `file`, and one per page. glyphs: texts of further glyph names."""
    return _kernel(df, id_col, content_col, schema.PARSED, options_of(content, detail, limits, glyphs), _pages)


def parse_files(spark: SparkSession, path, content=0, detail=0, limits=None, pattern: str = PATTERN) -> DataFrame:
    """parse() over files; doc_id is the path."""
    options = options_of(content, detail, limits)
    return parse(files(spark, path, options, pattern=pattern), options.content, options.detail, options.limits, id_col="path")


def parse_structure(df: DataFrame, limits=None, id_col: str = "doc_id", content_col: str = "content", keep_data: bool = False) -> DataFrame:
    """File structure of a binary column, one nested row a document; keep_data: with what its streams decode to."""
    return _kernel(df, id_col, content_col, schema.STRUCTURE, options_of(limits=limits), partial(_structure, keep_data=keep_data))


def parse_page_tree(df: DataFrame, limits=None, id_col: str = "doc_id", content_col: str = "content", depth: int = 128) -> DataFrame:
    """Structure.page_tree() of a binary column in one step: each file is read and walked, and nothing but its pages' rows leaves the kernel."""
    return _kernel(df, id_col, content_col, schema.TREE, options_of(limits=limits), partial(_page_tree, depth=depth))


def parse_lines(df: DataFrame, limits=None, id_col: str = "doc_id", content_col: str = "content", glyphs: dict[str, str] | None = None, gap: float = 0.5) -> DataFrame:
    """Parsed.layout() of a binary column in one step: glyphs are placed and joined where they are read, and only lines leave the kernel."""
    return _kernel(df, id_col, content_col, schema.LINES, options_of(TEXT, FULL, limits, glyphs), partial(_lines, gap=gap))
