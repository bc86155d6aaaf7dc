"""PDF files as a stream: the same rows as the batch reader, file by file as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.reader import files, options_of, parse


def parse_stream(spark: SparkSession, path: str, content=0, detail=0, limits=None) -> DataFrame:
    """Streaming parse() over a folder; stateless, so any sink and output mode `append` will do."""
    options = options_of(content, detail, limits)
    return parse(files(spark, path, options, stream=True), options.content, options.detail, options.limits, id_col="path")
