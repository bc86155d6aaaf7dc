"""Lexer, object parser and stream filters for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Lex:
    """pdf_lex(data, offset): kind, start, end of every token; a last row with kind 'error' if one is malformed."""

    def eval(self, data: bytes, offset: int) -> Iterator[tuple]:
        from quire.kernel.syntax import lex

        if data is None:
            return
        found, error = lex(bytes(data), offset or 0)
        for i, (kind, start, end) in enumerate(found):
            yield i, kind, start, end, bytes(data)[start:end], None
        if error:
            yield len(found), "error", None, None, None, str(error)


class ParseObject:
    """pdf_parse_object(data, offset): node rows of the object there, and where it ends; one row with an error if malformed."""

    def eval(self, data: bytes, offset: int) -> Iterator[tuple]:
        from quire.kernel.errors import PdfError
        from quire.kernel.rows import flatten
        from quire.kernel.syntax import parse_object

        if data is None:
            return
        try:
            found, end = parse_object(bytes(data), offset or 0)
        except PdfError as e:
            yield (None,) * 12 + (None, str(e))
            return
        for n in flatten(found):
            yield n["node_id"], n["parent_id"], n["ord"], n["dict_key"], n["kind"], n["lexeme"], n["bytes"], n["ref_num"], n["ref_gen"], n["span_start"], n["span_end"], n["depth"], end, None


LEX = "i int, kind string, start bigint, end bigint, bytes binary, error string"
NODES = "node_id int, parent_id int, ord int, dict_key string, kind string, lexeme string, bytes binary, ref_num bigint, ref_gen int, span_start bigint, span_end bigint, depth int, consumed bigint, error string"


def decode_filters(data: pd.Series, filters: pd.Series) -> pd.Series:
    """Bytes through a chain of filters, each `Name` or `Name:predictor,colors,bits,columns`; null on any error."""
    from quire.kernel.errors import PdfError
    from quire.kernel.filters import decode, unpredict

    def one(raw, chain):
        if raw is None or chain is None:
            return None
        raw = bytes(raw)
        try:
            for step in chain:
                name, _, parms = step.partition(":")
                raw = decode(name.encode(), raw, 256 << 20)
                if parms:
                    raw = unpredict(raw, *map(int, parms.split(",")))
        except (PdfError, ValueError):
            return None
        return raw

    return pd.Series([one(d, c) for d, c in zip(data, filters)], dtype=object)


def register(spark: SparkSession) -> None:
    """Make pdf_lex, pdf_parse_object (table functions) and pdf_decode (scalar) known to SQL."""
    spark.udtf.register("pdf_lex", F.udtf(Lex, returnType=LEX))
    spark.udtf.register("pdf_parse_object", F.udtf(ParseObject, returnType=NODES))
    spark.udf.register("pdf_decode", F.pandas_udf(decode_filters, "binary"))
