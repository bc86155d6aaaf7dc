"""File structure as tables: precedence, references, the page tree, regions and bytes, over what the kernel found."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..options import Limits, ParseOptions


class Structure:
    """Tables over one parse_structure() result."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _exploded(self, column: str) -> DataFrame:
        return self.rows.select("doc_id", F.explode(column).alias("x")).select("doc_id", "x.*")

    def records(self) -> DataFrame:
        return self._exploded("records")

    def objects(self) -> DataFrame:
        return self._exploded("objects")

    def nodes(self) -> DataFrame:
        return self._exploded("nodes")

    def trailer(self) -> DataFrame:
        return self._exploded("trailer")

    def regions(self) -> DataFrame:
        return self._exploded("regions")

    def sources(self) -> DataFrame:
        return self._exploded("sources")

    def errors(self) -> DataFrame:
        return self.rows.filter("error IS NOT NULL").select("doc_id", "error.*")

    def resolved_xref(self) -> DataFrame:
        """The record in force for each object number: the one of the newest section that has it."""
        newest = F.row_number().over(Window.partitionBy("doc_id", "num").orderBy("section"))
        return self.records().withColumn("_n", newest).filter("_n = 1").drop("_n")

    def region_counts(self, *kinds: str) -> DataFrame:
        """doc_id, n: how many regions of these kinds each file has that has any, counted in its row."""
        n = F.size(F.filter("regions", lambda r: r["kind"].isin(*kinds))).alias("n")
        return self.rows.select("doc_id", n).filter("n > 0")

    def gaps(self, claimed: DataFrame, length: DataFrame) -> DataFrame:
        """Unknown intervals between claimed, disjoint ones (doc_id, start, end) of files (doc_id, length)."""
        order = Window.partitionBy("doc_id").orderBy("start")
        after = claimed.join(length, "doc_id").select("doc_id", F.col("end").alias("start"), F.coalesce(F.lead("start").over(order), F.col("length")).alias("end"))
        first = length.join(claimed.groupBy("doc_id").agg(F.min("start").alias("_s")), "doc_id", "left").select("doc_id", F.lit(0).cast("bigint").alias("start"), F.coalesce("_s", "length").alias("end"))
        return first.union(after).filter("start < end")

    def _beside(self, references: DataFrame | Column) -> DataFrame:
        """doc_id, asked (array of references), roots, records: each document's references in its row.

        References are a table (doc_id, ref_num, ref_gen, any others), gathered by document and met in one join, or a
        column of the structure's rows (array of structs), for which nothing is moved.
        """
        root = F.filter("nodes", lambda n: n["parent_id"].isNull())
        roots = F.transform(root, lambda n: F.struct(*(n[c].alias(c) for c in ("num", "gen", "kind", "lexeme", "bytes", "ref_num", "ref_gen"))))
        records = F.transform("records", lambda r: F.struct(*(r[c].alias(c) for c in ("section", "num", "entry_type", "field_b"))))
        given = [roots.alias("roots"), records.alias("records")]
        if isinstance(references, Column):
            return self.rows.select("doc_id", references.alias("asked"), *given)
        rest = [c for c in references.columns if c != "doc_id"]
        listed = references.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("asked"))
        # what is parsed is estimated as no larger than what was scanned for it: without the hint it would be broadcast
        return listed.join(self.rows.select("doc_id", *given).hint("merge"), "doc_id", "left").select("doc_id", "asked", "roots", "records")

    def resolve(self, references: DataFrame | Column, strict: bool = False) -> DataFrame:
        """References (doc_id, ref_num, ref_gen; or an array of them in each row) with their object's root node; none, and an error if strict, where undefined.

        A reference never leaves its document: each document's are looked up in its row, and nodes and records are
        not dealt out by object.
        """
        beside = self._beside(references)
        found = T.StructType.fromDDL("found array<struct<kind:string,lexeme:string,bytes:binary,next_num:bigint,next_gen:int,error:string>>")
        out, arrow = T.StructType([*beside.schema.fields[:2], *found.fields]), to_arrow_schema(found).field(0).type

        def run(batches):
            for batch in batches:
                for part in _parts(batch):
                    known = zip(*(part.column(c).to_pylist() for c in ("asked", "roots", "records")))
                    rows = [_looked_up(asked or [], roots or [], _in_force(records)) for asked, roots, records in known]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, arrow)], ["doc_id", "asked", "found"])

        each = beside.mapInArrow(run, out).select("doc_id", F.explode(F.arrays_zip("asked", "found")).alias("x")).select("doc_id", "x.asked.*", "x.found.*")
        own = [f.name for f in beside.schema["asked"].dataType.elementType.fields]
        columns = ["doc_id", *own] if isinstance(references, Column) else references.columns
        keep = ["kind", "lexeme", "bytes", "next_num", "next_gen"]
        return each.select(*columns, *keep, "error") if strict else each.select(*columns, F.coalesce("kind", F.lit("null")).alias("kind"), *keep[1:])

    def chains(self, references: DataFrame | Column, depth: int = 256) -> DataFrame:
        """References (doc_id, ref_num, ref_gen; or an array of them in each row) followed to the end: hops, kind, lexeme, error (cycle or limit).

        A chain never leaves its document, so each document's references meet its row of objects in one join at most
        and are followed there: no step is a join, and nothing but a document's own size bounds a row.
        """
        beside = self._beside(references).withColumn("asked", F.array_distinct(F.transform("asked", lambda r: F.struct(r["ref_num"].alias("ref_num"), r["ref_gen"].alias("ref_gen")))))
        kind = beside.schema["doc_id"].dataType.simpleString()
        out = f"doc_id {kind}, first_num bigint, first_gen int, hops int, kind string, lexeme string, error string"
        arrow = to_arrow_schema(T.StructType.fromDDL(out))

        def run(batches):
            for batch in batches:
                for part in _parts(batch):
                    rows = []
                    for row in part.to_pylist():
                        force = _in_force(row["records"])
                        at = {(o["num"], o["gen"]): o for o in row["roots"] or [] if _usable(force.get(o["num"]), o["gen"])}
                        found = [(r["ref_num"], r["ref_gen"]) for r in row["asked"] or []]
                        rows += [{"doc_id": row["doc_id"], "first_num": f[0], "first_gen": f[1]} | _follow(at, f, depth) for f in found]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return beside.mapInArrow(run, out)

    def page_tree(self, depth: int = 128) -> DataFrame:
        """doc_id, page, num, gen and inherited attributes of each page, from the objects' nodes alone.

        Each document's row is walked where it lies: no shuffle (parse_page_tree() gives the same rows from the files,
        without a structure between). media_box and crop_box are as written; resources is
        the number of the object that holds the dictionary in force (null if there is none). A tree that is too deep,
        leads back to itself or is malformed gives one row with `error` after the pages before it.
        """
        kind = self.rows.schema["doc_id"].dataType.simpleString()
        out = f"doc_id {kind}, {schema.TREE}"
        arrow = to_arrow_schema(T.StructType.fromDDL(out))

        def run(batches):
            from ..kernel.tree import of_rows

            for batch in batches:
                for part in _parts(batch):
                    found = [{"doc_id": row["doc_id"]} | p for row in part.to_pylist() for p in of_rows(row["nodes"] or [], row["trailer"] or []).pages(depth)]
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

        read = ("num", "gen", "node_id", "parent_id", "ord", "dict_key", "kind", "lexeme", "bytes", "ref_num", "ref_gen")
        nodes = F.transform("nodes", lambda n: F.struct(*(n[c].alias(c) for c in read)))
        return self.rows.select("doc_id", nodes.alias("nodes"), "trailer").mapInArrow(run, out)

    def duplicate_keys(self) -> DataFrame:
        """Dictionaries with a key that stands twice."""
        keyed = self.nodes().filter("dict_key IS NOT NULL")
        return keyed.groupBy("doc_id", "num", "parent_id", "dict_key").count().filter("count > 1")

    def orphans(self) -> DataFrame:
        """Objects that no reference, and no trailer entry, points at."""
        used = self.nodes().filter("kind = 'reference'").select("doc_id", F.col("ref_num").alias("num")).union(self.trailer().filter("kind = 'reference'").select("doc_id", "ref_num"))
        return self.objects().filter("origin != 'error'").join(used, ["doc_id", "num"], "left_anti")


def _parts(batch: pa.RecordBatch, rows: int = 256, size: int = 4 << 20):
    """Slices of a batch that are small as Python objects too: few rows, fewer if rows are large."""
    step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _in_force(records: list[dict] | None) -> dict[int, dict]:
    """The record in force for each object number: the one of the newest section that has it."""
    force: dict[int, dict] = {}
    for r in sorted(records or [], key=lambda r: r["section"]):
        force.setdefault(r["num"], r)
    return force


def _looked_up(asked: list[dict], roots: list[dict], force: dict[int, dict]) -> list[dict]:
    """For each reference its object's root, or why there is none."""
    root, out = {o["num"]: o for o in roots}, []
    for r in asked:
        num, gen = r["ref_num"], r["ref_gen"]
        entry = force.get(num)
        kind = None if entry is None else entry["entry_type"]
        o, error = None, {None: "absent", "free": "free", "unknown": "unknown entry"}.get(kind)
        if error is None and gen is not None:
            o, error = (root.get(num), None) if _usable(entry, gen) else (None, "generation mismatch")
        same = {"next_num": o["ref_num"], "next_gen": o["ref_gen"]} | {c: o[c] for c in ("kind", "lexeme", "bytes")} if o else dict.fromkeys(("kind", "lexeme", "bytes", "next_num", "next_gen"))
        out.append(same | {"error": error})
    return out


def _usable(record: dict | None, gen: int) -> bool:
    """Whether the cross-reference record in force leads to an object of this generation."""
    return record is not None and record["entry_type"] in ("in_use", "compressed") and gen == (record["field_b"] if record["entry_type"] == "in_use" else 0)


def _follow(objects: dict, first: tuple, depth: int) -> dict:
    """Hops from a reference to a value, and the value's kind and lexeme; an undefined object is null."""
    path, hops, kind, lexeme = [first], 0, "reference", None
    while kind == "reference":
        if hops > depth:
            return {"hops": hops, "kind": None, "lexeme": None, "error": "limit"}
        hops += 1
        o = objects.get(path[-1])
        if o is None:
            return {"hops": hops, "kind": None if hops > depth else "null", "lexeme": None, "error": "limit" if hops > depth else None}
        kind, lexeme = o["kind"], o["lexeme"]
        if kind == "reference":
            after = (o["ref_num"], o["ref_gen"])
            if after in path:
                return {"hops": hops, "kind": None, "lexeme": None, "error": "cycle"}
            path.append(after)
    over = hops > depth
    return {"hops": hops, "kind": None if over else kind, "lexeme": None if over else lexeme, "error": "limit" if over else None}


def bytes_of(spans: DataFrame, contents: DataFrame, content_col: str = "content") -> DataFrame:
    """Spans (doc_id, start, end and any other columns) of the file with their bytes.

    A document's spans are gathered into one row before they meet its bytes, so a file is moved once however many
    spans it has; cutting is a JVM expression. Null where a span lies outside the file.
    """
    rest = [c for c in spans.columns if c != "doc_id"]
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("_spans"))
    inside = listed.join(contents.select("doc_id", F.col(content_col).alias("_content")), "doc_id")

    def cut(s):
        ok = (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.octet_length("_content"))
        piece = F.substring("_content", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        return F.struct(*(s[c].alias(c) for c in rest), F.when(ok, piece).alias("bytes"))

    return inside.select("doc_id", F.explode(F.transform("_spans", cut)).alias("_s")).select("doc_id", "_s.*")


def source_bytes(spans: DataFrame, contents: DataFrame, options: ParseOptions | None = None, content_col: str = "content") -> DataFrame:
    """Spans (doc_id, source, start, end and others) of any source with their bytes: the file, decoded streams, joined contents.

    Sources are numbered as they arise, so this repeats the reading that gave the spans: parse_structure()'s, or that
    of parse() under `options`. A document's spans and its bytes meet in one row. Null where a span has no source.
    """
    rest = [c for c in spans.columns if c != "doc_id"]
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("spans"))
    given = listed.join(contents.select("doc_id", F.col(content_col).alias("content")), "doc_id")
    out = T.StructType([*spans.schema.fields, T.StructField("bytes", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        from ..kernel.rows import sources

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                known = sources(row["content"], options) if row["content"] is not None else {}
                found = []
                for s in row["spans"]:
                    data = known.get(s["source"])
                    ok = data is not None and 0 <= s["start"] <= s["end"] <= len(data)
                    found.append({"doc_id": row["doc_id"]} | s | {"bytes": data[s["start"] : s["end"]] if ok else None})
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return given.select("doc_id", "spans", "content").mapInArrow(run, out)


def stream_data(streams: DataFrame, contents: DataFrame, limits: Limits | None = None, content_col: str = "content") -> DataFrame:
    """Decoded bytes of stream objects (doc_id, num, gen and others): image pixels, font programs, embedded files.

    Only the asked streams are decoded. `error` says why there are no bytes.
    """
    rest = [c for c in streams.columns if c != "doc_id"]
    listed = streams.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("streams"))
    given = listed.join(contents.select("doc_id", F.col(content_col).alias("content")), "doc_id")
    out = T.StructType([*streams.schema.fields, T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType())])
    arrow, limits = to_arrow_schema(out), (limits or Limits()).checked()

    def run(batches):
        from ..kernel.rows import stream_bytes

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                decoded = stream_bytes(row["content"], [(s["num"], s["gen"]) for s in row["streams"]], limits)
                yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"]} | s | {"bytes": d, "error": e} for s, (d, e) in zip(row["streams"], decoded)], schema=arrow)

    return given.select("doc_id", "streams", "content").mapInArrow(run, out)
