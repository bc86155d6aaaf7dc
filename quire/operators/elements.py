"""Element tables of parsed documents, each an explode of the page rows; position is `ord`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Parsed:
    """Tables over one parse() result. Tables share the kernel's work after write() or persist(); each report runs it once."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def persist(self) -> "Parsed":
        self.rows = self.rows.persist()
        return self

    def write(self, path: str) -> "Parsed":
        """The same tables over rows written to a folder: the kernel runs once, and each table reads only its own columns."""
        self.rows.write.parquet(path)
        return Parsed(self.rows.sparkSession.read.schema(self.rows.schema).parquet(path))

    def close(self) -> None:
        """Drop what persist() kept; may be called again."""
        self.rows.unpersist()

    def files(self) -> DataFrame:
        return self.rows.filter("page = -1").select("doc_id", "file.*").drop("n_pages", "fonts", "image_resources", "diagnostics", "error")

    def _pages(self) -> DataFrame:
        return self.rows.filter("page >= 0")

    def pages(self) -> DataFrame:
        return self._pages().select("doc_id", "page", "num", "gen", "media_box", "crop_box", "rotate", "user_unit", "complete", "n_operations")

    def _elements(self, column: str) -> DataFrame:
        return self._pages().select("doc_id", "page", F.posexplode(column).alias("ord", "x")).select("doc_id", "page", "ord", "x.*")

    def texts(self) -> DataFrame:
        return self._elements("texts")

    def glyphs(self) -> DataFrame:
        texts = self.texts().select("doc_id", "page", F.col("ord").alias("text_ord"), "font_size", F.posexplode("glyphs").alias("glyph_ord", "x"))
        return texts.select("doc_id", "page", "text_ord", "glyph_ord", "font_size", "x.*")

    def graphics(self) -> DataFrame:
        return self._elements("graphics")

    def images(self) -> DataFrame:
        return self._elements("images")

    def annotations(self) -> DataFrame:
        return self._elements("annotations")

    def operations(self) -> DataFrame:
        return self._elements("operations")

    def page_items(self) -> DataFrame:
        return self._elements("items")

    def _of_file(self, column: str) -> DataFrame:
        return self.rows.filter("page = -1").select("doc_id", F.posexplode(f"file.{column}").alias("ord", "x")).select("doc_id", "ord", "x.*")

    def fonts(self) -> DataFrame:
        return self._of_file("fonts")

    def image_resources(self) -> DataFrame:
        return self._of_file("image_resources")

    def diagnostics(self) -> DataFrame:
        return self._of_file("diagnostics")

    def errors(self) -> DataFrame:
        return self.rows.filter("page = -1 AND file.error IS NOT NULL").select("doc_id", "file.error.*")

    def outcomes(self) -> DataFrame:
        """One row a document, from its file row alone, so that nothing is moved: header, pages, diagnostics (their codes), and the error, null where there is none."""
        codes = F.transform(F.coalesce("file.diagnostics", F.array()), lambda d: d["code"])
        own = [F.col(f"file.{c}").alias(c) for c in ("header_start", "version_major", "version_minor")]
        return self.rows.filter("page = -1").select("doc_id", *own, F.coalesce("file.n_pages", F.lit(0)).cast("bigint").alias("pages"), codes.alias("codes"), "file.error.class", "file.error.message")

    def page_outcomes(self) -> DataFrame:
        """page_counts() with the count of the file's diagnostics and the class of its error: a document's rows meet once, however many there are."""
        counts = self.page_counts().schema.names[1:]
        n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
        page = F.struct((F.col("page") + 1).alias("page"), "complete", *(n(c).alias(c) for c in counts[2:]))
        of_file = F.struct(n("file.diagnostics").alias("diagnostics"), F.col("file.error.class").alias("class"))
        rows = self.rows.select("doc_id", F.when(F.col("page") >= 0, page).alias("p"), F.when(F.col("page") < 0, of_file).alias("f"))
        per = rows.groupBy("doc_id").agg(F.collect_list("p").alias("p"), F.collect_list("f").alias("f"))
        return per.select("doc_id", F.col("f")[0].alias("f"), F.explode("p").alias("p")).select("doc_id", *(f"p.{c}" for c in counts), "f.*")

    def by_page(self) -> DataFrame:
        """Texts and graphics grouped by page in execution order; pages without any have empty arrays."""
        return self._pages().select("doc_id", "page", "media_box", "crop_box", F.coalesce("texts", F.array()).alias("texts"), F.coalesce("graphics", F.array()).alias("graphics"))

    def page_counts(self) -> DataFrame:
        """Counts and completeness of each page (numbered from 1)."""
        n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
        return self._pages().select("doc_id", (F.col("page") + 1).alias("page"), F.col("complete"), n("texts").alias("texts"), n("graphics").alias("graphics"), n("images").alias("images"), n("annotations").alias("annotations"))

    def _counts(self) -> list[Column]:
        """Aggregates over a document's rows, its pages' and its file's, so that one pass of the kernel gives them all."""
        own = lambda c: F.sum(F.when(F.col("page") >= 0, F.coalesce(F.size(c), F.lit(0)))).cast("bigint")
        of_file = lambda c: F.max(F.coalesce(F.size(f"file.{c}"), F.lit(0))).cast("bigint")
        pages = F.count_if(F.col("page") >= 0).alias("pages")
        kinds = [F.coalesce(own(c), F.lit(0)).alias(c) for c in ("texts", "graphics", "images", "annotations")]
        return [of_file("image_resources").alias("image_resources"), of_file("fonts").alias("fonts"), of_file("diagnostics").alias("diagnostics"), pages, *kinds]

    def summary(self) -> DataFrame:
        """Counts of each document; documents without pages stay. Documents without an id are counted as one."""
        return self.rows.groupBy("doc_id").agg(*self._counts())

    def summary_json(self) -> DataFrame:
        """doc_id, json: counts with the pages' own counts inside."""
        n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c)
        page = F.struct((F.col("page") + 1).alias("page"), F.col("complete").alias("interpretation_complete"), n("texts"), n("graphics"), n("images"))
        details = F.array_sort(F.collect_list(F.when(F.col("page") >= 0, page)))
        keys = ["pages", "texts", "graphics", "images", "image_resources", "fonts", "annotations", "diagnostics"]
        per = self.rows.groupBy("doc_id").agg(*self._counts(), details.alias("page_details"))
        return per.select("doc_id", F.to_json(F.struct(*keys, F.when(F.size("page_details") > 0, F.col("page_details")).alias("page_details"))).alias("json"))

    def result_json(self) -> DataFrame:
        """doc_id, json of the whole result without what is empty: content, detail, pages, image resources, diagnostics; bytes as base64."""
        some = lambda c, name: F.when(F.size(c) > 0, F.col(c)).alias(name)
        kinds = ("texts", "graphics", "images", "annotations", "operations")
        page = F.to_json(F.struct("page", "media_box", "crop_box", "rotate", "user_unit", "complete", *(some(c, c) for c in kinds)))
        pages = F.array_sort(F.collect_list(F.when(F.col("page") >= 0, F.struct("page", page.alias("j")))))
        detail = F.when(F.col("file.detail") > 0, F.col("file.detail")).alias("detail")
        rest = F.to_json(F.struct(F.col("file.content").alias("content"), detail, some("file.image_resources", "image_resources"), some("file.diagnostics", "diagnostics")))
        per = self.rows.groupBy("doc_id").agg(F.max(F.when(F.col("page") < 0, rest)).alias("_rest"), F.array_join(F.transform(pages, lambda x: x["j"]), ",").alias("_pages"))
        whole = F.concat(F.expr("substring(_rest, 1, length(_rest) - 1)"), F.lit(',"pages":['), "_pages", F.lit("]}"))
        return per.select("doc_id", whole.alias("json"))

    def plain_text(self) -> DataFrame:
        """doc_id, text: a line per show operation, a form feed line between pages."""
        lines = self._pages().select("doc_id", "page", F.concat(F.when(F.col("page") > 0, F.lit("\f\n")).otherwise(""), F.array_join(F.transform("texts", lambda t: F.concat(F.coalesce(t["unicode"], F.lit("")), F.lit("\n"))), "")).alias("s"))
        return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "s"))), lambda x: x["s"]), "").alias("text"))

    def layout(self, gap: float = 0.5) -> DataFrame:
        """doc_id, page, y, line: visual lines rebuilt from glyph positions (needs text at full detail)."""
        return page_lines(self._pages(), gap)


def page_lines(pages: DataFrame, gap: float = 0.5) -> DataFrame:
    """layout() of page rows, where they lie: a page's glyphs are sorted and joined inside its row, and none becomes a row or moves."""

    def placed(t, i):
        x = lambda g: g["origin"]["x"]
        return F.transform(t["glyphs"], lambda g, k: F.struct(F.round(g["origin"]["y"]).cast("bigint").alias("y"), x(g).alias("x"), i.alias("text_ord"), k.alias("glyph_ord"), (x(g) + g["advance"]["x"]).alias("end"), t["font_size"].alias("size"), g["unicode"].alias("unicode")))

    glyphs = F.array_sort(F.flatten(F.transform(F.filter("texts", lambda t: t["glyphs"].isNotNull()), placed)))
    rows = pages.select("doc_id", "page", glyphs.alias("g"))
    at = lambda i: F.get("g", i)  # noqa: E731  null outside
    wide = lambda v, b: (b["y"] == v["y"]) & (v["x"] - b["end"] > v["size"] * gap) & b["unicode"].rlike(r"\S")
    marked = F.transform("g", lambda v, i: F.concat(F.when(wide(v, at(i - 1)), " ").otherwise(""), v["unicode"]))
    firsts = F.filter(F.transform("g", lambda v, i: i), lambda i: (i == 0) | (at(i - 1)["y"] != at(i)["y"]))
    rows = rows.select("doc_id", "page", "g", marked.alias("s"), firsts.alias("firsts"))
    line = lambda a, k: F.struct(at(a)["y"].alias("y"), F.rtrim(F.array_join(F.slice("s", a + 1, F.coalesce(F.get("firsts", k + 1), F.size("g")) - a), "")).alias("line"))
    return rows.select("doc_id", "page", F.explode(F.transform("firsts", line)).alias("l")).select("doc_id", "page", "l.y", "l.line")


def layout(glyphs: DataFrame, gap: float = 0.5) -> DataFrame:
    """Glyphs of one page and rounded height, left to right; a gap above `gap` of the font size is a space."""
    g = glyphs.select("doc_id", "page", F.round("origin.y").cast("bigint").alias("y"), F.col("origin.x").alias("x"), (F.col("origin.x") + F.col("advance.x")).alias("end"), F.col("font_size"), "unicode", F.struct("text_ord", "glyph_ord").alias("nth"))
    line = Window.partitionBy("doc_id", "page", "y").orderBy("x", "nth")
    wide = (F.col("x") - F.lag("end").over(line) > F.col("font_size") * gap) & (F.trim(F.regexp_replace(F.lag("unicode").over(line), r"\s+", "")) != "")
    marked = g.withColumn("s", F.concat(F.when(wide, " ").otherwise(""), F.col("unicode")))
    joined = marked.groupBy("doc_id", "page", "y").agg(F.array_sort(F.collect_list(F.struct("x", "nth", "s"))).alias("l"))
    return joined.select("doc_id", "page", "y", F.rtrim(F.array_join(F.transform("l", lambda v: v["s"]), "")).alias("line"))


def layout_text(lines: DataFrame) -> DataFrame:
    """doc_id, text: lines from the top of each page, a form feed line between pages."""
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "line"))), lambda v: v["line"]), "\n").alias("s"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "s"))), lambda v: v["s"]), "\n\f\n").alias("text"))


def running_depth(operations: DataFrame, opens: str = "q", closes: str = "Q") -> DataFrame:
    """Nesting after each operation of a page: an audit of balanced operators."""
    order = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    step: Column = F.when(F.col("operator") == opens, 1).when(F.col("operator") == closes, -1).otherwise(0)
    return operations.withColumn("nesting", F.sum(step).over(order))
