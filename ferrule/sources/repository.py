"""Reading a repository of source files and documentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Directories that a scan leaves out, and its limits.
IGNORED = ["target", "build", ".git", "node_modules", "generated", "out", ".idea", ".gradle"]
MOST_FILES, MOST_BYTES, MOST_DOC_BYTES = 20_000, 2_000_000, 200_000


def package_of(text: Column) -> Column:
    """The package that a source file declares outside comments; null if none."""
    code = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")
    # Statements end with semicolons; the one that names the package may follow annotations, not other code on its line.
    statements = F.split(code, ";")
    named = r"(?:^|[\n)]|@[\w.]+)\s*package\s+([\w.]+)\s*$"
    return F.regexp_extract(F.get(F.filter(F.slice(statements, F.lit(1), F.size(statements) - 1), lambda s: s.rlike(named)), F.lit(0)), named, 1)


def scan(spark: SparkSession, root: str, repository: str, suffix: str = ".java", ignored: Sequence[str] = IGNORED, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All files of a repository that end in ``suffix``, accepted or skipped with a reason, in the order of their paths.

    Columns: id, relative_path, size, reason (too_large, max_source_files, or null if accepted), hash, text, encoding_issue, package.
    Content is read only where a file is not too large; what is not UTF-8 is read as Latin-1 and flagged. The limit counts accepted
    files; to apply it, only paths and sizes are ordered.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    inside = ~F.arrays_overlap(F.split(relative, "/"), F.array(*map(F.lit, ignored)))
    listed = files.select(relative.alias("relative_path"), F.col("length").alias("size")).where(inside)
    fits = F.col("size") <= most_bytes
    # The order is total over one repository, whose number of paths its limit is about.
    before = F.sum(fits.cast("int")).over(Window.orderBy("relative_path").rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(F.coalesce(before, F.lit(0)) >= most_files, "max_source_files").when(~fits, "too_large")
    judged = listed.withColumn("reason", reason)
    read = files.where(F.col("length") <= most_bytes).select(relative.alias("relative_path"), "content")
    joined = judged.join(read, "relative_path", "left").withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return joined.select(
        F.substring(F.sha1(F.concat(F.lit(f"{repository}:"), F.col("relative_path"))), 1, 16).alias("id"),
        "relative_path",
        "size",
        "reason",
        F.sha2("content", 256).alias("hash"),
        text.alias("text"),
        (~utf8).alias("encoding_issue"),
        package_of(text).alias("package"),
    )


def markdown_sections(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The sections of Markdown texts that are not empty: path, heading, start_line, end_line, text."""
    lines = docs.select(path, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    head = F.col("line").rlike(r"^#{1,6}\s+\S")
    order = Window.partitionBy(path).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"head": head, "section": F.sum(head.cast("int")).over(order)})
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_replace("line", r"^[# ]+", ""))))
    sections = lines.groupBy(path, "section").agg(title.alias("heading"), F.min("pos").alias("first"), F.max("pos").alias("last"), body.alias("body"))
    joined = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return sections.select(
        path, F.coalesce("heading", F.lit("(top)")).alias("heading"), (F.col("first") + 1).alias("start_line"), (F.col("last") + 1).alias("end_line"), joined.alias("text")
    ).where("text <> ''")


def is_test(path: Column, class_name: Column, annotations: Column) -> Column:
    """Is a method test code: by its directory, the name of its class, or an annotation?"""
    simple = F.element_at(F.split(class_name, r"\."), -1)
    named = F.array(*map(F.lit, ["Test", "ParameterizedTest", "RepeatedTest", "TestFactory"]))
    folders = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    return F.arrays_overlap(folders, F.array(F.lit("test"), F.lit("tests"))) | simple.rlike("(Tests?|IT|Spec)$") | F.coalesce(F.arrays_overlap(annotations, named), F.lit(False))


def lines_of(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text, counted from 1, both included."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def documentation(spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED, most_bytes: int = MOST_DOC_BYTES) -> DataFrame:
    """The sections of a repository's README files, and of the Markdown files in its ``docs`` folder: path, is_readme and those of ``markdown_sections``.

    Files that are too large, or not UTF-8, are left out.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root).where(F.col("length") <= most_bytes)
    relative = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    folders = F.split(relative, "/")
    readme = F.lower(F.element_at(folders, -1)).startswith("readme")
    wanted = (readme | F.lower(relative).startswith("docs/")) & ~F.arrays_overlap(folders, F.array(*map(F.lit, ignored)))
    text = F.col("content").cast("string")
    told = files.where(wanted & F.is_valid_utf8(text)).select(relative.alias("path"), readme.alias("is_readme"), text.alias("text"))
    return markdown_sections(told).join(told.select("path", "is_readme"), "path")
