"""Log files and text file trees."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which files a workspace scan reads.
TEXT_SUFFIXES = (
    ".py", ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf",
    ".sh", ".js", ".ts", ".tsx", ".jsx",
    ".go", ".java", ".kt", ".kts", ".scala", ".rs", ".rb", ".cs", ".swift",
    ".html", ".css", ".scss", ".vue", ".svelte",
    ".c", ".cpp", ".h", ".hpp",
    ".env", ".properties", ".gradle",
)
TEXT_NAMES = ("Dockerfile", "SKILL.md", "README.md")
IGNORED_DIRS = (
    ".git", ".codebuddy", "node_modules", "vendor", "dist", "build", "coverage", "__pycache__", ".idea", ".vscode",
    "generated", "references", "tests", "assets", ".pytest_cache",
)


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a log file as event rows; a JSON line is read by the normalisation."""
    return lines.where(F.trim(F.col(column)) != "").select(F.col(column).alias("message"), F.lit("logs").alias("otel_signal"))


def read_log_files(spark: SparkSession, path: str, stream: bool = False, glob: str = "*.log", **options) -> DataFrame:
    """``*.log`` files below ``path``, as a batch or as a growing folder."""
    reader = (spark.readStream if stream else spark.read).options(pathGlobFilter=glob, **options)
    return log_lines(reader.text(path))


#: Encodings that are tried in this order after UTF-8; the last one reads any bytes.
LADDER = ("gb18030", "latin-1")


def decoded(raw: Column, encodings: Sequence[str]) -> Column:
    """``text`` and ``encoding`` of bytes by the first decoder that accepts all of them, null where none does."""
    names = tuple(encodings)

    @F.pandas_udf("text string, encoding string")
    def climb(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            found = (None, None)
            for name in names if content is not None else ():
                try:
                    found = bytes(content).decode(name), name
                    break
                except UnicodeDecodeError:
                    continue
            out.append(found)
        return pd.DataFrame(out, columns=["text", "encoding"])

    return climb(raw)


def read_text_tree(
    spark: SparkSession, path: str, max_bytes: int | None = None, ignored=IGNORED_DIRS, suffixes=TEXT_SUFFIXES, encodings: Sequence[str] = ()
) -> DataFrame:
    """Text files below ``path``: ``path`` relative to it, ``content`` as text, ``readable``.

    UTF-8 (a byte order mark is dropped). With ``encodings`` (for instance ``LADDER``) a file with other bytes is read by the first that
    accepts all of them, and the column ``encoding`` names it. Without, or if none does, ``readable`` is false and the content
    has replacement characters in place of the other bytes. ``max_bytes`` leaves out larger files, none by default. Empty files
    are not listed, as Spark does not read them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.regexp_replace(F.lit(path.rstrip("/")), "^file:/*", "/")
    plain = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    relative = F.when(plain.startswith(base), F.substr(plain, F.length(base) + 2)).otherwise(plain)
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    dot = F.regexp_extract(F.lower(name), r"(?<=.)(\.[^.]+)$", 1)
    wanted = dot.isin(*suffixes) | name.isin(*TEXT_NAMES)
    hidden = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in ignored]))
    files = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    raw = F.col("content").cast("string")
    kept = files.where(wanted & ~hidden)
    text, valid = F.regexp_replace(F.make_valid_utf8(raw), "^﻿", ""), F.is_valid_utf8(raw)
    if not encodings:
        return kept.select(relative.alias("path"), text.alias("content"), valid.alias("readable"))
    # Only the bytes of files that are not UTF-8 leave the JVM.
    climbed = kept.select(relative.alias("path"), "content", decoded(F.when(~valid, F.col("content")), encodings).alias("_d"))
    mark = F.when(F.startswith(F.col("content"), F.lit(b"\xef\xbb\xbf")), "utf-8-sig").otherwise("utf-8")
    return climbed.select(
        "path",
        F.when(valid, text).otherwise(F.coalesce("_d.text", text)).alias("content"),
        (valid | F.col("_d.text").isNotNull()).alias("readable"),
        F.when(valid, mark).otherwise(F.col("_d.encoding")).alias("encoding"),
    )


def read_config(spark: SparkSession, path: str) -> str:
    """Text of one small settings file (prices, alert rules, panels, discovery rules) on shared storage."""
    return spark.read.text(path, wholetext=True).first()["value"]
