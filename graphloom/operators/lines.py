"""Symbols of source files by one rule a line: a fallback without a parser, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of, stable_id

#: (languages, kind, pattern whose group is the name): the first rule of a language that gives a name counts.
RULES = (
    (("rust",), "function", r"^(?:pub )?fn ([^(]*)"),
    (("rust",), "class", r"^(?:pub )?struct +([^\s{]+)"),
    (("rust",), "function", r"fn (main)\("),
    (("python",), "function", r"^def ([^(]*)"),
    (("python",), "class", r"^class ([^(:]*)"),
    (("typescript", "javascript"), "function", r"function ([^(]*)"),
    (("typescript", "javascript"), "class", r"^(?:export )?class +([^\s{]+)"),
    (("go",), "function", r"^func (?:\([^)]*\) *)?([^(]*)"),
    (("go",), "class", r"^type (\S+).* struct"),
    (("java",), "class", r"(?:^|\s)class\s+([^\s{]+)"),
    (("java",), "function", r"^(?=.*(?: void |public ))(?:[^(]*\s)?([^\s(]+)\s*\("),
)
COMMENTS = ("//", "#")


def line_symbols(files: DataFrame) -> DataFrame:
    """(id, kind, name, fqn, file_path, start_line, end_line, visibility) from files (path, language, text).

    Comment lines, other languages and null texts give nothing, nor does a declaration without a name. A Go function without a receiver keeps its own name.
    Only Rust functions without `pub` are private."""
    line = F.btrim("raw", F.lit(" \t\r\f\v"))
    rows = files.select("path", "language", F.posexplode(lines_of(F.col("text"))).alias("at", "raw")).select("path", "language", (F.col("at") + 1).alias("start_line"), line.alias("line"))
    for mark in COMMENTS:
        rows = rows.where(~F.col("line").startswith(mark))

    def named(languages: tuple[str, ...], kind: str, pattern: str) -> F.Column:
        name = F.trim(F.regexp_extract("line", pattern, 1))
        return F.when(F.col("language").isin(*languages) & (name != ""), F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    met = rows.withColumn("found", F.coalesce(*(named(*rule) for rule in RULES))).where("found is not null").select("path", "language", "start_line", "line", "found.*")
    private = (F.col("language") == "rust") & (F.col("kind") == "function") & F.col("line").startswith("fn ")
    return met.select(
        stable_id("symbol", F.col("path"), F.col("name"), F.col("start_line"), F.col("kind")).alias("id"),
        "kind",
        "name",
        F.concat("path", F.lit("::"), "name").alias("fqn"),
        F.col("path").alias("file_path"),
        "start_line",
        F.col("start_line").alias("end_line"),
        F.when(private, "private").otherwise("public").alias("visibility"),
    )
