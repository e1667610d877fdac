"""Reading a source tree as a table of files."""

from __future__ import annotations

import logging
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, language_of
from .store import STATE, qualified

IGNORE_FILES = (".gitignore", ".graphloomignore")
LANGUAGES_FILE = "graphloom.languages.toml"
HIDDEN = "path string, content binary, mtime_secs long"
log = logging.getLogger(__name__)


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))


def _hidden(spark: SparkSession, root: str) -> DataFrame:
    """Files whose path has a part that begins with a dot or an underscore: Spark's file sources pass them over."""
    from pyarrow import fs

    system, base = _file_system(root)
    infos = system.get_file_info(fs.FileSelector(base, recursive=True))
    paths = [i.path[len(base) :].lstrip("/") for i in infos if i.type == fs.FileType.File]
    paths = [p for p in paths if re.search(r"(^|/)[._]", p) and not p.startswith(STATE + "/")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        for batch in batches:
            for path in batch["path"]:
                full = f"{base}/{path}"
                with system.open_input_stream(full) as stream:
                    yield pd.DataFrame({"path": [path], "content": [stream.read()], "mtime_secs": [int(system.get_file_info(full).mtime_ns or 0) // 10**9]})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths) // 100, 1000))).mapInPandas(read, HIDDEN)


def rule_regex(rule: str) -> tuple[str, bool, bool] | None:
    """(regex, whether for directories only, whether it takes back) of a line of an ignore file; None for comments."""
    rule = rule.rstrip("\n\r ")
    if not rule or rule.startswith("#"):
        return None
    back, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
    only, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return ("" if anchored else "(?:.*/)?") + out, only, back


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether the path or a directory of it is ignored. rules: (directory, line), the last match counts."""
    known = [(re.escape(d + "/") if d else "", r) for d, line in rules if (r := rule_regex(line))]
    if not known:
        return F.lit(False)
    parts = F.split(path, "/")

    def by_rules(at: Column) -> Column:
        part, is_directory = F.array_join(F.slice(parts, 1, at), "/"), at < F.size(parts)
        out = F.lit(False)
        for base, (regex, only, back) in known:
            met = part.rlike(f"^{base}{regex}$")
            out = F.when(met & is_directory if only else met, F.lit(not back)).otherwise(out)
        return out

    return F.exists(F.sequence(F.lit(1), F.size(parts)), by_rules)


def _extensions(spark: SparkSession, root: str) -> dict[str, str]:
    """The built-in extensions with those of the tree's own language file; a file that doesn't parse counts for nothing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", LANGUAGES_FILE).load(root).select(F.decode("content", "UTF-8")).limit(1).collect()
    out = dict(EXTENSIONS)
    try:
        for language in tomllib.loads(found[0][0])["languages"] if found else ():
            if language["id"] in EXTENSIONS.values():
                out |= dict.fromkeys(language["extensions"], language["id"])
            else:
                log.warning("unknown language %s", language["id"])
    except (tomllib.TOMLDecodeError, KeyError, TypeError):
        log.warning("%s can't be read", LANGUAGES_FILE)
        return dict(EXTENSIONS)
    return out


def scan(spark: SparkSession, root: str, *, rules: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """(path, language, content_hash, mtime_secs, text) of the source files below root that no ignore file names.

    `rules` are further ignore lines, such as the user's own. Files that are not UTF-8 fail. An empty tree has no rows.
    `hidden` also reads files below names with a leading dot or underscore, through pyarrow's file systems; set it to
    False for stores that pyarrow can't open.
    """
    base = qualified(spark, root)
    rest = _hidden(spark, base) if hidden else spark.createDataFrame([], HIDDEN)
    extensions = _extensions(spark, base)
    visible = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(sorted(extensions)) + "}").load(base)
    visible = visible.select(F.substring("path", len(base) + 2, 1 << 30).alias("path"), "content", F.unix_timestamp("modificationTime").alias("mtime_secs"))
    lines = [("", r) for r in rules]
    if hidden:
        names = rest.where(F.element_at(F.split("path", "/"), -1).isin(*IGNORE_FILES)).select("path", F.decode("content", "UTF-8").alias("text")).collect()
        for row in sorted(names, key=lambda r: (r.path.count("/"), r.path.endswith(IGNORE_FILES[1]), r.path)):
            directory = row.path.rpartition("/")[0]
            lines += [(directory, line) for line in row.text.splitlines()]
    files = visible.unionByName(rest).withColumn("language", language_of(F.col("path"), extensions)).where("language is not null")
    kept = files.where(~ignored(F.col("path"), lines) & ~F.col("path").startswith(STATE + "/"))
    return kept.select("path", "language", F.sha2("content", 256).alias("content_hash"), "mtime_secs", F.decode("content", "UTF-8").alias("text"))

