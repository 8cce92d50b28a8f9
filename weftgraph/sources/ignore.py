"""Ignore rules of a source tree, as a join of paths' ancestors with compiled rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def glob_to_regex(glob: str) -> str:
    """A glob as a regular expression over the path below the rules' folder."""
    rooted = glob.startswith("/") or "/" in glob.rstrip("/")
    out, i, g = "", 0, glob.lstrip("/").rstrip("/")
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[" and (end := g.find("]", i + 2)) > 0:
            body = g[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif g[i] == "\\" and i + 1 < len(g):
            out, i = out + re.escape(g[i + 1]), i + 2
        else:
            out, i = out + re.escape(g[i]), i + 1
    return ("^" if rooted else "^(?:.*/)?") + out + "$"


def compile_rules(spark: SparkSession, files: list[tuple[str, str]], never: tuple[str, ...] = (".git",)) -> DataFrame:
    """Rules of (folder, text) pairs: (base, ord, negated, dir_only, pattern), nearer folders later; ``never``: folders that
    are out at any depth, whatever the rules say."""
    rows = []
    for base, text in sorted(files, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])):
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            glob = line[1:] if negated else line
            rows.append((base + "/" if base else "", len(rows), negated, glob.endswith("/"), glob_to_regex(glob)))
    rows += [("", len(rows) + k, False, True, glob_to_regex(name)) for k, name in enumerate(never)]
    return spark.createDataFrame(rows, "base string, ord int, negated boolean, dir_only boolean, pattern string")


def ignore_filter(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, included): the last rule that fits decides on each ancestor; a file below an excluded folder stays out."""
    parts = F.split("path", "/")
    each = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("at"), (i < F.size(parts)).alias("is_dir")))).alias("x")).select("path", "x.*")
    steps = each.select("at", "is_dir").distinct()
    fits = steps.join(F.broadcast(rules), F.col("at").startswith(F.col("base")) & (F.col("is_dir") | ~F.col("dir_only")) & F.expr("substring(at, char_length(base) + 1) rlike pattern"))
    verdict = fits.groupBy("at", "is_dir").agg(F.max_by("negated", "ord").alias("kept"))
    return each.join(verdict, ["at", "is_dir"], "left").groupBy("path").agg(F.bool_and(F.coalesce("kept", F.lit(True))).alias("included"))


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, modified, length) of files with one of the extensions, any depth, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path"), F.col("modificationTime").alias("modified"), "length")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*[e.lstrip(".").lower() for e in extensions]))


def included_files(spark: SparkSession, root: str, extensions: tuple[str, ...], rules: DataFrame) -> DataFrame:
    """(path below the root, modified, length) of files with one of the extensions that no rule shuts out."""
    top = root.rstrip("/")
    found = scan_files(spark, root, extensions)
    below = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    found = found.withColumn("path", F.substr(below, F.lit(len(top) + 2)))
    return found.join(ignore_filter(found.select("path"), rules).where("included").select("path"), "path", "left_semi")
