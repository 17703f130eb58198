"""Compilation databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, directory string, command string, arguments array<string>"
SOURCE = r"\.(c|cc|cpp|cxx|c\+\+|C)$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(file, directory, arguments)`` with absolute files; a command is split at blanks outside quotes (S-04)."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    words = F.regexp_extract_all("command", F.lit(r'(?:[^\s"\']+|"[^"]*"|\'[^\']*\')+'), F.lit(0))
    words = F.transform(words, lambda w: F.regexp_replace(w, "[\"']", ""))
    full = F.when(F.col("file").startswith("/") | F.col("directory").isNull(), F.col("file")).otherwise(F.concat("directory", F.lit("/"), "file"))
    return rows.select(full.alias("file"), "directory", F.coalesce("arguments", words).alias("arguments"))


def clean_arguments(c: Column | str) -> Column:
    """Arguments a parser needs: without the compiler, outputs, sources, warnings; ``-isystem X`` as one (S-05).

    The fold carries what the next argument is: nothing special, to be skipped, or joined to the last.
    """
    args = F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("next"))

    def step(acc: Column, x: Column) -> Column:
        out, nxt = acc["out"], acc["next"]
        plain = F.when(x.rlike("^-W|^-pedantic|^-c$|^-M") | (x.rlike(SOURCE) & ~x.startswith("-")), out).otherwise(F.array_append(out, x))
        new = F.when(nxt == "skip", out).when(nxt != "", F.array_append(out, F.concat(nxt, x))).when(x.isin("-o", "-MF", "-MT", "-MQ", "-isystem"), out).otherwise(plain)
        then = F.when(nxt != "", F.lit("")).when(x.isin("-o", "-MF", "-MT", "-MQ"), F.lit("skip")).when(x == "-isystem", F.lit("-isystem")).otherwise(F.lit(""))
        return F.struct(new.alias("out"), then.alias("next"))

    return F.aggregate(args, start, step, lambda acc: acc["out"])


def select(rows: DataFrame, source_paths: list[str], exclude: list[str] | None = None, generated: list[str] | None = None, keep_headers: bool = False) -> DataFrame:
    """Entries to parse: not excluded, in the project's paths, not generated, and no headers unless asked for (S-06)."""
    def any_of(parts: list[str] | None) -> Column:
        return F.exists(F.array(*map(F.lit, parts)), lambda p: F.col("file").contains(p)) if parts else F.lit(False)

    out = rows.where(~any_of(exclude))
    if source_paths:
        out = out.where(any_of(source_paths))
    out = out.where(~any_of(generated))
    return out if keep_headers else out.where(F.col("file").rlike(SOURCE))


def lookup(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``(wanted, file, arguments)``: the entry of each of ``files(wanted)`` (S-07).

    That of the same path, else one whose path has it as a part, else one whose path it ends with; of
    several the first by path. Parts are found by a join on the first letters at every place of a path.
    """
    low = files.select("wanted").where("wanted <> ''").distinct()
    wanted = low.withColumn("gram", F.substring("wanted", 1, 3))
    size = F.length("file")
    gram = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.substring(F.col("file"), i, F.lit(k)))
    placed = rows.select("file", "arguments", F.explode(F.array_distinct(F.concat(gram(1), gram(2), gram(3)))).alias("gram"))
    part = wanted.join(placed, "gram").where(F.col("file").contains(F.col("wanted")))
    part = part.select("wanted", "file", "arguments", F.when(F.col("file") == F.col("wanted"), 0).otherwise(1).alias("rank"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    longer = low.withColumn("base", base("wanted")).join(rows.select("file", "arguments", base("file").alias("base")), "base")
    longer = longer.where(F.col("wanted").endswith(F.concat(F.lit("/"), F.regexp_replace("file", "^/", "")))).select("wanted", "file", "arguments", F.lit(2).alias("rank"))
    best = part.unionByName(longer).groupBy("wanted").agg(F.min(F.struct("rank", "file", "arguments")).alias("m"))
    return best.select("wanted", "m.file", "m.arguments")


def cross_flags(c: Column | str, triple: str | None, includes: list[str]) -> Column:
    """Arguments with a target triple and the toolchain's include folders (E-12)."""
    extra = ([f"--target={triple}"] if triple else []) + [f"-isystem{p}" for p in includes]
    base = F.col(c) if isinstance(c, str) else c
    return F.concat(base, F.array(*map(F.lit, extra))) if extra else base
