"""Markdown folders, configuration, changes, telemetry and ground truth as sources; JSON, JSON lines and text as sinks."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from lodegraph.functions import text as t

# --- Markdown ----------------------------------------------------------------------------------------


def _decoder(encodings: tuple[str, ...]):
    """Bytes to text by the first encoding that fits; the last one replaces what it can't read."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for e in encodings[:-1] if b is not None else ():
                try:
                    return bytes(b).decode(e)
                except UnicodeDecodeError:
                    pass
            return None if b is None else bytes(b).decode(encodings[-1], "replace")

        return content.map(one)

    return decode


def read_markdown(spark: SparkSession, path: str, exclude: list[str] | None = None, encodings: tuple[str, ...] = ("UTF-8", "GBK"), modified_after: str | None = None) -> DataFrame:
    """``(path, text, modified)`` of all Markdown files under a folder, relative to it (S-08, S-09, S-15).

    A file that is no valid UTF-8 is read in the next encoding. ``exclude`` are shell patterns on
    the relative path.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string")).otherwise(_decoder(encodings)("content"))
    out = rows.select(F.replace("path", F.lit(full), F.lit("")).alias("path"), text.alias("text"), F.col("modificationTime").alias("modified"))
    return out.where(~t.matches_any("path", exclude)) if exclude else out


# --- configuration -----------------------------------------------------------------------------------


@dataclass
class ProjectConfig:
    """Settings of a project (S-10, S-11); unknown keys are ignored."""

    name: str = ""
    compile_commands: str = ""
    source_paths: list[str] = field(default_factory=list)
    generated_paths: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    target_triple: str = ""
    toolchain_includes: list[str] = field(default_factory=list)
    docs_dir: str = ""
    doc_dirs: list[str] = field(default_factory=list)
    extra_doc_dirs: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    tag_rules: list[dict] = field(default_factory=list)
    section_split: dict = field(default_factory=dict)
    manual_links: list[dict] = field(default_factory=list)
    lazy_increment: dict = field(default_factory=lambda: {"enabled": True, "threshold": 20})

    @classmethod
    def load(cls, text: str) -> ProjectConfig:
        """From JSON, or from YAML where a YAML library is installed."""
        try:
            data = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError("not JSON, and no YAML library is installed") from e
            data = yaml.safe_load(text)
        data = data or {}
        flat = {**data.pop("project", {}), **data}
        return cls(**{f.name: flat[f.name] for f in fields(cls) if flat.get(f.name) is not None})

    def rules(self) -> list[tuple[str, list[str]]]:
        return [(r["path_pattern"], list(r.get("tags", []))) for r in self.tag_rules]

    def links(self, spark: SparkSession) -> DataFrame:
        """Links given by hand: ``(doc, heading, code)`` (J-12)."""
        rows = [(x["doc"], x.get("heading", ""), c) for x in self.manual_links for c in x.get("code", [])]
        return spark.createDataFrame(rows, "doc string, heading string, code string")


def configured_links(links: DataFrame, sections: DataFrame, code: DataFrame) -> DataFrame:
    """``(doc_id, code_id, confidence, method)`` of links given by hand (J-12).

    ``links(doc, heading, code)`` come from a configuration file; a section fits if its path contains
    ``doc`` and its heading is ``heading`` (any if empty).
    """
    wanted = links.collect()  # the lines of a configuration file
    hit = F.array_compact(F.array(*(F.when(F.col("path").contains(r["doc"]) & (F.lit(not r["heading"]) | (F.col("heading") == r["heading"])), F.lit(r["code"])) for r in wanted))) if wanted else F.array().cast("array<string>")
    found = sections.select(F.col("id").alias("doc_id"), F.explode(hit).alias("name")).distinct()
    return found.join(code.select(F.col("id").alias("code_id"), "name"), "name").select("doc_id", "code_id", F.lit(1.0).alias("confidence"), F.lit("config").alias("method"))


# --- changes -----------------------------------------------------------------------------------------


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        out = subprocess.run(
            ["git", "-C", o["path"], "diff", "--name-status", "-z", "-M", o.get("from", "HEAD~1"), o.get("to", "HEAD")], capture_output=True, check=True, timeout=300
        ).stdout.decode("utf-8", "replace").split("\0")
        i = 0
        while i < len(out) and out[i]:
            status = out[i][0]
            if status in "RC":  # a rename is a deletion and an addition
                if status == "R":
                    yield "D", out[i + 1]
                yield "A", out[i + 2]
                i += 3
            else:
                yield status, out[i + 1]
                i += 2


class GitChanges(DataSource):
    """``spark.read.format("git_changes")``: ``(status, file)`` between two commits of the repository at ``path`` (S-12)."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return "status string, file string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(self.options))


def git_head(path: str) -> str | None:
    """The commit a repository is at; None where there is none (S-13, C-01)."""
    got = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=60)
    return got.stdout.strip() if got.returncode == 0 else None


def listed_changes(spark: SparkSession, files: list[str]) -> DataFrame:
    """Files given by hand, as modified (S-14)."""
    return spark.createDataFrame([("M", f) for f in files], "status string, file string")


def admitted(changes: DataFrame, threshold: int) -> bool:
    """Whether there are changes, and not more than a refresh on demand may handle (C-02, C-03)."""
    n = changes.limit(threshold + 1).count()
    return 0 < n <= threshold


# --- telemetry ---------------------------------------------------------------------------------------

TELEMETRY = "ts timestamp, tool string, args map<string, string>, n_results int, duration_ms double"


def read_telemetry(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Calls of tools as JSON lines; lines that are none are left out (S-17)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(TELEMETRY).option("mode", "DROPMALFORMED").json(path).where("tool IS NOT NULL")


def append_telemetry(rows: DataFrame, path: str) -> None:
    """Adds calls as JSON lines (S-16)."""
    rows.write.mode("append").json(path)


# --- ground truth ------------------------------------------------------------------------------------


def read_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``classes``, ``supertypes``, ``functions`` and ``references`` of a ground-truth file (S-18)."""
    schema = (
        "classes array<struct<name:string,namespace:string,file:string,start_line:int,is_abstract:boolean,supertypes:array<string>,subtypes:array<string>>>, "
        "functions array<struct<name:string,owner_class:string,namespace:string,signature_normalized:string,return_type:string,is_virtual:boolean,is_pure_virtual:boolean,is_override:boolean>>, "
        "call_references array<struct<symbol:string,owner_class:string,references:array<struct<file:string,line:int,kind:string>>>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    classes = rows.select(F.explode("classes").alias("c")).select("c.*")
    refs = rows.select(F.explode("call_references").alias("c")).select("c.symbol", "c.owner_class", F.explode("c.references").alias("r")).select("symbol", "owner_class", "r.*")
    return {
        "classes": classes.drop("supertypes", "subtypes"),
        "supertypes": classes.select("name", F.explode("supertypes").alias("base")),
        "functions": rows.select(F.explode("functions").alias("f")).select("f.*"),
        "references": refs,
    }


# --- sinks -------------------------------------------------------------------------------------------


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A document graph as JSON lines, nodes and edges in folders of their own (S-23, S-24, S-26)."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def report_lines(df: DataFrame, title: str) -> DataFrame:
    """Rows as the lines of a Markdown table under a title: ``(place, line)`` (S-27, S-29)."""
    head = [f"## {title}", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns)), F.lit(" |"))
    first = df.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "place long, line string")
    return first.unionByName(df.select(F.monotonically_increasing_id().alias("place"), cells.alias("line")))


def with_frontmatter(documents: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """Documents without a head get one from what their path, text and time tell (S-28, F-36..F-38).

    Tags are those of the key ``words`` that the title or path has.
    """
    name = F.regexp_replace(t.basename("path"), r"\.md$", "")
    kind = t.document_type("path", "text", F.lit(None).cast("string"))
    tags = t.keyword_tags(F.concat_ws(" ", t.document_title("text"), "path"), words or {})
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("\ntags: ["), F.array_join(tags, ", "), F.lit("]"))).otherwise("")
    head = F.concat(
        F.lit("---\ndoc_id: "), F.regexp_replace(name, "[^A-Za-z0-9_-]+", "-"), F.lit("\ntype: "), kind, F.lit("\ndate: "), t.document_date("path", "text", F.col("modified")).cast("string"), listed, F.lit("\n---\n\n")
    )
    return documents.withColumn("text", F.when(F.col("text").startswith("---\n"), F.col("text")).otherwise(F.concat(head, "text")))


def with_marks(documents: DataFrame) -> DataFrame:
    """Documents in which a diary's related symbols stand in code marks, and plain paths of documents are links (S-28, F-38)."""
    symbol = r"(?<![`\w:/.~])([A-Z]\w*(?:::~?\w+)*)(?:\(\))?(?![`\w:/.])"
    path = r"(?<![(\[`\w/.-])((?:[\w.-]+/)*([\w-]+)\.md)(?![)\]`\w])"
    related = rf"^\s*-\s*\*\*{t.DIARY_FIELDS['symbols']}\*\*"
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(x.rlike(related), F.regexp_replace(x, symbol, "`$1`")).otherwise(F.regexp_replace(x, path, "[$2]($1)")))
    return documents.withColumn("text", F.array_join(lines, "\n"))


def site_lines(sites: DataFrame, texts: DataFrame, most: int = 200) -> DataFrame:
    """``(file, line, code)``: the text of lines of files, trimmed (J-29)."""
    numbered = texts.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "code")).withColumn("line", F.col("at") + 1)
    return sites.join(numbered, ["file", "line"]).select("file", "line", F.substring(F.trim("code"), 1, most).alias("code"))
