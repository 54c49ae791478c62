"""Documents from files, path filters, recorded runs and labels, and the sinks of reports."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from versoscan.functions.lineage import cut

# fixed values: directories that a walk passes over
DEFAULT_EXCLUDES = (
    ".git", ".hg", ".svn", "_build", "build", "dist", "node_modules", ".venv", "venv", ".tox", ".nox", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "__pycache__", "*.egg-info", ".worktrees", ".claude", ".devin", ".agents", ".cursor",
)

REQUEST = "struct<pairs:array<struct<i:int,j:int>>,probs:map<string,double>,model:string,usage:struct<input_tokens:bigint,output_tokens:bigint>>"
RUNS = f"runs array<struct<experiment:string,doc:string,rep:int,variant:string,polarity:int,params:struct<q:int>,requests:array<{REQUEST}>>>"
LABELS = "labels array<struct<doc:string,i:int,j:int,label:string,stratum:string,note:string>>"


def decoded(uri: Column) -> Column:
    """A file's path as given: file metadata escapes spaces and some other characters. A plus sign stays one."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def is_directory(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    """An absolute path with its file system, however it was given."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def uri_of(spark: SparkSession, path: str) -> str:
    """An absolute path, escaped, as the file systems of pyarrow take it in tasks."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toASCIIString()
    return re.sub("^file:/+", "file:///", uri)


def is_open_to_tasks(uri: str) -> bool:
    """Whether pyarrow lists this directory; some stores (s3a, viewfs without libhdfs) only Spark's readers know."""
    try:
        store, root = fs.FileSystem.from_uri(uri)
        return store.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


SUFFIXES = "*.{md,txt}"
WALK = 10_000  # entries that a task lists below a directory before it hands on the directories it has not opened
FILES, BYTES = 4096, 32 << 20  # of a task that reads files
ROWS, HELD = 256, 8 << 20  # texts, and bytes of them, that go to Spark at once


def listed(spark: SparkSession, uri: str, walk: int = WALK) -> DataFrame:
    """(name, bytes): the .md and .txt files below a directory that is open to tasks, named by their paths behind it.

    Tasks list the directories, in as many rounds as it takes, and leave the names in a checkpoint: the driver only
    counts, and a task holds the entries of one directory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        rows = lambda names, sizes: pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])
        for top in (name for batch in batches for name in batch.column(0).to_pylist()):
            below, seen = [top], 0
            while below and seen < walk:
                at = below.pop()
                found = store.get_file_info(fs.FileSelector(root.rstrip("/") + at or "/"))
                seen += 1 + len(found)
                for k in range(0, len(found), WALK):
                    own = [f for f in found[k : k + WALK] if f.type == fs.FileType.File and f.base_name.endswith((".md", ".txt"))]
                    yield rows([f"{at}/{f.base_name}" for f in own], [f.size for f in own])
                below += [f"{at}/{f.base_name}" for f in found if f.type == fs.FileType.Directory]
            yield rows(below, [None] * len(below))

    todo, folders, out = spark.createDataFrame([("",)], "name string"), 1, None
    while folders:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = cut(todo.repartition(min(folders, most)).mapInArrow(run, "name string, bytes long"))
        todo = found.where("bytes is null").select("name")
        names = found.where("bytes is not null")
        folders, out = todo.count(), names if out is None else out.unionByName(names)
    return out


def contents(found: DataFrame, uri: str) -> DataFrame:
    """(name, text) of listed(name, bytes) files below a directory, read whole by tasks of like numbers of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        rows = lambda names, texts: pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["name", "value"])
        names, texts, held = [], [], 0
        for name in (name for batch in batches for name in batch.column(0).to_pylist()):
            with store.open_input_stream(root.rstrip("/") + name, compression=None) as file:
                texts.append(file.read())
            names.append(name)
            held += len(texts[-1])
            if len(names) >= ROWS or held >= HELD:
                yield rows(names, texts)
                names, texts, held = [], [], 0
        yield rows(names, texts)

    n, size = found.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(min(n, found.sparkSession.sparkContext.defaultParallelism), n // FILES, size // BYTES, 1)
    return found.select("name").repartition(tasks).mapInArrow(run, "name string, value binary").select("name", F.col("value").cast("string").alias("text"))


def read_documents(spark: SparkSession, paths: str | Sequence[str], excludes: Sequence[str] = (), use_defaults: bool = True, recursive: bool = True, base: str | None = None) -> DataFrame:
    """(doc_id, text): every .md and .txt file below the directories, and every file named itself whatever its suffix,
    whole, its path the id. Excludes hold below a directory, not for it, nor for files named. See ``in_listing_order``;
    ``excluded_files`` counts what is left out.

    Where pyarrow does not reach a directory's store, Spark's reader takes it: that one lists on the driver, and passes
    over empty files and names that begin with a dot or an underscore.
    """
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        rows = lambda df: df.select(decoded(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))
        if is_directory(spark, path):
            if not recursive:
                raise ValueError(f"{path} is a directory; read it with recursive=True")
            root = qualified(spark, path)
            bad = lambda at: is_excluded(at, F.lit(root), excludes, use_defaults, base and qualified(spark, base))
            if is_open_to_tasks(uri := uri_of(spark, path)):
                at = F.concat(F.lit(root.rstrip("/")), "name")
                found = contents(listed(spark, uri).where(~bad(at)), uri).select(at.alias("doc_id"), "text")
            else:
                found = rows(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).text(path, wholetext=True))
                found = found.where(~bad(F.col("doc_id")))
        else:
            found = rows(spark.read.text(path, wholetext=True))
        out = found if out is None else out.unionByName(found)
    return out


def excluded_files(spark: SparkSession, paths: str | Sequence[str], excludes: Sequence[str] = (), use_defaults: bool = True, base: str | None = None) -> DataFrame:
    """(root, files, excluded): of each directory's .md and .txt files, how many a read with these excludes leaves out. A
    file named itself is one file. Only paths are read, no contents. Stores are listed as by ``read_documents``."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        below = is_directory(spark, path)
        if below and is_open_to_tasks(uri := uri_of(spark, path)):
            found = listed(spark, uri).select(F.concat(F.lit(qualified(spark, path).rstrip("/")), "name").alias("path"))
        else:
            found = (files.option("pathGlobFilter", SUFFIXES) if below else files).load(path).select("path")
        bad = is_excluded(F.col("path"), F.lit(qualified(spark, path)), excludes, use_defaults, base and qualified(spark, base)) if below else F.lit(False)
        one = found.select("path", F.lit(path).alias("root")).groupBy("root").agg(F.count("*").alias("files"), F.count_if(bad).alias("excluded"))
        out = one if out is None else out.unionByName(one)
    return out


def write_documents(docs: DataFrame, path: str) -> None:
    """docs(file, text) as files below ``path``, each whole, with a line end behind it; folders come with them.

    Each task writes its files at their names, so there is nothing to move at the end; a task that runs again writes the
    same ones.
    """
    top = uri_of(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(top)
        made = set()
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                for name, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    at = f"{root}/{name}"
                    if (folder := at.rpartition("/")[0]) not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    with store.open_output_stream(at) as out:
                        out.write(f"{text or ''}\n".encode())
        yield from ()

    docs.select("file", "text").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def in_listing_order(docs: DataFrame) -> DataFrame:
    """Documents of one directory as a walk lists them: .md files before .txt files, each by path."""
    return docs.orderBy(F.when(F.col("doc_id").endswith(".md"), 0).otherwise(1), "doc_id")


def _matches(part: Column, patterns: Sequence[str]) -> Column:
    """Case-sensitive file-name patterns; * also matches slashes."""
    if not patterns:
        return F.lit(False)
    return part.rlike("|".join(f"(?:{re.sub(r'^\(\?s:|\)\\[zZ]$', '', fnmatch.translate(p))})" for p in patterns).join(("^(?s:", ")$")))


def _below(path: Column, root: Column) -> Column:
    """The part of a path below root; the path itself where it isn't below. Both may name the local file system or not."""
    plain = lambda p: F.regexp_replace(p, "^file:/+", "/")
    path, root = plain(path), F.concat(F.regexp_replace(plain(root), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


def is_excluded(path: Column, root: Column, excludes: Sequence[str] = (), use_defaults: bool = True, base: str | None = None) -> Column:
    """Whether a path below root is passed over: a part of it matches a default, or its relative path, one of its
    parts or one of its directories matches a pattern of ``excludes``, relative to root or to the directory ``base``
    in which the patterns were written. A path not below root is taken as relative."""
    parts_of = lambda rel: F.filter(F.split(rel, "/"), lambda p: p != "")
    parts = parts_of(_below(path, root))
    found = F.exists(parts, lambda p: _matches(p, DEFAULT_EXCLUDES)) if use_defaults else F.lit(False)
    if excludes:
        above = lambda own: F.transform(own, lambda _, k: F.array_join(F.slice(own, 1, k + 1), "/"))
        for own in [parts] if base is None else [parts, parts_of(_below(path, F.lit(base)))]:
            found = found | F.exists(F.array_union(own, above(own)), lambda p: _matches(p, excludes))
    return found


def excluded_counts(paths: DataFrame, excludes: Sequence[str] = (), use_defaults: bool = True) -> DataFrame:
    """(root, files, excluded) of paths(path, root)."""
    bad = is_excluded(F.col("path"), F.col("root"), excludes, use_defaults)
    return paths.groupBy("root").agg(F.count("*").alias("files"), F.count_if(bad).alias("excluded"))


def read_runs(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """Recorded requests, one row each: run_id, request (its place in the run), experiment, doc, rep, variant, polarity, q,
    pairs, probs, model, usage. A file is one JSON record, or has one a line."""
    files = spark.read.schema(RUNS).option("multiLine", one_a_file).json(path)
    place = F.concat_ws("#", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    runs = files.select(place.alias("file"), F.posexplode("runs").alias("k", "r"))
    rows = runs.select(F.concat_ws("#", "file", "k").alias("run_id"), "r.*").select("*", F.posexplode("requests").alias("request", "x"))
    return rows.select("run_id", "request", "experiment", "doc", "rep", "variant", F.coalesce("polarity", F.lit(1)).alias("polarity"), F.col("params.q").alias("q"), "x.pairs", "x.probs", "x.model", "x.usage")


def read_labels(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    return spark.read.schema(LABELS).option("multiLine", one_a_file).json(path).select(F.explode("labels").alias("l")).select("l.*")


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON record a line."""
    reports.select("report").write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Report lines in order of document and part; one range of documents a file."""
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "part", "line").select("line").write.mode("overwrite").text(path)


def table_hash(df: DataFrame) -> Column:
    """A number that depends on all rows of df, not on their order or partitions; to be taken as an aggregate."""
    texts = [F.to_json(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    return F.coalesce(F.sum(F.xxhash64(*texts).cast("decimal(20,0)")), F.lit(0)).cast("string")


MANIFEST = "name string, schema string, rows long, hash string"


def write_dump(tables: dict[str, DataFrame], path: str) -> None:
    """The tables below ``path`` and a manifest with the schema, the number of rows and a hash of each.

    Counts and hashes are those of the rows as written, read back. The manifest comes last: without it there is no dump,
    so a reader never takes what a lost run has left for a whole one.
    """
    spark = next(iter(tables.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        n, total = back.agg(F.count("*"), table_hash(back)).first()
        rows.append((name, df.schema.json(), n, total))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{path}/manifest")


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump. A table that lacks rows or holds others than its manifest says is an error."""
    out = {}
    for name, schema, n, total in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect():
        df = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{name}")
        found = df.agg(F.count("*"), table_hash(df)).first()
        if tuple(found) != (n, total):
            raise ValueError(f"{path}/{name}: {found[0]} rows with hash {found[1]}, the manifest says {n} with {total}")
        out[name] = df
    return out


def eval_dump(cands: DataFrame, calls: DataFrame, sweep: DataFrame, hashes: DataFrame, path: str) -> None:
    """What a threshold evaluation leaves: candidates, calls, counts and input hashes. See ``read_dump``."""
    write_dump({"candidates": cands, "calls": calls, "thresholds": sweep, "inputs": hashes}, path)


def write_runs(requests: DataFrame, path: str) -> None:
    """Recorded requests(run_id, experiment, doc, rep, variant, polarity, q, model, pairs, probs, usage) as JSON files
    that ``read_runs`` reads: one record a run, its requests nested in the order of ``request``, if there is such a
    column, else of their pairs."""
    run = ["experiment", "doc", "rep", "variant", "polarity"]
    place = F.col("request").cast("long") if "request" in requests.columns else F.lit(0).cast("long")
    one = F.struct("pairs", "probs", "model", "usage")
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("request"), F.col("pairs").alias("key"), one.alias("one"))), lambda a, b: F.when((a["request"] < b["request"]) | ((a["request"] == b["request"]) & (a["key"] < b["key"])), -1).when((a["request"] == b["request"]) & (a["key"] == b["key"]), 0).otherwise(1))
    runs = requests.groupBy("run_id", *run, "q").agg(F.transform(ordered, lambda x: x["one"]).alias("requests"))
    record = F.struct(*run, F.struct("q").alias("params"), "requests")
    runs.select(F.array(record).alias("runs")).write.mode("overwrite").json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """labels(doc, i, j, label, stratum, note) as JSON files that ``read_labels`` reads, one record a document."""
    one = F.struct("doc", "i", "j", "label", "stratum", "note")
    labels.groupBy("doc").agg(F.sort_array(F.collect_list(one)).alias("labels")).select("labels").write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """The boundary report as JSON records, a group each, nulls kept."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
