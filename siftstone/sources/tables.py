"""Parquet and JSON-lines input from lists, folders and globs; sinks; stored bands; inspection."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import preview

FORMATS = {"parquet": "*.parquet", "jsonl": "*.json*"}
#: Name of the stamp beside stored bands; Spark skips names that begin with an underscore.
STAMP = "_siftstone_stamp.json"


class CheckpointMismatch(RuntimeError):
    """A stored table is incomplete, or was made from other rows or with other parameters."""


def split_paths(paths: str | list[str]) -> list[str]:
    """Comma-separated text or a list; commas in braces belong to a glob; blanks around and empty parts go."""
    parts = re.split(r",(?![^{}]*\})", paths) if isinstance(paths, str) else paths
    out = [p.strip() for p in parts if p.strip()]
    if not out:
        raise ValueError("no input path")
    return out


def _at(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _globbed(spark: SparkSession, pattern: str) -> list[str]:
    at, fs = _at(spark, pattern)
    found = fs.globStatus(at)
    return [s.getPath().toString() for s in found] if found is not None else []


def _files_below(spark: SparkSession, path: str):
    """Names of all files below a path (of the file itself), one by one."""
    at, fs = _at(spark, path)
    files = fs.listFiles(at, True)
    while files.hasNext():
        yield files.next().getPath().toString()


def _glob_regex(pattern: str) -> str:
    """One path part as a regular expression: ``*``, ``?``, ``[...]`` and ``{a,b}`` within a name."""
    marks = {"*": "[^/]*", "?": "[^/]"}
    out = ""
    for m in re.finditer(r"\[([!^]?)([^\]]+)\]|\{([^}]*)\}|(.)", pattern, re.DOTALL):
        if m[2]:
            out += f"[{'^' if m[1] else ''}{m[2]}]"
        elif m[3] is not None:
            out += f"(?:{'|'.join(map(_glob_regex, m[3].split(',')))})"
        else:
            out += marks.get(m[4], re.escape(m[4]))
    return out


def _any_depth(pattern: str) -> re.Pattern:
    """A pattern of relative paths in which a part ``**`` stands for any number of folders, none included, and at the end for any file below."""
    parts = [p for p in pattern.split("/") if p]
    out = ""
    for p in parts[:-1]:
        out += "(?:[^/]+/)*" if p == "**" else _glob_regex(p) + "/"
    return re.compile(out + (".*" if parts[-1] == "**" else _glob_regex(parts[-1])))


def _resolved(spark: SparkSession, path: str) -> list[str]:
    """Existing paths that a path or glob stands for. With ``**`` they are files, and the whole pattern, the part after the stars too, must match."""
    if "**" not in path:
        return _globbed(spark, path)
    head = path.partition("**")[0]
    head = head if head.endswith("/") or not head else head[: head.rfind("/") + 1]
    wanted = _any_depth(path[len(head) :])
    out = []
    for root in _globbed(spark, head.rstrip("/") or ("/" if head else ".")):
        names = ((f, f[len(root.rstrip("/")) + 1 :]) for f in _files_below(spark, root))
        out += [f for f, inner in names if wanted.fullmatch(inner) and not inner.rpartition("/")[2].startswith(("_", "."))]
    return sorted(out)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a file, or a folder with at least one file below it, is there."""
    return any(True for one in _resolved(spark, path) for _ in _files_below(spark, one))


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Sorted names of all files below a path or glob that end in ``suffix``."""
    return sorted(name for one in _resolved(spark, path) for name in _files_below(spark, one) if name.endswith(suffix))


def _partitioned(spark: SparkSession, root: str) -> bool:
    """Whether the first data file below a folder lies in ``name=value`` folders only; then the folder is read with its partition columns, and filters on them prune folders."""
    for name in _files_below(spark, root):
        inner = name[len(root.rstrip("/")) + 1 :].split("/")
        if not inner[-1].startswith(("_", ".")):
            return len(inner) > 1 and all("=" in p for p in inner[:-1])
    return False


def read_documents(spark: SparkSession, paths: str | list[str], fmt: str = "parquet", id_col: str = "id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Rows of all files below the paths; both named columns must exist.

    ``columns`` prunes the scan; None keeps all. A path that matches nothing is
    an error. Folders of ``name=value`` folders keep their partition columns;
    several inputs are joined by column name, a column that one lacks being null.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {sorted(FORMATS)}")
    found = [r for p in split_paths(paths) for r in _resolved(spark, p)]
    if not found:
        raise FileNotFoundError(str(paths))

    def folder(path: str) -> bool:
        at, fs = _at(spark, path)
        return fs.getFileStatus(at).isDirectory()

    folders = {p for p in found if folder(p)}
    hive = [p for p in found if p in folders and _partitioned(spark, p)]
    plain = [p for p in found if p not in hive]
    load = (lambda reader, of: reader.parquet(*of)) if fmt == "parquet" else (lambda reader, of: reader.json(of))
    frames = []
    if plain:
        reader = spark.read.option("recursiveFileLookup", "true")
        frames.append(load(reader.option("pathGlobFilter", FORMATS[fmt]) if folders & set(plain) or "**" in str(paths) else reader, plain))
    frames += [load(spark.read.option("pathGlobFilter", FORMATS[fmt]), [p]) for p in hive]
    df = frames[0]
    for more in frames[1:]:
        df = df.unionByName(more, allowMissingColumns=True)
    missing = {id_col, text_col} - set(df.columns)
    if missing:
        raise ValueError(f"columns not found: {sorted(missing)}")
    return df.select(*columns) if columns else df


def limited(df: DataFrame, id_col: str, n: int | None, strict: bool = True) -> DataFrame:
    """The n rows with the least ids: the same rows at every run. With strict, fewer rows than n are an error."""
    if n is None:
        return df
    if strict and df.limit(n).count() < n:
        raise ValueError(f"the input has fewer than {n} rows")
    return df.orderBy(id_col).limit(n)


def is_unique(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null and none repeats; only ids are shuffled."""
    row = df.select(F.col(id_col).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.max(F.col("i").isNull()).alias("null")).first()
    return row["most"] in (None, 1) and not row["null"]


def require_unique(df: DataFrame, id_col: str) -> DataFrame:
    """The same frame, or an error that names how many ids repeat."""
    bad = df.groupBy(id_col).count().where("count > 1").count()
    if bad:
        raise ValueError(f"{bad} ids stand more than once")
    return df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    pairs.write.csv(path, header=True)


def input_stamp(df: DataFrame, id_col: str) -> dict:
    """What tells one input from another without reading its texts: rows and a checksum of the ids (one scan of the id
    column), a digest of the input files' names, and the bytes that they and other sources hold."""
    total = F.sum(F.xxhash64(F.col(id_col)).cast("decimal(38,0)"))
    row = df.select(id_col).agg(F.count(F.lit(1)).alias("n"), total.alias("s")).first()
    files = hashlib.sha256("\n".join(sorted(df.inputFiles())).encode()).hexdigest()
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return {"rows": row["n"], "ids": str(row["s"]), "files": files, "bytes": size}


def stored_or_computed(spark: SparkSession, path: str | None, compute, stamp: dict | None = None) -> DataFrame:
    """The table at ``path`` if it was made to the end from what ``stamp`` describes, else computed, written there and read back.

    The stamp is stored beside the rows after they are all written. A folder
    that holds files but no ``_SUCCESS`` mark or no stamp (a killed write), or
    another stamp (other rows, other parameters), raises ``CheckpointMismatch``;
    nothing is ever reused or overwritten on a guess.
    """
    if path is None:
        return compute()
    said = json.dumps(stamp or {}, sort_keys=True)
    note, fs = _at(spark, f"{path.rstrip('/')}/{STAMP}")
    if not path_exists(spark, path):
        compute().write.parquet(path)
        out = fs.create(note, True)
        out.write(bytearray(said.encode()))
        out.close()
    else:
        done, _ = _at(spark, f"{path.rstrip('/')}/_SUCCESS")
        if not fs.exists(done) or not fs.exists(note):
            raise CheckpointMismatch(f"{path} was not written to its end; delete it or name another folder")
        stream = fs.open(note)
        held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if held != json.loads(said):
            differ = sorted(k for k in {*held, *(stamp or {})} if held.get(k) != json.loads(said).get(k))
            raise CheckpointMismatch(f"{path} was made from something else: {', '.join(differ)} differ")
    return spark.read.parquet(path)


def schema_rows(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of each column."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def preview_rows(df: DataFrame, id_col: str, n: int = 3, width: int = 100) -> DataFrame:
    """The n rows with the least ids, long strings cut."""
    cut = [preview(F.col(f.name), width).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields]
    return df.orderBy(id_col).limit(n).select(*cut)


def inspect(df: DataFrame, id_col: str) -> dict:
    """Schema, column names, three cut rows and the row count; for people, not for pipelines."""
    return {"schema": df.schema.simpleString(), "columns": df.columns, "rows": [r.asDict() for r in preview_rows(df, id_col).collect()], "count": df.count()}
