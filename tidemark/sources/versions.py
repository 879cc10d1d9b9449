"""Tables whose versions are committed whole.

A table is a folder of data folders, and of commits: small files, numbered, each of which
names the folders that make up one version, with their partition values. Writers put
rows beside what is there and then add the next commit, which takes its name in one step and
fails if another writer was first. Readers take the last one. So a reader sees a version before or after
a write, never between, and a write that dies leaves the table as it was; what it left behind
``collect`` removes, with versions that nobody needs any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS = "_commits"
#: What Spark names the folder of a partition value that is NULL.
NULL_PART = "__HIVE_DEFAULT_PARTITION__"
Choice = Callable[[dict], bool]
#: Of a part that was there, and of the new parts' values: whether it stays.
Stays = Callable[[dict, list[dict]], bool]


@dataclass(frozen=True)
class Version:
    """parts: a folder's name below the table's, with its partition values."""

    number: int
    schema: StructType
    parts: tuple[tuple[str, dict], ...]


class Conflict(RuntimeError):
    """Another writer committed first."""


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, in order; nothing if there is none."""
    fs, p = files(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    return [int(x[:-5]) for x in names(spark, f"{root}/{name}/{COMMITS}") if x.endswith(".json") and x[0] != "."]


def version(spark: SparkSession, root: str, name: str, number: int | None = None) -> Version | None:
    """The last version, or that of a number; None if there is none."""
    there = numbers(spark, root, name)
    if not there or (number is not None and number not in there):
        return None
    number = there[-1] if number is None else number
    fs, p = files(spark, f"{root}/{name}/{COMMITS}/{number:012d}.json")
    stream = fs.open(p)
    try:
        said = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return Version(number, StructType.fromJson(said["schema"]), tuple((path, values) for path, values in said["parts"]))


def commit(spark: SparkSession, root: str, name: str, made: Version) -> None:
    folder = f"{root}/{name}/{COMMITS}"
    fs, final = files(spark, f"{folder}/{made.number:012d}.json")
    _, beside = files(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(json.dumps({"schema": made.schema.jsonValue(), "parts": made.parts}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(beside, final):
        fs.delete(beside, False)
        raise Conflict(f"version {made.number} of {name} is there already")


def write(df: DataFrame, root: str, name: str, by: dict[str, Column] | None = None, keep: Stays | None = None) -> Version:
    """A new version: df's rows, in a folder for each value of the columns ``by``, and the parts of the last one that ``keep``.

    Rows are dealt by these columns before they are written, so that a folder gets a file or, if it is large,
    a few, and not one from each task.
    """
    spark = df.sparkSession
    last = version(spark, root, name)
    data = f"data-{uuid.uuid4().hex}"
    if by:
        keys = [f"by_{k}" for k in by]
        dealt = df.withColumns({f"by_{k}": c for k, c in by.items()}).hint("rebalance", *[F.col(k) for k in keys])
        dealt.write.partitionBy(*keys).parquet(f"{root}/{name}/{data}")
        fs, p = files(spark, f"{root}/{name}/{data}/" + "/".join(f"{k}=*" for k in keys))
        found = sorted(x.getPath().toString().rpartition(f"/{name}/{data}/")[2] for x in fs.globStatus(p) or ())
        value = lambda x: None if x == NULL_PART else unquote(x)
        new = [(f"{data}/{x}", {y.partition("=")[0][3:]: value(y.partition("=")[2]) for y in x.split("/")}) for x in found]
    else:
        df.write.parquet(f"{root}/{name}/{data}")
        new = [(data, {})]
    values_of = [values for _, values in new]
    stay = [(path, values) for path, values in last.parts if keep(values, values_of)] if last and keep else []
    made = Version((last.number if last else 0) + 1, df.schema, tuple(stay + new))
    commit(spark, root, name, made)
    return made


def read(spark: SparkSession, root: str, name: str, schema: StructType | None = None, choose: Choice | None = None, number: int | None = None) -> DataFrame | None:
    """The last version, or that of a number; only the parts that ``choose`` takes. None if there is none.

    With a schema, ValueError unless the version has its columns, in any order, with their types.
    """
    found = version(spark, root, name, number)
    if found is None:
        return None
    if schema is not None:
        there = {f.name: f.dataType for f in found.schema.fields}
        if wrong := [f.name for f in schema.fields if there.get(f.name) != f.dataType]:
            raise ValueError(f"{name} has other columns or types: {', '.join(wrong)}")
    parts = [path for path, values in found.parts if choose is None or choose(values)]
    schema = schema or found.schema
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{name}/{p}" for p in parts])


def replace(spark: SparkSession, root: str, name: str, gone: Choice, changed: Choice, rewrite: Callable[[DataFrame], DataFrame], by: dict[str, Column]) -> Version | None:
    """A new version without the parts that ``gone`` takes, those that ``changed`` takes rewritten, the others as they are."""
    last = version(spark, root, name)
    if last is None or not any(gone(v) or changed(v) for _, v in last.parts):
        return last
    border = read(spark, root, name, choose=lambda v: changed(v) and not gone(v))
    return write(rewrite(border), root, name, by, lambda v, _: not gone(v) and not changed(v))


def collect(spark: SparkSession, root: str, name: str, keep: int = 1) -> list[str]:
    """Removes all versions but the last ``keep``, and data that none of those names; the folders removed.

    Not while another writer is at work: its data has no commit yet.
    """
    there = numbers(spark, root, name)
    stay = {path.partition("/")[0] for n in there[-keep:] for path, _ in version(spark, root, name, n).parts}
    for n in there[:-keep]:
        fs, p = files(spark, f"{root}/{name}/{COMMITS}/{n:012d}.json")
        fs.delete(p, False)
    gone = [x for x in names(spark, f"{root}/{name}") if x.startswith("data-") and x not in stay]
    for x in gone:
        fs, p = files(spark, f"{root}/{name}/{x}")
        fs.delete(p, True)
    return gone


def register(spark: SparkSession, database: str, root: str, name: str) -> None:
    """The last version as an external table of the catalog; its parts are the table's partitions, by the columns by_*."""
    found = version(spark, root, name)
    if found is None:
        raise ValueError(f"no table {name} below {root}")
    quoted = f"`{database}`.`{name}`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}/_database'")
    spark.sql(f"DROP TABLE IF EXISTS {quoted}")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields]
    keys = [f"by_{k}" for k in found.parts[0][1]] if found.parts else []
    if not keys:
        at = f"{root}/{name}/{found.parts[0][0]}" if found.parts else f"{root}/{name}/none"
        spark.sql(f"CREATE TABLE {quoted} ({', '.join(columns)}) USING parquet LOCATION '{at}'")
        return
    columns += [f"{k} string" for k in keys]
    spark.sql(f"CREATE TABLE {quoted} ({', '.join(columns)}) USING parquet PARTITIONED BY ({', '.join(keys)}) LOCATION '{root}/{name}'")
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "\\'") + "'"
    parts = [f"PARTITION ({', '.join(f'by_{k} = {literal(v)}' for k, v in values.items())}) LOCATION '{root}/{name}/{path}'" for path, values in found.parts]
    if parts:
        spark.sql(f"ALTER TABLE {quoted} ADD {' '.join(parts)}")
