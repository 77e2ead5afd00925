"""Generations of tables: staged, validated, then visible all at once.

Paths go through Hadoop's file systems, so a generation may live in any store that Spark writes to. A generation is a
folder named by its content; a pointer file names the current one. Publication has two phases. The first writes tables
and a manifest to a staging folder of its own and checks them as written; nothing that readers see has changed, and a
failure leaves only that folder, which goes. The second renames the folder to its generation and replaces the pointer,
each in one step: a reader finds the old generation or the new one, whole, and never none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.operators.governance import table_digest

Check = Callable[[DataFrame], list[str]]


class NotPublished(FileNotFoundError):
    pass


class Conflict(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def _create(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file takes the place of an old one in one step: readers find either, whole."""
    beside = f"{path}.{uuid.uuid4().hex}"
    _create(spark, beside, text)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    make = jvm.org.apache.hadoop.fs.Path
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), sc._jsc.hadoopConfiguration()).rename(make(beside), make(path), how)


def write_text_once(spark: SparkSession, path: str, text: str) -> str:
    """Write a file if it isn't there; if it is, it has to be the same. Returns 'written' or 'same'."""
    fs, p, _ = _fs(spark, path)
    if fs.exists(p):
        if read_text(spark, path) != text:
            raise Conflict(f"{path} holds another text")
        return "same"
    replace_text(spark, path, text)
    return "written"


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        raise NotPublished(path)
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_once(df: DataFrame, path: str) -> str:
    """Write a table if it isn't there; if it is, its content has to be the same. Returns 'written' or 'same'."""
    fs, p, _ = _fs(df.sparkSession, path)
    if fs.exists(p):
        if table_digest(df).first() != table_digest(df.sparkSession.read.parquet(path)).first():
            raise ValueError(f"{path} holds other rows")
        return "same"
    df.write.parquet(path)
    return "written"


@dataclass(frozen=True)
class Staged:
    """What the first phase has made: a checked folder, and the generation that it's to become."""

    root: str
    folder: str
    generation: str
    manifest: dict


def prepare(spark: SparkSession, root: str, tables: dict[str, DataFrame], checks: dict[str, Check] | None = None) -> Staged:
    """Phase one: write tables and manifest to a staging folder and check them as written; on failure the folder goes."""
    folder = f"{root}/_staging/{uuid.uuid4().hex}"
    made, manifest = hashlib.sha256(), {}
    try:
        for name, df in sorted(tables.items()):
            df.write.parquet(f"{folder}/{name}")
            written = spark.read.parquet(f"{folder}/{name}")
            problems = (checks or {}).get(name, lambda _: [])(written)
            if problems:
                raise ValueError(f"{name}: {'; '.join(problems)}")
            n, digest = table_digest(written).first()
            manifest[name] = {"rows": n, "digest": digest, "schema": written.schema.jsonValue()}
            made.update(f"{name}:{n}:{digest}\n".encode())
        _create(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    except BaseException:
        abort(spark, folder)
        raise
    return Staged(root, folder, made.hexdigest()[:16], manifest)


def abort(spark: SparkSession, folder: str) -> None:
    fs, p, _ = _fs(spark, folder)
    fs.delete(p, True)


def commit(spark: SparkSession, staged: Staged, expected: str | None = None) -> str:
    """Phase two: the folder becomes its generation, then the pointer names it. Returns 'published' or 'same'.

    expected: the generation that has to be current still, '' for none; another one is a Conflict, and nothing changes.
    Repeating a commit whose second step failed completes it.
    """
    try:
        now = current_generation(spark, staged.root) or ""
        if expected is not None and now not in (expected, staged.generation):
            raise Conflict(f"{now or 'nothing'} is current, not {expected or 'nothing'}")
        fs, source, make = _fs(spark, staged.folder)
        target = make(f"{staged.root}/{staged.generation}")
        if not fs.exists(target) and fs.exists(source) and not fs.rename(source, target) and not fs.exists(target):
            raise OSError(f"cannot publish {staged.generation}")
        if json.loads(read_text(spark, f"{staged.root}/{staged.generation}/manifest.json")) != staged.manifest:
            raise Conflict(f"{staged.generation} is there with another manifest")
        if now == staged.generation:
            return "same"
        replace_text(spark, f"{staged.root}/current.json", json.dumps({"generation": staged.generation}))
        return "published"
    finally:
        abort(spark, staged.folder)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], checks: dict[str, Check] | None = None, expected: str | None = None) -> str:
    """Both phases. Returns the generation's id, a digest of its tables' contents, so a replay finds its own."""
    staged = prepare(spark, root, tables, checks)
    commit(spark, staged, expected)
    return staged.generation


def current_generation(spark: SparkSession, root: str) -> str | None:
    try:
        return json.loads(read_text(spark, f"{root}/current.json"))["generation"]
    except NotPublished:
        return None


def current(spark: SparkSession, root: str) -> str:
    generation = current_generation(spark, root)
    if generation is None:
        raise NotPublished(root)
    return f"{root}/{generation}"


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, root)}/{table}")


def validate(spark: SparkSession, root: str) -> list[str]:
    """What of the current generation no longer agrees with its manifest."""
    folder = current(spark, root)
    problems = []
    for name, said in json.loads(read_text(spark, f"{folder}/manifest.json")).items():
        n, digest = table_digest(spark.read.parquet(f"{folder}/{name}")).first()
        if (n, digest) != (said["rows"], said["digest"]):
            problems.append(name)
    return problems


def generation_report(spark: SparkSession, root: str, per_key: dict[str, tuple[list[str], int]], references: dict[str, tuple[str, str, str]]) -> DataFrame:
    """table, check, rows and problems of the current generation, one row a check.

    per_key: table -> (key columns, how many rows each key has to have): keys with another number are problems.
    references: name -> (table, column, table that has to have each value): rows without one are orphans.
    """
    bad, out = validate(spark, root), []
    for name in json.loads(read_text(spark, f"{current(spark, root)}/manifest.json")):
        out.append(read_current(spark, root, name).agg(F.lit(name).alias("table"), F.lit("manifest").alias("check"), F.count("*").alias("rows"), F.lit(int(name in bad)).cast("long").alias("problems")))
    for name, (keys, each) in per_key.items():
        counts = read_current(spark, root, name).groupBy(*keys).agg(F.count("*").alias("n"))
        out.append(counts.agg(F.lit(name).alias("table"), F.lit(f"{each} a key").alias("check"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") != each).alias("problems")))
    for check, (name, column, other) in references.items():
        rows, there = read_current(spark, root, name), read_current(spark, root, other).select(column).distinct()
        met = rows.join(there.withColumn("_there", F.lit(True)), column, "left")
        out.append(met.agg(F.lit(name).alias("table"), F.lit(check).alias("check"), F.count("*").alias("rows"), F.count_if(F.col("_there").isNull()).alias("problems")))
    return reduce(DataFrame.unionByName, out)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seen: str = "occurrences") -> DataFrame:
    """Rows of both by key; the newer values win and occurrences add up: an upsert as a rebuild."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    values = [c for c in old.columns if c not in keys and c != seen]
    latest = F.max_by(F.struct(*values), "_v").alias("x") if values else F.lit(None).alias("x")
    return both.groupBy(*keys).agg(latest, F.sum(F.coalesce(seen, F.lit(1))).alias(seen)).select(*keys, *([f"x.{c}" for c in values]), seen)
