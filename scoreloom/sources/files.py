"""Finding files below a folder: digests, fallback orders and whole documents, each row with the file it came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.sources.text import select_run


def found(spark: SparkSession, root: str, *, glob: str | None = None, digest: bool = False) -> DataFrame:
    """(file, folder, length, modified[, sha256]) of every file at any depth below ``root``. Contents are read only for
    digests, in the tasks; ``folder`` is the way from ``root`` to the file."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        read = read.option("pathGlobFilter", glob)
    base = "/" + root.rstrip("/").split("/")[-1] + "/"
    inside = F.substring_index(F.element_at(F.split("path", base.replace(".", r"\.")), -1), "/", -1)
    way = F.element_at(F.split("path", base.replace(".", r"\.")), -1)
    folder = F.regexp_replace(way, r"/?[^/]*$", "")
    more = [F.sha2("content", 256).alias("sha256")] if digest else []
    return read.load(root).select(inside.alias("file"), folder.alias("folder"), "length", F.col("modificationTime").alias("modified"), *more)


def first_kind(files: DataFrame, kinds: Sequence[tuple[str, str]], group: str, *, path: str = "folder") -> DataFrame:
    """Per group only the files of the first kind that has any. ``kinds``: name and pattern of the path, best first;
    files of no kind are left out."""
    place = F.coalesce(*[F.when(F.col(path).rlike(p), F.lit(i)) for i, (_, p) in enumerate(kinds)])
    ranked = files.withColumn("_kind", place).filter("_kind is not null")
    best = ranked.groupBy(group).agg(F.min("_kind").alias("_best"))
    name = F.get(F.array(*[F.lit(n) for n, _ in kinds]), F.col("_kind"))
    return ranked.join(best, group).filter("_kind = _best").withColumn("kind", name).drop("_kind", "_best")


def chosen_outputs(files: DataFrame, kinds: Sequence[tuple[str, str]], group: str, manifest: DataFrame | None = None) -> DataFrame:
    """One file per group: the first kind that has any, then the recorded one (its digest must agree), else any if all
    contents agree, else an error."""
    some = first_kind(files, kinds, group)
    pick = select_run(some.select(F.col(group).alias("grp"), F.col("folder").alias("path"), "sha256"), manifest)
    return some.join(pick.select(F.col("grp").alias(group), F.col("path").alias("folder")), [group, "folder"])


def read_documents(spark: SparkSession, root: str, schema: T.StructType, *, glob: str | None = None, tags: Mapping[str, str] | None = None) -> DataFrame:
    """JSON files at any depth, each one document over many lines, by a declared schema. A file that is no such document
    keeps its text in ``_corrupt``; ``tags`` are read off the path (name -> pattern with one group)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = spark.read.schema(full).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true")
    if glob:
        read = read.option("pathGlobFilter", glob)
    docs = read.json(root)
    return docs.select("*", *[F.regexp_extract("_metadata.file_path", p, 1).alias(n) for n, p in (tags or {}).items()])
