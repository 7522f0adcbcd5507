"""Delimited and line-oriented text readers. No schema inference anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.scalars import clean, to_double, to_long

_NUM = {"double": to_double, "bigint": to_long}


def typed(df: DataFrame, schema: dict[str, str], variants: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Pick columns by name (first existing variant), clean missing words, cast tolerantly.
    A column absent under every name becomes NULL."""
    variants = variants or {}

    def one(name: str, kind: str) -> Column:
        found = next((c for c in (name, *variants.get(name, ())) if c in df.columns), None)
        if found is None:
            return F.lit(None).cast(kind).alias(name)
        raw = F.col(f"`{found}`")
        return (_NUM[kind](raw) if kind in _NUM else clean(raw)).alias(name)

    return df.select(*[one(n, k) for n, k in schema.items()])


def read_table(
    spark: SparkSession, path: str | list[str], schema: dict[str, str], *, sep: str = "\t", comment: str | None = None,
    variants: dict[str, Sequence[str]] | None = None, recursive: bool = False, glob: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Header-driven table (gzip by extension). Columns are addressed by name; only the
    picked ones are parsed. ``keep`` names hidden columns such as ``_metadata.file_path``."""
    reader = spark.read.option("sep", sep).option("header", True).option("quote", "").option("recursiveFileLookup", recursive)
    if comment:
        reader = reader.option("comment", comment)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.csv(path)
    out = typed(raw, schema, variants)
    if keep:
        out = raw.select(*[F.col(k).alias(k.split(".")[-1]) for k in keep], *_exprs(out, raw, schema, variants))
    return out


def _exprs(out, raw, schema, variants):
    variants = variants or {}
    cols = []
    for name, kind in schema.items():
        found = next((c for c in (name, *variants.get(name, ())) if c in raw.columns), None)
        base = F.lit(None).cast(kind) if found is None else (_NUM[kind](F.col(f"`{found}`")) if kind in _NUM else clean(F.col(f"`{found}`")))
        cols.append(base.alias(name))
    return cols


def read_headerless(
    spark: SparkSession, path: str | list[str], columns: Sequence[tuple[str, str]], *, sep: str = "\t", min_fields: int | None = None,
) -> DataFrame:
    """Headerless table read as lines: blank, '#' and short rows are skipped, and the
    file name and line order are kept (``file``, ``line_no``)."""
    return parse_headerless(read_lines(spark, path), columns, sep=sep, min_fields=min_fields)


def parse_headerless(lines: DataFrame, columns: Sequence[tuple[str, str]], *, sep: str = "\t", min_fields: int | None = None) -> DataFrame:
    need = len(columns) if min_fields is None else min_fields
    pattern = r"\t" if sep == "\t" else sep
    keep = [c for c in lines.columns if c != "value"]
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    # The generated row holds the split line, so the field-count filter and the columns
    # below share one split instead of having it pushed into each.
    parts = rows.select(*keep, F.inline(F.array(F.struct(F.split("value", pattern, -1).alias("_f")))))
    field = lambda i: F.get("_f", F.lit(i))
    return parts.filter(F.size("_f") >= need).select(
        *keep, *[(_NUM[k](field(i)) if k in _NUM else F.trim(field(i))).alias(n) for i, (n, k) in enumerate(columns)]
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and a position that sorts in file order.

    The position combines the input split's offset with the order inside the split,
    so it needs no second pass and no single-task numbering.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_o")
    )
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.withColumn("line_no", F.col("_o") + within).drop("_o")


def panels(lines: DataFrame, marker: str = "## Panel ") -> DataFrame:
    """Rows of a multi-panel file tagged with the panel they follow (``value``, ``panel``)."""
    from scoreloom.operators.ordered import carry_forward

    is_mark = F.col("value").startswith(marker)
    name = F.trim(F.substring(F.col("value"), F.lit(len(marker) + 1), F.length("value")))
    tagged = carry_forward(lines, "line_no", is_mark, name, name="panel")
    return tagged.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """FASTA records -> id, header, seq, length.

    The record separator is a newline followed by '>', so a record is one row and
    files split between tasks at record boundaries.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    return parse_fasta(raw)


def parse_fasta(records: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.col("value"), "^>", "")
    header = F.trim(F.substring_index(body, "\n", 1))
    rest = F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise("")
    seq = F.upper(F.regexp_replace(rest, r"\s+", ""))
    return (
        records.select(header.alias("header"), seq.alias("seq"))
        .filter(F.col("header") != "")
        .select(F.element_at(F.split("header", r"\s+"), 1).alias("id"), "header", "seq", F.length("seq").alias("length"))
    )


def header_tag(header: Column | str, tag: str) -> Column:
    """Value of ``tag=value`` in a FASTA header; a missing tag fails the job."""
    h = F.col(header) if isinstance(header, str) else header
    v = F.regexp_extract(h, rf"(?:^|[\s;|]){tag}=([^\s;|]+)", 1)
    return F.when(v != "", v).otherwise(F.raise_error(F.concat(F.lit(f"no {tag}= tag in: "), h)))


def first_nonempty(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Fallback chain: per key only the rows of the first source that has any."""
    tagged = None
    for i, df in enumerate(sources):
        part = df.withColumn("_src", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.groupBy(*keys).agg(F.min("_src").alias("_first"))
    return tagged.join(first, list(keys)).filter(F.col("_src") == F.col("_first")).drop("_src", "_first")


def select_run(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One output file per group from (grp, path, content or sha256): the manifest's pick (digest
    must match), else any one when all contents agree, else an error."""
    hashed = files if "sha256" in files.columns else files.withColumn("sha256", F.sha2("content", 256)).drop("content")
    if manifest is None:
        joined = hashed.withColumn("_want", F.lit(None).cast("string"))
    else:
        joined = hashed.join(manifest.select("path", F.col("sha256").alias("_want")), "path", "left")
    agg = joined.groupBy("grp").agg(
        F.min(F.when(F.col("_want").isNotNull(), F.struct("path", "sha256", "_want"))).alias("_m"),
        F.count_distinct("sha256").alias("_n"), F.min(F.struct("path", "sha256")).alias("_any"),
    )
    changed = F.concat(F.lit("digest changed: "), F.col("_m.path"))
    clash = F.concat(F.lit("conflicting runs need a selection: "), F.col("grp").cast("string"))
    path = (
        F.when(F.col("_m.path").isNotNull(), F.when(F.col("_m.sha256") == F.col("_m._want"), F.col("_m.path")).otherwise(F.raise_error(changed)))
        .when(F.col("_n") == 1, F.col("_any.path")).otherwise(F.raise_error(clash))
    )
    return agg.select("grp", path.cast("string").alias("path"))


def run_list(samples: DataFrame, active: Sequence[str], roles: dict[str, str]) -> DataFrame:
    """Cohort run list: active cohorts only, role codes mapped, URLs cut to file names."""
    from scoreloom.functions.scalars import url_basename

    table = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return samples.filter(F.col("cohort").isin(*active)).select(
        "cohort", "run", url_basename("R1").alias("r1_file"), url_basename("R2").alias("r2_file"),
        F.coalesce(table[F.col("role")], F.col("role")).alias("role"),
    )


def members(meta: DataFrame, parent: str, column: str) -> DataFrame:
    """Comma-separated member column -> (member, parent) rows."""
    m = F.explode(F.split(column, ",")).alias("member")
    return meta.select(F.col(parent).alias("parent"), m).withColumn("member", F.trim("member")).filter(F.col("member") != "")


CRISPR_SCHEMA = T.StructType([
    T.StructField("Sequences", T.ArrayType(T.StructType([
        T.StructField("Id", T.StringType()),
        T.StructField("Crisprs", T.ArrayType(T.StructType([
            T.StructField("Start", T.LongType()), T.StructField("End", T.LongType()),
            T.StructField("Evidence_Level", T.IntegerType()),
            T.StructField("Regions", T.ArrayType(T.StructType([
                T.StructField("Type", T.StringType()), T.StructField("Sequence", T.StringType()),
            ]))),
        ]))),
    ]))),
])


def crispr_arrays(docs: DataFrame, *, min_level: int = 2, min_spacer: int = 25, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nested array JSON (parsed with CRISPR_SCHEMA) -> (arrays, spacers).

    Low-evidence arrays are dropped; short spacers are dropped and the kept ones are
    renumbered inside their array, with array functions on the row they came in.
    """
    # Outer generators: an inner one puts a filter on its array below itself, so that a document just parsed is parsed
    # again for the filter. Rows of no array end at the next generator or at the filter behind it.
    seqs = docs.select(*keep, F.explode_outer("Sequences").alias("s"))
    arr = seqs.select(*keep, F.col("s.Id").alias("contig_id"), F.posexplode("s.Crisprs").alias("i", "c"))
    arr = arr.withColumn("array_id", F.concat("contig_id", F.lit("_CRISPR_"), (F.col("i") + 1).cast("string")))
    arr = arr.filter(F.coalesce("c.Evidence_Level", F.lit(0)) >= min_level)
    spc = F.filter("c.Regions", lambda r: (r["Type"] == "Spacer") & (F.coalesce(F.length(r["Sequence"]), F.lit(0)) > 0))
    arr = arr.withColumn("_all", F.coalesce(spc, F.expr("slice(c.Regions, 1, 0)"), F.array().cast(
        "array<struct<Type:string,Sequence:string>>")))
    arr = arr.withColumn("_kept", F.filter("_all", lambda r: F.length(r["Sequence"]) >= min_spacer))
    arrays = arr.select(
        *keep, "contig_id", "array_id", F.col("c.Start").alias("start"), F.col("c.End").alias("end"),
        F.size("_kept").alias("n_spacers"), (F.size("_all") - F.size("_kept")).alias("n_spacers_skipped"),
        F.col("c.Evidence_Level").alias("evidence_level"),
    )
    spacers = arr.select(*keep, "contig_id", "array_id", F.posexplode_outer("_kept").alias("p", "r")).filter("p is not null").select(
        *keep,
        F.concat("array_id", F.lit("_spacer_"), (F.col("p") + 1).cast("string")).alias("spacer_id"),
        F.col("r.Sequence").alias("sequence"), "contig_id", "array_id",
    )
    return arrays, spacers
