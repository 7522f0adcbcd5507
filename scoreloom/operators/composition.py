"""Community tables in long form (sample, taxon, count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ratio

# Taxon prefix -> collapsed name.
PREFIX_COLLAPSE = (
    ("Gardnerella", "Gardnerella_vaginalis"),
    ("Bifidobacterium", "g_Bifidobacterium"),
    ("Streptococcus", "g_Streptococcus"),
    ("Enterococcus", "g_Enterococcus"),
    ("Staphylococcus", "g_Staphylococcus"),
    ("Fannyhessea", "Atopobium_vaginae"),
    ("Prevotella_timonensis", "Prevotella_timonensis"),
    ("Prevotella_spNov3", "Prevotella_timonensis"),
    ("Prevotella_spNov2", "Prevotella_timonensis"),
    ("Prevotella_sp000479005", "Prevotella_timonensis"),
    ("Lactobacillus_mulieris", "Lactobacillus_jensenii"),
    ("Lactobacillus_paragasseri", "Lactobacillus_gasseri"),
)
# Exact taxon renames, applied after the numeric suffix is removed.
RENAMES = {
    "UBA629_sp005465875": "BVAB1",
    "KA00274_sp902373515": "BVAB2/BVAB3",
    "Nanoperiomorbus_sp004136275": "BVAB_TM7",
}


def melt(wide: DataFrame, sample: str, *, taxon: str = "taxon", count: str = "count") -> DataFrame:
    """Wide sample x taxon table -> long rows; NULL counts are 0."""
    cols = [c for c in wide.columns if c != sample]
    long = wide.unpivot([sample], [F.col(f"`{c}`").cast("double").alias(c) for c in cols], taxon, count)
    return long.fillna(0.0, [count])


def collapsed_name(taxon: Column | str, prefixes=PREFIX_COLLAPSE, renames=RENAMES, reference: Sequence[str] = ()) -> Column:
    """Target name of a taxon: prefix collapse, numeric suffix removal, rename, then
    genus roll-up for taxa outside a reference list that has the genus entry."""
    t = F.col(taxon) if isinstance(taxon, str) else taxon
    expr = None
    for pre, new in prefixes:
        cond = t.startswith(pre)
        expr = F.when(cond, new) if expr is None else expr.when(cond, new)
    name = expr.otherwise(F.regexp_replace(t, r"_(\d+)$", "")) if expr is not None else F.regexp_replace(t, r"_(\d+)$", "")
    if renames:
        table = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
        name = F.coalesce(table[name], name)
    genera = [g for g in reference if g.startswith("g_")]
    if genera:
        rolled = None
        for g in genera:
            cond = name.startswith(g[2:] + "_") & ~name.isin(*reference)
            rolled = F.when(cond, g) if rolled is None else rolled.when(cond, g)
        name = rolled.otherwise(name)
    return name


def collapse_taxa(long: DataFrame, name: Column, *, sample: str = "sample", count: str = "count") -> DataFrame:
    """Counts per (sample, collapsed taxon); one partial-combining aggregate."""
    return long.groupBy(sample, name.alias("taxon")).agg(F.sum(count).alias(count))


def diversity(long: DataFrame, *, sample: str = "sample", count: str = "count", min_share: float = 0.001, genus: Column | None = None) -> DataFrame:
    """Shannon index (natural log), richness over a relative abundance floor, and the
    share of a genus. Uses H = ln(N) - sum(n ln n)/N, so no per-row total is joined."""
    n = F.col(count).cast("double")
    taxa = long.filter(n > 0)
    packed = taxa.groupBy(sample).agg(
        F.sum(n).alias("total"), F.sum(n * F.ln(n)).alias("_nln"),
        F.sum(F.when(genus, n).otherwise(0.0)).alias("_g") if genus is not None else F.lit(0.0).alias("_g"),
    )
    rich = taxa.join(packed.select(sample, "total"), sample).groupBy(sample).agg(
        F.count_if(n / F.col("total") >= min_share).alias("richness")
    )
    return packed.join(rich, sample).select(
        sample, "total", (F.ln("total") - F.col("_nln") / F.col("total")).alias("shannon"), "richness",
        ratio(F.col("_g"), F.col("total")).alias("genus_fraction"),
    )


def widen(long: DataFrame, taxa: Sequence[str], *, sample: str = "sample", count: str = "count") -> DataFrame:
    """Export form: one column per listed taxon plus the read count."""
    return long.groupBy(sample).agg(
        F.sum(count).alias("read_count"), *[F.coalesce(F.sum(F.when(F.col("taxon") == t, F.col(count))), F.lit(0)).alias(t) for t in taxa]
    )
