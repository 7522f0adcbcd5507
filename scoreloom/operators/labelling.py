"""Truth construction: evidence tiers, enrichment labels, recruitment status, mapping labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import rules as R
from scoreloom.functions.scalars import is_finite
from scoreloom.sources.scratch import settle

INF = float("inf")


def evidence_flags(entities: DataFrame, lines: Mapping[str, DataFrame], *, entity: str = "entity_id") -> DataFrame:
    """Entities with one boolean per evidence line.

    Lines are unioned as (entity, line) and folded into flags by one aggregate, so
    the shuffle count does not grow with the number of lines.
    """
    tagged = None
    for name, df in lines.items():
        part = df.select(F.col(entity), F.lit(name).alias("_line"))
        tagged = part if tagged is None else tagged.unionByName(part)
    flags = tagged.groupBy(entity).agg(*[F.bool_or(F.col("_line") == n).alias(n) for n in lines])
    return entities.join(flags, entity, "left").fillna(False, list(lines))


def tier_columns(
    *, merge_first_two: bool = False, exclude: Sequence[str] = (), family: str = "family",
    host_genes: str = "host_genes", viral_genes: str = "viral_genes", taxon: str = "taxon",
    coords: str = "coords", spacer: str = "spacer_id",
) -> dict[str, Column]:
    """Tier, category, evidence set and notes from flags e1a..e5 and context columns.

    Independent lines: E1 (E1a or E1b), E2, E3, E4, E5; optionally E1 and E2 count
    as one. Tier 1 = three or more, 2 = two, 3 = one, 0 = none but grounded as
    negative (marker genes first, then taxonomy), -1 = ambiguous.
    """
    on = lambda n: F.lit(False) if n.upper() in {x.upper() for x in exclude} else F.col(n)
    e1a, e1b, e2, e3, e4, e5 = (on(n) for n in ("e1a", "e1b", "e2", "e3", "e4", "e5"))
    e1 = e1a | e1b
    lines = [e1 | e2, e3, e4, e5] if merge_first_two else [e1, e2, e3, e4, e5]
    n = sum((x.cast("int") for x in lines), F.lit(0))
    host, viral = F.coalesce(F.col(host_genes), F.lit(0)), F.coalesce(F.col(viral_genes), F.lit(0))
    by_genes = (host > 0) & (viral == 0)
    by_taxon = F.col(taxon).isNotNull()
    tier = (
        F.when(n >= 3, 1).when(n == 2, 2).when(n == 1, 3).when(by_genes | by_taxon, 0).otherwise(-1)
    )
    family_known = e1a & F.coalesce(~F.col(family).isin("phage", "unknown"), F.lit(False))
    category = (
        F.when((n == 0) & (tier == 0), "bacterial")
        .when(n == 0, "ambiguous")
        .when(e3, "prophage")
        .when(family_known, "eukaryotic_virus")
        .otherwise("free_phage")
    )
    hit = n > 0
    notes = F.array_compact(
        F.array(
            F.when((n == 0) & by_genes, F.concat(F.lit("checkv:"), viral.cast("string"), F.lit("_viral_genes"))),
            F.when((n == 0) & ~by_genes & by_taxon, F.concat(F.lit("kraken2:"), F.col(taxon))),
            F.when((n == 0) & ~by_genes & ~by_taxon & (host == 0) & (viral == 0), "no_gene_classification"),
            F.when(hit & e3 & (F.col(coords) != ""), F.concat(F.lit("phigaro:"), F.col(coords))),
            F.when(hit & ~e3 & family_known, F.concat(F.lit("family:"), F.col(family))),
            F.when(hit & ~e3 & e5, "rca_validated"),
            F.when(hit & ~e3 & ~family_known & ~e5 & e4, F.concat(F.lit("crispr_spacer_hit:"), F.coalesce(F.col(spacer), F.lit("")))),
        )
    )
    names = (("E1a", e1a), ("E1b", e1b), ("E2", e2), ("E3", e3), ("E4", e4), ("E5", e5))
    evidence = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in names]))
    return {"n_evidence": n, "tier": tier, "category": category, "evidence_lines": evidence, "notes": notes}


def evidence_tier(df: DataFrame, **options) -> DataFrame:
    """Entities with tier, category, evidence set and notes; options as in ``tier_columns``."""
    return df.select("*", *[c.alias(n) for n, c in tier_columns(**options).items()])


def enrichment_ratio(
    first: DataFrame, second: DataFrame, sizes: DataFrame, *, entity: str = "entity_id", n_first: str, n_second: str,
    enriched: float = 10.0, low: float = 0.5, high: float = 2.0,
) -> DataFrame:
    """Full outer join of two coverage tables -> raw and library-normalised ratio and class.

    ``first`` is the baseline library (depth in the denominator); ``sizes`` is the
    one-row table of library sizes. Zero baseline with signal is Infinity; both zero is 0.
    """
    a = first.select(entity, F.col("depth").alias("depth_a"), F.col("length").alias("_la"))
    b = second.select(entity, F.col("depth").alias("depth_b"), F.col("length").alias("_lb"))
    j = a.join(b, entity, "full_outer").fillna(0, ["depth_a", "depth_b", "_la", "_lb"])
    n_a, n_b = sizes.select(n_first).scalar(), sizes.select(n_second).scalar()
    da, db = F.col("depth_a").cast("double"), F.col("depth_b").cast("double")
    special = F.when(db > 0, F.lit(INF)).otherwise(0.0)
    raw = F.when(da > 0, F.try_divide(db, da)).otherwise(special)
    norm = F.when(da > 0, F.try_divide(db * n_a, da * n_b)).otherwise(special)
    out = j.select(
        entity, F.greatest("_la", "_lb").alias("length"), da.alias("depth_a"), db.alias("depth_b"),
        raw.alias("ratio_raw"), norm.alias("ratio"),
    )
    return out.withColumn("enrichment_class", enrichment_class("ratio", enriched, low, high))


def enrichment_class(ratio: str, enriched: float = 10.0, low: float = 0.5, high: float = 2.0) -> Column:
    r = F.col(ratio)
    return (
        F.when(r > enriched, "enriched").when((r > low) & (r < high), "background")
        .when(r <= low, "depleted").otherwise("moderate")
    )


#: What an entity counts as that a table does not list.
NOT_LISTED = {"quality": "Not-determined", "viral_genes": 0, "host_genes": 0, "provirus": "No", "classified": False, "taxon": "unclassified", "domain": "unknown"}


def with_context(entities: DataFrame, context: DataFrame, *, entity: str = "entity_id") -> DataFrame:
    """Entities with quality, genes and taxonomy; those that the context lacks count as not listed."""
    return entities.join(context, entity, "left").fillna({c: v for c, v in NOT_LISTED.items() if c in context.columns})


def enrichment_label(df: DataFrame, *, domains: Sequence[str] = ("Bacteria", "Archaea"), klass: str = "enrichment_class") -> DataFrame:
    """TP / TN / dark_matter / excluded with a reason, from class, quality, genes and taxonomy.

    Expects ratio, quality, viral_genes, host_genes, provirus, classified, taxon, domain.
    """
    k = F.col(klass)
    signal = R.quality_signal("quality", "viral_genes", "provirus")
    viral = signal != "no_viral_signal"
    unknown = (F.col("viral_genes") == 0) & (F.col("host_genes") == 0) & ~F.col("classified")
    host = (F.col("host_genes") > 0) & (F.col("viral_genes") == 0)
    negative = ~viral & F.col("domain").isin(*domains)
    label = (
        F.when((k == "enriched") & viral, "TP")
        .when((k == "enriched") & unknown, "dark_matter")
        .when((k == "background") & negative, "TN")
        .otherwise("excluded")
    )
    shown = lambda places: F.when(F.col("ratio") == INF, "inf").otherwise(F.call_function("format_number", F.col("ratio"), F.lit(f"0.{'0' * places}")))
    at = lambda name, places: F.concat(F.lit(f"{name}(R="), shown(places), F.lit(")"))
    plus = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    rich, plain = at("enriched", 1), at("background", 2)
    reason = (
        F.when((k == "enriched") & viral, plus(rich, "+", signal))
        .when((k == "enriched") & unknown, plus(rich, "+no_checkv+unclassified"))
        .when((k == "enriched") & host, plus(rich, "+host_genes=", F.col("host_genes").cast("string"), "+no_viral"))
        .when(k == "enriched", plus(rich, "+ambiguous(", signal, ")"))
        .when((k == "background") & negative, plus(plain, "+", signal, "+kraken2=", F.col("taxon")))
        .when((k == "background") & viral, plus(plain, "+viral_signal(", signal, ")"))
        .when(k == "background", plus(plain, "+domain=", F.col("domain")))
        .when(k == "moderate", at("moderate_enrichment", 2))
        .otherwise(at("depleted", 2))
    )
    return df.withColumn("label", label).withColumn("reason", reason)


def assign_domain(assignments: DataFrame, taxid_domain: DataFrame) -> DataFrame:
    """Domain per entity: report lookup by taxid, else viral words in the name, else
    Bacteria; unclassified stays unclassified. Expects status, taxon, taxid."""
    j = assignments.join(taxid_domain, "taxid", "left")
    fallback = F.when(R.is_viral_taxon("taxon", R.VIRAL_DOMAIN_WORDS), "Viruses").otherwise("Bacteria")
    return j.withColumn("domain", F.when(F.col("status") == "U", "unclassified").otherwise(F.coalesce("domain", fallback)))


def recruitment_status(pairs: Column | str, breadth: Column | str, min_pairs: Column | int = 10, min_breadth: Column | float = 70.0) -> Column:
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    b = F.col(breadth) if isinstance(breadth, str) else breadth
    return F.when(p == 0, "absent").when((p >= min_pairs) & (b >= min_breadth), "positive").otherwise("ambiguous")


def mapping_labels(
    entities: DataFrame, positive: DataFrame, negative: DataFrame, *, entity: str = "entity_id",
    excluded_prefixes: Sequence[str] = (), min_identity: float = 95.0, min_coverage: float = 80.0, tie: Sequence[str] = ("line_no",),
    category: Column | None = None,
) -> DataFrame:
    """Best qualifying positive hit > best qualifying negative hit > background.

    The two hit tables are reduced to one best row per entity by an aggregate and
    joined once each. A positive target starting with an excluded id is flagged.
    """
    good = (F.col("pident") >= min_identity) & (F.col("coverage") >= min_coverage)
    rank = F.struct((-F.col("pident")).alias("_k"), *tie)

    def best(df: DataFrame, name: str) -> DataFrame:
        return df.filter(good).groupBy(entity).agg(F.min_by(F.struct("target", "pident", "coverage"), rank).alias(name))

    j = entities.join(best(positive, "_p"), entity, "left").join(best(negative, "_n"), entity, "left")
    is_excluded = F.lit(False)
    for pre in excluded_prefixes:
        is_excluded = is_excluded | F.col("_p.target").startswith(pre)
    label = (
        F.when(F.col("_p").isNotNull() & is_excluded, "excluded_chimeric_risk")
        .when(F.col("_p").isNotNull(), "viral").when(F.col("_n").isNotNull(), "bacterial").otherwise("background")
    )
    pick = F.coalesce("_p", "_n")
    cat = category if category is not None else R.target_category("_p.target")
    return j.select(
        *entities.columns, label.alias("label"), F.coalesce(pick["target"], F.lit("-")).alias("source"),
        F.when(F.col("_p").isNotNull(), cat).when(F.col("_n").isNotNull(), "negative_control").otherwise("-").alias("source_category"),
        pick["pident"].alias("pident"), pick["coverage"].alias("coverage"),
    )


def spacer_evidence(
    hits: DataFrame, *, min_length: int = 25, min_identity: float = 95.0, min_coverage: float = 95.0, max_hits: int = 50,
    tie: Sequence[str] = ("line_no",), heaviest: int = 10_000,
) -> DataFrame:
    """Spacer hits on other entities, promiscuous spacers dropped, best hit per target.

    Hits are counted per spacer, in the map tasks first. A spacer with more than 1/``heaviest`` of all hits is one of at
    most ``heaviest``: these are broadcast and their rows go where they are read. What is left is joined by spacer, where
    none has more than that part of the rows.
    """
    cov = F.try_divide(F.col("length") * 100.0, F.col("qlen"))
    kept = hits.withColumn("coverage", F.coalesce(cov, F.lit(0.0))).filter(
        (F.col("qlen") >= min_length) & (F.col("target") != F.col("source"))
        & (F.col("pident") >= min_identity) & (F.col("coverage") >= min_coverage)
    )
    counts = settle(kept.groupBy("spacer_id").agg(F.count("*").alias("n_hits")))
    every = counts.agg(F.coalesce(F.sum("n_hits"), F.lit(0))).scalar()
    hot = counts.filter((F.col("n_hits") > max_hits) & (F.col("n_hits") > every / heaviest)).select("spacer_id")
    fine = counts.filter(F.col("n_hits") <= max_hits).select("spacer_id")
    rank = F.struct((-F.col("pident")).alias("_k"), *tie)
    return (
        kept.join(F.broadcast(hot), "spacer_id", "left_anti").join(fine, "spacer_id", "left_semi")
        .groupBy("target")
        .agg(F.min_by(F.struct("spacer_id", "source", "pident", "coverage"), rank).alias("h"))
        .select("target", "h.*")
    )


def catalogue_status(queries: DataFrame, best: DataFrame, *, query: str = "qseqid", identity: float = 90.0, fraction: float = 75.0) -> DataFrame:
    """homolog / partial / no detectable homology for every query."""
    j = queries.join(best, query, "left")
    status = (
        F.when(F.col("weighted_identity").isNull(), "no_detectable_homology")
        .when((F.col("weighted_identity") >= identity) & (F.col("q_af") >= fraction), "homolog")
        .otherwise("partial")
    )
    return j.withColumn("status", status)


def species_status(queries: DataFrame, best: DataFrame, *, query: str = "qseqid", identity: float = 95.0, fraction: float = 85.0) -> DataFrame:
    """species / relative / absent by identity and fraction of the shorter sequence."""
    j = queries.join(best, query, "left")
    status = (
        F.when(F.col("weighted_identity").isNull(), "absent")
        .when((F.col("weighted_identity") >= identity) & (F.col("af_shorter") >= fraction), "species")
        .otherwise("relative")
    )
    return j.withColumn("status", status)


def panel_status(queries: DataFrame, best: DataFrame, ani: DataFrame, *, query: str = "qseqid", identity: float = 95.0, fraction: float = 85.0) -> DataFrame:
    """species / relative / absent from two searches: the whole-genome table (query, ref, ani, af_shorter) and the best
    subject of the hits. Either may show the species; the match is the hits' subject, else the table's reference."""
    hit = best.select(query, F.col("sseqid").alias("_hit"), "weighted_identity", F.col("af_shorter").alias("_fraction"))
    whole = ani.select(F.col("query").alias(query), F.col("ref").alias("_ref"), "ani", F.col("af_shorter").alias("ani_fraction"))
    j = queries.join(hit, query, "left").join(whole, query, "left")
    near = lambda i, f: F.coalesce((F.col(i) >= identity) & (F.col(f) >= fraction), F.lit(False))
    status = F.when(near("ani", "ani_fraction") | near("weighted_identity", "_fraction"), "species").when(F.col("_hit").isNotNull() | F.col("_ref").isNotNull(), "relative").otherwise("absent")
    shown = F.when(near("ani", "ani_fraction"), "whole_genome").when(near("weighted_identity", "_fraction"), "hits")
    return j.select(*queries.columns, status.alias("status"), shown.alias("species_by"), F.coalesce("_hit", "_ref", F.lit("")).alias("match"), "ani", "ani_fraction", "weighted_identity", F.col("_fraction").alias("hit_fraction"))


def exclude_native(labels: DataFrame, exclusions: DataFrame, *, background: str = "background", source: str = "source", genome: str = "genome") -> DataFrame:
    """Labels again after the genomes that a background holds natively are known: a viral label that rests on such a
    genome becomes excluded_chimeric_risk."""
    native = exclusions.select(F.col(background), F.col(genome).alias(source)).distinct().withColumn("_native", F.lit(True))
    hit = (F.col("label") == "viral") & F.col("_native").isNotNull()
    return labels.join(native, [background, source], "left").withColumn("label", F.when(hit, "excluded_chimeric_risk").otherwise(F.col("label"))).select(*labels.columns)


def prefer_task(hits: DataFrame, keys: Sequence[str], *, species: str, largest: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Best row per key over several search tasks: species-level first, then the
    ``largest`` columns (coverage, score), then the tie columns."""
    rest = [c for c in hits.columns if c not in keys]
    rank = F.struct((~F.col(species)).alias("_s"), *[(-F.col(c)).alias(f"_{i}") for i, c in enumerate(largest)], *tie)
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b")).select(*keys, "_b.*")


def with_posterior(df: DataFrame, x: Column, params: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Add the posterior of each (weight, mean, sd) component at x. Parameters are numbers or columns.

    Every step is a column of its own: as one expression it repeats each logarithm for every place that needs it and
    grows past what the JVM compiles, so that rows are interpreted.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    at, k = F.col("_x"), range(len(params))
    logs = {f"_l{i}": F.log(lit(w) / lit(s)) - (at - lit(m)) * (at - lit(m)) / (lit(s) * lit(s) * 2.0) for i, (w, m, s) in enumerate(params)}
    out = df.withColumn("_x", x).withColumns(logs).withColumn("_top", F.greatest(*logs))
    out = out.withColumns({f"_e{i}": F.exp(F.col(f"_l{i}") - F.col("_top")) for i in k})
    out = out.withColumn("_sum", sum((F.col(f"_e{i}") for i in k[1:]), F.col("_e0")))
    return out.withColumns({n: F.col(f"_e{i}") / F.col("_sum") for i, n in enumerate(names)}).drop("_x", "_top", "_sum", *logs, *[f"_e{i}" for i in k])


def mixture_label(df: DataFrame, params, *, ratio: str = "ratio", p_high: float = 0.95, p_middle: float = 0.95,
                  domains: Sequence[str] = ("Bacteria", "Archaea")) -> DataFrame:
    """Relabel by mixture posteriors. ``params`` sorted by mean; Infinity counts as
    certainly high, 0 as certainly low."""
    r = F.col(ratio)
    ok = is_finite(ratio) & (r > 0)
    post = [f"_p{i}" for i in range(len(params))]
    fitted = with_posterior(df, F.log10(F.when(ok, r).otherwise(1.0)), params, post)
    hi = F.when(r == 0, 0.0).when(r == INF, 1.0).when(ok, F.col(post[-1]))
    mid = F.when(r == 0, 0.0).when(r == INF, 0.0).when(ok, F.col(post[1]))
    viral = R.quality_signal("quality", "viral_genes", "provirus") != "no_viral_signal"
    unknown = (F.col("viral_genes") == 0) & (F.col("host_genes") == 0) & ~F.col("classified")
    out = fitted.withColumn("p_high", hi).withColumn("p_middle", mid).drop(*post)
    label = (
        F.when((F.col("p_high") > p_high) & viral, "TP")
        .when((F.col("p_high") > p_high) & unknown, "dark_matter")
        .when(F.col("p_high") > p_high, "excluded")
        .when((F.col("p_middle") > p_middle) & ~viral & F.col("domain").isin(*domains), "TN")
        .otherwise("excluded")
    )
    return out.withColumn("mixture_label", label)
