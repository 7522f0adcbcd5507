"""Classification rules over text, accessions and evidence fields (ordered CASE expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.scalars import clean, col, contains_any, first_keyword, rank_path

# Keyword -> family, in order of precedence.
FAMILY_KEYWORDS = (
    (("papillomavirus",), "Papillomaviridae"),
    (("papilloma virus",), "Papillomaviridae"),
    (("herpesvirus",), "Herpesviridae"),
    (("herpes virus",), "Herpesviridae"),
    (("torque teno",), "Anelloviridae"),
    (("anellovirus",), "Anelloviridae"),
    (("alphatorquevirus",), "Anelloviridae"),
    (("betatorquevirus",), "Anelloviridae"),
    (("gammatorquevirus",), "Anelloviridae"),
    (("genomovirus",), "Genomoviridae"),
    (("gemycircularvirus",), "Genomoviridae"),
    (("polyomavirus",), "Polyomaviridae"),
    (("polyoma virus",), "Polyomaviridae"),
)

# Genome category by words in the sequence id, in order of precedence.
CATEGORY_KEYWORDS = (
    (("papillomavirus",), "hpv"),
    (("hpv",), "hpv"),
    (("herpes",), "herpesvirus"),
    (("hsv",), "herpesvirus"),
    (("torque",), "anellovirus"),
    (("teno",), "anellovirus"),
    (("anello",), "anellovirus"),
    (("gardnerella", "phage"), "gardnerella_phage"),
    (("lactobacillus", "phage"), "lactobacillus_phage"),
    (("megasphaera", "phage"), "megasphaera_phage"),
    (("fannyhessea", "phage"), "fannyhessea_phage"),
    (("sneathia", "phage"), "sneathia_phage"),
)
# A further word that counts in descriptions, not in accessions.
DESCRIPTION_KEYWORDS = ((("ttv",), "anellovirus"),)
# Genera whose plain (non-phage) sequences are negative controls.
CONTROL_GENERA = ("lactobacillus", "gardnerella", "megasphaera", "fannyhessea", "atopobium", "sneathia")
# Accession -> category, used only when the words do not decide.
ACCESSION_CATEGORY = {
    "NC_001526": "hpv", "NC_001357": "hpv", "NC_001592": "hpv", "NC_001443": "hpv",
    "NC_001806": "herpesvirus", "NC_001798": "herpesvirus", "NC_002076": "anellovirus",
    "NC_011801": "lactobacillus_phage", "NC_007924": "lactobacillus_phage",
    "MW387018": "gardnerella_phage", "CP072197": "negative_control", "NC_014644": "negative_control",
    "IMGVR_UViG_3300045988_117760": "megasphaera_phage",
    "IMGVR_UViG_3300045988_083571": "megasphaera_phage",
    "IMGVR_UViG_3300007272_000043": "fannyhessea_phage",
    "IMGVR_UViG_2636415511_000001": "sneathia_phage",
}
# Words that mark a taxon as viral.
VIRAL_TAXON_WORDS = ("virus", "viridae", "phage")
VIRAL_DOMAIN_WORDS = ("virus", "phage", "viridae", "virales")
# Quality classes that trigger the completeness evidence line.
TRIGGER_QUALITIES = ("Medium-quality", "High-quality", "Complete")


def family_of_title(
    title: Column | str, table=FAMILY_KEYWORDS, generic=("phage", "virus"), generic_class="phage"
) -> Column:
    """Family by keyword: bracketed organism first, then the full title, then generic words."""
    t = F.coalesce(col(title), F.lit(""))
    low = F.lower(t)
    organism = F.lower(F.regexp_extract(t, r"\[([^\]]+)\]", 1))
    in_title = first_keyword(low, table, None)
    found = F.when(organism != "", F.coalesce(first_keyword(organism, table, None), in_title)).otherwise(in_title)
    return F.coalesce(found, F.when(contains_any(low, generic), generic_class), F.lit("unknown"))


def genome_category(seq_id: Column | str, words=(*CATEGORY_KEYWORDS, *DESCRIPTION_KEYWORDS), controls=CONTROL_GENERA) -> Column:
    """Category of a source sequence by words in its description, then by control genus."""
    low = F.lower(col(seq_id))
    return F.coalesce(first_keyword(low, words, None), F.when(contains_any(low, controls), "negative_control"), F.lit("unknown"))


def target_category(seq_id: Column | str, words=CATEGORY_KEYWORDS, accessions=ACCESSION_CATEGORY, control_prefix: str = "NZ_") -> Column:
    """Category of a mapping target, known by its accession: words in the id, then whole ids and accessions without
    version, then the prefix of assembled bacterial sequences. A control genus alone decides nothing."""
    raw = col(seq_id)
    accession = F.substring_index(raw, ".", 1)
    table = F.create_map(*[F.lit(x) for kv in accessions.items() for x in kv])
    prefix = F.when(accession.startswith(control_prefix), "negative_control")
    return F.coalesce(first_keyword(F.lower(raw), words, None), table[raw], table[accession], prefix, F.lit("unknown"))


def is_viral_taxon(name: Column | str, words=VIRAL_TAXON_WORDS) -> Column:
    return contains_any(F.lower(col(name)), words)


def quality_reasons(quality, viral_genes, provirus, min_genes: int = 1, qualities=TRIGGER_QUALITIES) -> Column:
    """Array of the reasons that trigger the quality evidence line (empty = not triggered)."""
    q, g, p = col(quality), col(viral_genes), col(provirus)
    return F.array_compact(
        F.array(
            F.when(q.isin(*qualities), F.concat(F.lit("quality:"), q)),
            F.when(F.lower(p) == "yes", F.lit("provirus:Yes")),
            F.when(g >= min_genes, F.concat(F.lit("viral_genes:"), g.cast("string"))),
        )
    )


def quality_signal(quality, viral_genes, provirus, qualities=TRIGGER_QUALITIES) -> Column:
    """First matching reason, or 'no_viral_signal'."""
    q, g, p = col(quality), col(viral_genes), col(provirus)
    return (
        F.when(q.isin(*qualities), F.concat(F.lit("checkv_quality="), q))
        .when(g >= 1, F.concat(F.lit("viral_genes="), g.cast("string")))
        .when(p == "Yes", F.lit("provirus=Yes"))
        .otherwise("no_viral_signal")
    )


def grounding_class(notes: Column | str, human=("Homo sapiens", "9606"), taxon_prefix="kraken2:", gene_prefix="checkv"):
    """What a negative rests on: human taxon, other taxon, marker genes, or NULL."""
    n = F.coalesce(col(notes), F.lit(""))
    return (
        F.when(contains_any(n, human), "human")
        .when(n.startswith(taxon_prefix), "bact_arch")
        .when(n.startswith(gene_prefix), "checkv_host")
    )


def length_bin(length: Column | str, edges: tuple[int, ...], labels: tuple[str, ...]) -> Column:
    """Left-closed bins; ``labels`` has one more entry than ``edges``."""
    x = col(length)
    expr = None
    for edge, label in zip(edges, labels):
        cond = x < edge
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(labels[-1])


def completeness_bin(quality: Column | str) -> Column:
    """Topology proxy from the quality class."""
    q = col(quality)
    return (
        F.when(q == "Complete", "complete")
        .when(q.isin("High-quality", "Medium-quality"), "high_medium")
        .otherwise("low_undetermined")
    )


def novelty_class(identity: Column | str, known: float = 99.0, novel: float = 95.0) -> Column:
    """Class of the best identity to anything known; no hit counts as novel."""
    i = col(identity)
    return (
        F.when(i.isNull() | (i < novel), "novel_below_95pct")
        .when(i >= known, "same_species_in_metavr")
        .otherwise("close_relative_in_metavr")
    )


def homology_risk(fraction: Column | str, identity: Column | str) -> Column:
    f, i = col(fraction), col(identity)
    return (
        F.when((f >= 50) & (i >= 95), "HIGH").when((f >= 10) & (i >= 90), "MODERATE").otherwise("LOW")
    )


def diversity_arm(community: Column | str, high_prefix: str = "IV") -> Column:
    return F.when(clean(community).startswith(high_prefix), "high").when(clean(community).isNotNull(), "low")


def community_stratum(base: Column | str, sub: Column | str) -> Column:
    b, s = F.coalesce(col(base), F.lit("")), F.coalesce(col(sub), F.lit(""))
    return (
        F.when(b == "I", "CST-I")
        .when((b == "IV-B") | s.startswith("IV-B"), "CST-IV-B")
        .when((b == "IV-A") | s.startswith("IV-A"), "CST-IV-A")
        .when(b.startswith("IV") | s.startswith("IV-C"), "CST-IV-other")
    )


def first_host_genus(species_list: Column | str) -> Column:
    """Genus (first word) of the first listed species, '-' when none is listed."""
    first = F.trim(F.substring_index(F.coalesce(col(species_list), F.lit("")), ",", 1))
    return F.when(first.isin("", "-"), "-").otherwise(F.substring_index(first, " ", 1))


def mentions(text: Column | str, words: tuple[str, ...]) -> Column:
    return contains_any(F.lower(F.coalesce(col(text), F.lit(""))), words)


def host_rank(path: Column | str, rank: str) -> Column:
    return F.try_element_at(rank_path(path), F.lit(rank))


def category_score(cat: Column | str) -> Column:
    """Confidence category 1..6 -> score, 0.15 lost per step, never below 0."""
    return F.greatest(F.lit(0.0), 1.0 - (col(cat).cast("double") - 1.0) * 0.15)


def spacer_source(spacer_id: Column | str, marker: str = "_CRISPR_", drop_tokens: int = 4) -> Column:
    """Parent id: text before the last marker, else the id minus its last tokens."""
    s = col(spacer_id)
    by_marker = F.regexp_extract(s, f"^(.+){marker}", 1)
    parts = F.split(s, "_")
    kept = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - drop_tokens, F.lit(0))), "_")
    return F.when(by_marker != "", by_marker).when(F.size(parts) > drop_tokens, kept).otherwise(s)


def domain_class(
    families: Column, replication: tuple[str, ...], phage: tuple[str, ...] = ("Zot",), phage_prefix: str = "Phage_"
) -> Column:
    """Class of a gene from the protein families it carries."""
    rep = F.arrays_overlap(families, F.array(*[F.lit(w) for w in replication]))
    vir = F.exists(families, lambda f: f.isin(*phage) | f.startswith(phage_prefix))
    return (
        F.when(rep, "Plasmid replication / mobilisation")
        .when(vir, "Phage-type domain")
        .when(F.size(families) > 0, "Other Pfam domain")
        .otherwise("No Pfam domain")
    )


def training_overlap(source: Column | str, accession: Column | str, panel: Column | str, cfg: Column) -> Column:
    """Was a genome likely in a model's training data?

    ``cfg`` is a struct with booleans: external_db, refseq, ncbi, genbank, uvig, partial.
    """
    s, a, p = col(source), col(accession), col(panel)
    refseq = (s == "RefSeq") | a.startswith("NC_") | a.startswith("GCF_")
    genbank = (s == "GenBank") | a.startswith("MW")
    uvig = (s == "MetaVR_v5") | a.startswith("IMGVR_UViG")
    yes, no, maybe = F.lit("likely_in_training"), F.lit("not_in_training"), F.lit("possible")
    known = cfg["refseq"] | cfg["ncbi"] | cfg["genbank"]
    return (
        F.when(cfg["external_db"], "db_dependent")
        .when(p == "novel", no)
        .when(refseq, F.when(known, yes).when(cfg["partial"], maybe).otherwise(no))
        .when(genbank, F.when(cfg["genbank"], yes).when(cfg["ncbi"], maybe).otherwise(no))
        .when(uvig, F.when(cfg["uvig"], yes).otherwise(no))
        .otherwise(maybe)
    )


def high_quality_candidate(quality, viral_genes, length, *, qualities=("Complete", "High-quality"), min_genes=5, min_length=10000) -> Column:
    return col(quality).isin(*qualities) & (col(viral_genes) >= min_genes) & (col(length) >= min_length)


def panel_eligible(novelty, quality, length, viral_genes, host_genes, provirus, *, min_length=10000, min_genes=5, max_host=0) -> Column:
    """Novel, high quality, long and gene-rich, and either free of host genes or a provirus.
    Text that is not a number makes a row ineligible."""
    n = lambda c: F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), F.lit("0")).try_cast("bigint")
    ok = (
        (col(novelty) == "novel_below_95pct") & col(quality).isin("Complete", "High-quality")
        & (n(length) >= min_length) & (n(viral_genes) >= min_genes) & ((n(host_genes) <= max_host) | (col(provirus) == "Yes"))
    )
    return F.coalesce(ok, F.lit(False))


def homology_dependence(model: Column | str, dependent: tuple[str, ...]) -> Column:
    return F.when(col(model).isin(*dependent), "marker/reference-dependent").otherwise("composition-based")
