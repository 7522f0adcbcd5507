"""Reader layouts, id folding and resolution, run selection, labels."""

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import decide as D
from scoreloom.operators import labelling as L
from scoreloom.operators import quality as QC
from scoreloom.operators import setops as S
from scoreloom.operators import composition as K
from scoreloom.functions import rules as R
from scoreloom.sources import biology as BIO
from scoreloom.sources import predictions as P
from scoreloom.sources import sinks as SK
from scoreloom.sources import text as TX


def scores(df):
    return {r["entity_id"]: r["score"] for r in df.collect()}


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity_id string")


def test_folding_exact_id_wins(spark):
    raw = spark.createDataFrame([("a_fragment_1", 1.0), ("a_fragment_2", 1.0), ("a", 0.0), ("missing_fragment_1", 1.0)], "entity_id string, score double")
    known = ids(spark, "a", "a_fragment_1", "other")
    once = D.fold_regions(raw, known, P.REGION_SUFFIX["VIBRANT"])
    want = {"a_fragment_1": 1.0, "a": 1.0, "missing_fragment_1": 1.0}
    assert scores(once) == want
    assert scores(D.fold_regions(once, known, P.REGION_SUFFIX["VIBRANT"])) == want


def test_virus_summary_folding(spark):
    raw = spark.createDataFrame([("p|provirus_1_100", "0.7"), ("q|provirus_1_100", "0.69")], "seq_name string, virus_score string")
    assert scores(D.fold_regions(P.genomad(raw), ids(spark, "p", "q"), P.REGION_SUFFIX["geNomad"])) == {"p": 0.7, "q": 0.69}


def test_region_scores_nan_and_inf(spark):
    raw = spark.createDataFrame([("a||0_partial", "0.9"), ("a||full", "nan"), ("b||full", "inf"), ("c||lt2gene", "nan"), ("d||full", ".3")], "seqname string, max_score string")
    got = scores(D.fold_regions(P.virsorter2(raw), ids(spark, "a", "b", "c", "d||full"), P.REGION_SUFFIX["VirSorter2"]))
    assert got == {"a": 0.9, "b": math.inf, "c": 0.0, "d||full": 0.3}


def test_nan_is_sticky_in_max_merge(spark):
    df = spark.createDataFrame([("a", 0.9, None), ("a", float("nan"), None)], "entity_id string, score double, pvalue double")
    assert math.isnan(scores(P.merged_max(df))["a"])


def resolve(spark, headers, *known):
    raw = P.virsorter_headers(spark.createDataFrame([(h,) for h in headers], "value string"))
    out = D.resolve_ids(raw, ids(spark, *known), F.col("candidates"), F.replace(F.col("entity_id"), F.lit("."), F.lit("_")))
    return scores(out.groupBy(F.coalesce("resolved", "body").alias("entity_id")).agg(F.max("score").alias("score")))


def test_dotted_ids(spark):
    got = resolve(
        spark, [">VIRSorter_NODE_10_cov_1_2-circular-cat_2", ">VIRSorter_NODE_10_cov_1_2_gene_1_gene_4-100-400-cat_1", ">VIRSorter_real-circular-cat_2",
                ">VIRSorter_other_gene_1_gene_4-100-400-cat_5"], "NODE_1", "NODE_10_cov_1.2", "real-circular", "real", "other")
    assert got == {"NODE_10_cov_1.2": 1.0, "real-circular": 0.85, "other": pytest.approx(0.4)}


def test_ambiguous_id_fails(spark):
    with pytest.raises(Exception, match="ambiguous id"):
        resolve(spark, [">VIRSorter_a_b-cat_2"], "a.b", "a_b")


def test_run_selection(spark):
    files = lambda *rows: spark.createDataFrame([(g, p, c.encode()) for g, p, c in rows], "grp string, path string, content binary")
    assert TX.select_run(files(("g", "r2", "a"), ("g", "r1", "a"))).first()["path"] == "r1"
    with pytest.raises(Exception, match="conflicting runs"):
        TX.select_run(files(("g", "r1", "a"), ("g", "r2", "b"))).collect()
    import hashlib

    manifest = spark.createDataFrame([("r2", hashlib.sha256(b"b").hexdigest())], "path string, sha256 string")
    assert TX.select_run(files(("g", "r1", "a"), ("g", "r2", "b")), manifest).first()["path"] == "r2"
    with pytest.raises(Exception, match="digest changed"):
        TX.select_run(files(("g", "r2", "changed")), manifest).collect()


def test_containment_csv_boundary(spark):
    lines = spark.createDataFrame([("v_boundary,0.5",), ("v_below,0.4999999",), ("",), ("n_above,0.8",)], "value string")
    t = spark.createDataFrame([("v_boundary", 1), ("v_below", 1), ("n_above", 0), ("n_none", 0)], "entity_id string, label int")
    calls = D.dense_calls(t, P.sourmash(lines).withColumn("model", F.lit("m")), [D.Rule("m", 0.5)])
    from scoreloom.operators.confusion import confusion

    r = confusion(calls).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 1, 1, 1)


def test_files_read_back(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("#accession\tval\n# note\nx\tNA\ny\t2.5\nz\tnan\n")
    df = TX.read_table(spark, str(tmp_path / "t.tsv"), {"accession": "string", "val": "double", "gone": "bigint"}, variants={"accession": ("#accession",)})
    got = {r["accession"]: r["val"] for r in df.collect()}
    assert got["x"] is None and got["y"] == 2.5 and math.isnan(got["z"])
    (tmp_path / "h.tsv").write_text("\n".join(["# c", "", "q\ts\t99.0\t10\t0\t0\t1\t10\t1\t10\t1e-5\t50\t100\t200", "bad\trow", "q\ts2\t98\t10\t0\t0\t1\t10\t1\t10\t1e-5\t50\t100\t200\textra"]))
    rows = BIO.read_hits(spark, str(tmp_path / "h.tsv")).orderBy("line_no").collect()
    assert [r["sseqid"] for r in rows] == ["s", "s2"] and rows[0]["evalue"] == 1e-5
    (tmp_path / "x.fa").write_text(">a desc label=viral\nACGT\nac\n>b label=bacterial\n\n>c label=viral\nTT")
    fa = {r["id"]: (r["seq"], r["length"], r["tag"]) for r in TX.read_fasta(spark, str(tmp_path / "x.fa")).withColumn("tag", TX.header_tag("header", "label")).collect()}
    assert fa == {"a": ("ACGTAC", 6, "viral"), "b": ("", 0, "bacterial"), "c": ("TT", 2, "viral")}
    (tmp_path / "p.txt").write_text("## Panel A\nr1\nr2\n## Panel B\nr3\n")
    assert {(r["panel"], r["value"]) for r in TX.panels(TX.read_lines(spark, str(tmp_path / "p.txt"))).collect()} == {("A", "r1"), ("A", "r2"), ("B", "r3")}


def test_missing_header_tag_fails(spark):
    with pytest.raises(Exception, match="no label= tag"):
        spark.createDataFrame([("a b c",)], "header string").select(TX.header_tag("header", "label")).collect()


def test_sink_column_order(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "b int, extra int")
    SK.write_table(df, str(tmp_path / "o"), ["a", "b"])
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "o")).columns == ["a", "b"]


def test_spacer_sources(spark):
    rows = ["NODE_1_x_CRISPR_2_spacer_3", "a_CRISPR_1_CRISPR_2_spacer_1", "foo_1_2_3_4", "plain"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(R.spacer_source("s")).collect()]
    assert got == ["NODE_1_x", "a_CRISPR_1", "foo", "plain"]


def test_family_keywords(spark):
    rows = ["E1 [Human papillomavirus 16]", "herpesvirus-like [Lactobacillus phage]", "capsid [Torque teno virus]", "tail protein [Gardnerella phage]", "ribosomal protein", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(R.family_of_title("t")).collect()]
    assert got == ["Papillomaviridae", "Herpesviridae", "Anelloviridae", "phage", "unknown", "unknown"]


def flags(spark, rows):
    base = {"e1a": False, "e1b": False, "e2": False, "e3": False, "e4": False, "e5": False, "host_genes": 0, "viral_genes": 0, "taxon": None, "family": "unknown", "coords": "", "spacer_id": None}
    schema = "id string, e1a boolean, e1b boolean, e2 boolean, e3 boolean, e4 boolean, e5 boolean, host_genes int, viral_genes int, taxon string, family string, coords string, spacer_id string"
    return spark.createDataFrame([tuple({"id": k, **base, **v}.values()) for k, v in rows.items()], schema)


def test_tier_rules(spark):
    df = flags(spark, {
        "three": {"e1a": True, "e2": True, "e4": True, "spacer_id": "s9"}, "e1_counts_once": {"e1a": True, "e1b": True},
        "euk": {"e1a": True, "e2": True, "family": "Papillomaviridae"}, "prophage": {"e3": True, "e5": True, "coords": "1-9"},
        "genes_first": {"host_genes": 2, "taxon": "L. crispatus"}, "taxon_only": {"taxon": "L. crispatus"}, "nothing": {}, "viral_genes": {"viral_genes": 3},
    })
    got = {r["id"]: (r["tier"], r["category"], ",".join(r["evidence_lines"]), "; ".join(r["notes"])) for r in L.evidence_tier(df).collect()}
    assert got["three"] == (1, "free_phage", "E1a,E2,E4", "crispr_spacer_hit:s9")
    assert got["e1_counts_once"] == (3, "free_phage", "E1a,E1b", "")
    assert got["euk"] == (2, "eukaryotic_virus", "E1a,E2", "family:Papillomaviridae")
    assert got["prophage"][:2] == (2, "prophage") and got["prophage"][3].startswith("phigaro:1-9")
    assert got["genes_first"] == (0, "bacterial", "", "checkv:0_viral_genes")
    assert got["taxon_only"] == (0, "bacterial", "", "kraken2:L. crispatus")
    assert got["nothing"] == (-1, "ambiguous", "", "no_gene_classification") and got["viral_genes"] == (-1, "ambiguous", "", "")
    merged = {r["id"]: r["tier"] for r in L.evidence_tier(df, merge_first_two=True).collect()}
    assert merged["three"] == 2 and merged["euk"] == 3
    cut = {r["id"]: r["tier"] for r in L.evidence_tier(df, exclude=("E4",)).collect()}
    assert cut["three"] == 2


def test_enrichment_classes(spark):
    a = spark.createDataFrame([("x", 1.0, 10), ("y", 2.0, 10), ("z", 0.0, 10)], "entity_id string, depth double, length int")
    b = spark.createDataFrame([("x", 20.0, 12), ("y", 2.0, 10), ("w", 3.0, 7)], "entity_id string, depth double, length int")
    size = spark.createDataFrame([(100, 100)], "n_a int, n_b int")
    got = {r["entity_id"]: (r["ratio"], r["enrichment_class"], r["length"]) for r in L.enrichment_ratio(a, b, size, n_first="n_a", n_second="n_b").collect()}
    assert got == {"x": (20.0, "enriched", 12), "y": (1.0, "background", 10), "z": (0.0, "depleted", 10), "w": (math.inf, "enriched", 7)}


def test_mixture_label_edges(spark):
    params = ((0.5, -2.0, 0.3), (0.3, 0.0, 0.3), (0.2, 2.0, 0.3))
    rows = [("inf", math.inf, "Complete", 0, 0, "No", True, "Bacteria"), ("zero", 0.0, "Complete", 0, 0, "No", True, "Bacteria"), ("mid", 1.0, "Low-quality", 0, 0, "No", True, "Bacteria"),
            ("dark", 100.0, "Low-quality", 0, 0, "No", False, "unclassified")]
    df = spark.createDataFrame(rows, "id string, ratio double, quality string, viral_genes int, host_genes int, provirus string, classified boolean, domain string")
    assert {r["id"]: r["mixture_label"] for r in L.mixture_label(df, params).collect()} == {"inf": "TP", "zero": "excluded", "mid": "TN", "dark": "dark_matter"}


def test_taxon_names(spark):
    rows = ["Lactobacillus_mulieris_1", "Gardnerella_piotii", "Lactobacillus_crispatus_0", "UBA629_sp005465875", "Dialister_micraerophilus", "Prevotella_spNov3_2"]
    ref = ("g_Dialister", "Lactobacillus_crispatus")
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(K.collapsed_name("t", reference=ref)).collect()]
    assert got == ["Lactobacillus_jensenii", "Gardnerella_vaginalis", "Lactobacillus_crispatus", "BVAB1", "g_Dialister", "Prevotella_timonensis"]


def test_checks_are_empty_when_they_hold(spark):
    a = spark.createDataFrame([("m", 0.5), ("n", 0.7)], "k string, v double")
    assert QC.tolerance_violations(a, a, ["k"], ["v"], 1e-9).count() == 0
    assert QC.missing_keys(a, a, ["k"]).count() == 0
    assert S.set_difference(a, a, "k").count() == 0
    off = spark.createDataFrame([("m", 0.6)], "k string, v double")
    assert QC.tolerance_violations(a, off, ["k"], ["v"], 0.01).count() == 2
    assert {(r["k"], r["side"]) for r in S.set_difference(a, off, "k").collect()} == {("n", "left_only")}


def test_leave_one_out(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0), ("m", "c", 6.0)], "model string, block string, v double")
    assert {r["omitted"]: r["mean_v"] for r in S.leave_one_out(df, "block", ["model"], ["v"]).collect()} == {"a": 4.0, "b": 3.5, "c": 1.5}


def test_incomplete_runs(spark):
    df = spark.createDataFrame([("b1", "x", 0, True), ("b1", "y", 1, True), ("b2", "x", 0, False)], "block string, model string, exit_code int, has_artifact boolean")
    got = {(r["block"], r["model"]): r["problem"] for r in QC.incomplete_runs(df, ["x", "y"]).collect()}
    assert got == {("b1", "y"): "failed", ("b2", "x"): "no_artifact", ("b2", "y"): "absent"}


def lines(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, line_no long")


def test_protein_hits_take_both_layouts(spark):
    head = "q\ts\t91.5\t80\t3\t0\t1\t240\t5\t84\t1e-30\t155.5"
    got = BIO.protein_hits(lines(spark, head + "\tcapsid protein [some phage]", head + "\t900\t400\tlong title", head)).orderBy("line_no").collect()
    assert [r.stitle for r in got] == ["capsid protein [some phage]", "long title", ""]
    assert [(r.qlen, r.slen, r.bitscore) for r in got] == [(None, None, 155.5), (900, 400, 155.5), (None, None, 155.5)]


def test_paf_reads_every_tag(spark):
    core = "q\t100\t0\t50\t+\tt\t500\t10\t60\t20\t50\t60"
    far = core + "".join(f"\tx{i}:i:{i}" for i in range(120)) + "\tde:f:0.0100000000000000000000000000000000000000000001"
    assert [r.pident for r in BIO.paf(lines(spark, far, core)).collect()] == [pytest.approx(99.0), pytest.approx(40.0)]
    assert [r.pident for r in BIO.paf(lines(spark, far), identity="matches").collect()] == [pytest.approx(40.0)]


def test_screen_rows_take_the_fifth_column(spark):
    r = BIO.screen_rows(lines(spark, "0.99\t980/1000\t3\t0\tgenome.fna\tcomment")).first()
    assert (r["name"], r.identity, r.shared_hashes, r.total_hashes) == ("genome.fna", 0.99, 980, 1000)


def test_gene_families_by_domain_score(spark):
    row = lambda fam, full, dom: f"{fam} PF1 100 gene_1 - 300 1e-9 {full} 0.1 1 2 1e-9 1e-8 {dom} 0.1 1 90"
    rows = lines(spark, "# comment", row("A", 90.0, 10.0), row("B", 10.0, 50.0), row("C", 5.0, 50.0), row("B", 1.0, 2.0))
    assert BIO.gene_families(BIO.domain_hits(rows)).first().families == ["C", "B", "A"]


def test_window_classifier_column(spark):
    raw = spark.createDataFrame([("c1", "900", "0.75", "viral", "x", "3")], "contig_id string, length string, viral_score string, prediction string, hvseeker_class string, num_fragments string")
    assert scores(P.hvseeker(raw)) == {"c1": 0.75}


def test_ani_ties_keep_the_first_line(spark):
    df = spark.createDataFrame([("q", "zeta", "95", "80", "70", 1), ("q", "alpha", "95", "90", "60", 2)], "Query_name string, Ref_name string, ANI string, Align_fraction_ref string, Align_fraction_query string, line_no long")
    assert BIO.ani_best(df, order="line_no").first()["ref"] == "zeta" and BIO.ani_best(df).first()["ref"] == "alpha"


def test_best_subject_by_identical_bases(spark):
    from scoreloom.operators import intervals as I

    df = spark.createDataFrame([("q", "long", 180.0, 100.0), ("q", "scored", 100.0, 150.0), ("r", "b", 5.0, 1.0), ("r", "a", 5.0, 2.0)], "qseqid string, sseqid string, identical_bases double, total_bitscore double")
    assert {r.qseqid: r.sseqid for r in I.best_subject(df).collect()} == {"q": "long", "r": "a"}


def test_labels_of_entities_without_context(spark):
    e = spark.createDataFrame([("x", 12.34, "enriched"), ("y", 1.005, "background"), ("z", float("inf"), "enriched")], "entity_id string, ratio double, enrichment_class string")
    c = spark.createDataFrame([("z", "Complete", 1, 0, "No", True, "t", "Viruses")], "entity_id string, quality string, viral_genes int, host_genes int, provirus string, classified boolean, taxon string, domain string")
    got = {r.entity_id: (r.label, r.reason) for r in L.enrichment_label(L.with_context(e, c)).collect()}
    assert got == {"x": ("dark_matter", "enriched(R=12.3)+no_checkv+unclassified"), "y": ("excluded", f"background(R={1.005:.2f})+domain=unknown"), "z": ("TP", "enriched(R=inf)+checkv_quality=Complete")}


def test_categories_by_description_and_by_accession(spark):
    ids = ["Lactobacillus_iners_1", "NC_014644.1", "CP072197.1", "NZ_ABC.1", "IMGVR_UViG_2636415511_000001", "lactobacillus phage x", "HSV-1 strain", "TTV 3", "Sneathia phage", "NC_011801", "zz"]
    got = {r["i"]: (r["a"], r["b"]) for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", R.genome_category("i").alias("a"), R.target_category("i").alias("b")).collect()}
    assert got == {
        "Lactobacillus_iners_1": ("negative_control", "unknown"), "NC_014644.1": ("unknown", "negative_control"), "CP072197.1": ("unknown", "negative_control"), "NZ_ABC.1": ("unknown", "negative_control"),
        "IMGVR_UViG_2636415511_000001": ("unknown", "sneathia_phage"), "lactobacillus phage x": ("lactobacillus_phage",) * 2, "HSV-1 strain": ("herpesvirus",) * 2, "TTV 3": ("anellovirus", "unknown"),
        "Sneathia phage": ("sneathia_phage",) * 2, "NC_011801": ("unknown", "lactobacillus_phage"), "zz": ("unknown", "unknown"),
    }


def test_files_at_any_depth(spark, tmp_path):
    from scoreloom.sources import files as FI
    from scoreloom.sources import text as TX

    def put(way, content):
        p = tmp_path / "root" / way
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)

    put("a/x/run1/s.best.txt", "one\n")
    put("a/x/run2/s.best.txt", "one\n")
    put("a/x/run1/s.plain.fna", ">z\n")
    put("b/s.plain.fna", ">q\n")
    put("b/notes.md", "no")
    root = str(tmp_path / "root")
    files = FI.found(spark, root, digest=True).withColumn("sample", F.substring_index("folder", "/", 1)).withColumn("way", F.concat_ws("/", "folder", "file"))
    assert {(r["folder"], r["file"], r["length"]) for r in files.collect()} >= {("a/x/run1", "s.best.txt", 4), ("b", "notes.md", 2)}
    first = FI.first_kind(files, (("best", r"\.best\.txt$"), ("plain", r"\.fna$")), "sample", path="way")
    assert {(r["sample"], r["kind"], r["way"]) for r in first.collect()} == {("a", "best", "a/x/run1/s.best.txt"), ("a", "best", "a/x/run2/s.best.txt"), ("b", "plain", "b/s.plain.fna")}
    pick = FI.chosen_outputs(files.filter("file = 's.best.txt'"), (("run", "run"),), "sample").collect()
    assert [(r["sample"], r["folder"]) for r in pick] == [("a", "a/x/run1")]
    put("a/x/run2/s.best.txt", "two\n")
    spark.catalog.clearCache()
    with pytest.raises(Exception, match="conflicting runs"):
        FI.chosen_outputs(FI.found(spark, root, glob="*.best.txt", digest=True).withColumn("sample", F.lit("a")), (("run", "run"),), "sample").collect()

    put("j/good/1.json", '{\n "Sequences": [\n  {"Id": "c", "Crisprs": []}\n ]\n}')
    put("j/bad/2.json", '{\n "Sequences": [\n  {"Id": "c", ')
    docs = FI.read_documents(spark, root, TX.CRISPR_SCHEMA, glob="*.json", tags={"sample": r"/j/(\w+)/"}).select("sample", "Sequences", "_corrupt").collect()
    assert {(r["sample"], r["_corrupt"] is None) for r in docs} == {("good", True), ("bad", False)}


def test_nested_documents_are_parsed_once_and_empty_ones_give_no_rows(spark):
    level = lambda n: '{"Start": 1, "End": 9, "Evidence_Level": %s, "Regions": [{"Type": "Spacer", "Sequence": "%s"}, {"Type": "Spacer", "Sequence": "A"}, null]}' % n
    good = '{"Sequences": [null, {"Id": "a", "Crisprs": [null, %s, %s]}, {"Id": "b"}, {"Id": "c", "Crisprs": []}]}' % (level(("3", "C" * 30)), level(("2", "G")))
    rows = [(good,), ('{"Sequences": []}',), ('{"Sequences": null}',), ("{}",), ("not json",), (None,)]
    docs = spark.createDataFrame(rows, "json string").selectExpr("concat(json, '') AS json").select(F.from_json("json", TX.CRISPR_SCHEMA).alias("j")).select("j.*")
    arrays, spacers = TX.crispr_arrays(docs)
    assert sorted((r.array_id, r.n_spacers, r.n_spacers_skipped) for r in arrays.collect()) == [("a_CRISPR_2", 1, 1), ("a_CRISPR_3", 0, 2)]
    assert [(r.spacer_id, len(r.sequence)) for r in spacers.collect()] == [("a_CRISPR_2_spacer_1", 30)]
    for out in (arrays, spacers):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1
