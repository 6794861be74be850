"""Hand-computed fixtures and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import derive
from plumbline.operators import calibration as cal
from plumbline.operators import kernels, ranks, resample
from plumbline.plans.residues import build_dataset
from plumbline.schemas import SEARCH_RESPONSE, require_columns
from plumbline.sources import readers, writers


def test_bins_follow_the_edge_array(spark):
    edges = np.linspace(0, 1, 21)
    values = [float(p) for p in range(0, 101)] + [-1.0, 101.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "plddt double")
    got = {r.plddt: r.b for r in df.select("plddt", derive.bin_index(derive.confidence(F.col("plddt"))).alias("b")).collect()}
    want = np.clip(np.digitize(np.clip(np.array(values) / 100.0, 0, 1), edges) - 1, 0, 19)
    assert got.pop(None) is None
    assert got == dict(zip(values, want.tolist(), strict=True))


def test_summary_of_two_targets(spark):
    df = spark.createDataFrame([("A", 90.0, 0.9), ("A", 90.0, 0.9), ("B", 90.0, 0.5), ("B", None, 0.1)], "candidate string, plddt double, lddt double")
    r = cal.summarize(df).first()
    assert r.n == 3 and r.overconfidence == pytest.approx(0.9 - 2.3 / 3)
    assert r.ece <= r.mce + 1e-12 and abs(r.overconfidence) <= r.ece + 1e-12
    assert cal.summarize(df.limit(0)).first().n == 0
    table = [x.candidate for x in cal.per_target_table(df).collect()]
    assert table == ["B", "A"]
    b = resample.bootstrap_metric(df.where("candidate = 'A'"), "overconfidence", 50).first()
    assert b.lo == pytest.approx(b.hi) and b.point == pytest.approx(0.0)
    c = resample.bootstrap_contrast(df.withColumn("s", F.lit("x")), "s", "x", "x", reps=20).first()
    assert (c.lo, c.hi, c.point) == (0, 0, 0)


def test_null_levels_are_strata_and_last(spark):
    df = spark.createDataFrame([(None if i % 2 else "rigid", 80.0, 0.7) for i in range(120)], "flexibility string, plddt double, lddt double")
    got = cal.stratified_summary(df, ["flexibility"]).collect()
    assert [(r.flexibility, r.n) for r in got] == [("rigid", 60), (None, 60)]
    with pytest.raises(KeyError):
        require_columns(df, "nothing")


def test_average_ranks_and_auc(spark):
    v = [1.0, 2.0, 2.0, 5.0, 9.0, 9.0, 9.0, 12.0]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    got = [r.r for r in ranks.average_ranks(df, "v", "r").orderBy("v").collect() if r.v is not None]
    assert got == [1, 2.5, 2.5, 4, 6, 6, 6, 8]
    small = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "v double, t boolean")
    assert ranks.auc(small, "v", "t").first().auc == pytest.approx(0.875)
    assert ranks.auc(small, "v", "t", low_flags=True).first().auc == pytest.approx(0.125)
    assert ranks.auc(small.where("t"), "v", "t").first().auc is None
    p = resample.permutation_p(spark.createDataFrame([(str(i), float(i), i > 15) for i in range(20)], "k string, v double, t boolean"), "k", "v", "t", 99).first()
    assert 1 / 100 <= p.p_perm < 0.05
    few = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, False), ("c", 3.0, None)], "k string, v double, t boolean")
    assert tuple(resample.permutation_p(few, "k", "v", "t", 9).first()) == (3, 1, None, None)
    none = spark.createDataFrame([(str(i), float(i), False) for i in range(9)], "k string, v double, t boolean")
    assert tuple(resample.permutation_p(none, "k", "v", "t", 9).first()) == (9, 0, None, None)


@pytest.mark.parametrize("n,sizes", [(2, {}), (4, {"low": 1, "mid": 1, "high": 2}), (5, {"low": 2, "mid": 1, "high": 2}), (7, {"low": 2, "mid": 2, "high": 3})])
def test_tertiles(spark, n, sizes):
    df = spark.createDataFrame([(f"t{i}", float(i)) for i in range(n)] + [("x", None)], "candidate string, v double")
    got = ranks.tertile(df, "v", "candidate", "b").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in got if r.b} == sizes


def test_chain_gaps(spark):
    df = spark.createDataFrame([("A", i) for i in (1, 2, 5, 6)] + [("B", i) for i in (7, 9)], "chain string, res_id int")
    got = df.withColumn("g", derive.near_chain_gap("res_id", "chain")).where("g").select("res_id").collect()
    assert sorted(r[0] for r in got) == [2, 5, 7, 9]


def test_strata(spark):
    df = spark.createDataFrame([(None, None, None, None), (2, 1.0, "a", 0.5), (0, -0.5, "c", 0.2), (1, 0.0, "", 0.3)], "n int, z double, sse string, rsa double")
    got = df.select(derive.ligand_state(F.col("n")), derive.flexibility(F.col("z")), derive.structured(F.col("sse")), derive.exposure(F.col("rsa"))).collect()
    assert [tuple(r) for r in got] == [("apo", None, None, None), ("holo", "flexible", "helix_or_sheet", "exposed"), ("apo", "rigid", "coil", "buried"), ("holo", "intermediate", None, "partial")]


def test_build_dataset_keeps_rows_and_drops_low_coverage(spark):
    scores = spark.createDataFrame([("a", 90.0, 0.9, 0.9), ("a", 80.0, 0.8, 0.9), ("b", 70.0, 0.5, 0.5)], "candidate string, plddt double, lddt double, coverage double")
    cov = spark.createDataFrame([("a", 1), ("a", 2)], "candidate string, nonpolymer_entity_count int")
    assert [(r.candidate, r.ligand_state) for r in build_dataset(scores, cov).collect()] == [("a", "holo")] * 4
    got = build_dataset(scores, cov, one_row=True).collect()
    assert [(r.candidate, r.nonpolymer_entity_count) for r in got] == [("a", 1)] * 2
    assert [r.ligand_state for r in build_dataset(scores, cov.limit(0)).collect()] == ["apo"] * 2


def test_neff_and_alignment(spark):
    msa = spark.createDataFrame([("t", i, s) for i, s in enumerate(["ACDE", "ACDE", "ACDF", "WWWW", ""])], "candidate string, row int, sequence string")
    r = kernels.neff(msa).first()
    assert (r.n_sequences, r.neff, r.neff_per_col, r.length, r.neff_estimated) == (4, 2.0, 0.5, 4, False)
    (score, pairs), (gapped, more) = kernels.align_batch([("ACDEF", "CDE"), ("AAAACCCC", "AAAAGCCCC")], kernels.identity_scores())
    assert score == 15 and pairs == [(1, 0), (2, 1), (3, 2)]
    assert gapped == 31 and len(more) == 8  # a mismatch and a free end beat the gap
    table = kernels.substitution_scores("# a matrix\n   A C\nA 4 0\nC 0 9\n")
    assert table[("A", "C")] == 0 and table[("C", "C")] == 9


def test_lddt_and_agreement(spark):
    rng = np.random.default_rng(1)
    at = rng.normal(0, 8, (20, 3))
    moved = at + rng.normal(0, 0.7, at.shape)
    frame = lambda x: spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(x)], "structure string, atom int, x double, y double, z double")
    got = {r.atom: r.lddt for r in kernels.lddt(frame(at), frame(moved)).collect()}
    d0 = np.linalg.norm(at[:, None] - at[None], axis=2)
    d1 = np.linalg.norm(moved[:, None] - moved[None], axis=2)
    for i in range(20):
        near = (d0[i] < 15) & (np.arange(20) != i)
        if not near.any():
            assert i not in got
            continue
        want = np.mean([(np.abs(d0[i] - d1[i])[near] < t).mean() for t in (0.5, 1, 2, 4)])
        assert got[i] == pytest.approx(want)
    models = frame(at).withColumn("model", F.lit(0)).unionByName(frame(at).withColumn("model", F.lit(1)))
    assert {round(r.ensemble_agreement, 9) for r in kernels.ensemble_agreement(models).collect()} == {1.0}
    assert kernels.ensemble_agreement(models.where("model = 0")).count() == 0


def test_nested_hits(spark):
    rows = [("x", '{"total_count": 2, "result_set": [{"identifier": "P1", "services": [{"service_type": "sequence", "nodes": [{"match_context": [{"sequence_identity": 0.4}]}]}, {"service_type": "text", "nodes": [{"node_id": 1}]}]}, {"identifier": "P2", "services": [{"service_type": "sequence", "nodes": [{"match_context": [{"sequence_identity": 0.7}]}]}]}]}'), ("none", "{}"), ("bad", '{"total_count": 1, "result_set": [{"identifier": "P3", "services": []}]}')]
    df = spark.createDataFrame(rows, "candidate string, value string").select("candidate", F.from_json("value", SEARCH_RESPONSE).alias("response"))
    best, n = readers.max_identity(F.col("response"))
    assert {r[0]: (r[1], r[2]) for r in df.select("candidate", best, n).collect()} == {"x": (0.7, 2), "none": (0.0, 0), "bad": (0.0, 1)}
    got = {r.candidate: r for r in readers.best_hit(df).collect()}
    assert (got["x"].max_identity, got["x"].best_hit, got["x"].parse_failed) == (0.7, "P2", False)
    assert (got["none"].max_identity, got["none"].parse_failed) == (None, False)
    assert got["bad"].parse_failed
    assert not readers.identity_counters(readers.best_hit(df)).first().sound


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.a3m").write_text(">q one\nACd.E\nFG\n>r\nA-Ck\n")
    got = readers.a3m(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.candidate, r.header, r.sequence) for r in got] == [("x", "q one", "ACEFG"), ("x", "r", "A-C")]
    cif = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_seq_id\n_atom_site.label_asym_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nATOM 11 CA GLY 1 A 0.0 1.0 2.0\nATOM 12 CA ALA 2 A 1.0 1.0 2.0\n#\n"
    (tmp_path / "y.cif").write_text(cif)
    atoms = readers.atoms(spark, str(tmp_path / "y.cif"))
    assert [(r.chain, r.res_id, r.res_name) for r in readers.ca_residues(atoms).orderBy("res_id").collect()] == [("A", 1, "GLY"), ("A", 2, "ALA")]
    (tmp_path / "inv.json").write_text('{"cases": [{"target": "t", "predicted_path": "p"}]}')
    assert [(r.target, r.model_idx) for r in readers.inventory(spark, str(tmp_path / "inv.json")).collect()] == [("t", 0)]
    (tmp_path / "ids.json").write_text('["1ABC_1", "2DEF_1"]')
    assert [r[0] for r in readers.candidate_ids(spark, str(tmp_path / "ids.json")).collect()] == ["1ABC_1", "2DEF_1"]
    maps = spark.createDataFrame([('{"1": 2}',), ('[{"predicted": 3, "reference": 4}]',)], "t string")
    assert [r[0] for r in maps.select(readers.residue_mapping(F.col("t"))).collect()] == [{1: 2}, {3: 4}]
    assert readers.confidence_values('{"plddt": [1, 2]}') == [1.0, 2.0]
    with pytest.raises(ValueError):
        readers.confidence_values('{"x": 1}')
    (tmp_path / "scores").mkdir()
    (tmp_path / "scores" / "b.csv").write_text("plddt,lddt\n90,0.9\n")
    got = readers.score_tables(spark, str(tmp_path / "scores"), "plddt double, lddt double").collect()
    assert [(r.candidate, r.plddt) for r in got] == [("b", 90.0)]
    listing = spark.createDataFrame([("t", "t/a.a3m"), ("t", "t/a.aligned.pqt"), ("u", "u/x.txt")], "candidate string, path string")
    assert [tuple(r) for r in readers.pick_msa(listing).collect()] == [("t", "t/a.aligned.pqt")]
    assert writers.write_csv(spark.range(0).toDF("x"), str(tmp_path / "none"), skip_empty=True) is False
    targets = spark.createDataFrame([("t", "A" * 160), ("u", "C" * 81)], "candidate string, sequence string")
    text = [r[0] for r in targets.select(writers.fasta(F.col("candidate"), F.col("sequence"))).collect()]
    assert text == [">protein|name=t\n" + "A" * 80 + "\n" + "A" * 80, ">protein|name=u\n" + "C" * 80 + "\nC"]
    schema = {"properties": {"a": {"type": "array", "items": {"properties": {"b": {"rcsb_search_context": ["x"]}}}}, "c": {"rcsb_search_context": ["y"]}, "d": {}}}
    assert readers.search_paths(schema) == ["a.b", "c"]
    more = {"properties": {"l": {"type": "array", "items": {"type": "string", "rcsb_search_context": ["x"]}, "rcsb_search_context": ["x"]}, "o": {"rcsb_search_context": ["x"], "properties": {"p": {"rcsb_search_context": ["x"]}}}}}
    assert readers.search_paths(more) == ["o.p"]


def test_candidate_parts(spark):
    df = spark.createDataFrame([("1ABC_2",)], "c string")
    a, b = derive.candidate_parts(F.col("c"))
    assert tuple(df.select(a, b).first()) == ("1ABC", "2")
    with pytest.raises(Exception, match="ENTRY_ENTITY"):
        spark.createDataFrame([("x",)], "c string").select(derive.candidate_parts(F.col("c"))[0]).collect()


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_full_outer_keeps_all_customers(spark, tmp_path):
    from plumbline.plans.queries import QUERIES

    spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 5.0), (1, 4.0), (2, 6.0), (9, 7.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in QUERIES["covariate_full_outer"](spark, str(tmp_path)).select("candidate", "bal", "price").collect()}
    assert got == {("1", 10.0, 4.0), ("2", 20.0, 6.0), ("3", 30.0, None), ("9", None, 7.0)}
