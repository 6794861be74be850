"""Evaluation of cases, specs, kernels on structures, and the sources without a query."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.operators import evaluate, kernels, ranks, resample, specs
from plumbline.sources import readers, writers

CASE = ("t", "apo", 0)
SIDE = "target string, condition string, model_idx int, place int, number int, name string"


def joined(spark, predicted, reference, mapping):
    side = lambda rows: spark.createDataFrame([(*CASE, k, *r) for k, r in enumerate(rows)], SIDE)
    maps = spark.createDataFrame([(*CASE, *m) for m in mapping], "target string, condition string, model_idx int, predicted int, reference int")
    return evaluate.join_residues(side(predicted), side(reference), maps)


@pytest.mark.parametrize("predicted,reference,mapping,problem", [
    ([(1, "ALA"), (2, "GLY")], [(1, "ALA")], [(1, 1), (2, 2)], "count"), ([(1, "ALA"), (2, "GLY")], [(1, "ALA"), (2, "GLY")], [(1, 1)], "unmapped"),
    ([(1, "ALA"), (2, "GLY")], [(1, "ALA"), (3, "GLY")], [(1, 1), (2, 2)], "number"), ([(1, "ALA"), (2, "GLY")], [(1, "ALA"), (2, "SER")], [(1, 1), (2, 2)], "name"),
])
def test_violations_are_named_and_raise(spark, predicted, reference, mapping, problem):
    rows = joined(spark, predicted, reference, mapping)
    assert rows.orderBy("place").collect()[-1].problem == problem
    with pytest.raises(Exception, match=f"t/apo/0.*{problem}"):
        evaluate.strict(rows).collect()


def test_matching_residues_join_and_look_up(spark):
    rows = joined(spark, [(1, "ALA"), (2, "GLY")], [(11, "ALA"), (12, "GLY")], [(1, 11), (2, 12)])
    assert [r.problem for r in rows.collect()] == [None, None] and evaluate.strict(rows).count() == 2
    confidence = spark.createDataFrame([(*CASE, 1, 95.0)], "target string, condition string, model_idx int, residue int, plddt double")
    metrics = spark.createDataFrame([(*CASE, 0.8, 1.5, 2, 0.7, {"A.2.": 0.6})], "target string, condition string, model_idx int, tm_score double, rmsd double, aligned_length int, global_lddt double, local_lddt map<string,double>")
    got = evaluate.per_residue(evaluate.strict(rows), confidence, metrics).orderBy("place").collect()
    assert [(r.predicted_residue_number, r.reference_residue_number, r.pLDDT, r.local_lddt, r.tm_score) for r in got] == [(1, 11, 95.0, None, 0.8), (2, 12, None, 0.6, 0.8)]
    case = evaluate.per_structure(rows, metrics).first()
    assert (case.joined_fraction, case.warning, case.aligned_length) == (1.0, False, 2)
    bad = joined(spark, [(1, "ALA"), (2, "GLY")], [(11, "ALA"), (12, "SER")], [(1, 11), (2, 12)])
    case = evaluate.per_structure(bad, metrics).first()
    assert (case.joined_fraction, case.warning) == (0.5, True)


def test_aligner_output(spark):
    df = spark.createDataFrame([("Aligned length=  98, RMSD=   1.25, x\nTM-score= 0.91 (a)\nTM-score= 0.5",), ("TM-score= 0.91",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(evaluate.aligner_output(F.col("t"))).collect()]
    assert tuple(got[0]) == (0.91, 1.25, 98, None) and got[1].tm_score == 0.91
    assert all(g.problem for g in got[1:])


def test_specs(spark):
    df = spark.createDataFrame([("a", True, 1, "x-y"), ("b", False, 2, "z")], "candidate string, near boolean, n int, kind string")
    assert [specs.coerce_level(df, "near", w) for w in ("Yes", "0", "maybe")] == [True, False, "maybe"]
    assert specs.coerce_level(df, "n", "2") == 2.0 and specs.coerce_level(df, "n", "two") == "two" and specs.coerce_level(df, "kind", "1") == "1"
    assert df.where(specs.level_mask(df, "near", "maybe")).count() == 0 and df.where(specs.level_mask(df, "n", "2")).count() == 1
    assert specs.parse_contrast("a:b-c-d") == ("a", "b", "c-d")
    for bad in ("a", "a:b", "b-c"):
        with pytest.raises(ValueError):
            specs.parse_contrast(bad)
    assert specs.where_spec(df, "near=true").first().candidate == "a" and specs.where_spec(df, "near=other").first().candidate == "b"
    assert specs.where_spec(df, "n=2").count() == 1 and specs.where_spec(df, "kind=x-y").count() == 1
    with pytest.raises(KeyError):
        specs.where_spec(df, "nothing=1")
    for bad in ("n=two", "n=7"):
        with pytest.raises(ValueError):
            specs.where_spec(df, bad)
    scored = df.withColumns({"plddt": F.lit(80.0), "lddt": F.when(F.col("near"), 0.7).otherwise(0.9)})
    found, skipped = specs.contrasts(scored, ["near:true-false", "n:1-9", "x:a-b", "bad"], reps=50)
    r = found.first()
    assert r.contrast == "near: true - false" and r.point == pytest.approx(0.2) and len(skipped) == 3
    assert specs.contrasts(scored, [])[0] is None
    m = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "id int, rcsb_non_std_monomer_count int")
    assert sorted(r.id for r in specs.standard_monomers(m).collect()) == [1, 2]


def test_tails_and_eligible_columns(spark):
    df = spark.createDataFrame([(f"t{i}", float(i % 7), i, True, "x", 1.0) for i in range(25)], "candidate string, v double, w int, flag boolean, text string, v_x double")
    assert ranks.eligible(df) == ["v", "w", "flag"]
    assert ranks.top_k(df, "v", "candidate", 3, "tail").where("tail").count() == 3
    assert {r.candidate for r in ranks.top_k(df, "v", "candidate", 2, "tail").where("tail").collect()} == {"t13", "t20"}
    assert ranks.top_k(df, "v", "candidate", None, "tail", quantile=0.1).where("tail").count() == 2  # 2.5 to even
    assert ranks.top_k(df, "v", "candidate", None, "tail", quantile=0.0).where("tail").count() == 1
    scan = resample.scan_with_p(df.withColumn("tail", F.col("w") >= 20), "candidate", ["v", "w"], "tail", 99)
    assert [r.covariate for r in scan.collect()] == ["w", "v"]
    got = ranks.significant(scan).orderBy(F.desc("covariate")).collect()
    assert [(r.covariate, r.significant, r.direction) for r in got] == [("w", True, "higher"), ("v", False, "lower")]
    assert got[0].auc_tail_higher == 1.0 and got[0].bonferroni == 0.025 and (got[0].tail_median, got[0].rest_median) == (22.0, 9.5)


def test_a_mean_at_its_bound_is_in_no_tail(spark):
    """Four orders of adding 0.8 three times and 0.9, 0.7: means that differ in their last bits only."""
    orders = [(0.8, 0.9, 0.7, 0.8, 0.8), (0.7, 0.8, 0.8, 0.8, 0.9), (0.8, 0.8, 0.8, 0.9, 0.7), (0.9, 0.7, 0.8, 0.8, 0.8)]
    means = [sum(o) / 5 for o in orders] + [math.nextafter(0.8, 0), math.nextafter(0.8, 1)]
    assert min(means) < 0.8 < max(means)
    df = spark.createDataFrame([(76.0, m) for m in means] + [(76.0, 0.79), (75.5, 0.79), (None, 0.79)], "p double, l double")
    got = [r.t for r in ranks.within_bounds(df, {"p": 75.5}, {"l": 0.8}, "t").collect()]
    assert got == [False] * len(means) + [True, False, None]


def test_running_sums_and_numbers_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 500, 3000).tolist()
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, w int").repartition(16)
    got = sorted(((r.v, r.w, r.s) for r in scratch.running(df, ["v", "w"], F.col("w"), "s").collect()))
    total = 0
    for v, w, s in got:
        assert s == total
        total += w
    ordered = sorted((r.n, r.v, r.w) for r in scratch.numbered(df, ["v", "w"], "n").collect())
    assert [(n, v, w) for n, v, w in ordered] == [(k, *x) for k, x in enumerate(sorted((v, w) for v, w, _ in got))]
    assert scratch.numbered(df.limit(0), ["v"], "n").count() == 0


def test_rank_correlations_equal_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300), "y": rng.integers(0, 20, 300).astype(float)})
    df = spark.createDataFrame(pdf.to_records(index=False).tolist(), "a double, b double, y double").withColumn("b", F.when(F.col("b") < 1.5, F.col("b")))
    pdf.loc[pdf.b >= 1.5, "b"] = np.nan
    got = {(r.x, r.y): r for r in ranks.spearman_pairs(df, [("a", "b"), ("b", "y")]).collect()}
    for x, y in (("a", "b"), ("b", "y")):
        both = pdf[[x, y]].dropna().rank()
        assert got[x, y].rho == pytest.approx(both[x].corr(both[y])) and got[x, y].n == len(both)
    assert ranks.spearman_pairs(df.limit(2), [("a", "y")]).first().rho is None
    combined = pdf.a.rank(pct=True) + pdf.b.rank(pct=True)
    bad = pdf.y <= pdf.y.quantile(0.1)
    rows = {r.signal: r for r in ranks.signal_comparison(df, ["a", "b"], "y").collect()}
    for name, v in (("a", pdf.a), ("b", pdf.b), ("combined", combined)):
        keep = v.notna()
        r, f = (-v[keep]).rank(), bad[keep]
        area = (r[f].sum() - f.sum() * (f.sum() + 1) / 2) / (f.sum() * (~f).sum())
        assert rows[name].auc == pytest.approx(area) and rows[name].rho == pytest.approx(v[keep].rank().corr(pdf.y[keep].rank()))


def test_sparse_and_broken_bins(spark):
    rows = [(f"t{i % 9}", 60.0 + 20 * (i % 2), 0.9 if i % 2 else 0.2) for i in range(90)] + [("t1", 10.0, 0.9)]
    got = {r.bin: r for r in resample.classified_curve(spark.createDataFrame(rows, "candidate string, plddt double, lddt double"), 50, min_count=5).collect()}
    assert got[11].verdict == "overconfident" and got[16].verdict == "underconfident"
    assert (got[2].flag, got[2].verdict) == ("sparse", None) and got[11].ci == "[+40.00, +40.00]"


def plain_alignment(a, b, scores, gap_open=-10.0, gap_extend=-1.0):
    """The score of the best global alignment with free ends, cell by cell."""
    n, m = len(a), len(b)
    best = np.full((3, n + 1, m + 1), -1e18)
    best[0, 0, 0], best[1, 1:, 0], best[2, 0, 1:] = 0, 0, 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[0, i, j] = best[:, i - 1, j - 1].max() + scores.get((a[i - 1], b[j - 1]), -4.0)
            o, e = (0, 0) if j == m else (gap_open, gap_extend)
            best[1, i, j] = max(best[0, i - 1, j] + o, best[1, i - 1, j] + e, best[2, i - 1, j] + o)
            o, e = (0, 0) if i == n else (gap_open, gap_extend)
            best[2, i, j] = max(best[0, i, j - 1] + o, best[1, i, j - 1] + o, best[2, i, j - 1] + e)
    return best[:, n, m].max()


def alignment_score(a, b, pairs, scores):
    """What the aligned positions are worth; runs between them are gaps, free at the ends."""
    total = sum(scores.get((a[i], b[j]), -4.0) for i, j in pairs)
    for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False):
        for run in (k - i - 1, m - j - 1):
            total += -10 - (run - 1) if run else 0
    return total


def test_alignments_equal_plain_ones(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("ACDE"), rng.integers(0, 14)))
    pairs, scores = [(word(), word()) for _ in range(150)], kernels.identity_scores()
    for (a, b), (score, found) in zip(pairs, kernels.align_batch(pairs, scores), strict=True):
        assert score == pytest.approx(plain_alignment(a, b, scores))
        assert not found or score == pytest.approx(alignment_score(a, b, found, scores))
    df = spark.createDataFrame([(1, "ACDEF", "CDE"), (2, None, "A"), (3, "", "")], "k int, ref string, sub string")
    got = {r.k: (r.score, r.n_aligned) for r in kernels.align_global(df, ["k"]).collect()}
    assert got == {1: (15.0, 3), 2: (0.0, 0), 3: (0.0, 0)}


def test_depth_of_large_alignments(spark):
    rng = np.random.default_rng(2)
    rows = [("big", k, "".join(rng.choice(list("AC"), 12))) for k in range(900)] + [("small", k, "ACDE"[: 4 - k % 2]) for k in range(6)]
    df = spark.createDataFrame(rows, "candidate string, row int, sequence string")
    whole = {r.candidate: r for r in kernels.neff(df).collect()}
    exact = {r.candidate: r for r in kernels.neff_exact(df, block=100).collect()}
    assert {c: (r.n_sequences, r.neff, r.length) for c, r in whole.items()} == {c: (r.n_sequences, r.neff, r.length) for c, r in exact.items()}
    assert whole["small"].n_sequences == 3 and whole["small"].neff == 1.0
    part = {r.candidate: r for r in kernels.neff(df, max_seqs=200).collect()}
    assert part["big"].neff_estimated and part["big"].n_sequences == 900 and not part["small"].neff_estimated
    import hashlib

    kept = sorted((s for c, k, s in rows if c == "big"), key=lambda s: 0)
    order = sorted(range(900), key=lambda k: (hashlib.md5(f"0:{k}".encode()).hexdigest(), k))[:200]
    want = kernels._weight([kept[k] for k in order], 12, 0.62) * 900 / 200
    assert part["big"].neff == pytest.approx(round(want, 3))


def test_chains_are_paired_and_atoms_matched(spark):
    names = ["ALA", "GLY", "SER", "CYS", "TRP", "VAL"]
    schema = "structure string, atom int, chain string, res_id int, res_name string, atom_name string, x double, y double, z double"

    def atoms(chains, shift):
        rows, k = [], 0
        for chain, residues in chains:
            for i, n in residues:
                for a, name in enumerate(("N", "CA")):
                    rows.append(("s", k, chain, i, names[n], name, i * 3.0 + a, shift * (i % 2), 0.0))
                    k += 1
        return spark.createDataFrame(rows, schema)

    ref = atoms([("A", [(1, 0), (2, 1), (3, 2), (4, 3)]), ("B", [(1, 4), (2, 5), (3, 4), (4, 4)])], 0.0)
    sub = atoms([("X", [(10, 4), (11, 5), (12, 4), (13, 4)]), ("Y", [(20, 0), (21, 1), (22, 2)]), ("Z", [(30, 0), (31, 1), (32, 2)])], 0.0)
    best = kernels.best_chains(ref, sub)
    assert {(r.chain, r.sub_chain) for r in best.collect()} == {("A", "Y"), ("B", "X")}  # Y stands before Z
    matched, coverage = kernels.match_atoms(best, ref, sub)
    assert matched.count() == 7 and coverage.first().coverage == 7 / 8
    assert kernels.match_atoms(best, ref, sub, "all-atom")[0].count() == 14
    with pytest.raises(ValueError):
        kernels.match_atoms(best, ref, sub, "other")
    same = kernels.structure_scores(ref, ref, "all-atom").collect()
    assert len(same) == 8 and {r.lddt for r in same} == {1.0} and {r.coverage for r in same} == {1.0}
    one = spark.createDataFrame([("s", 0, "A", 1, "ALA", "N", 0.0, 0.0, 0.0), ("s", 1, "A", 1, "ALA", "CA", 1.0, 0.0, 0.0)], schema)
    assert kernels.structure_scores(one, one, "all-atom").first().lddt is None  # no atom of another residue


def test_surface_areas(spark):
    schema = "structure string, atom int, chain string, res_id int, res_name string, atom_name string, x double, y double, z double, b_factor double"
    rows = [("one", 0, "A", 1, "ALA", "CA", 0.0, 0.0, 0.0, 5.0), ("one", 1, "A", 1, "ALA", "HA", 1.0, 0.0, 0.0, 5.0)]
    rows += [("two", k, "A", 1 + 2 * k, ("GLY", "UNK")[k], "CA", 2.0 * k, 0.0, 0.0, 10.0 * k) for k in range(2)]
    rng = np.random.default_rng(4)
    at, names = rng.uniform(-8, 8, (120, 3)), ["N", "CA", "C", "O", "CB", "CG"]
    rows += [("many", k, "A", k // 6, "PHE", names[k % 6], *map(float, at[k]), 1.0) for k in range(120)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.structure, r.atom): r.area for r in kernels.accessible_area(df).collect()}
    r = 1.88 + 1.4
    assert got["one", 0] == pytest.approx(4 * np.pi * r * r) and ("one", 1) not in got
    assert got["two", 0] == pytest.approx(2 * np.pi * r * (r + 1.0), rel=0.01)  # the cap beyond the middle is hidden
    radii = np.array([{"N": 1.64, "CA": 1.88, "C": 1.61, "O": 1.42, "CB": 1.88, "CG": 1.61}[names[k % 6]] + 1.4 for k in range(120)])
    for k in range(120):
        away = ((at[k] + kernels.sphere(1000) * radii[k])[:, None, :] - np.delete(at, k, axis=0)[None]) ** 2
        free = (away.sum(axis=2) >= np.delete(radii, k) ** 2).all(axis=1).mean()
        assert got["many", k] == pytest.approx(4 * np.pi * radii[k] ** 2 * free)
    notes = {(r.structure, r.res_id): r for r in kernels.residue_annotations(df).collect()}
    assert notes["one", 1].ref_bfactor_z == 0.0 and notes["one", 1].rsa == pytest.approx(min(got["one", 0] / 129, 1.5)) and not notes["one", 1].near_chain_gap
    assert (notes["two", 1].ref_bfactor_z, notes["two", 3].ref_bfactor_z) == (-1.0, 1.0) and notes["two", 3].rsa is None and notes["two", 3].near_chain_gap
    assert kernels.residue_annotations(df.limit(0)).count() == 0


def test_agreement_join_raises_on_nothing(spark):
    a = spark.createDataFrame([("t", "A", 1, 0.5)], "candidate string, chain string, res_id int, agreement double")
    assert evaluate.agreement_join(a.drop("agreement"), a).count() == 1
    with pytest.raises(ValueError):
        evaluate.agreement_join(a.drop("agreement").where("res_id = 2"), a)


def test_sources_without_a_query(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    (tmp_path / "r.csv").write_text("candidate,plddt,lddt\nt,90,0.9\n")
    assert readers.residue_table(spark, path("r.csv"), "candidate string, plddt double, lddt double").first().plddt == 90
    assert dict(readers.residue_table(spark, path("r.csv")).dtypes)["lddt"] == "double"
    readers.residue_table(spark, path("r.csv")).write.parquet(path("r.parquet"))
    assert readers.residue_table(spark, path("r.parquet")).count() == 1
    (tmp_path / "x.csv").write_text("plddt\n90\n")
    with pytest.raises(KeyError):
        readers.residue_table(spark, path("x.csv"))
    (tmp_path / "cov.json").write_text(json.dumps([{"candidate": "t", "a": 1, "b": 2}]))
    assert readers.covariates(spark, path("cov.json"), ["b", "c"]).columns == ["candidate", "b"]
    (tmp_path / "none.json").write_text(json.dumps([{"a": 1}]))
    assert readers.covariates(spark, path("none.json"), ["a"]) is None
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "good.json").write_text('{"total_count": 3}')
    (tmp_path / "cache" / "bad.json").write_text('{"total_count": ')
    assert [(r.file, r.response.total_count) for r in readers.cached_json(spark, path("cache")).collect()] == [("good.json", 3)]
    entries = spark.createDataFrame([("t", "AC\nD", "X", "", "2020", "2019", "", "T")], "candidate string, sequence_canonical string, sequence string, deposit_date string, initial_release_date string, deposition_date string, struct_title string, title string")
    assert tuple(readers.covariate_rows(entries).first()) == ("t", "ACD", 3, "2020", "T")
    targets = spark.createDataFrame([("t", "", "A\nC"), ("u", None, None), ("", "A", "A")], "candidate string, sequence_canonical string, sequence string")
    assert [tuple(r) for r in readers.target_sequences(targets).collect()] == [("t", "AC")] and readers.target_sequences(targets, 1).count() == 1
    spark.createDataFrame([("AC",), ("",)], "sequence string").write.parquet(path("m.parquet"))
    assert [r[0] for r in readers.aligned_msa(spark, path("m.parquet")).collect()] == ["AC"]
    (tmp_path / "c.csv").write_text("residue_index,plddt\n3,95\n")
    assert tuple(readers.confidence_csv(spark, path("c.csv")).first()) == (3, 95.0)
    (tmp_path / "d.csv").write_text("place,plddt\n3,95\n")
    with pytest.raises(KeyError):
        readers.confidence_csv(spark, path("d.csv"))
    writers.write_json(targets, path("out"))
    assert spark.read.json(path("out")).count() == 3
    (tmp_path / "q.pdb").write_text("MODEL     1\nATOM      1  CA  ALA A   5       1.000   2.000   3.000  1.00 20.50\nHETATM    2  O   HOH A   6       1.000   2.000   3.000  1.00 20.50\nATOM      3  CA  UNK A   7       1.000   2.000   3.000  1.00\nENDMDL\n")
    rows = readers.atoms(spark, path("q.pdb"))
    assert [(r.res_id, r.b_factor) for r in rows.orderBy("res_id").collect()] == [(5, 20.5), (7, None)]
    assert [r.res_id for r in readers.protein_atoms(rows).collect()] == [5] and readers.protein_atoms(rows, 2).count() == 0
    cif = "loop_\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_seq_id\n_atom_site.label_asym_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n\"O5'\" DA 1 'A B' 0 1 2\n#\n"
    assert readers.cif_atoms(cif)[0][1:5] == ("A B", 1, "DA", "O5'")
