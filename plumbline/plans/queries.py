"""The engine's operators over the driver's tables, each with the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import derive
from plumbline.operators import calibration as cal
from plumbline.operators import evaluate, kernels, ranks, resample, specs
from plumbline.plans import sql
from plumbline.plans.residues import build_dataset, dataset, residues, rounded, table, target_covariates
from plumbline.plans.sql import METRICS, bins, draws, rd, with_residues
from plumbline.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Replicates of bootstraps and of threshold intervals, and permutations.
REPS, THRESHOLD_REPS, PERMS = 2000, 500, 5000
THRESHOLDS = [50.0, 60.0, 70.0, 80.0, 85.0, 90.0, 95.0]


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query, with its SQL if there is any; doubles are rounded alike on both sides."""

    def keep(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return keep


# Reliability bins and metrics


@query(with_residues(f"SELECT bin, {rd('bin * 0.05', 'bin_lo')}, {rd('(bin + 1) * 0.05', 'bin_hi')}, c AS n, {rd('sc / c', 'mean_conf')}, {rd('sa / c', 'mean_acc')}, {rd('(sc - sa) / c', 'gap')} FROM b", bins()))
def reliability_curve(spark, sf_dir):
    return cal.reliability_curve(residues(spark, sf_dir))


@query(with_residues(f"SELECT {METRICS} FROM b", bins()))
def calib_summary(spark, sf_dir):
    return cal.summarize(residues(spark, sf_dir))


def _by(name: str, *columns: str) -> None:
    keys = ", ".join(columns)
    query(with_residues(f"SELECT {keys}, {METRICS} FROM b GROUP BY {keys} HAVING sum(c) >= 50", bins(keys)), name)(lambda spark, sf_dir: cal.stratified_summary(dataset(spark, sf_dir, tertiles=any(c.endswith("_bin") for c in columns)), list(columns)))


_by("calib_by_flexibility", "flexibility")
_by("calib_by_structured", "structured")
_by("calib_by_exposure", "exposure")
_by("calib_by_ligand", "ligand_state")
_by("calib_by_novelty", "novelty_bin")
_by("calib_by_depth", "msa_depth_bin")
_by("calib_two_way", "flexibility", "ligand_state")

_GAP = "(sum(sc) - sum(sa)) / sum(c)"


@query(with_residues(f"SELECT flexibility, {rd('apo', 'apo')}, {rd('holo', 'holo')}, {rd('apo - holo', 'apo_minus_holo')} FROM (SELECT flexibility, max(v) FILTER (ligand_state = 'apo') AS apo, max(v) FILTER (ligand_state = 'holo') AS holo FROM (SELECT flexibility, ligand_state, {_GAP} AS v FROM b GROUP BY ALL HAVING sum(c) >= 50) GROUP BY 1)", bins("flexibility, ligand_state")))
def interaction_gap(spark, sf_dir):
    strata = cal.stratified_summary(dataset(spark, sf_dir), ["flexibility", "ligand_state"])
    return cal.interaction_gap(strata, "flexibility", "ligand_state", ["apo", "holo"])


@query(with_residues(f"SELECT 'all' AS stratum, {rd('apo', 'apo')}, {rd('holo', 'holo')}, {rd('apo - holo', 'apo_minus_holo')} FROM (SELECT max(v) FILTER (ligand_state = 'apo') AS apo, max(v) FILTER (ligand_state = 'holo') AS holo FROM (SELECT ligand_state, {_GAP} AS v FROM b GROUP BY ALL HAVING sum(c) >= 50))", bins("ligand_state")))
def marginal_gap(spark, sf_dir):
    strata = cal.stratified_summary(dataset(spark, sf_dir), ["ligand_state"])
    return cal.interaction_gap(strata.withColumn("stratum", F.lit("all")), "stratum", "ligand_state", ["apo", "holo"])


_LEVELS = ["flexible", "intermediate", "rigid"]


@query(with_residues("SELECT exposure, " + ", ".join(f"round(100.0 * count(*) FILTER (flexibility = '{x}') / count(*), 1) + 0.0 AS {x}" for x in _LEVELS) + " FROM d GROUP BY 1"))
def crosstab_pct(spark, sf_dir):
    return cal.crosstab_percent(dataset(spark, sf_dir), "exposure", "flexibility", _LEVELS)


@query(with_residues(f"SELECT flexibility, {rd('avg(lddt)', 'mean_lddt')}, {rd('avg(plddt)', 'mean_plddt')} FROM d GROUP BY 1"))
def group_mean(spark, sf_dir):
    return dataset(spark, sf_dir).groupBy("flexibility").agg(F.avg("lddt").alias("mean_lddt"), F.avg("plddt").alias("mean_plddt"))


@query(with_residues(f"SELECT candidate, {METRICS} FROM b GROUP BY 1", bins("candidate")))
def per_target_table(spark, sf_dir):
    return cal.per_target_table(residues(spark, sf_dir))


@query(with_residues(f"SELECT {rd('quantile_cont(v, 0.25)', 'q1')}, {rd('quantile_cont(v, 0.5)', 'median')}, {rd('quantile_cont(v, 0.75)', 'q3')}, {rd('min(v)', 'low')}, {rd('max(v)', 'high')}, {rd('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)', 'share_positive')}, count(v) AS n FROM (SELECT candidate, {_GAP} AS v FROM b GROUP BY 1)", bins("candidate")))
def target_spread(spark, sf_dir):
    return cal.spread(cal.per_target_table(residues(spark, sf_dir)), "overconfidence")


@query(with_residues(f"SELECT bin, n, {rd('n / total', 'share')}, {rd('gap', 'gap')}, {rd('mce', 'mce')}, {rd('dense', 'mce_dense')} FROM (SELECT bin, c AS n, (sc - sa) / c AS gap, abs(sc - sa) / c AS size, sum(c) OVER () AS total, max(abs(sc - sa) / c) OVER () AS mce, max(CASE WHEN c >= 100 THEN abs(sc - sa) / c END) OVER () AS dense FROM b) ORDER BY size DESC, bin LIMIT 1", bins()))
def mce_diagnosis(spark, sf_dir):
    return cal.mce_diagnosis(cal.reliability_curve(residues(spark, sf_dir)), 100)


@query(with_residues("SELECT candidate, count(*) AS n_residues, " + ", ".join((
    rd("avg(CASE WHEN flexibility = 'flexible' THEN 1.0 ELSE 0.0 END)", "frac_flexible"), rd("avg(CASE WHEN flexibility = 'rigid' THEN 1.0 ELSE 0.0 END)", "frac_rigid"), rd("avg(CASE WHEN structured = 'coil' THEN 1.0 ELSE 0.0 END)", "frac_coil"),
    rd("avg(CASE WHEN exposure = 'exposed' THEN 1.0 ELSE 0.0 END)", "frac_exposed"), rd("avg(ref_bfactor_z)", "mean_ref_bfactor_z"), "round(avg(ref_bfactor), 3) + 0.0 AS mean_ref_bfactor", rd("avg(rsa)", "mean_rsa"),
)) + " FROM d GROUP BY 1"))
def composition(spark, sf_dir):
    return cal.composition(dataset(spark, sf_dir)).withColumn("mean_ref_bfactor", F.round("mean_ref_bfactor", 3))


# Derived columns


@query(with_residues(f"SELECT candidate, chain, res_id, plddt, lddt, {rd('ref_bfactor_z', 'ref_bfactor_z')}, flexibility FROM d"))
def zscore_within(spark, sf_dir):
    return dataset(spark, sf_dir).select("candidate", "chain", "res_id", "plddt", "lddt", "ref_bfactor_z", "flexibility")


@query(with_residues("SELECT candidate, chain, res_id, coalesce(res_id - lag(res_id) OVER w > 1, FALSE) OR coalesce(lead(res_id) OVER w - res_id > 1, FALSE) AS near_chain_gap FROM (SELECT DISTINCT candidate, chain, res_id FROM r) WINDOW w AS (PARTITION BY candidate, chain ORDER BY res_id)"))
def chain_gap_flags(spark, sf_dir):
    rows = residues(spark, sf_dir).select("candidate", "chain", "res_id").distinct()
    return rows.withColumn("near_chain_gap", derive.near_chain_gap("res_id", "candidate", "chain"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, CAST(sum(moved) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e)
SELECT user_id, run, min(event_type) AS event_type, min(event_id) AS first_id, count(*) AS n_atoms, """ + rd("avg(value)", "mean_value") + " FROM f GROUP BY 1, 2")
def residue_runs(spark, sf_dir):
    rows = derive.run_number(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type"])
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.min("event_id").alias("first_id"), F.count("*").alias("n_atoms"), F.avg("value").alias("mean_value"))


@query(with_residues("SELECT DISTINCT candidate, max_identity, novelty_bin, msa_depth_bin FROM d"))
def tertiles(spark, sf_dir):
    return dataset(spark, sf_dir, tertiles=True).select("candidate", "max_identity", "novelty_bin", "msa_depth_bin").distinct()


@query(with_residues("SELECT DISTINCT ligand_state, structured, exposure FROM d"))
def strata_labels(spark, sf_dir):
    return dataset(spark, sf_dir).select("ligand_state", "structured", "exposure").distinct()


@query("""SELECT p_partkey, least(greatest(p_retailprice / 1000, 0.0), 1.5) AS rsa, CASE WHEN p_size > 25 THEN 'C' ELSE 'X' END AS code FROM part""")
def accessibility_and_codes(spark, sf_dir):
    name = F.when(F.col("p_size") > 25, "CYS").otherwise("ZZZ")
    p = table(spark, sf_dir, "part").select("p_partkey", derive.clip(F.col("p_retailprice") / 1000, 0.0, 1.5).alias("rsa"), derive.one_letter(name).alias("code"))
    return p


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS entry, CAST(o_custkey AS VARCHAR) AS entity FROM orders")
def candidate_parse(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("c"))
    entry, entity = derive.candidate_parts(F.col("c"))
    return ids.select("o_orderkey", entry.alias("entry"), entity.alias("entity"))


@query("SELECT DISTINCT p_brand AS entry FROM part")
def sorted_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select(derive.first_text(F.col("p_brand"), F.col("p_type")).alias("entry")).distinct().orderBy("entry")


# Joins and filters


@query(with_residues("SELECT candidate, count(*) AS n FROM r WHERE candidate NOT IN (SELECT candidate FROM r GROUP BY 1 HAVING min(0.5 + abs(CAST(candidate AS BIGINT) % 10) / 10.0) < 0.8) GROUP BY 1"))
def low_coverage_anti(spark, sf_dir):
    rows = residues(spark, sf_dir).withColumn("coverage", 0.5 + F.abs(F.col("candidate").cast("long") % 10) / 10.0)
    return rows.join(cal.low_coverage(rows), "candidate", "left_anti").groupBy("candidate").agg(F.count("*").alias("n"))


@query(with_residues("SELECT candidate, chain, res_id, plddt, lddt, npc AS nonpolymer_entity_count, max_identity, ligand_state FROM d"))
def covariate_left_join(spark, sf_dir):
    return dataset(spark, sf_dir).select("candidate", "chain", "res_id", "plddt", "lddt", "nonpolymer_entity_count", "max_identity", "ligand_state")


@query("""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS candidate, c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT CAST(o_custkey AS VARCHAR) AS candidate, min(o_totalprice) AS price FROM orders GROUP BY 1)
SELECT coalesce(a.candidate, b.candidate) AS candidate, bal, price FROM a FULL JOIN b ON a.candidate = b.candidate""")
def covariate_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("candidate"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("candidate"), F.col("o_totalprice").alias("price"))
    return readers.merge_covariates([a, b])


@query("""WITH p AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey AS num, o_orderstatus AS nm FROM orders),
q AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_orderkey AS num, o_orderstatus AS nm FROM orders)
SELECT p.t AS target, p.k AS place, p.num AS predicted, q.num AS reference, p.nm = q.nm AS same_name FROM p JOIN q ON p.t = q.t AND p.k = q.k""")
def validated_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "target")
    place = lambda *c: F.row_number().over(Window.partitionBy("target").orderBy(*c)).alias("place")
    p = o.select("target", place("o_orderkey"), F.col("o_orderkey").alias("predicted"), F.col("o_orderstatus").alias("pn"))
    q = o.select("target", place("o_orderdate", "o_orderkey"), F.col("o_orderkey").alias("reference"), F.col("o_orderstatus").alias("rn"))
    return p.join(q, ["target", "place"]).select("target", "place", "predicted", "reference", (F.col("pn") == F.col("rn")).alias("same_name"))


_POOL = [("baseline", "TRUE"), ("cheap", "p_retailprice <= 1000"), ("small", "p_size <= 20"), ("brand", "p_brand <> 'Brand#11'"), ("both", "p_retailprice <= 1000 AND p_size <= 20")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) AS entities, count(DISTINCT p_type) AS clusters FROM part WHERE {w}" for n, w in _POOL))
def pool_sensitivity(spark, sf_dir):
    return specs.pool_sweep(table(spark, sf_dir, "part"), dict(_POOL), "p_type")


@query("SELECT p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size BETWEEN 5 AND 45) WHERE k = 1")
def cluster_representatives(spark, sf_dir):
    return specs.representatives(table(spark, sf_dir, "part").where("p_size between 5 and 45"), "p_type", "p_retailprice", "p_partkey")


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS candidate FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def pending_targets(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("candidate"))
    return writers.pending(wanted, table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").cast("string").alias("candidate"))).distinct()


# Resampling


def _interval(body: str, alpha: float = 0.05) -> str:
    return f"{rd(f'quantile_cont({body}, {alpha / 2})', 'lo')}, {rd(f'quantile_cont({body}, {1 - alpha / 2})', 'hi')}, {rd(f'stddev_pop({body})', 'se')}, count({body}) AS n_reps"


_REP_BINS = ", q AS (SELECT rep, bin, sum(m * c) AS c, sum(m * sc) AS sc, sum(m * sa) AS sa FROM p JOIN ids USING (idx) JOIN b USING (candidate) GROUP BY 1, 2)"


def _boot(name: str, metric: str, expression: str) -> None:
    one = f"SELECT {rd(expression, 'point')} FROM (SELECT bin, sum(c) AS c, sum(sc) AS sc, sum(sa) AS sa FROM b GROUP BY 1)"
    oracle = with_residues(f"SELECT * FROM ({one}), (SELECT {_interval('v')} FROM (SELECT rep, {expression} AS v FROM q GROUP BY 1))", bins("candidate") + draws(REPS) + _REP_BINS)
    query(oracle, name)(lambda spark, sf_dir: resample.bootstrap_metric(residues(spark, sf_dir), metric, REPS))


_boot("boot_overconfidence", "overconfidence", _GAP)
_boot("boot_ece", "ece", "sum(abs(sc - sa)) / sum(c)")
_boot("boot_mce", "mce", "max(abs(sc - sa) / c)")


@query(with_residues(
    f"SELECT {rd('pa - pb', 'point')}, lo, hi, se, n_reps, lo > 0 OR hi < 0 AS excludes_zero FROM (SELECT sum(sc - sa) FILTER (flexibility = 'flexible') / sum(c) FILTER (flexibility = 'flexible') AS pa, sum(sc - sa) FILTER (flexibility = 'rigid') / sum(c) FILTER (flexibility = 'rigid') AS pb FROM b), (SELECT {_interval('va - vb')} FROM v)",
    bins("candidate, flexibility") + draws(REPS) + ", v AS (SELECT rep, sum(m * (sc - sa)) FILTER (flexibility = 'flexible') / sum(m * c) FILTER (flexibility = 'flexible') AS va, sum(m * (sc - sa)) FILTER (flexibility = 'rigid') / sum(m * c) FILTER (flexibility = 'rigid') AS vb FROM p JOIN ids USING (idx) JOIN b USING (candidate) GROUP BY 1)",
))
def boot_contrast(spark, sf_dir):
    return resample.bootstrap_contrast(dataset(spark, sf_dir), "flexibility", "flexible", "rigid", reps=REPS)


@query(with_residues(f"SELECT bin, {rd('quantile_cont((sc - sa) / c, 0.025)', 'gap_lo')}, {rd('quantile_cont((sc - sa) / c, 0.975)', 'gap_hi')} FROM q GROUP BY 1", bins("candidate") + draws(REPS) + _REP_BINS))
def curve_ci(spark, sf_dir):
    return resample.curve_intervals(residues(spark, sf_dir), REPS)


_T = ", tt AS (SELECT unnest([" + ", ".join(map(sql.number, THRESHOLDS)) + "]) AS threshold), s AS (SELECT threshold, candidate, count(*) AS c, sum(conf) AS sc, sum(lddt) AS sa, sum(plddt) AS sp FROM d JOIN tt ON plddt >= threshold GROUP BY 1, 2)"


@query(with_residues(
    f"SELECT threshold, residues_kept, {rd('residues_kept / total', 'share_kept')}, mean_plddt, mean_lddt, gap, gap_lo, gap_hi FROM (SELECT threshold, CAST(sum(c) AS BIGINT) AS residues_kept, {rd('sum(sp) / sum(c)', 'mean_plddt')}, {rd('sum(sa) / sum(c)', 'mean_lddt')}, {rd('(sum(sc) - sum(sa)) / sum(c)', 'gap')} FROM s GROUP BY 1) JOIN (SELECT threshold, {rd('quantile_cont(v, 0.025)', 'gap_lo')}, {rd('quantile_cont(v, 0.975)', 'gap_hi')} FROM (SELECT threshold, rep, sum(m * (sc - sa)) / sum(m * c) AS v FROM p JOIN ids USING (idx) JOIN s USING (candidate) GROUP BY 1, 2) GROUP BY 1) USING (threshold), (SELECT count(*) AS total FROM d)",
    draws(THRESHOLD_REPS) + _T,
))
def threshold_table(spark, sf_dir):
    return resample.threshold_table(residues(spark, sf_dir), THRESHOLDS, THRESHOLD_REPS)


# Ranks

_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT o_orderkey, o_totalprice, o_orderpriority, {_RANK.format('o_orderpriority')} AS avg_rank FROM orders")
def avg_rank(spark, sf_dir):
    return ranks.average_ranks(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").withColumn("p", F.substring("o_orderpriority", 1, 1).cast("int")), "p", "avg_rank").drop("p", "avg_rank_n")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {rd(f'({_RANK.format('l_quantity')}) / count(*) OVER ()', 'pct_rank')} FROM lineitem")
def pct_rank(spark, sf_dir):
    return ranks.percent_rank(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity", "pct_rank")


def _auc(value: str, flag: str, source: str, extra: str = "") -> str:
    return f"SELECT {rd('(sum(rk) FILTER (f) - k * (k + 1) / 2.0) / (k * (n - k))', 'auc')}, k AS n_flagged, n FROM (SELECT f, {_RANK.format('v')} AS rk, count(*) FILTER (f) OVER () AS k, count(*) OVER () AS n FROM (SELECT {value} AS v, {flag} AS f FROM {source}) WHERE v IS NOT NULL AND f IS NOT NULL) GROUP BY k, n"


@query(_auc("n_chars", "toxic = 1", "documents JOIN labels USING (doc_id)"))
def auc_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return ranks.auc(rows.withColumn("f", F.col("toxic") == 1), "n_chars", "f")


@query(with_residues(_auc("-plddt", "lddt <= cut", "(SELECT plddt, lddt, quantile_cont(lddt, 0.1) OVER () AS cut FROM d)")))
def auroc_low_score(spark, sf_dir):
    return ranks.auc(ranks.worst_quantile(residues(spark, sf_dir), "lddt", 0.1, "bad"), "plddt", "bad", low_flags=True)


@query(with_residues(f"SELECT {rd('corr(a, b)', 'rho')}, count(*) AS n FROM (SELECT {_RANK.format('ref_bfactor')} AS a, {_RANK.format('plddt')} AS b FROM r)"))
def spearman(spark, sf_dir):
    return ranks.spearman(residues(spark, sf_dir), "ref_bfactor", "plddt")


_SIGNALS = ", s AS (SELECT candidate, chain, res_id, ref_bfactor, plddt, lddt, (" + _RANK.format("plddt") + ") / count(*) OVER () + (" + _RANK.format("ref_bfactor") + ") / count(*) OVER () AS combined, quantile_cont(lddt, 0.1) OVER () AS cut FROM r)"


@query(with_residues(f"SELECT candidate, chain, res_id, ref_bfactor, {rd('combined', 'combined')} FROM s", _SIGNALS))
def rank_average(spark, sf_dir):
    return ranks.rank_average(residues(spark, sf_dir), ["plddt", "ref_bfactor"], "combined").select("candidate", "chain", "res_id", "ref_bfactor", "combined")


@query(with_residues(" UNION ALL ".join(f"SELECT '{c}' AS signal, auc, rho FROM ({_auc(f'-{c}', 'lddt <= cut', 's')}), (SELECT {rd('corr(a, b)', 'rho')} FROM (SELECT {_RANK.format(c)} AS a, {_RANK.format('lddt')} AS b FROM s))" for c in ("plddt", "ref_bfactor", "combined")), _SIGNALS))
def signal_compare(spark, sf_dir):
    return ranks.signal_comparison(residues(spark, sf_dir), ["plddt", "ref_bfactor"], "lddt", 0.1)


@query(with_residues("SELECT candidate, CAST(count(*) FILTER (lddt <= cut) AS BIGINT) AS n_bad, count(*) AS n FROM (SELECT candidate, lddt, quantile_cont(lddt, 0.1) OVER () AS cut FROM r) GROUP BY 1"))
def bad_decile(spark, sf_dir):
    rows = ranks.worst_quantile(residues(spark, sf_dir), "lddt", 0.1, "bad")
    return rows.groupBy("candidate").agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n"))


_PER = ", pt AS (SELECT candidate, sum(c) AS n, (sum(sc) - sum(sa)) / sum(c) AS overconfidence, sum(sp) / sum(c) AS mean_plddt, sum(sa) / sum(c) AS mean_lddt FROM b GROUP BY 1), ft AS (SELECT *, row_number() OVER (ORDER BY round(overconfidence, 9) DESC, candidate) <= 20 AS tail FROM pt JOIN t USING (candidate))"


def _tail_table(spark, sf_dir):
    per = cal.per_target_table(residues(spark, sf_dir)).withColumn("o", F.round("overconfidence", 9))
    sizes = residues(spark, sf_dir).groupBy("candidate").agg(F.count("*").alias("neff"))
    full = per.join(target_covariates(spark, sf_dir), "candidate", "left").join(sizes, "candidate")
    return ranks.top_k(full, "o", "candidate", 20, "tail").drop("o")


@query(with_residues(f"SELECT candidate, {rd('overconfidence', 'overconfidence')}, tail FROM ft", bins("candidate") + _PER))
def tail_topk(spark, sf_dir):
    return _tail_table(spark, sf_dir).select("candidate", "overconfidence", "tail")


@query(with_residues("SELECT candidate, mean_plddt > 75.5 AND mean_lddt < 0.8 AS tail FROM ft", bins("candidate") + _PER))
def tail_threshold(spark, sf_dir):
    return ranks.within_bounds(_tail_table(spark, sf_dir), {"mean_plddt": 75.5}, {"mean_lddt": 0.8}, "tail").select("candidate", "tail")


_SCAN = ", x AS (SELECT 'max_identity' AS covariate, max_identity AS v, tail AS f FROM ft UNION ALL SELECT 'npc', npc, tail FROM ft UNION ALL SELECT 'neff', neff, tail FROM ft), y AS (SELECT covariate, v, f, rank() OVER (PARTITION BY covariate ORDER BY v) + (count(*) OVER (PARTITION BY covariate, v) - 1) / 2.0 AS rk FROM x WHERE v IS NOT NULL), g AS (SELECT covariate, count(*) AS n, (sum(rk) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0) / (count(*) FILTER (f) * (count(*) - count(*) FILTER (f))) AS auc, quantile_cont(v, 0.5) FILTER (f) AS tm, quantile_cont(v, 0.5) FILTER (NOT f) AS rm FROM y GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT v) >= 2)"


def _scan(spark, sf_dir):
    return ranks.covariate_scan(_tail_table(spark, sf_dir).withColumnRenamed("nonpolymer_entity_count", "npc"), ["max_identity", "npc", "neff"], "tail")


@query(with_residues(f"SELECT covariate, n, {rd('auc', 'auc_tail_higher')}, {rd('abs(auc - 0.5)', 'effect')}, {rd('tm', 'tail_median')}, {rd('rm', 'rest_median')} FROM g", bins("candidate") + _PER + _SCAN))
def covariate_scan(spark, sf_dir):
    return _scan(spark, sf_dir)


@query(with_residues(f"SELECT covariate, {rd('0.05 / count(*) OVER ()', 'bonferroni')}, CASE WHEN auc > 0.5 THEN 'higher' ELSE 'lower' END AS direction, CAST(rank() OVER (ORDER BY round(abs(auc - 0.5), 9) DESC) AS BIGINT) AS place FROM g", bins("candidate") + _PER + _SCAN))
def bonferroni(spark, sf_dir):
    found = ranks.significant(_scan(spark, sf_dir).withColumn("p_perm", F.lit(None).cast("double")))
    place = F.rank().over(Window.orderBy(F.desc(F.round("effect", 9)))).cast("long")  # a row for each covariate
    return found.select("covariate", "bonferroni", "direction", place.alias("place"))


@query(with_residues(
    f"SELECT n, k, CAST(count(*) FILTER (abs((s - k * (k + 1) / 2.0) / (k * (n - k)) - 0.5) >= abs((rk - k * (k + 1) / 2.0) / (k * (n - k)) - 0.5) - 1e-12) AS BIGINT) AS hits, {rd(f'(count(*) FILTER (abs((s - k * (k + 1) / 2.0) / (k * (n - k)) - 0.5) >= abs((rk - k * (k + 1) / 2.0) / (k * (n - k)) - 0.5) - 1e-12) + 1) / {PERMS + 1}.0', 'p_perm')} FROM (SELECT perm, n, k, rk, sum(r) AS s FROM (SELECT perm, r, n, k, rk, row_number() OVER (PARTITION BY perm ORDER BY dg, candidate) AS place FROM (SELECT *, {sql.digest('0', 'perm', 'candidate')} AS dg FROM pr, (SELECT unnest(range({PERMS})) AS perm))) WHERE place <= k GROUP BY ALL) WHERE n >= 5 AND k < n GROUP BY n, k",
    bins("candidate") + _PER + ", pr0 AS (SELECT candidate, tail, rank() OVER (ORDER BY max_identity) + (count(*) OVER (PARTITION BY max_identity) - 1) / 2.0 AS r FROM ft), pr AS (SELECT *, count(*) OVER () AS n, CAST(count(*) FILTER (tail) OVER () AS BIGINT) AS k, sum(r) FILTER (tail) OVER () AS rk FROM pr0)",
))
def permutation_p(spark, sf_dir):
    """A row if the test can be made."""
    return resample.permutation_p(_tail_table(spark, sf_dir), "candidate", "max_identity", "tail", PERMS).where("p_perm is not null")


@query(with_residues(f"SELECT {rd('corr(lddt - s * plddt - i, ref_bfactor)', 'corr_residual')}, count(*) AS n FROM r, (SELECT regr_slope(lddt, plddt) AS s, regr_intercept(lddt, plddt) AS i FROM r)"))
def residual_corr(spark, sf_dir):
    return ranks.residual_correlation(residues(spark, sf_dir), "lddt", "plddt", "ref_bfactor")


# Nested documents, sequences, kernels

_HITS = "SELECT user_id AS candidate, coalesce(max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) FILTER (event_type = 'click'), 0.0) AS max_identity, CAST(count(*) AS INT) AS n_hits FROM events GROUP BY 1"


def _responses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k double")["k"]
    context = F.array(F.struct(k.alias("sequence_identity")))
    services = F.array(F.struct(F.when(F.col("event_type") == "click", "sequence").otherwise(F.col("event_type")).alias("service_type"), F.array(F.struct(context.alias("match_context"))).alias("nodes")))
    hit = F.struct(F.col("event_id").cast("string").alias("identifier"), services.alias("services"))
    rows = e.groupBy(F.col("user_id").alias("candidate")).agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct("event_id", hit.alias("h")))).alias("hs"))
    return rows.select("candidate", F.struct(F.col("total").alias("total_count"), F.transform("hs", lambda x: x["h"]).alias("result_set")).alias("response"))


@query(_HITS)
def json_nested_max(spark, sf_dir):
    best, n = readers.max_identity(F.col("response"))
    return _responses(spark, sf_dir).select("candidate", best.alias("max_identity"), n.alias("n_hits"))


_BEST = "SELECT user_id AS candidate, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS max_identity, CAST(event_id AS VARCHAR) AS best_hit, count(*) OVER (PARTITION BY user_id) AS n_hits, FALSE AS parse_failed, row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC, event_id) AS place FROM events"


@query(f"SELECT candidate, max_identity, best_hit, n_hits, parse_failed FROM ({_BEST}) WHERE place = 1")
def training_identity(spark, sf_dir):
    return readers.best_hit(_responses(spark, sf_dir))


@query(f"SELECT count(*) AS scored, CAST(0 AS BIGINT) AS novel, CAST(0 AS BIGINT) AS broken, TRUE AS sound FROM ({_BEST}) WHERE place = 1")
def identity_counters(spark, sf_dir):
    return readers.identity_counters(readers.best_hit(_responses(spark, sf_dir)))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS key FROM pages")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.cache_key(F.col("url")).alias("key"))


_URL = "CASE page_id % 3 WHEN 0 THEN 'https://data.rcsb.org/rest/v1/core/entry/E' || page_id WHEN 1 THEN 'https://data.rcsb.org/rest/v1/core/polymer_entity/E' || page_id || '/1' ELSE url END"


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'entry/E' || page_id || '.json' WHEN 1 THEN 'polymer_entity/E' || page_id || '_1.json' ELSE CASE WHEN page_id % 2 = 0 THEN 'search/' || substr(sha256(url), 1, 16) || '_' || substr(sha256('{{\"a\": [1, true], \"b\": ' || page_id || '}}'), 1, 16) ELSE 'other/' || substr(sha256(url), 1, 16) END || '.json' END AS path FROM pages")
def cache_paths(spark, sf_dir):
    """Bodies have their keys in another order than their canonical form."""
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"b":'), F.col("page_id").cast("string"), F.lit(', "a":[1,true]}')))
    return table(spark, sf_dir, "pages").select("page_id", readers.cache_path(F.expr(_URL), body).alias("path"))


@query("WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q FROM documents) SELECT doc_id, md5('>protein|name=' || CAST(doc_id AS VARCHAR) || chr(10) || rtrim(regexp_replace(q, '(.{80})', '\\1' || chr(10), 'g'), chr(10))) AS record_md5 FROM s")
def fasta_wrap(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("q"))
    return s.select("doc_id", F.md5(writers.fasta(F.col("doc_id").cast("string"), F.col("q")).cast("binary")).alias("record_md5"))


@query("SELECT conv_id AS candidate, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS row, CAST(turn AS VARCHAR) AS header, regexp_replace(regexp_replace(text, '\\s', '', 'g'), '[a-z.]', '', 'g') AS sequence FROM conversations")
def a3m_strip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    value = F.array_join(F.transform("t", lambda x: F.concat(F.lit(">"), x["turn"].cast("string"), F.lit("\n"), x["text"])), "\n")
    return readers.a3m_records(rows.select(F.col("conv_id").alias("candidate"), value.alias("value")))


_MSA = "WITH m AS (SELECT l_partkey AS candidate, row_number() OVER () AS id, l_returnflag || l_linestatus || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 2, '0') || substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 10) AS s FROM lineitem), w AS (SELECT a.candidate, a.id, 1.0 / count(*) AS w FROM m a JOIN m b ON a.candidate = b.candidate AND (" + " + ".join(f"CAST(substr(a.s, {i}, 1) = substr(b.s, {i}, 1) AS INT)" for i in range(1, 15)) + ") >= 0.62 * 14 GROUP BY 1, 2) SELECT candidate, CAST(count(*) AS INT) AS n_sequences, round_even(sum(w), 3) + 0.0 AS neff, CAST(14 AS INT) AS length, FALSE AS neff_estimated FROM w GROUP BY 1"


@query(_MSA)
def neff(spark, sf_dir):
    s = F.concat("l_returnflag", "l_linestatus", F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    msa = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("candidate"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("row"), s.alias("sequence"))
    found = kernels.neff(msa.withColumn("candidate", F.col("candidate").cast("string")))
    return found.select(F.col("candidate").cast("long").alias("candidate"), "n_sequences", "neff", "length", "neff_estimated")


def _points(k: int) -> str:
    return ", ".join(f"CAST(embedding[{k + i}] AS DOUBLE) * 100 AS {c}" for i, c in enumerate("xyz"))


def _model(spark, sf_dir, k: int):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("structure"), F.col("vec_id").alias("atom"), *((F.get("embedding", F.lit(k - 1 + i)).cast("double") * 100).alias(c) for i, c in enumerate("xyz")))


def _distance(a: str, b: str) -> str:
    return f"sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2) + pow({a}.z - {b}.z, 2))"


def _lddt(left: str, right: str) -> str:
    near = " + ".join(f"CAST(diff < {t} AS INT)" for t in kernels.THRESHOLDS)
    return f"SELECT structure, atom, avg(({near}) / 4.0) AS v FROM (SELECT a.structure, a.atom, abs({_distance('a', 'b')} - {_distance('a1', 'b1')}) AS diff FROM {left} a JOIN {left} b ON a.structure = b.structure AND a.atom <> b.atom AND {_distance('a', 'b')} < 15 JOIN {right} a1 ON a1.atom = a.atom JOIN {right} b1 ON b1.atom = b.atom) GROUP BY 1, 2"


_MODELS = "WITH " + ", ".join(f"m{k} AS (SELECT CAST(label AS VARCHAR) AS structure, vec_id AS atom, {_points(k)} FROM embeddings)" for k in (1, 4, 7, 10))


@query(f"{_MODELS} SELECT structure, atom, {rd('v', 'lddt')} FROM ({_lddt('m1', 'm4')})")
def lddt_residue(spark, sf_dir):
    return kernels.lddt(_model(spark, sf_dir, 1), _model(spark, sf_dir, 4))


@query(f"{_MODELS} SELECT structure, atom, {rd('avg(v)', 'ensemble_agreement')}, CAST(3 AS BIGINT) AS n_models FROM ({_lddt('m4', 'm7')} UNION ALL {_lddt('m4', 'm10')} UNION ALL {_lddt('m7', 'm10')}) GROUP BY 1, 2")
def ensemble_agreement(spark, sf_dir):
    models = None
    for m, k in enumerate((4, 7, 10)):
        one = _model(spark, sf_dir, k).withColumn("model", F.lit(m))
        models = one if models is None else models.unionByName(one)
    return kernels.ensemble_agreement(models)


_SPHERE = "s AS (SELECT cos(t) * sqrt(1 - h * h) AS sx, sin(t) * sqrt(1 - h * h) AS sy, h AS sz, k FROM (SELECT k, 1 - (2 * k + 1) / 1000.0 AS h, k * pi() * (3 - sqrt(5)) AS t FROM (SELECT unnest(range(1000)) AS k)))"
_HIDDEN = "SELECT DISTINCT a.structure, a.atom, k FROM a JOIN a b ON a.structure = b.structure AND a.atom <> b.atom AND " + _distance("a", "b") + " < a.r + b.r JOIN s ON pow(a.x + a.r * sx - b.x, 2) + pow(a.y + a.r * sy - b.y, 2) + pow(a.z + a.r * sz - b.z, 2) < b.r * b.r"


@query(f"{_MODELS}, a AS (SELECT *, CAST(CASE atom % 4 WHEN 0 THEN 1.88 WHEN 1 THEN 1.64 WHEN 2 THEN 1.42 ELSE 1.77 END AS DOUBLE) + 1.4 AS r FROM m1), {_SPHERE}, h AS (SELECT structure, atom, count(*) AS c FROM ({_HIDDEN}) GROUP BY 1, 2) SELECT a.structure, a.atom, {rd('4 * pi() * r * r * (1000 - coalesce(c, 0)) / 1000', 'area')} FROM a LEFT JOIN h USING (structure, atom)")
def surface_area(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("CB", "N", "O", "SG"))), (F.col("atom") % 4 + 1).cast("int"))
    return kernels.accessible_area(_model(spark, sf_dir, 1).select("*", F.lit("CYS").alias("res_name"), name.alias("atom_name")))


@query()
def align_global(spark, sf_dir):
    """Whole names against whole types of the parts, as sequences of letters."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z]", "")
    pairs = table(spark, sf_dir, "part").select("p_partkey", letters("p_name").alias("ref"), letters("p_type").alias("sub"))
    return kernels.align_global(pairs, ["p_partkey"]).select("p_partkey", "score", "n_aligned")


@query("SELECT p_partkey, repeat('█', CAST(trunc(p_size / 2.0) AS INT)) AS bar FROM part")
def sparkline(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", writers.sparkline(F.col("p_size")).alias("bar"))


@query("SELECT candidate, count(*) FILTER (b > m + s) AS n_flexible, count(*) AS n FROM (SELECT CAST(l_suppkey AS VARCHAR) AS candidate, l_extendedprice AS b, avg(l_extendedprice) OVER w AS m, stddev_pop(l_extendedprice) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) GROUP BY 1")
def flexible_count(spark, sf_dir):
    rows = derive.with_zscore(residues(spark, sf_dir), "ref_bfactor", "candidate", "z")
    return rows.groupBy("candidate").agg(F.count_if(F.col("z") > 1).alias("n_flexible"), F.count("*").alias("n"))


# Residues by name


_NAMES = sorted(derive.MAX_ASA)
_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in [*_NAMES, "UNK"]) + "]"


_AREAS = "CASE name " + " ".join(f"WHEN '{n}' THEN {sql.number(a)}" for n, a in derive.MAX_ASA.items()) + " END"
_CODES = "CASE name " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in derive.ONE_LETTER.items()) + " ELSE 'X' END"


@query(f"SELECT p_partkey, name, CASE WHEN name <> 'UNK' THEN {rd(f'least(greatest(p_retailprice / 8 / {_AREAS}, 0.0), 1.5)', 'x').removesuffix(' AS x')} END AS rsa, {_CODES} AS code FROM (SELECT *, {_NAME_LIST}[p_partkey % 21 + 1] AS name FROM part)")
def residue_lookup(spark, sf_dir):
    """Every residue name, and an unknown one."""
    name = F.element_at(F.array(*(F.lit(n) for n in [*_NAMES, "UNK"])), (F.col("p_partkey") % 21 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").withColumn("name", name)
    return rows.select("p_partkey", "name", derive.relative_accessibility(F.col("p_retailprice") / 8, F.col("name")).alias("rsa"), derive.one_letter(F.col("name")).alias("code"))


@query("SELECT DISTINCT CASE WHEN p_size > 25 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS entry FROM part")
def entry_ids(spark, sf_dir):
    """The entry of a candidate, or the entry id where there is no candidate."""
    candidate = F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(derive.entry_id(candidate, F.col("p_size").cast("string")).alias("entry")).distinct().orderBy("entry")


@query("SELECT p_partkey FROM part WHERE p_size <= 25 OR p_size = 26")
def standard_monomers(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") - 25, F.lit(1)).alias("rcsb_non_std_monomer_count"))
    return specs.standard_monomers(entries).select("p_partkey")


# Evaluation of cases

_EVALUATION = """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS target, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey AS number, o_orderstatus AS name, o_totalprice AS price FROM orders),
r AS (SELECT CAST(o_custkey AS VARCHAR) AS target, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey + CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS number, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS name FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AND o_orderkey < 2000)),
m AS (SELECT o_orderkey AS predicted, o_orderkey AS mapped FROM orders WHERE NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O')),
np AS (SELECT target, count(*) AS n FROM p GROUP BY 1), nr AS (SELECT target, count(*) AS n FROM r GROUP BY 1),
j AS (SELECT coalesce(p.target, r.target) AS target, 'apo' AS condition, CAST(0 AS INT) AS model_idx, coalesce(p.place, r.place) AS place, p.number AS predicted_residue_number, r.number AS reference_residue_number, p.name AS predicted_residue_name, r.name AS reference_residue_name, p.price, mapped FROM p FULL JOIN r ON p.target = r.target AND p.place = r.place LEFT JOIN m ON m.predicted = p.number),
e AS (SELECT j.* EXCLUDE (mapped), CASE WHEN np.n IS DISTINCT FROM nr.n THEN 'count' WHEN mapped IS NULL THEN 'unmapped' WHEN mapped <> reference_residue_number THEN 'number' WHEN predicted_residue_name IS DISTINCT FROM reference_residue_name THEN 'name' END AS problem FROM j LEFT JOIN np ON np.target = j.target LEFT JOIN nr ON nr.target = j.target),
k AS (SELECT CAST(c_custkey AS VARCHAR) AS target, CAST('0.' || c_nationkey AS DOUBLE) AS tm_score, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey || '.5' AS DOUBLE) END AS rmsd, c_nationkey AS aligned_length, c_acctbal AS global_lddt FROM customer)
"""


def _case(key: str):
    return [F.col(key).cast("string").alias("target"), F.lit("apo").alias("condition"), F.lit(0).alias("model_idx")]


def _evaluated(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("place")
    predicted = o.select(*_case("o_custkey"), place, F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("name"))
    is_a = lambda priority, status: (F.col("o_orderpriority") == priority) & (F.col("o_orderstatus") == status)
    name = F.when(is_a("5-LOW", "O"), "X").otherwise(F.col("o_orderstatus"))
    rest = o.where(~(is_a("2-HIGH", "P") & (F.col("o_orderkey") < 2000)))  # some cases lack residues
    reference = rest.select(*_case("o_custkey"), place, (F.col("o_orderkey") + is_a("1-URGENT", "F").cast("int")).alias("number"), name.alias("name"))
    mapping = o.where(~is_a("3-MEDIUM", "O")).select(*_case("o_custkey"), F.col("o_orderkey").alias("predicted"), F.col("o_orderkey").alias("reference"))
    return evaluate.join_residues(predicted, reference, mapping)


def _metrics(spark, sf_dir):
    n = F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("Aligned length=  "), n, F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit(", RMSD=   "), n, F.lit(".5"))).otherwise(""), F.lit("\nTM-score= 0."), n, F.lit(" (first)\nTM-score= 0.99"))
    local = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("A."), F.col("o_orderkey").cast("string"), F.lit(".")), "o_totalprice"))).alias("local_lddt"))
    c = table(spark, sf_dir, "customer").withColumn("u", evaluate.aligner_output(text)).join(local, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(*_case("c_custkey"), "u.tm_score", "u.rmsd", "u.aligned_length", F.col("c_acctbal").alias("global_lddt"), "local_lddt")


@query(_EVALUATION + "SELECT e.* EXCLUDE (price), CASE WHEN predicted_residue_name <> 'O' THEN round(price / 1000, 7) END AS \"pLDDT\", tm_score, rmsd, global_lddt, CASE WHEN predicted_residue_name <> 'P' THEN price END AS local_lddt FROM e LEFT JOIN k ON k.target = e.target")
def evaluation_residues(spark, sf_dir):
    confidence = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(*_case("o_custkey"), F.col("o_orderkey").alias("residue"), (F.col("o_totalprice") / 1000).alias("plddt"))
    return evaluate.per_residue(_evaluated(spark, sf_dir), confidence, _metrics(spark, sf_dir))


@query(_EVALUATION + f"SELECT e.target, 'apo' AS condition, CAST(0 AS INT) AS model_idx, tm_score, rmsd, aligned_length, global_lddt, joined_fraction, joined_fraction < 0.9 AS warning FROM (SELECT target, {rd('CAST(count(*) FILTER (problem IS NULL) AS DOUBLE) / count(*)', 'joined_fraction')} FROM e GROUP BY 1) e LEFT JOIN k ON k.target = e.target")
def evaluation_cases(spark, sf_dir):
    return evaluate.per_structure(_evaluated(spark, sf_dir), _metrics(spark, sf_dir))


@query("SELECT c_custkey || '_1' AS candidate, CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 'refs/' || c_custkey || '.cif.gz' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'refs/' || c_custkey || '.bcif.gz' END AS path FROM customer")
def reference_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_mktsegment")
    kinds = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit(".bcif.gz"), F.lit(".cif.gz"))).when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit(".cif.gz"))).when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit(".bcif.gz"))).otherwise(F.array(F.lit(".txt")))
    listing = c.select("k", F.explode(kinds).alias("e")).select(F.concat(F.lit("refs/"), "k", "e").alias("path"))
    return evaluate.reference_files(c.select(F.concat("k", F.lit("_1")).alias("candidate")), listing)


@query(with_residues("SELECT candidate, count(*) AS n, count(area) AS n_annotated, max(area) AS largest FROM r LEFT JOIN (SELECT candidate, chain, res_id, max(rsa) AS area FROM r WHERE rsa IS NOT NULL GROUP BY ALL) a USING (candidate, chain, res_id) GROUP BY 1"))
def annotated_scores(spark, sf_dir):
    rows = residues(spark, sf_dir)
    notes = rows.where("rsa is not null").groupBy("candidate", "chain", "res_id").agg(F.max("rsa").alias("area"))
    rows = evaluate.with_annotations(rows.select("candidate", "chain", "res_id"), notes, ("candidate", "chain", "res_id"))
    return rows.groupBy("candidate").agg(F.count("*").alias("n"), F.count("area").alias("n_annotated"), F.max("area").alias("largest"))


# Specs


def _contrast_sql(column: str, a: str, b: str) -> str:
    gap = lambda level, m="": f"sum({m}(sc - sa)) FILTER ({column} = '{level}') / sum({m}c) FILTER ({column} = '{level}')"
    values = f"SELECT rep, {gap(a, 'm * ')} - ({gap(b, 'm * ')}) AS v FROM p JOIN ids USING (idx) JOIN b USING (candidate) GROUP BY 1"
    return f"SELECT '{column}: {a} - {b}' AS contrast, point, lo, hi, se, n_reps, lo > 0 OR hi < 0 AS excludes_zero FROM (SELECT {rd(f'{gap(a)} - ({gap(b)})', 'point')} FROM b), (SELECT {_interval('v')} FROM ({values}))"


@query(with_residues(" UNION ALL ".join(_contrast_sql(*c) for c in (("structured", "coil", "helix_or_sheet"), ("exposure", "buried", "exposed"))), bins("candidate, structured, exposure") + draws(REPS)))
def contrast_specs(spark, sf_dir):
    """Two good specs; a malformed one, an unknown column and an empty level are skipped."""
    given = ["structured:coil-helix_or_sheet", "exposure:buried-exposed", "structured", "nothing:a-b", "exposure:buried-drowned"]
    found, skipped = specs.contrasts(dataset(spark, sf_dir), given, reps=REPS)
    assert len(skipped) == 3
    return found


@query(with_residues(f"SELECT bin, c AS n, {rd('sc - sa', 'total_gap')} FROM b", bins("", "d", "chain = 'A'")))
def where_curve(spark, sf_dir):
    return cal.reliability_curve(specs.where_spec(residues(spark, sf_dir), "chain=A")).select("bin", "n", (F.col("gap") * F.col("n")).alias("total_gap"))


@query(with_residues(
    f"SELECT bin, {rd('bin * 5', 'bin_lo')}, {rd('(bin + 1) * 5', 'bin_hi')}, n, {rd('n / total', 'share')}, {rd('100 * sc / n', 'mean_plddt')}, {rd('sa / n', 'mean_lddt')}, {rd('100 * (sc - sa) / n', 'gap_pp')}, {rd('lo', 'gap_lo')}, {rd('hi', 'gap_hi')}, CASE WHEN n < 500 THEN 'sparse' ELSE '' END AS flag, printf('[%+.2f, %+.2f]', lo, hi) AS ci, CASE WHEN n >= 500 AND lo > 0 THEN 'overconfident' WHEN n >= 500 AND hi < 0 THEN 'underconfident' END AS verdict FROM (SELECT bin, CAST(sum(c) AS BIGINT) AS n, sum(sc) AS sc, sum(sa) AS sa, sum(sum(c)) OVER () AS total FROM b GROUP BY 1) JOIN (SELECT bin, 100 * quantile_cont((sc - sa) / c, 0.025) AS lo, 100 * quantile_cont((sc - sa) / c, 0.975) AS hi FROM q GROUP BY 1) USING (bin)",
    bins("candidate") + draws(REPS) + _REP_BINS,
))
def classified_curve(spark, sf_dir):
    return resample.classified_curve(residues(spark, sf_dir), REPS, min_count=500)


# Correlations between signals


def _rho(name_x: str, name_y: str, x: str, y: str) -> str:
    return f"SELECT '{name_x}' AS x, '{name_y}' AS y, {rd('corr(a, b)', 'rho')}, count(*) AS n FROM (SELECT {_RANK.format(x)} AS a, {_RANK.format(y)} AS b FROM r WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


_PAIRS = [("plddt", "ref_bfactor"), ("plddt", "rsa"), ("rsa", "lddt")]


@query(with_residues(" UNION ALL ".join(_rho(x, y, x, y) for x, y in _PAIRS)))
def signal_correlations(spark, sf_dir):
    return ranks.spearman_pairs(residues(spark, sf_dir), _PAIRS)


_AGREE = ", ag AS (SELECT candidate, chain, res_id, max(rsa) AS agreement FROM r WHERE rsa IS NOT NULL GROUP BY ALL), s AS (SELECT plddt, agreement, lddt, (" + _RANK.format("plddt") + ") / count(*) OVER () + (" + _RANK.format("agreement") + ") / count(*) OVER () AS combined, quantile_cont(lddt, 0.1) OVER () AS cut FROM r JOIN ag USING (candidate, chain, res_id))"


@query(with_residues(" UNION ALL ".join(f"SELECT '{c}' AS signal, auc, rho FROM ({_auc(f'-{c}', 'lddt <= cut', 's')}), (SELECT {rd('corr(a, b)', 'rho')} FROM (SELECT {_RANK.format(c)} AS a, {_RANK.format('lddt')} AS b FROM s))" for c in ("plddt", "agreement", "combined")), _AGREE))
def agreement_compare(spark, sf_dir):
    rows = residues(spark, sf_dir)
    agreement = rows.where("rsa is not null").groupBy("candidate", "chain", "res_id").agg(F.max("rsa").alias("agreement"))
    joined = evaluate.agreement_join(rows.select("candidate", "chain", "res_id", "plddt", "lddt"), agreement)
    return ranks.signal_comparison(joined, ["plddt", "agreement"], "lddt", 0.1)


_SCAN_P = ", px AS (SELECT candidate, 'max_identity' AS covariate, max_identity AS v, tail AS f FROM ft UNION ALL SELECT candidate, 'npc', npc, tail FROM ft UNION ALL SELECT candidate, 'neff', neff, tail FROM ft), py AS (SELECT candidate, covariate, f, rank() OVER (PARTITION BY covariate ORDER BY v) + (count(*) OVER (PARTITION BY covariate, v) - 1) / 2.0 AS rk FROM px WHERE v IS NOT NULL), pk AS (SELECT covariate, count(*) AS pn, CAST(count(*) FILTER (f) AS BIGINT) AS k, sum(rk) FILTER (f) AS own FROM py GROUP BY 1), pd AS (SELECT covariate, perm, rk, row_number() OVER (PARTITION BY covariate, perm ORDER BY " + sql.digest("0", "perm", "candidate") + f", candidate) AS place FROM py, (SELECT unnest(range({PERMS})) AS perm)), ps AS (SELECT covariate, perm, pn, k, own, sum(rk) AS s FROM pd JOIN pk USING (covariate) WHERE place <= k AND k < pn AND pn >= 5 GROUP BY ALL), pp AS (SELECT covariate, (count(*) FILTER (abs((s - k * (k + 1) / 2.0) / (k * (pn - k)) - 0.5) >= abs((own - k * (k + 1) / 2.0) / (k * (pn - k)) - 0.5) - 1e-12) + 1) / {PERMS + 1}.0 AS p FROM ps GROUP BY 1)"


@query(with_residues(f"SELECT covariate, n, {rd('auc', 'auc_tail_higher')}, {rd('abs(auc - 0.5)', 'effect')}, {rd('tm', 'tail_median')}, {rd('rm', 'rest_median')}, {rd('p', 'p_perm')}, {rd('0.05 / count(*) OVER ()', 'bonferroni')}, CASE WHEN auc > 0.5 THEN 'higher' ELSE 'lower' END AS direction, coalesce(p < 0.05 / count(*) OVER (), FALSE) AS significant FROM g LEFT JOIN pp USING (covariate)", bins("candidate") + _PER + _SCAN + _SCAN_P))
def tail_scan(spark, sf_dir):
    table_ = _tail_table(spark, sf_dir).select("candidate", "max_identity", F.col("nonpolymer_entity_count").alias("npc"), "neff", "tail")
    return ranks.significant(resample.scan_with_p(table_, "candidate", ranks.eligible(table_.drop("tail")), "tail", PERMS))


__all__ = ["ORACLES", "QUERIES", "build_dataset"]
