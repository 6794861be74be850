"""The same logical tables in the oracle's SQL."""

from __future__ import annotations

from plumbline.functions.derive import edges

#: Digits of compared doubles; shares of a few hundred residues don't end in a 5 right after them.
DIGITS = 7

#: Common table expressions; `r` is residues(), `d` dataset().
RESIDUES = """r AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS candidate, l_returnflag AS chain, l_orderkey AS res_id, 50 + l_quantity AS plddt, 1 - 5 * l_tax AS lddt, l_extendedprice AS ref_bfactor,
    nullif(l_discount, CAST('0.05' AS DOUBLE)) * 10 AS rsa, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' ELSE 'c' END AS sse
  FROM lineitem)"""
TARGETS = """, t0 AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS candidate, nullif(s_nationkey % 4, 3) AS npc, s_acctbal AS max_identity FROM supplier),
t1 AS (SELECT candidate, count(*) AS neff FROM r GROUP BY 1),
t2 AS (SELECT t1.candidate, neff, npc, max_identity FROM t1 LEFT JOIN t0 ON t0.candidate = t1.candidate),
t AS (SELECT *, row_number() OVER (ORDER BY max_identity, candidate) - 1 AS ri, row_number() OVER (ORDER BY neff, candidate) - 1 AS rn, count(*) OVER () AS nt FROM t2),
z AS (SELECT *, CASE WHEN stddev_pop(ref_bfactor) OVER w > 0 THEN (ref_bfactor - avg(ref_bfactor) OVER w) / stddev_pop(ref_bfactor) OVER w ELSE 0 END AS ref_bfactor_z FROM r WINDOW w AS (PARTITION BY candidate)),
d AS (SELECT z.*, npc, max_identity, neff, CASE WHEN coalesce(npc, 0) > 0 THEN 'holo' ELSE 'apo' END AS ligand_state,
  CASE WHEN ref_bfactor_z >= 1.0 THEN 'flexible' WHEN ref_bfactor_z <= -0.5 THEN 'rigid' ELSE 'intermediate' END AS flexibility,
  CASE WHEN sse IN ('a', 'b') THEN 'helix_or_sheet' WHEN sse = 'c' THEN 'coil' END AS structured,
  CASE WHEN rsa IS NULL THEN NULL WHEN rsa >= 0.5 THEN 'exposed' WHEN rsa <= 0.2 THEN 'buried' ELSE 'partial' END AS exposure,
  CASE WHEN 3 * ri < nt - 1 THEN 'low' WHEN 3 * ri < 2 * (nt - 1) THEN 'mid' ELSE 'high' END AS novelty_bin,
  CASE WHEN 3 * rn < nt - 1 THEN 'low' WHEN 3 * rn < 2 * (nt - 1) THEN 'mid' ELSE 'high' END AS msa_depth_bin,
  least(greatest(plddt / 100.0, 0.0), 1.0) AS conf
  FROM z JOIN t ON t.candidate = z.candidate)"""


def number(x: float) -> str:
    """A double literal (a bare one would be a decimal)."""
    return f"CAST('{x!r}' AS DOUBLE)"


def bin_of(conf: str = "conf", n_bins: int = 20) -> str:
    return "(" + " + ".join(f"CAST({conf} >= {number(e)} AS INT)" for e in edges(n_bins)[1:-1]) + ")"


def with_residues(body: str, more: str = "") -> str:
    return f"WITH {RESIDUES}{TARGETS}{more} {body}"


def rd(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 AS {name}"


def bins(by: str = "", source: str = "d", where: str = "TRUE") -> str:
    """The table b of bin statistics."""
    keys = f"{by}, " if by else ""
    return f", b AS (SELECT {keys}{bin_of()} AS bin, count(*) AS c, sum(conf) AS sc, sum(lddt) AS sa, sum(plddt) AS sp FROM {source} WHERE {where} GROUP BY ALL)"


METRICS = ", ".join((
    "CAST(sum(c) AS BIGINT) AS n", rd("sum(abs(sc - sa)) / sum(c)", "ece"), rd("max(abs(sc - sa) / c)", "mce"), rd("(sum(sc) - sum(sa)) / sum(c)", "overconfidence"), rd("sum(sp) / sum(c)", "mean_plddt"), rd("sum(sa) / sum(c)", "mean_lddt"),
))


def digest(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || chr(58) || '.join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 8) AS BIGINT)"


def draws(reps: int, seed: int = 0) -> str:
    """ids (candidate, idx) and the table p of draws (rep, idx, m)."""
    return f""", ids AS (SELECT candidate, row_number() OVER (ORDER BY candidate) - 1 AS idx FROM (SELECT DISTINCT candidate FROM d)),
nn AS (SELECT count(*) AS n FROM ids),
p AS (SELECT rep, {digest(str(seed), 'rep', 'draw')} % n AS idx, count(*) AS m FROM nn, (SELECT unnest(range({reps})) AS rep) a, (SELECT idx AS draw FROM ids) b GROUP BY ALL)"""
