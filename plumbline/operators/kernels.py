"""Pair kernels: effective sequence number, lDDT, ensemble agreement, global alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions.derive import near_chain_gap, one_letter, relative_accessibility, with_zscore

#: Published definition of lDDT: inclusion radius and distance thresholds, in angstroms.
RADIUS, THRESHOLDS = 15.0, (0.5, 1.0, 2.0, 4.0)
BLOCK = 256


def _weight(seqs: list[str], length: int, seqid: float) -> float:
    """The sum over the sequences of 1 / (sequences with enough equal columns), block by block."""
    x = np.array([np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in seqs]).reshape(len(seqs), length)
    need, weight = seqid * length, 0.0
    for a in range(0, len(x), BLOCK):
        near = np.zeros(len(x[a : a + BLOCK]), np.int64)
        for b in range(0, len(x), BLOCK):
            near += ((x[a : a + BLOCK, None, :] == x[None, b : b + BLOCK, :]).sum(axis=2) >= need).sum(axis=1)
        weight += (1.0 / near).sum()
    return weight


def _lengths(msa: DataFrame) -> DataFrame:
    """msa's rows of the candidate's first length, with length and total, the number of such rows."""
    rows = msa.where("sequence <> ''").select("candidate", "row", "sequence")
    sizes = rows.groupBy("candidate", F.length("sequence").alias("length")).agg(F.count("*").alias("c"), F.min("row").alias("r"))
    first = sizes.groupBy("candidate").agg(F.min_by("length", "r").alias("length"), F.min_by("c", "r").alias("total"))
    return rows.join(first, "candidate").where(F.length("sequence") == F.col("length"))


_DEPTH = "candidate string, n_sequences int, neff double, neff_per_col double, length int, neff_estimated boolean"


def neff(msa: DataFrame, seqid: float = 0.62, max_seqs: int = 5000, seed: int = 0) -> DataFrame:
    """MSA depth by candidate from aligned sequences (columns candidate, row, sequence).

    A sequence weighs 1 / (sequences with at least seqid of its columns equal, itself among them).
    Rows of another length than the candidate's first don't count; empty ones are dropped. Of more
    than max_seqs sequences, those of smallest seeded digest are compared and the sum scaled up, as
    the definition has it (neff_exact() compares all). Digests are uniform, so a bound that twice
    max_seqs of them keep is put on them before the shuffle, and a task streams over its candidates
    with max_seqs sequences in memory.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("row").cast("string")).cast("binary"))
    rows = _lengths(msa).withColumn("digest", digest)
    share = F.lit(2.0 * max_seqs) / F.col("total")
    bound = F.lower(F.lpad(F.hex((F.lit(float(1 << 32)) * share).cast("long")), 8, "0"))
    rows = rows.where((F.col("total") <= 2 * max_seqs) | (F.substring("digest", 1, 8) < bound))
    rows = rows.repartition("candidate").sortWithinPartitions("candidate", "digest", "row").select("candidate", "sequence", "length", "total")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, int, int, list[str]]] = []

        def depth(name: str, length: int, total: int, seqs: list[str]) -> tuple:
            value = _weight(seqs, length, seqid) * total / len(seqs)
            return name, total, round(value, 3), round(value / length, 4), length, total > len(seqs)

        for pdf in batches:
            names, seqs = pdf.candidate.to_numpy(), pdf.sequence.tolist()
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, int)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(names)], strict=True):
                if not held or held[-1][0] != names[s]:
                    held.append((names[s], int(pdf.length.iloc[s]), int(pdf.total.iloc[s]), []))
                room = max_seqs - len(held[-1][3])
                held[-1][3].extend(seqs[s : min(e, s + room)])
            if len(held) > 1:
                yield pd.DataFrame([depth(*h) for h in held[:-1]], columns=_DEPTH_NAMES)
                held = held[-1:]
        if held:
            yield pd.DataFrame([depth(*h) for h in held], columns=_DEPTH_NAMES)

    return rows.mapInPandas(step, _DEPTH)


_DEPTH_NAMES = [c.split()[0] for c in _DEPTH.split(", ")]


def neff_exact(msa: DataFrame, seqid: float = 0.62, block: int = 2000) -> DataFrame:
    """neff() over all sequences, however many: blocks of about `block` of them meet in pairs.

    `row` must tell a candidate's sequences apart. A task holds two blocks; the work is quadratic in
    a candidate's sequences, as the definition is.
    """
    rows = _lengths(msa).withColumn("blocks", F.ceil(F.col("total") / F.lit(block)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("candidate", F.col("row").cast("string").alias("row"), "sequence", "length", "total", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        length, i, j = int(pdf.length.iloc[0]), int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        x = np.array([np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in pdf.sequence]).reshape(len(pdf), length)
        own = pdf.own.to_numpy()
        near = np.zeros(len(pdf), np.int64)
        for mine, theirs in ((i, j), (j, i)) if i != j else ((i, i),):
            at, to = np.flatnonzero(own == mine), np.flatnonzero(own == theirs)
            for a in range(0, len(at), BLOCK):
                for b in range(0, len(to), BLOCK):
                    near[at[a : a + BLOCK]] += ((x[at[a : a + BLOCK], None, :] == x[None, to[b : b + BLOCK], :]).sum(axis=2) >= seqid * length).sum(axis=1)
        return pd.DataFrame({"candidate": pdf.candidate, "row": pdf.row, "length": pdf.length, "total": pdf.total, "near": near})

    near = rows.groupBy("candidate", "i", "j").applyInPandas(step, "candidate string, row string, length int, total int, near long")
    near = near.groupBy("candidate", "row", "length", "total").agg(F.sum("near").alias("near"))
    value = F.sum(F.lit(1.0) / F.col("near"))
    return near.groupBy("candidate", F.col("total").alias("n_sequences"), "length").agg(F.bround(value, 3).alias("neff"), F.bround(value / F.first("length"), 4).alias("neff_per_col")).select("candidate", "n_sequences", "neff", "neff_per_col", "length", F.lit(False).alias("neff_estimated"))


def lddt(reference: DataFrame, subject: DataFrame, radius: float = RADIUS, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """structure, atom, lddt: the share of an atom's reference distances that the subject keeps.

    Both frames: structure, atom, x, y, z. For each atom, the other atoms of its structure within
    the radius in the reference count; a distance is kept at a threshold if it differs by less.
    A self join on cells of the radius' size, so only neighbouring cells meet. With a column
    `residue` in the reference, atoms of the same residue don't count and the result is by residue:
    structure, residue, lddt.
    """
    own = [c for c in ("residue",) if c in reference.columns]
    r = reference.select("structure", "atom", *own, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    both = r.join(subject.select("structure", "atom", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1")), ["structure", "atom"])
    cell = [F.floor(F.col(c) / F.lit(radius)).cast("long") for c in ("x0", "y0", "z0")]
    both = both.withColumns(dict(zip(("cx", "cy", "cz"), cell, strict=True)))
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), (F.col("cz") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    names = ("atom", *own, "x0", "y0", "z0", "x1", "y1", "z1")
    left = both.select("structure", *names, around.alias("c")).select("structure", *names, "c.*")
    right = both.select("structure", "cx", "cy", "cz", *(F.col(n).alias(f"{n}_b") for n in names))
    pairs = left.join(right, ["structure", "cx", "cy", "cz"]).where("residue <> residue_b" if own else "atom <> atom_b")
    distance = lambda k: F.sqrt(sum((F.pow(F.col(f"{c}{k}") - F.col(f"{c}{k}_b"), 2) for c in "xyz"), F.lit(0.0)))
    pairs = pairs.withColumn("d0", distance(0)).where(F.col("d0") < radius).withColumn("diff", F.abs(F.col("d0") - distance(1)))
    kept = sum(((F.col("diff") < t).cast("double") for t in thresholds), F.lit(0.0)) / len(thresholds)
    return pairs.groupBy("structure", *(own or ["atom"])).agg(F.avg(kept).alias("lddt"))


def ensemble_agreement(models: DataFrame, radius: float = RADIUS, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """structure, atom, ensemble_agreement, n_models: mean lDDT over all pairs of models.

    models: structure, model, atom, x, y, z. Structures of under 2 models, or whose models differ
    in atoms, give no rows.
    """
    shape = models.groupBy("structure", "model").agg(F.count_distinct("atom").alias("n"))
    good = shape.groupBy("structure").agg(F.count("*").alias("n_models"), F.min("n").alias("a"), F.max("n").alias("b")).where("n_models >= 2 and a = b").select("structure", "n_models")
    models = models.join(good, "structure")
    ids = models.select("structure", "model").distinct()
    pairs = ids.select("structure", F.col("model").alias("m1")).join(ids.select("structure", F.col("model").alias("m2")), "structure").where("m1 < m2")
    key_of = lambda p: F.concat_ws("|", p["structure"], p["m1"].cast("string"), p["m2"].cast("string"))
    side = lambda m: pairs.join(models, (pairs.structure == models.structure) & (pairs[m] == models.model)).select(key_of(pairs).alias("structure"), "atom", "x", "y", "z")
    scores = lddt(side("m1"), side("m2"), radius, thresholds)
    scores = scores.join(pairs.select(key_of(pairs).alias("key"), F.col("structure").alias("s")), F.col("structure") == F.col("key"))
    found = scores.groupBy(F.col("s").alias("structure"), "atom").agg(F.avg("lddt").alias("ensemble_agreement"))
    return found.join(good, "structure")


def chain_sequences(atoms: DataFrame) -> DataFrame:
    """structure, chain, place (its first atom), sequence (one-letter codes) and residues (res_id) of each
    chain. atoms: structure, atom (the order), chain, res_id, res_name."""
    residues = atoms.groupBy("structure", "chain", "res_id").agg(F.min("atom").alias("at"), F.min_by("res_name", "atom").alias("res_name"))
    rows = residues.groupBy("structure", "chain").agg(F.min("at").alias("place"), F.sort_array(F.collect_list(F.struct("at", one_letter(F.col("res_name")).alias("code"), "res_id"))).alias("rs"))
    return rows.select("structure", "chain", "place", F.array_join(F.col("rs.code"), "").alias("sequence"), F.col("rs.res_id").alias("residues"))


def best_chains(reference: DataFrame, subject: DataFrame, scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """structure, chain, sub_chain, score, ref_res, sub_res: the aligned residues of each reference chain
    with the subject chain that aligns best (of equal scores the first; a chain may serve again)."""
    r, s = chain_sequences(reference), chain_sequences(subject)
    pairs = r.select("structure", "chain", F.col("sequence").alias("ref"), F.col("residues").alias("ref_residues"))
    pairs = pairs.join(s.select("structure", F.col("chain").alias("sub_chain"), F.col("place").alias("sub_place"), F.col("sequence").alias("sub"), F.col("residues").alias("sub_residues")), "structure")
    done = align_global(pairs, ["structure", "chain", "sub_chain", "sub_place", "ref_residues", "sub_residues"], scores)
    best = done.groupBy("structure", "chain").agg(F.max_by(F.struct("sub_chain", "score", "aligned", "ref_residues", "sub_residues"), F.struct("score", -F.col("sub_place"))).alias("b"))
    best = best.select("structure", "chain", "b.sub_chain", "b.score", "b.ref_residues", "b.sub_residues", F.explode("b.aligned").alias("p"))
    return best.select("structure", "chain", "sub_chain", "score", F.get("ref_residues", F.col("p.r")).alias("ref_res"), F.get("sub_residues", F.col("p.s")).alias("sub_res"))


def match_atoms(aligned: DataFrame, reference: DataFrame, subject: DataFrame, metric: str = "ca") -> tuple[DataFrame, DataFrame]:
    """Atoms of equal name in aligned residues, and for each structure n_matched, n_ref and coverage.

    aligned: as of best_chains(); the others: structure, atom, chain, res_id, atom_name, x, y, z. metric:
    'ca' or 'all-atom'. Of repeated names in a residue the last (largest atom) counts.
    """
    if metric not in ("ca", "all-atom"):
        raise ValueError("metric must be 'ca' or 'all-atom'")
    named = (lambda d: d.where("atom_name = 'CA'")) if metric == "ca" else (lambda d: d)
    last = lambda d: named(d).groupBy("structure", "chain", "res_id", "atom_name").agg(F.max_by(F.struct("x", "y", "z"), "atom").alias("at"), F.max("atom").alias("atom"))
    r = last(reference).select("structure", "chain", F.col("res_id").alias("ref_res"), "atom_name", "atom", F.col("at").alias("ref_at"))
    s = last(subject).select("structure", F.col("chain").alias("sub_chain"), F.col("res_id").alias("sub_res"), "atom_name", F.col("at").alias("sub_at"))
    matched = aligned.join(r, ["structure", "chain", "ref_res"]).join(s, ["structure", "sub_chain", "sub_res", "atom_name"])
    total = reference.groupBy("structure").agg(F.count_distinct("chain", "res_id").alias("n_ref"))
    found = matched.groupBy("structure").agg(F.count_distinct("chain", "ref_res").alias("n_matched"))
    found = total.join(found, "structure", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return matched, found.select("structure", "n_matched", "n_ref", F.try_divide("n_matched", "n_ref").alias("coverage"))


def structure_scores(reference: DataFrame, subject: DataFrame, metric: str = "ca", scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """structure, chain, res_id, lddt and coverage of each scored residue: chains are paired and aligned,
    atoms matched, and distances within a residue don't count."""
    matched, coverage = match_atoms(best_chains(reference, subject, scores), reference, subject, metric)
    residue = F.concat_ws("|", "chain", F.col("ref_res").cast("string"))
    at = lambda side: matched.select("structure", "atom", residue.alias("residue"), f"{side}.x", f"{side}.y", f"{side}.z")
    found = lddt(at("ref_at"), at("sub_at").drop("residue"))
    ids = matched.select("structure", "chain", F.col("ref_res").alias("res_id"), residue.alias("residue")).distinct()
    return ids.join(found, ["structure", "residue"], "left").join(coverage.select("structure", "coverage"), "structure").select("structure", "chain", "res_id", "lddt", "coverage")


#: Radii of heavy atoms by their bonds and hydrogens, in angstroms (a published set), and the
#: probe's. Carbons are tetrahedral but for those named here; so are hydroxyl oxygens.
RADII = {"C": 1.88, "N": 1.64, "O": 1.42, "S": 1.77}
BARE_CARBON, RING_CARBON, HYDROXYL, PROBE = 1.61, 1.76, 1.46, 1.4
BARE = ["ARG CZ", "ASN CG", "ASP CG", "GLN CD", "GLU CD", "HIS CG", "PHE CG", "TRP CG", "TRP CD2", "TRP CE2", "TYR CG", "TYR CZ"]
RING = [
    "HIS CD2", "HIS CE1", "PHE CD1", "PHE CD2", "PHE CE1", "PHE CE2", "PHE CZ", "TRP CD1", "TRP CE3", "TRP CZ2", "TRP CZ3", "TRP CH2",
    "TYR CD1", "TYR CD2", "TYR CE1", "TYR CE2",
]
HYDROXYLS = ["SER OG", "THR OG1", "TYR OH"]


def atom_radius(res_name: Column, atom_name: Column) -> Column:
    """The atom's radius by its name; null for hydrogens and other elements."""
    key, element = F.concat_ws(" ", res_name, atom_name), F.regexp_extract(atom_name, "[A-Z]", 0)
    named = F.when((atom_name == "C") | key.isin(BARE), BARE_CARBON).when(key.isin(RING), RING_CARBON).when(key.isin(HYDROXYLS), HYDROXYL)
    for e, r in RADII.items():
        named = named.when(element == e, r)
    return named


def sphere(points: int) -> np.ndarray:
    """Points of the unit sphere along a golden spiral."""
    k = np.arange(points)
    z, turn = 1 - (2 * k + 1) / points, k * np.pi * (3 - np.sqrt(5))
    ring = np.sqrt(1 - z * z)
    return np.stack((np.cos(turn) * ring, np.sin(turn) * ring, z), axis=1)


def accessible_area(atoms: DataFrame, points: int = 1000, probe: float = PROBE) -> DataFrame:
    """structure, atom, area: the solvent accessible surface of each heavy atom, in square angstroms.

    atoms: structure, atom, res_name, atom_name, x, y, z; atoms without a radius don't count. The area is
    the share of test points, on the sphere of the atom's and the probe's radii, that lie in no other such
    sphere. Atoms meet neighbours by cells, so a structure is no single task's; what touches an atom is
    bounded by its volume.
    """
    radius = atom_radius(F.col("res_name"), F.col("atom_name")) + F.lit(probe)
    side = 2 * (max(RADII.values()) + probe)
    cell = {f"c{c}": F.floor(F.col(c) / F.lit(side)).cast("long") for c in "xyz"}
    rows = atoms.select("structure", "atom", "x", "y", "z", radius.alias("r")).where("r is not null").withColumns(cell)
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), (F.col("cz") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    own = ("structure", "atom", "x", "y", "z", "r")
    left = rows.select(*own, around.alias("c")).select(*own, "c.*")
    right = rows.select("structure", "cx", "cy", "cz", *(F.col(c).alias(f"{c}_b") for c in own[1:]))
    offset = [F.col(f"{c}_b") - F.col(c) for c in "xyz"]
    near = left.join(right, ["structure", "cx", "cy", "cz"]).where("atom <> atom_b").where(sum((o * o for o in offset), F.lit(0.0)) < F.pow(F.col("r") + F.col("r_b"), 2))
    near = near.groupBy("structure", "atom").agg(F.flatten(F.collect_list(F.array(*offset, F.col("r_b")))).alias("near"))
    at = sphere(points)

    def areas(r: pd.Series, near: pd.Series) -> pd.Series:
        found = []
        for size, flat in zip(r, near, strict=True):
            free = np.ones(points, bool)
            if flat is not None and len(flat):
                others = np.asarray(flat, float).reshape(-1, 4)
                away = ((at[:, None, :] * size - others[None, :, :3]) ** 2).sum(axis=2)
                free = (away >= others[:, 3] ** 2).all(axis=1)
            found.append(4 * np.pi * size * size * free.mean())
        return pd.Series(found, dtype=float)

    area = F.pandas_udf(areas, DoubleType())
    return rows.select("structure", "atom", "r").join(near, ["structure", "atom"], "left").select("structure", "atom", area("r", "near").alias("area"))


def residue_annotations(atoms: DataFrame, points: int = 1000) -> DataFrame:
    """structure, chain, res_id, ref_bfactor, ref_bfactor_z, rsa and near_chain_gap of each residue.

    atoms: structure, atom, chain, res_id, res_name, atom_name, x, y, z, b_factor. The score is within the
    structure; rsa is null for an unknown residue. Secondary structure isn't computed.
    """
    rows = atoms.join(accessible_area(atoms, points), ["structure", "atom"], "left")
    area = F.sum(F.coalesce("area", F.lit(0.0)))
    found = rows.groupBy("structure", "chain", "res_id").agg(F.avg("b_factor").alias("ref_bfactor"), relative_accessibility(area, F.min_by("res_name", "atom")).alias("rsa"))
    found = with_zscore(found, "ref_bfactor", "structure", "ref_bfactor_z")
    return found.select("structure", "chain", "res_id", "ref_bfactor", "ref_bfactor_z", "rsa", near_chain_gap("res_id", "structure", "chain").alias("near_chain_gap"))


#: Bytes of traces that a batch of alignments keeps.
TRACE_BYTES = 64 << 20
_LOW = -1e18


def align_batch(pairs: list[tuple[str, str]], scores: dict[tuple[str, str], float], gap_open: float = -10.0, gap_extend: float = -1.0) -> list[tuple[float, list[tuple[int, int]]]]:
    """Global alignments with affine gaps, free at the ends: the score and the aligned positions of each.

    A gap of k costs gap_open + (k - 1) * gap_extend. Of equal predecessors a match is taken, then a gap
    in the second. All pairs' cells of one anti-diagonal are computed at once.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    rows, cols, size = int(n.max()), int(m.max()), len(pairs)
    letters = sorted({c for p in pairs for s in p for c in s})
    code = {c: k for k, c in enumerate(letters)}
    table = np.array([[scores.get((x, y), -4.0) for y in letters] for x in letters]).reshape(len(letters), len(letters))
    a, b = np.zeros((size, rows + 1), int), np.zeros((size, cols + 1), int)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = [code[c] for c in x], [code[c] for c in y]
    back = np.zeros((3, size, rows + 1, cols + 1), np.int8)  # 0 match, 1 gap in the second, 2 gap in the first
    back[1, :, :, 0], back[2, :, 0, :] = 1, 2
    last, before = (np.full((3, size, rows + 1), _LOW) for _ in range(2))
    final = np.zeros((size, 3))
    cost = np.array([[gap_open, gap_extend, gap_open], [gap_open, gap_open, gap_extend]])
    for d in range(rows + cols + 1):
        now = np.full((3, size, rows + 1), _LOW)
        if d == 0:
            now[0, :, 0] = 0.0
        if 0 < d <= rows:
            now[1, :, d] = 0.0
        if 0 < d <= cols:
            now[2, :, 0] = 0.0
        i = np.arange(max(1, d - cols), min(rows, d - 1) + 1)
        if len(i):
            j = d - i
            ways = [before[:, :, i - 1] + (table[a[:, i - 1], b[:, j - 1]] if letters else 0.0)]
            for step, free, prev in ((0, j[None, :] == m[:, None], last[:, :, i - 1]), (1, i[None, :] == n[:, None], last[:, :, i])):
                ways.append(prev + np.where(free[None], 0.0, cost[step][:, None, None]))
            for state, way in enumerate(ways):
                back[state][:, i, j] = way.argmax(axis=0)
                now[state][:, i] = way.max(axis=0)
        ends = np.flatnonzero(n + m == d)
        final[ends] = now[:, ends, n[ends]].T
        last, before = now, last
    state, i, j, k = final.argmax(axis=1), n.copy(), m.copy(), np.arange(size)
    score = final[k, state]
    found: list[list[tuple[int, int]]] = [[] for _ in pairs]
    while len(k := k[(i[k] > 0) | (j[k] > 0)]):
        came = back[state[k], k, i[k], j[k]]
        for x in k[state[k] == 0].tolist():
            found[x].append((int(i[x]) - 1, int(j[x]) - 1))
        i[k] -= state[k] != 2
        j[k] -= state[k] != 1
        state[k] = came
    return [(float(v), f[::-1]) for v, f in zip(score, found, strict=True)]


def substitution_scores(text: str) -> dict[tuple[str, str], float]:
    """The scores of a substitution matrix file: comments, a line of letters, a line for each letter."""
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return {(row[0], b): float(v) for row in lines[1:] for b, v in zip(lines[0], row[1:], strict=True)}


def identity_scores(match: float = 5.0, mismatch: float = -4.0, letters: str = "ACDEFGHIKLMNPQRSTVWY") -> dict[tuple[str, str], float]:
    """The scores to use where no matrix file is given."""
    return {(a, b): match if a == b else mismatch for a in letters for b in letters}


def align_global(pairs: DataFrame, keep: list[str], scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """keep, score, n_aligned, aligned (0-based positions) for columns ref and sub, row by row.

    scores: of a standard protein matrix, read from its file by substitution_scores(); identities without
    one. A null sequence is empty.
    """
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

    scores = scores or identity_scores()
    place = StructType([StructField("r", IntegerType()), StructField("s", IntegerType())])
    schema = StructType([*(pairs.schema[k] for k in keep), StructField("score", DoubleType()), StructField("n_aligned", IntegerType()), StructField("aligned", ArrayType(place))])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given = [(r or "", s or "") for r, s in zip(pdf.ref, pdf["sub"], strict=True)]
            done: list = [None] * len(given)
            order = sorted(range(len(given)), key=lambda k: (len(given[k][0]), len(given[k][1])))
            start = 0
            while start < len(order):
                end, rows, cols = start, 0, 0
                while end < len(order):  # as many pairs as the traces have room for, one at least
                    rows, cols = max(rows, len(given[order[end]][0]) + 1), max(cols, len(given[order[end]][1]) + 1)
                    if end > start and 3 * rows * cols * (end + 1 - start) > TRACE_BYTES:
                        break
                    end += 1
                for k, found in zip(order[start:end], align_batch([given[k] for k in order[start:end]], scores), strict=True):
                    done[k] = found
                start = end
            yield pdf[keep].assign(score=[d[0] for d in done], n_aligned=[len(d[1]) for d in done], aligned=[[{"r": i, "s": j} for i, j in d[1]] for d in done])

    return pairs.mapInPandas(step, schema)
