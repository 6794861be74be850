import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import fingerprints as FP
from plumbline.llm import jaccard as J
from plumbline.llm import licenses as L
from plumbline.llm.components import connected_components
from plumbline.llm.ngram_hash import ngram_sets

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def gram_set(text, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def groups(pairs, nodes):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in nodes}


def brute(rows, n, num, den):
    sets = {i: gram_set(t, n) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    found = groups(linked, ids)
    return {i: (len(sets[i]), found[i]) for i in ids}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_equals_brute_force(spark, small, n, num, den):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    for k in range(120):  # a chain of near copies that drift apart, and short texts
        base[rng.integers(60)] = f"v{k}"
        rows.append((10_000 + k, " ".join(base) if k % 5 else " ".join(base[: k % 4])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, n, num, den).collect()}
    assert got == brute(rows, n, num, den)


def by_rows(rows, n, num, den):
    """(doc_id, size, component) of each row: all texts of a doc_id are one document."""
    sets = [gram_set(t, n) for _, t in rows]
    own = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    linked = [(a, b) for x, a in enumerate(own) for b in own[x + 1 :] if rows[a][0] == rows[b][0] or den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    found = groups(linked, range(len(rows)))
    least = {}
    for k in own:
        least[found[k]] = min(least.get(found[k], rows[k][0]), rows[k][0])
    return sorted(((i, len(sets[k]), least.get(found[k], i)) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard_by_shuffle_and_small_blocks(spark, small, monkeypatch):
    for name, value in (("BROADCAST_KEYS", 0), ("PIVOT_BLOCK", 500), ("COMMON_FIRST", 3), ("HEAVY", 2), ("PIECE", 2), ("CELL_BITS", 5)):
        monkeypatch.setattr(J, name, value)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op10_jaccard_join(spark, small).collect()}
    assert got == brute(rows, 4, 85, 100)


def repeated_ids():
    """Documents 1, 2, 3 are near copies, 4 is a copy of another text of 3; more ids repeat at random."""
    rng = np.random.default_rng(8)
    text = lambda k, swaps: " ".join(np.where(np.isin(np.arange(60), swaps), f"x{k}", [f"{k}w{i}" for i in range(60)]))
    rows = [(1, text(1, [])), (2, text(1, [59])), (3, text(1, [0])), (3, text(2, [])), (4, text(2, [])), (3, None), (3, ""), (None, text(1, [])), (7, text(3, [])), (7, text(3, []))]
    return rows + [(int(rng.integers(10, 30)), text(int(rng.integers(5, 12)), [int(rng.integers(0, 60))] if rng.integers(2) else [])) for _ in range(60)]


def test_jaccard_keeps_links_of_repeated_ids(spark):
    rows = repeated_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=str)
    assert got == by_rows(rows, 4, 85, 100) and (4, 57, 1) in got


def test_the_sql_of_the_join_says_the_same():
    import duckdb
    import pandas as pd

    rows = [(*r, k) for k, r in enumerate(repeated_ids())]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "k"]).astype({"doc_id": "Int64"})
    with duckdb.connect() as con:
        con.register("documents", documents)
        got = con.sql(J.ORACLE_SQL).fetchall()
    assert sorted(got, key=str) == by_rows(repeated_ids(), 4, 85, 100)


def test_one_of_each_group_stays(spark, awkward, nothing):
    rows = repeated_ids()
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, th int")
    got = J.one_of_each(df, 4, 85, 100)
    assert got.columns == df.columns
    sets = [gram_set(t, 4) for _, t in rows]
    own = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    found = groups([(a, b) for x, a in enumerate(own) for b in own[x + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])], own)
    kept = [r.th for r in got.collect()]
    assert sorted(k for k in range(len(rows)) if k not in found) == sorted(k for k in kept if k not in found)
    groups_of = {}
    for k, c in found.items():
        groups_of.setdefault(c, []).append(k)
    for members in groups_of.values():
        stays = [k for k in members if k in kept]
        assert len(stays) == 1 and rows[stays[0]][0] == min(rows[k][0] for k in members)
    assert J.one_of_each(awkward, 5, 80, 100).columns == awkward.columns
    assert J.one_of_each(nothing, 5, 80, 100).count() == 0


def test_a_passage_of_many_unlinked_documents_makes_few_pairs(spark, monkeypatch):
    """3000 documents share a passage and nothing else: no quadratic number of pairs is made."""
    monkeypatch.setattr(J, "COMMON", 1 << 40)  # nothing is known to be common from the start
    made = []
    across = J._across
    monkeypatch.setattr(J, "_across", lambda *a: made.append(across(*a)) or made[-1])
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(k, passage + " " + " ".join(f"d{k}w{i}" for i in range(40 + k % 60))) for k in range(3000)]
    rows += [(5000 + k, rows[k][1] + " end") for k in range(20)]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert made[0].count() < 30_000


def test_jaccard_awkward(spark, awkward, nothing):
    rows = J.jaccard_components(awkward).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == awkward.count()
    assert got[3] == (5, 0) and got[0] == (5, 0) and got[None] == (5, None)
    assert [got[i] for i in (1, 2, 4, 5)] == [(0, 1), (0, 2), (0, 4), (1, 5)]
    assert J.jaccard_components(nothing).count() == 0


def test_ngram_sets_equal_plain_sets():
    texts = ["", " ", "a", "A b", "a B c d e", "a b c d a b c d a", "É é x y\x1cz w\tq\nr", "x " * 50]
    for n in (2, 4, 5):
        sets = ngram_sets(texts, n)
        assert [len(s) for s in sets] == [len(gram_set(t, n)) for t in texts]
        assert [s.tolist() for s in sets] == [ngram_sets([t], n)[0].tolist() for t in texts]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, 1)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {i: c for i, c in groups(pairs, {x for p in pairs for x in p}).items() if i in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r.doc_id: r for r in FP.op2_scaled_sketch(spark, small).collect()}
    assert len(got) == len(rows)
    words = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))}
    wrong, by_text = [], {}
    for (doc_id, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        r, half = got[doc_id], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(r.fingerprint)
        a, b = shingles(text), shingles(edited)
        if len(a | b) > 300:
            wrong.append(abs(r.near_edited - len(a & b) / len(a | b)))
        kept = len(r.fingerprint.split(",")) / len(a)
        assert len(a) < 200 or 0.03 < kept < 0.3
    assert all(len(v) == 1 for v in by_text.values()) and np.mean(wrong) < 0.08
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for r in got.values()])


def test_fingerprints_merge_and_awkward(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(FP, "BUCKET_ROWS", 2)
    rows = FP.edited_fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    texts = sorted([(r.doc_id, r.text or "") for r in awkward.where("doc_id is not null").collect()])
    by = {(r.doc_id, r.edited_sha256) for r in rows}
    for (doc_id, text), (_, after) in zip(texts, [*texts[1:], texts[0]], strict=True):
        half = len(text) // 2
        assert (doc_id, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()) in by
    assert FP.edited_fingerprints(nothing).count() == 0
    long, part = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(long, part)], "a string, b string").select(FP.sketch(F.col("a")).alias("a"), FP.sketch(F.col("b")).alias("b"))
    r = df.select(FP.containment(F.col("b"), F.col("a")), FP.jaccard(F.col("a"), F.col("b")), F.size("a")).first()
    assert r[0] > 0.95 and r[1] < 0.2 and 350 < r[2] < 650


def test_keys_are_stored_in_a_file_a_core(spark, monkeypatch):
    """Many ranges, as on check_h; their numbers stay, so that a bucket doesn't span two of them."""
    tables, conf = [], {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(FP, "stored", lambda df, f=FP.stored: tables.append(f(df)) or tables[-1])
    df = spark.range(0, 3000).select(F.lit(True).alias("known"), F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        cut, opening, last, known = FP.buckets(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    (keys,) = tables
    assert len(keys.inputFiles()) <= spark.sparkContext.defaultParallelism
    ranges = sorted((r.a, r.b, r.n) for r in keys.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).collect())
    assert len(ranges) > 30 and all(b - a + 1 == n for a, b, n in ranges) and sum(n for *_, n in ranges) == 3000
    assert sorted(r.doc_id for r in opening.collect()) == [a for a, *_ in ranges] and (last, known) == (len(ranges), 1)
    assert cut.select("bucket").distinct().count() == last


def test_a_repeated_id_is_cut(spark, monkeypatch):
    monkeypatch.setattr(FP, "BUCKET_ROWS", 4)
    rows = [(None if k % 3 else 7, f"text {k} of the hot ids") for k in range(90)] + [(k, f"text {k}") for k in range(20)] + [(7, "equal rows")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64("text").alias("h")
    cut, _, last, known = FP.buckets(df.select(*key))
    sizes = {(r.bucket, r.known): r.n for r in cut.distinct().groupBy("bucket", "known").agg(F.count("*").alias("n")).collect()}
    assert {b for b, _ in sizes} == set(range(1, last + 1)) and max(sizes.values()) <= 4
    assert known == min(b for b, k in sizes if k) > max(b for b, k in sizes if not k)
    hashes = {t: h for t, h in df.select("text", F.xxhash64("text")).distinct().collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    after = [t for _, t in rows[1:]] + [next(t for i, t in rows if i is not None)]
    expected = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + a[: len(t) // 2]).encode()).hexdigest()) for (i, t), a in zip(rows, after, strict=True)]
    assert Counter((r.doc_id, r.edited_sha256) for r in FP.edited_fingerprints(df).collect()) == Counter(expected)
    none = FP.edited_fingerprints(df.where("doc_id is null")).collect()
    assert len(none) == 60 and all(r.doc_id is None and r.edited_sha256 and r.near_next is not None for r in none)


def plain_sketch(text, words=FP.WORDS, fraction=FP.FRACTION):
    """All shingle hashes, and those below the fraction (or the smallest), by the xxhash library."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    found = set()
    for i in range(max(1, len(hashes) - words + 1) if hashes else 0):
        seed = 42
        for h in hashes[i : i + words]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
        found.add(signed(seed))
    low = sorted(x for x in found if x < -(1 << 63) + int(fraction * (1 << 64)))
    return found, low or sorted(found)[:1]


def test_fingerprints_equal_plain_sketches(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r.text) < 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in FP.edited_fingerprints(df).collect()}
    likeness = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    shown = lambda s: ",".join(f"{x & (2**64 - 1):x}" for x in s)
    for (doc_id, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        a, b, c = (plain_sketch(t)[1] for t in (text, text[: len(text) - half] + after[:half], after))
        r = got[doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (shown(a), shown(b))
        assert (r.near_edited, r.near_next) == (pytest.approx(likeness(a, b)), pytest.approx(likeness(a, c)))
        assert r.contained_in_edited == pytest.approx(len(set(a) & set(b)) / len(a) if a else 1.0)


def test_sketches_merge(spark):
    rng = np.random.default_rng(6)
    texts = ["", "one", "a b c d e f", "a b c d e"] + [" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (5, 6, 8, 40, 400, 4000)]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    got = df.select("a", "b", FP.merge(FP.sketch(F.col("a")), FP.sketch(F.col("b"))).alias("m")).collect()
    for r in got:
        union = plain_sketch(r.a)[0] | plain_sketch(r.b)[0]
        low = sorted(x for x in union if x < -(1 << 63) + int(FP.FRACTION * (1 << 64)))
        assert r.m == (low or sorted(union)[:1])


def license_brute(rows, templates, threshold=0.8):
    norm = lambda t: re.sub(r"[^a-z0-9\n]+", " ", t.lower())
    grams = lambda t: Counter((a, b) for w in [t.split()] for a, b in zip(w, w[1:], strict=False))
    made = [grams(norm(t).replace("\n", " ")) for _, t in templates]
    found = set()
    for doc_id, text in rows:
        text = norm(text or "")
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))]
        units += [("block", i, x) for i, x in enumerate(re.split(r" ?\n[ \n]*\n ?", text)) if "\n" in x]
        for unit, i, x in units:
            g = grams(x.replace("\n", " "))
            best = max(((2 * (g & t).total() / (g.total() + t.total()), -k) for k, t in enumerate(made) if g), default=(0, 0))
            if best[0] >= threshold:
                found.add((doc_id, unit, i, templates[-best[1]][0], round(best[0], 9)))
    return found


def test_licenses_equal_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    notice = L.NOTICES["MIT"]
    rows += [(9001, "x\n" + notice.replace("any person", "every person")), (9002, "intro words here\n\n" + notice.replace(", to any", ",\nto any") + "\n\nmore"), (9003, "Released under the MIT license"), (9004, "MIT"), (9005, "released under MIT License and much else that goes on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.unit, r.unit_no, r.license, round(r.dice, 9)) for r in L.scan_licenses(df).collect()}
    assert got == license_brute(rows, L.default_templates())
    assert {9001, 9002, 9003} <= {g[0] for g in got} and not {9004, 9005} & {g[0] for g in got}


def test_licenses_awkward(spark, awkward, nothing):
    assert L.scan_licenses(awkward).count() == 0
    assert L.scan_licenses(nothing).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in L.scan_licenses(twice).collect()) == ["1", "None"]
    assert L.scan_licenses(twice, templates=[]).count() == 0


def windows_brute(rows, templates, threshold=0.8):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    made, out = [pairs(words(t)) for _, t in templates], set()
    for doc_id, text in rows:
        g, scored = pairs(words(text)), []
        for k, t in enumerate(made):
            for i in range(len(g)):
                part = g[i : i + len(t)]
                overlap = (Counter(part) & Counter(t)).total()
                if part[0] in t and 2 * overlap / (len(part) + len(t)) >= threshold:
                    scored.append((2 * overlap / (len(part) + len(t)), overlap, -k, -i, len(part)))
        kept = []
        for w in sorted(scored, reverse=True):
            if all(-w[3] > y[4] - y[3] or -y[3] > w[4] - w[3] for y in kept):
                kept.append(w)
        out |= {(doc_id, -i, -k, n, o, round(d, 9)) for d, o, k, i, n in kept}
    return out


def test_license_windows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    templates = [("X", " ".join(rng.choice(list("abc"), 12))), ("Y", "a b a b a b"), ("Z", " ".join(rng.choice(list("abcde"), 30))), ("W", "a b c")]
    rows = [(k, " ".join(rng.choice(list("abcdefgh"[: 3 + k % 6]), 80))) for k in range(40)]
    rows += [(100 + k, rows[k][1] + "\n\n" + " ".join(templates[k % 4][1].split()[k % 3 :]) + ".\n " * (k % 2) + " a c") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.scan_anywhere(df, templates).where("unit = 'window'").collect()
    want = windows_brute(rows, templates)
    assert len(want) > 60 and {(r.doc_id, r.unit_no, r.template, r.n_bigrams, r.overlap, round(r.dice, 9)) for r in got} == want


def test_license_anywhere(spark, awkward, nothing):
    notice = L.NOTICES["MIT"]
    whole = "The first part of a licence text.\n\nIts second part says other things.\n\nAnd it has a third one."
    rows = [(1, "Some text. Released under the MIT License. More text."), (2, "Copyright 2020 A. Body and many more words of a long line of text\n" + notice + "\nand then other code " * 30), (3, whole), (3, whole), (4, "Released under the MIT License. " * 3), (5, "nothing of the kind"), (None, "So: released under the MIT License. More text.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.unit, r.license) for r in L.scan_anywhere(df, [*L.default_templates(), ("whole", whole)]).collect()]
    assert (1, "window", "MIT") in got and (2, "window", "MIT") in got and (None, "window", "MIT") in got
    assert got.count((3, "text", "whole")) == 1 and got.count((4, "window", "MIT")) == 3 and 5 not in {g[0] for g in got}
    assert not {(1, "line", "MIT"), (2, "block", "MIT"), (3, "block", "whole")} & set(got)
    assert L.scan_anywhere(awkward).count() == L.scan_anywhere(nothing).count() == L.scan_anywhere(df, []).count() == 0


def test_license_headers_keep_their_names(spark):
    other = "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    rows = [("GPL-2.0", other.format("This program", ";", "General Public License", ";", "2")), ("AGPL-3.0", other.format("This program", ":", "Affero General Public License", ",", "3")), ("LGPL-2.1", other.format("This library", ";", "Lesser General Public License", ";", "2.1")), ("LGPL-3.0", other.format("This program", ":", "Lesser General Public License", ",", "3")), ("GPL-3.0", L.NOTICES["GPL-3.0"])]
    short = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows += [("BSD-2-Clause", L.NOTICES["BSD-2-Clause"]), ("BSD-3-Clause", L.NOTICES["BSD-3-Clause"]), ("none", short)]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in L.scan_licenses(df).collect()}
    assert got == {(k, name) for k, (name, _) in enumerate(rows) if name != "none"}
