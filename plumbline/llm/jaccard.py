"""N-gram Jaccard join by blocks of the sparse matrix product of documents by n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, stored, table
from plumbline.llm.components import connected_components
from plumbline.llm.ngram_hash import mix, ngram_sets

WORDS, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Characters hashed at a time, and n-grams among which a task looks for common ones.
CHARS, BLOCK = 300_000, 3_000_000
#: Documents of a block from which an n-gram counts as common; common n-grams that are known from the
#: start, and in all. They are ordered last (a choice of order only: any order gives the same links).
COMMON, COMMON_FIRST, COMMON_MOST = 3, 1 << 17, 1 << 18
#: Classes that meet in one n-gram without being of one component, from which it is made common too,
#: and how often that is tried (again a choice of order only).
HEAVY, ROUNDS = 200, 3
#: Keys up to which a side is broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1 << 18
#: Blocks of the incidence matrix: the hashes of a row of more than CELL n-grams are cut at their top
#: bits into 2 ** k cells of about CELL or fewer.
CELL_BITS = 20
#: n-grams of partners that a pivot is multiplied with in one place (or SHARE times its own, if that is
#: more), and members of an n-gram's list that meet all others in one place.
PIVOT_BLOCK, SHARE, PIECE = 1 << 16, 16, 1024


def _shingles(column, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    texts = column.to_pylist()
    for i, j in slices(texts, CHARS):
        yield i, j, ngram_sets(texts[i:j], words)


def _common_step(words: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h = np.concatenate([np.zeros(0, np.uint64), *held])
            h.sort()
            first = np.flatnonzero(np.concatenate((h[:1] == h[:1], h[1:] != h[:-1])))
            n = np.diff(np.append(first, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(h[first[n >= COMMON]].view(np.int64)), pa.array(n[n >= COMMON].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, _, sets in _shingles(batch.column(0), words):
                held += sets
                size += sum(map(len, sets))
                if size > BLOCK:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return step


def _head_step(words: int, num: int, den: int, common: np.ndarray, rank: np.ndarray):
    """Adds to all columns but the last (the text) n, two signatures, and the first
    n - ceil(n * num / den) + 1 n-grams of each set in one order of all n-grams, common ones last."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _shingles(batch.column(batch.num_columns - 1), words):
                n, sig, kept = [], [], []
                for h in sets:
                    n.append(len(h))
                    sig.append(_signature(h))
                    keep = len(h) - -(-num * len(h) // den) + 1
                    at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
                    if len(common) and (is_common := common[at] == h).any():
                        h = h[np.lexsort((h, np.where(is_common, rank[at], 0)))]
                    kept.append(h[:keep].view(np.int64) if len(h) else h.view(np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(n, pa.int64()), pa.array([s[0] for s in sig], pa.int64()), pa.array([s[1] for s in sig], pa.int64()), prefix], [*batch.schema.names[:-1], "n", "sig_a", "sig_b", "prefix"])

    return step


def _signature(h: np.ndarray) -> tuple[int, int]:
    return (int(h.sum(dtype=np.uint64).view(np.int64)), int(mix(h).sum(dtype=np.uint64).view(np.int64))) if len(h) else (0, 0)


def _cell_bits(n: int) -> int:
    """A row of n n-grams is cut into 2 to that power of cells."""
    return max(0, (n - 1).bit_length() - CELL_BITS)


def _cell_level(n: Column) -> Column:
    return F.greatest(F.lit(0), F.length(F.bin(n - 1)) - F.lit(CELL_BITS))


def _rows_step(words: int):
    """cls, copies, n and, for each cell, the row of the incidence matrix as sorted 64-bit integers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _shingles(batch.column("text"), words):
                place, n, cell, row = [], [], [], []
                for k, h in enumerate(sets, i):
                    bits = _cell_bits(len(h))
                    cuts = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                    for c, (s, e) in enumerate(zip([0, *cuts], [*cuts, len(h)], strict=True)):
                        place.append(k)
                        n.append(len(h))
                        cell.append(c)
                        row.append(h[s:e].tobytes())
                at = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("cls").take(at), batch.column("copies").take(at), pa.array(n, pa.int64()), pa.array(cell, pa.int32()), pa.array(row, pa.binary())], ["cls", "copies", "n", "cell", "row"])

    return step


def _product_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial product of a pivot's cell with the cells that follow it in the stream: a, b, sizes, overlap."""
    held, pivot = None, np.zeros(0, np.uint64)
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("a", "part", "level", "cell")]
        is_pivot = batch.column("kind").to_numpy() == 0
        row, offset = batch.column("row"), batch.column("row").offset
        ends = np.frombuffer(row.buffers()[1], np.int32)[offset : offset + len(row) + 1] // 8
        data = np.frombuffer(row.buffers()[2], np.uint64, int(ends[-1])) if ends[-1] else np.zeros(0, np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
        place, overlap = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(is_pivot)], strict=True):
            key = tuple(int(k[s]) for k in keys)
            own = int(is_pivot[s:e].sum())  # a pivot's finer cells stand in front, in order
            if key != held:
                if not own:
                    raise ValueError("rows without their pivot")
                held, pivot = key, data[ends[s] : ends[s + own]].copy()
            elif own:
                pivot = np.concatenate((pivot, data[ends[s] : ends[s + own]]))
            s += own
            if s == e:
                continue
            flat = data[ends[s] : ends[e]]
            hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat if len(pivot) else np.zeros(len(flat), bool)
            run = np.concatenate(([0], np.cumsum(hit)))
            at = ends[s : e + 1] - ends[s]
            place.append(np.arange(s, e))
            overlap.append(run[at[1:]] - run[at[:-1]])
        take = pa.array(np.concatenate([np.zeros(0, np.int64), *place]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("a", "b", "n_a", "n_b")), pa.array(np.concatenate([np.zeros(0, np.int64), *overlap]).astype(np.int64))], ["a", "b", "n_a", "n_b", "overlap"])


def of_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is among the stored distinct keys: broadcast if they are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text that tells texts of one doc_id apart, and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _text_of(texts: DataFrame, classes: DataFrame, used: DataFrame) -> DataFrame:
    """cls, copies and the text of the stored distinct classes `used`."""
    keys = stored(of_keys(classes, used, ["cls"]).select("doc_id", "th", "cls", "copies"))
    return of_keys(texts, keys, ["doc_id", "th"], "inner").select("cls", "copies", "text")


def _single(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row of each key; only classes with repeated rows (copies over 1) have more than one."""
    rest = [c for c in rows.columns if c not in (*by, "copies")]
    more = rows.where("copies > 1").groupBy(*by).agg(*(F.min(c).alias(c) for c in rest))
    return rows.where("copies = 1").select(*by, *rest).unionByName(more.select(*by, *rest))


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of the stored candidate pairs (a, n_a, b, n_b) that link.

    The product of their rows, cell by cell: a cell of a pivot a is sent once for each PIVOT_BLOCK
    n-grams of its partners, in front of their cells. Rows of neighbouring sizes may be cut unlike;
    a pair then meets in the coarser cells. The overlaps of all cells are summed, and pairs below
    the bound from their sizes go.
    """
    used = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    rows = stored(_text_of(texts, classes, used).mapInArrow(_rows_step(words), "cls long, copies long, n long, cell int, row binary"))
    rows = _single(rows, ["cls", "n", "cell"])
    weight = pairs.groupBy("a", "n_a").agg(F.sum("n_b").alias("w")).select("a", F.ceil(F.col("w") / F.greatest(F.lit(PIVOT_BLOCK), F.col("n_a") * SHARE)).cast("int").alias("parts"))
    level = F.least(_cell_level(F.col("n_a")), _cell_level(F.col("n_b")))
    pairs = pairs.join(weight, "a").select("a", "b", "n_a", "n_b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), level.alias("level"))
    cells = lambda d, side: d.join(rows.select(F.col("cls").alias(side), F.col("n").alias("n_own"), F.col("cell").alias("fine"), "row"), side).withColumn("cell", F.expr(f"shiftright(fine, greatest(0, length(bin(n_own - 1)) - {CELL_BITS}) - level)"))
    names = ["a", "part", "level", "cell", "kind", "b", "fine", "n_a", "n_b", "row"]
    zero = F.lit(0).cast("long")
    pivots = cells(pairs.select("a", "part", "level").distinct(), "a").select("a", "part", "level", "cell", F.lit(0).alias("kind"), F.col("a").alias("b"), "fine", zero.alias("n_a"), zero.alias("n_b"), "row")
    partners = cells(pairs, "b").withColumn("kind", F.lit(1)).select(*names)
    stream = pivots.unionByName(partners).repartition("a", "part").sortWithinPartitions(*names[:7])
    product = stream.drop("fine").mapInArrow(_product_step, "a long, b long, n_a long, n_b long, overlap long")
    # intersection * den >= union * num
    return product.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap")).where(F.col("overlap") * (den + num) >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _promising(heads: DataFrame, pairs: DataFrame, least: Column) -> DataFrame:
    """Those of the stored pairs (a, n_a, b, n_b) whose kept n-grams share enough for a link.

    All other common n-grams lie behind the head of a or of b, so they can't be more than the
    longer rest.
    """
    used = stored(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    heads = stored(of_keys(heads, used, ["cls"]))
    side = lambda i: heads.select(F.col("cls").alias(i), F.col("prefix").alias(f"p_{i}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    rest = F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    return pairs.where(F.size(F.array_intersect("p_a", "p_b")) >= least - rest).select("a", "n_a", "b", "n_b").distinct()


def _across(member: DataFrame, mixed: DataFrame, in_front: Column, num: int, den: int) -> DataFrame:
    """The pairs (a, n_a, b, n_b) that meet in an n-gram in front and aren't of one component.

    member: h, cls, n, at, c (component); mixed: h, size. Only sizes that a link allows meet: levels
    of the logarithm of n that are equal or neighbours. A long list meets in pieces.
    """
    step = math.log(den / num) * (1 + 1e-6) if num < den else 1e-9
    level = F.floor(F.log("n") / F.lit(step)).cast("long")
    rows = member.join(mixed.select("h", F.ceil(F.col("size") / F.lit(PIECE)).cast("int").alias("pieces")), "h").withColumn("level", level)
    side = lambda i, *more: [*(F.col(c).alias(d) for c, d in (("cls", i), ("n", f"n_{i}"), ("at", f"at_{i}"), ("c", f"c_{i}"))), *more]
    a = rows.select("h", "level", *side("a"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    a = a.select("h", "piece", "a", "n_a", "at_a", "c_a", F.explode(F.array(F.struct("level", F.lit(False).alias("up")), F.struct((F.col("level") + 1).alias("level"), F.lit(True).alias("up")))).alias("l")).select("*", "l.*").drop("l")
    b = rows.select("h", "level", *side("b"), F.pmod(F.xxhash64("cls"), F.col("pieces")).cast("int").alias("piece"))
    pairs = a.join(b, ["h", "level", "piece"]).where((F.col("up") | (F.col("a") < F.col("b"))) & (F.col("c_a") != F.col("c_b")) & in_front)
    low = F.col("a") < F.col("b")
    pick = lambda x, y, name: F.when(low, F.col(x)).otherwise(F.col(y)).alias(name)
    return pairs.select(pick("a", "b", "a"), pick("n_a", "n_b", "n_a"), pick("b", "a", "b"), pick("n_b", "n_a", "n_b")).distinct()


def linked_classes(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts (row, doc_id, th, n, two signatures, of each row of docs), classes of rows with equal
    sets (cls, the signatures, and doc_id, th, copies of their first row) and parts (node, component:
    those classes that link with another).

    1. Equal sets become classes, by two 64-bit sums over the set and its size.
    2. Sets of n and m n-grams link if they share l = ceil((n + m) * num / (num + den)) or more. In
       one order of all n-grams, rare ones first, the first n - l + 1 and m - l + 1 then have one in
       common. So each class keeps its first n-grams (a column of the incidence matrix is an n-gram
       with its classes), and a pair counts only where both places lie so far in front.
    3. In each column, all are compared with the class in which the n-gram stands foremost. These
       links make most columns, those of large groups of near copies too, one component.
    4. An n-gram in which over HEAVY classes still meet across components is common by its exact
       count: it is put behind, and the heads of those classes are made anew.
    5. Of what remains, every pair across components is compared. So no link between components is
       lost, no group's pairs are all made, and unlinked documents, whose own n-grams stand in
       front, hardly meet.

    Pairs first have their kept n-grams counted, then the whole rows multiplied, block by block.
    """
    texts = _texts(docs)
    found = texts.select("text").mapInArrow(_common_step(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.desc("n"), "h").limit(COMMON_FIRST).toPandas()
    common = dict(zip(found.h.tolist(), found.n.tolist(), strict=True))
    head = "n long, sig_a long, sig_b long, prefix array<long>"
    facts = texts.mapInArrow(_head_step(words, num, den, *_ordered(common)), f"doc_id long, th long, {head}")
    facts = stored(facts.select(F.monotonically_increasing_id().alias("row"), "*"))
    same = ["n", "sig_a", "sig_b"]
    alike = facts.where("n > 0 and doc_id is not null").groupBy(*same, "doc_id", "th").agg(F.min("row").alias("cls"), F.count("*").alias("copies"))
    classes = alike.groupBy(*same).agg(F.min(F.struct("doc_id", "cls", "th", "copies")).alias("m"))
    classes = stored(classes.select(*same, "m.doc_id", "m.cls", "m.th", "m.copies"))
    least = F.expr(f"((n_a + n_b) * {num} + {num + den - 1}) div {num + den}")
    in_front = (F.col("at_a") <= F.col("n_a") - least) & (F.col("at_b") <= F.col("n_b") - least)

    heads = facts.select(F.col("row").alias("cls"), "n", "prefix").join(classes.select("cls"), "cls", "left_semi")
    kept = heads.select("cls", "n", F.posexplode("prefix").alias("at", "h"))
    columns = kept.groupBy("h").agg(F.count("*").alias("size"), F.min_by("cls", "at").alias("a"), F.min_by("n", "at").alias("n_a"), F.min("at").alias("at_a")).where("size > 1").drop("size")
    columns = stored(kept.join(columns, "h"))
    pairs = columns.select("a", "n_a", "at_a", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")).where((F.col("a") != F.col("b")) & in_front)
    pairs = stored(pairs.select("a", "n_a", "b", "n_b").distinct())
    checked = stored(_promising(heads, pairs, least))
    parts = stored(connected_components(_verified(texts, classes, checked, words, num, den)))

    of = parts.select(F.col("node").alias("cls"), "component")
    meeting = lambda rows: rows.select("h", "cls", "n", "at").join(of, "cls", "left").withColumn("c", F.coalesce("component", "cls")).drop("component")
    shared = lambda rows: rows.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size")).where("x < y").select("h", "size")
    member = meeting(columns)
    mixed = stored(shared(member))
    for _ in range(ROUNDS):
        heavy = mixed.where(F.col("size") > HEAVY).orderBy(F.desc("size"), "h").limit(COMMON_MOST - len(common)).collect()
        heavy = [r for r in heavy if r.h not in common]
        if not heavy:
            break
        common |= {r.h: r.size for r in heavy}
        moved = stored(docs.sparkSession.createDataFrame([(r.h,) for r in heavy], "h long"))
        touched = stored(of_keys(member, moved, ["h"]).select("cls").distinct())
        anew = _text_of(texts, classes, touched).mapInArrow(_head_step(words, num, den, *_ordered(common)), f"cls long, copies long, {head}")
        anew = stored(_single(anew.select("cls", "copies", "n", "prefix"), ["cls", "n"]))
        heads = heads.join(touched, "cls", "left_anti").unionByName(anew)
        kept = heads.select("cls", "n", F.posexplode("prefix").alias("at", "h"))
        member = meeting(kept)
        mixed = stored(shared(member))
    member = stored(member.join(mixed.select("h"), "h", "left_semi"))
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(_across(member, mixed, in_front, num, den).join(done, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = _verified(texts, classes, stored(_promising(heads, rest, least)), words, num, den)
        parts = stored(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    return facts.drop("prefix"), classes, parts


def _ordered(common: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The common n-grams in order, and the count of each."""
    h = np.array(list(common), np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array(list(common.values()), np.int64)[order]


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id: components under Jaccard >= num / den of word n-gram sets.

    A set holds the distinct n-grams of a whole text (A-Z as a-z; fewer words: the whole sequence
    as one). Texts without words, null texts and rows of null doc_id link with nothing, and are
    their own component (null for null). There is a result for each row. A doc_id is one document:
    all texts under it make its links, and its rows are of one component (but for texts without
    words). Further columns, of whatever name, aren't read. An empty table gives no rows.
    """
    facts, classes, parts = linked_classes(docs, words, num, den)
    same = ["n", "sig_a", "sig_b"]
    of = parts.select(F.col("node").alias("cls"), "component")
    named = stored(classes.join(of, "cls", "left").select(*same, "doc_id", F.coalesce("component", "cls").alias("c")))
    rows = facts.select("doc_id", *same, (F.col("doc_id").isNotNull() & (F.col("n") > 0)).alias("linked"))
    repeated = stored(rows.where("linked").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    if not repeated.isEmpty():  # texts of one doc_id join their components
        owned = of_keys(rows.where("linked"), repeated, ["doc_id"]).join(named.select(*same, "c"), same).select("doc_id", "c").distinct()
        owned = stored(owned)
        first = owned.groupBy("doc_id").agg(F.min("c").alias("b"))
        joined = connected_components(owned.join(first, "doc_id").select(F.col("c").alias("a"), "b"))
        named = stored(named.join(joined.withColumnRenamed("node", "c"), "c", "left").select(*same, "doc_id", F.coalesce("component", "c").alias("c")))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "c").select(*same, "component_id", F.lit(True).alias("linked"))
    rows = rows.join(named, [*same, "linked"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The rows of docs without near copies: of each group of linked texts the first by doc_id stays.

    Links are between texts, so differing texts under one doc_id are judged apart. Of rows that
    repeat the first in doc_id and text, the least by all columns stays; of other texts with the same
    set under that doc_id, none. Rows of null doc_id or without words all stay. Columns may have any
    names; an empty table gives no rows.
    """
    facts, classes, parts = linked_classes(docs, words, num, den)
    of = parts.select(F.col("node").alias("cls"), "component")
    named = classes.join(of, "cls", "left").withColumn("c", F.coalesce("component", "cls"))
    first = stored(named.groupBy("c").agg(F.min(F.struct("doc_id", "cls", "th", "copies")).alias("m")).select(F.col("m.doc_id").alias("i"), F.col("m.th").alias("t"), "m.copies"))
    text = F.coalesce("text", F.lit(""))
    apart = F.col("doc_id").isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct(*docs.columns).alias("r"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("t"), apart.alias("apart"))
    stay = rows.where("apart").select("r.*")
    kept = of_keys(rows.where("not apart"), first.where("copies = 1"), ["i", "t"])
    stay = stay.unionByName(kept.select("r.*"))
    repeated = first.where("copies > 1")
    if not repeated.isEmpty():
        stay = stay.unionByName(of_keys(rows.where("not apart"), repeated, ["i", "t"]).groupBy("i", "t").agg(F.min("r").alias("r")).select("r.*"))
    return stay


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components() of all documents: 4-word shingles, 0.85; see there for awkward rows."""
    return jaccard_components(table(spark, sf_dir, "documents"))


#: op10_jaccard_join in DuckDB's SQL: all pairs that share a shingle, and the closure of the links. It is
#: quadratic in the documents that share one, so it is for small tables.
ORACLE_SQL = """WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, CAST(len(words) - 2 AS BIGINT)), lambda i: array_to_string(words[i : i + 3], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
n AS (SELECT rid, doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
g AS (SELECT rid, unnest(shingles) AS shingle FROM s WHERE doc_id IS NOT NULL),
o AS (SELECT a.rid AS ra, b.rid AS rb, count(*) AS overlap FROM g a JOIN g b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM o JOIN n x ON x.rid = o.ra JOIN n y ON y.rid = o.rb WHERE 100 * overlap >= 85 * (x.n_shingles + y.n_shingles - overlap)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM n WHERE n_shingles > 0 AND doc_id IS NOT NULL UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY 1)
SELECT n.doc_id, n_shingles, CASE WHEN n_shingles > 0 THEN coalesce(component, n.doc_id) ELSE n.doc_id END AS component_id FROM n LEFT JOIN c ON c.doc_id = n.doc_id"""
