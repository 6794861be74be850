"""Threshold-scaled sketches of word shingles: every hash below a fixed fraction of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, table

WORDS, FRACTION = 5, 1 / 8
_LEAST = -(1 << 63)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """The sorted distinct 64-bit hashes of the text's word shingles that lie below the fraction.

    Words are the runs between ASCII white space, in lower case; a text of fewer words than a
    shingle has one, all its words; one without words (or null) has none. A text none of whose
    hashes lies below keeps its smallest one, so only texts without words have empty sketches.
    Sketches merge, by merge(): the union's sketch is what lies below in either, or else the smaller
    smallest.
    """
    limit = F.lit(_LEAST + int(fraction * (1 << 64)))
    hashes = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def kept(h: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(h) - F.lit(words - 1), F.lit(1)))
        shingles = F.transform(places, lambda i: F.xxhash64(F.slice(h, i, words)))
        return F.when(F.size(h) > 0, shingles).otherwise(F.array().cast("array<bigint>"))

    def below(s: Column) -> Column:
        low = F.filter(s, lambda x: x < limit)
        return F.when((F.size(low) > 0) | (F.size(s) == 0), F.sort_array(F.array_distinct(low))).otherwise(F.array(F.array_min(s)))

    return _once(_once(hashes, kept), below)


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of two shingle sets, from their sketches of the same fraction."""
    limit = F.lit(_LEAST + int(fraction * (1 << 64)))

    def below(u: Column) -> Column:
        low = F.filter(u, lambda x: x < limit)
        return F.when((F.size(low) > 0) | (F.size(u) == 0), F.sort_array(low)).otherwise(F.array(F.array_min(u)))

    return _once(F.array_union(a, b), below)


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """The share of common hashes among all of both; 1 for two empty sketches."""
    union = F.size(a) + F.size(b) - shared(a, b)
    return F.when(union == 0, F.lit(1.0)).otherwise(shared(a, b) / union)


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has, however much longer b is; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(shared(a, b) / F.size(a))


def shown(s: Column) -> Column:
    """A sketch as text: its hashes as unsigned hexadecimals, joined by commas."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.hex(x))), ",")


#: Distinct rows of a bucket at least, and buckets at most.
BUCKET_ROWS, BUCKETS = 1024, 1 << 14


def buckets(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """docs (known, doc_id, h, ...) with `bucket`; the keys that open them; their number, and the first known one.

    Buckets, from 1, are ranges of the order (known, doc_id, h), so a doc_id that many rows have is cut
    too; only rows equal in all three stay together. The distinct keys alone are range-partitioned
    and sorted, and every so many'th of them, with the first known one, opens a bucket; these (BUCKETS
    of them, and two for each partition, at most) are looked up by binary search. A core stores one
    file of keys, however many ranges it gets, as each file costs several processes where Hadoop has no
    native library.
    """
    key, cores = ["known", "doc_id", "h"], docs.sparkSession.sparkContext.defaultParallelism
    keys = stored(docs.select(key).distinct().repartitionByRange(*key).withColumn("part", F.spark_partition_id()).coalesce(cores))
    step = max(BUCKET_ROWS, -(-keys.count() // BUCKETS))
    place = F.row_number().over(Window.partitionBy("part", "known").orderBy("doc_id", "h"))
    bounds = sorted(tuple(r) for r in keys.withColumn("place", place).where((F.col("place") - 1) % step == 0).select(key).collect())
    arrays = [F.split(F.lit(",".join(str(int(b[k])) for b in bounds) or "0"), ",").cast("array<bigint>") for k in range(3)]
    own = [F.col("known").cast("long"), F.col("doc_id"), F.col("h")]

    def reached(at: Column) -> Column:
        (a, b, c), (known, doc_id, h) = (F.get(x, at) for x in arrays), own
        return (a < known) | ((a == known) & ((b < doc_id) | ((b == doc_id) & (c <= h))))

    powers = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length(), -1, -1)))
    search = F.aggregate(powers, F.lit(0), lambda n, p: F.when(reached(n + p - 1), n + p).otherwise(n))
    unknown = sum(not b[0] for b in bounds)
    opening = docs.sparkSession.createDataFrame([(*b, k) for k, b in enumerate(bounds, 1)], "known boolean, doc_id long, h long, bucket int")
    return docs.withColumn("bucket", search), opening, len(bounds), unknown + 1 if unknown < len(bounds) else 1


def edited_fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Sketches of each whole text, of its edited text, and their likeness to it and to the next's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document by doc_id (of equal ids, by the text's hash; after the last: the first).
    Texts are shuffled once, to buckets of neighbouring ids; a bucket also gets the next one's first
    row. Null text is empty; rows of null doc_id come first, and aren't the first that the last is
    followed by, unless there are no others; repeated rows each have a result; an empty table gives no rows.
    """
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    docs = docs.select(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows, opening, last, known = buckets(docs)
    first = docs.join(F.broadcast(opening), ["known", "doc_id", "h"]).groupBy("bucket", "known", "doc_id", "h").agg(F.min("text").alias("text"))
    before = F.array_compact(F.array(F.when(F.col("bucket") > 1, F.col("bucket") - 1), F.when(F.col("bucket") == known, F.lit(last))))
    first = first.withColumn("bucket", F.explode(before)).withColumn("s", sketch(F.col("text"), words, fraction))
    rows = rows.withColumn("s", sketch(F.col("text"), words, fraction)).withColumn("after", F.lit(False)).unionByName(first.withColumn("after", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("after", "known", "doc_id", "h", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_s", F.lead("s").over(order)).where(~F.col("after"))
    rows = rows.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")
    both = rows.select("doc_id", "n_chars", "s", "next_s", edited.alias("edited"))
    both = both.select("doc_id", "n_chars", "s", "next_s", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("edited"), words, fraction).alias("edited_s"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("s")).alias("fingerprint"), shown(F.col("edited_s")).alias("edited_fingerprint"), jaccard(F.col("s"), F.col("edited_s")).alias("near_edited"), jaccard(F.col("s"), F.col("next_s")).alias("near_next"),
        containment(F.col("s"), F.col("edited_s")).alias("contained_in_edited"), containment(F.col("s"), F.col("next_s")).alias("contained_in_next"),
    )


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_fingerprints() of all documents; see there for awkward rows."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
