"""Toxicity by a classifier chain of linear models."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import slices, stored, table, text_and_kept, with_kept

#: Bounds of the training sample: documents of each class of the last category, and features that
#: the driver is told of (those whose means in the classes differ most).
SAMPLE, VOCABULARY = 2000, 20_000
#: Features each category's model may use, and documents a feature must be in. With 150 of them the
#: recall on unseen labels is 0.958 and the false alarms 0.6 %, with 3000 0.840 and 0.7 % (sf0.1).
FEATURES, LEAST_DOCS, SHARE = 150, 4, 40
FOLDS, STEPS, RATE, DECAY = 5, 200, 0.08, 1e-4
THRESHOLD = 0.5
#: The chain's categories in order, each a condition on the label table.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Words whose features a Python worker keeps; beyond, it starts anew.
CACHE = 300_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def word_features(word: str) -> tuple[str, ...]:
    """The word and its beginnings of four to six letters, which stand for its stem."""
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n))


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(own: set[str], of: Callable[[str], Iterable[str]] = word_features) -> dict[str, float]:
    """The value of each feature of a text with the distinct words `own`.

    A word counts 1. A beginning, which chance brings into long texts, counts by its share of the
    words: 1 if one word in SHARE has it.
    """
    counts: dict[str, int] = {}
    for w in own:
        for f in of(w):
            counts[f] = counts.get(f, 0) + 1
    return {f: min(1.0, n * SHARE / len(own)) if f[-1] == "*" else 1.0 for f, n in counts.items()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """A logistic model on the features' values and on earlier probabilities."""

    weights: dict[str, float]
    chain: np.ndarray
    bias: float

    def scores(self, rows: list[dict[str, float]], earlier: np.ndarray) -> np.ndarray:
        get = self.weights.get
        return _sigmoid(np.array([sum(get(f, 0.0) * v for f, v in r.items()) for r in rows]) + earlier @ self.chain + self.bias)


@dataclass
class Incidence:
    """Documents by features, as parallel arrays of the places that are set and their values."""

    names: list[str]
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    rows: int

    def only(self, keep: np.ndarray) -> Incidence:
        """The documents `keep` (a mask), numbered anew."""
        at = keep[self.row]
        return Incidence(self.names, (np.cumsum(keep) - 1)[self.row[at]], self.col[at], self.value[at], int(keep.sum()))


def incidence(texts: list[str]) -> Incidence:
    """The features that at least LEAST_DOCS of the texts have."""
    counts: dict[str, int] = {}
    for t in texts:
        for f in {f for w in words(t) for f in word_features(w)}:
            counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= LEAST_DOCS)
    index = {f: i for i, f in enumerate(names)}
    return assemble(names, [_row(t, index) for t in texts])


def _row(text: str, index: dict[str, int]) -> tuple[list[int], list[float]]:
    """The known features of a text, and their values."""
    found = sorted((index[f], v) for f, v in features(words(text)).items() if f in index)
    return [c for c, _ in found], [v for _, v in found]


def assemble(names: list[str], rows: list[tuple[list[int], list[float]]]) -> Incidence:
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *(np.array(p, dtype=kind) for p in parts)])
    at = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows]) if rows else np.zeros(0, np.int64)
    return Incidence(names, at, join([c for c, _ in rows], np.int64), join([v for _, v in rows], np.float32), len(rows))


def fold_of(text: str) -> int:
    """Equal texts are in one fold."""
    return zlib.crc32(text.encode()) % FOLDS


def fit_linear(x: Incidence, earlier: np.ndarray, y: np.ndarray) -> tuple[Linear, np.ndarray]:
    """The model and its weight for each name of x.

    Features are chosen by the z value of their means in the two classes; classes weigh alike.
    """
    pos, neg = int(y.sum()), int((1 - y).sum())
    full = np.zeros(len(x.names))
    if not pos or not neg:
        return Linear({}, np.zeros(earlier.shape[1]), 30.0 if pos else -30.0), full
    in_pos = np.bincount(x.col, y[x.row] * x.value, len(full))
    in_all = np.bincount(x.col, x.value, len(full))
    variance = np.maximum(np.bincount(x.col, x.value.astype(float) ** 2, len(full)) / len(y) - (in_all / len(y)) ** 2, 0)
    z = np.abs(in_pos / pos - (in_all - in_pos) / neg) / np.sqrt(variance * (1 / pos + 1 / neg) + 1e-12)
    keep = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    place = np.full(len(full), -1)
    place[keep] = np.arange(len(keep))
    used = place[x.col] >= 0
    row, col, value = x.row[used], place[x.col[used]], x.value[used]
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    w, chain, bias = np.zeros(len(keep)), np.zeros(earlier.shape[1]), 0.0
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, chain, np.zeros(1))]
    for step in range(1, STEPS + 1):
        p = _sigmoid(np.bincount(row, w[col] * value, len(y)) + earlier @ chain + bias)
        e = (p - y) * weight
        grads = (np.bincount(col, e[row] * value, len(w)) + DECAY * w / len(keep), earlier.T @ e, np.array([e.sum()]))
        moves = []
        for g, (m, v) in zip(grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            moves.append(RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        w, chain, bias = w - moves[0], chain - moves[1], bias - float(moves[2][0])
    full[keep] = w
    return Linear({x.names[k]: float(v) for k, v in zip(keep, w, strict=True) if v}, chain, bias), full


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]

    def scores(self, rows: list[dict[str, float]]) -> np.ndarray:
        """A column of probabilities for each category, each model seeing the earlier columns."""
        found = np.zeros((len(rows), 0))
        for m in self.models:
            found = np.concatenate((found, m.scores(rows, found)[:, None]), axis=1)
        return found


def fit_chain(texts: list[str], labels: np.ndarray, names: list[str]) -> Chain:
    """train() on plain texts."""
    return train(incidence(texts), np.array([fold_of(t) for t in texts], np.int64), labels, names)


def train(x: Incidence, fold: np.ndarray, labels: np.ndarray, names: list[str]) -> Chain:
    """Trains the models in turn. In training, an earlier category's probability of a document
    comes from a model that hasn't seen its fold; the model kept has seen all."""
    earlier, models = np.zeros((x.rows, 0)), []
    for k in range(len(names)):
        y = labels[:, k].astype(np.int64)
        models.append(fit_linear(x, earlier, y)[0])
        if k + 1 < len(names):
            p = np.zeros(x.rows)
            for f in range(FOLDS):
                own, rest = x.only(fold == f), fold != f
                model, weights = fit_linear(x.only(rest), earlier[rest], y[rest])
                p[fold == f] = _sigmoid(np.bincount(own.row, weights[own.col] * own.value, own.rows) + earlier[fold == f] @ model.chain + model.bias)
            earlier = np.concatenate((earlier, p[:, None]), axis=1)
    return Chain(names, models)


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, th (a hash of the text), a flag for each category, text: the training documents, stored."""
    flags = [f"f{k}" for k in range(len(CATEGORIES))]
    known = labels.groupBy("doc_id").agg(*(F.max(F.coalesce(F.expr(e), F.lit(False)).cast("int")).alias(f) for f, (_, e) in zip(flags, CATEGORIES, strict=True)))
    first = lambda d, *more: [d.where(F.col(flags[-1]) == v).orderBy(F.xxhash64("doc_id"), "doc_id", *more).limit(sample) for v in (1, 0)]
    both = lambda parts: F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample rows at most
    rows = docs.where("text is not null").select("doc_id", "text").join(both(first(known)), "doc_id").withColumn("th", F.xxhash64("text"))
    keys = stored(rows.select("doc_id", "th", *flags).distinct())
    rows = rows.join(both(first(keys, "th")).select("doc_id", "th"), ["doc_id", "th"], "left_semi")
    return stored(rows.groupBy("doc_id", "th").agg(*(F.max(f).alias(f) for f in flags), F.min("text").alias("text")))


def _count_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, documents that have it, sums of its values and their squares, and of the values in
    the documents of each category."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        flags = list(zip(*(batch.column(f"f{k}").to_pylist() for k in range(len(CATEGORIES))), strict=True))
        for i, j in slices(texts):
            sums: dict[str, list[float]] = {}
            for t, own in zip(texts[i:j], flags[i:j], strict=True):
                for f, v in features(words(t)).items():
                    total = sums.setdefault(f, [0.0] * (3 + len(own)))
                    for k, x in enumerate((1.0, v, v * v, *(v * y for y in own))):
                        total[k] += x
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([x[k] for x in sums.values()], pa.float64()) for k in range(3 + len(CATEGORIES)))], ["feature", "n", "s", "q", *(f"p{k}" for k in range(len(CATEGORIES)))])


def _vocabulary(rows: DataFrame, total: int, positive: list[int]) -> list[str]:
    """The features of at least LEAST_DOCS documents; of more than VOCABULARY, those of largest z value."""
    sums = [f"p{k}" for k in range(len(CATEGORIES))]
    counts = rows.mapInArrow(_count_step, "feature string, " + ", ".join(f"{c} double" for c in ("n", "s", "q", *sums)))
    counts = counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q", *sums))).where(F.col("n") >= LEAST_DOCS)
    variance = F.greatest(F.col("q") / total - F.pow(F.col("s") / total, 2), F.lit(0.0))
    z = [F.abs(F.col(c) / y - (F.col("s") - F.col(c)) / (total - y)) / F.sqrt(variance * (1 / y + 1 / (total - y)) + 1e-12) for c, y in zip(sums, positive, strict=True) if 0 < y < total]
    found = counts.orderBy(F.desc(F.round(F.greatest(*z, F.lit(0.0), F.lit(0.0)), 9)), "feature").limit(VOCABULARY).select("feature").collect()
    return sorted(r[0] for r in found)


def _rows_step(names: list[str]):
    """doc_id, th, the flags, the fold, and the known features' places and values."""
    head = ["doc_id", "th", *(f"f{k}" for k in range(len(CATEGORIES)))]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {f: i for i, f in enumerate(names)}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [_row(t, index) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in head), pa.array([fold_of(t) for t in texts], pa.int32()), pa.array([c for c, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float64()))], [*head, "fold", "cols", "vals"])

    return step


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain learned from at most `sample` labelled documents of each toxicity class.

    The sample is those of smallest hashed id. A document has a category if one of its labels says
    so; labels that are null don't. Labels of unknown documents and documents of null text don't
    count, repeated rows count once, and texts of one doc_id count each; without labels every
    probability is 0. Features are counted in the tasks; the driver gets the sample's values of at
    most VOCABULARY features.
    """
    rows = _sample(docs, labels, sample)
    total, *positive = rows.agg(F.count("*"), *(F.coalesce(F.sum(f"f{k}"), F.lit(0)) for k in range(len(CATEGORIES)))).first()
    names = _vocabulary(rows, total, positive) if total else []
    kind = "doc_id long, th long, " + ", ".join(f"f{k} int" for k in range(len(CATEGORIES))) + ", fold int, cols array<int>, vals array<double>"
    found = sorted(rows.select(F.col("doc_id").cast("long").alias("doc_id"), *rows.columns[1:]).mapInArrow(_rows_step(names), kind).collect(), key=lambda r: (r.doc_id, r.th))
    y = np.array([r[2 : 2 + len(CATEGORIES)] for r in found]).reshape(-1, len(CATEGORIES))
    return train(assemble(names, [(r.cols, r.vals) for r in found]), np.array([r.fold for r in found], np.int64), y, [n for n, _ in CATEGORIES])


def _score_step(chain: Chain):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set().union(*(m.weights for m in chain.models))
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            texts, kept = text_and_kept(batch)
            for i, j in slices(texts, 500_000):
                if len(cache) > CACHE:
                    cache.clear()
                rows = []
                for t in texts[i:j]:
                    own = words(t or "")
                    for w in own.difference(cache):
                        cache[w] = tuple(known.intersection(word_features(w)))
                    rows.append(features(own, cache.__getitem__))
                p = chain.scores(rows)
                yield pa.RecordBatch.from_arrays([kept.slice(i, j - i), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["kept", *(f"p_{n}" for n in chain.names)])

    return step


def score(docs: DataFrame, chain: Chain, keep: list[str]) -> DataFrame:
    """kept (a struct of the columns `keep` of docs, so that names don't clash) and p_<category> for
    each category of the chain.

    All words of a text count. Null text is empty and scored as such; repeated rows stay; an empty
    table gives no rows. The models (at most FEATURES weights for each category) go to the tasks
    with the function; nothing is shuffled.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = with_kept(docs, keep)
    schema = StructType([rows.schema["kept"], *(StructField(f"p_{n}", DoubleType()) for n in chain.names)])
    return rows.mapInArrow(_score_step(chain), schema)


def toxic_ids(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and `toxic` (p_toxic at the threshold or above) of each row."""
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("kept.doc_id", *scored.columns[1:], (F.col("p_toxic") >= F.lit(threshold)).alias("toxic"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxic_ids() of all documents; null text is scored as empty, null and repeated ids stay, and an
    empty table gives no rows (see fit() and score())."""
    return toxic_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
