"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import slices, stored, table, text_and_kept, with_kept

#: Bytes of a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bounds of the training sample: documents of all languages together (each has an equal share), windows
#: spread over each of them, and languages (the most frequent ones).
SAMPLE_DOCS, SAMPLE_WINDOWS, LANGUAGES = 4000, 3, 256
STEPS, BATCH, RATE, SEED = 700, 64, 0.02, 7
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Upper-case letters are folded, and a pad is a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:32] = 32


def windows(data: bytes) -> np.ndarray:
    """All windows of the bytes, one after the other; the last is filled with spaces."""
    n = max(1, -(-len(data) // WINDOW))
    return _FOLD[np.frombuffer(data.ljust(n * WINDOW, b" "), np.uint8)].reshape(n, WINDOW)


@dataclass
class ByteConvNet:
    """filters[k]: (width k, 256, FILTERS), the weight of each byte at each place of a filter."""

    labels: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self) -> None:
        # a filter's sum over two neighbouring bytes is looked up at once
        self.pairs = [[(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(f) - 1, 2)] for f in self.filters]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The softmax for each window."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for f, pairs in zip(self.filters, self.pairs, strict=True):
            n = WINDOW - len(f) + 1
            total = pairs[0][pair[:, :n]]
            for k, p in enumerate(pairs[1:], 1):
                total += p[pair[:, 2 * k : 2 * k + n]]
            if len(f) % 2:
                total += f[-1][x[:, len(f) - 1 : len(f) - 1 + n]]
            pooled.append(total.max(axis=1))
        return _softmax(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Label and mean probability over all windows of each text, by their bytes."""
        data = [t.encode() for t in texts]
        x = [windows(d) for d in data]
        n = np.array([len(w) for w in x])
        stacked = np.concatenate(x)
        p = np.concatenate([self.probabilities(stacked[i : i + 256]) for i in range(0, len(stacked), 256)])
        weight = np.full(len(p), float(WINDOW))
        weight[np.cumsum(n) - 1] = [max(1, len(d) - (k - 1) * WINDOW) for d, k in zip(data, n.tolist(), strict=True)]
        sums = np.add.reduceat(p * weight[:, None], np.cumsum(n) - n, axis=0)
        mean = sums / sums.sum(axis=1, keepdims=True)
        best = mean.argmax(axis=1)
        return [self.labels[b] for b in best], mean[np.arange(len(best)), best].clip(0, 1).tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy of the windows x with labels y, and its gradient by each parameter."""
    n, count = len(x), bias.size // len(filters)
    pooled, where = [], []
    for f in filters:
        size = x.shape[1] - len(f) + 1
        s = f[0][x[:, :size]]
        for k in range(1, len(f)):
            s = s + f[k][x[:, k : k + size]]
        where.append(s.argmax(axis=1))
        pooled.append(s.max(axis=1))
    h = np.concatenate(pooled, axis=1) + bias
    a = np.maximum(h, 0)
    g = _softmax(a @ out + out_bias)
    loss = float(-np.log(g[np.arange(n), y] + 1e-30).mean())
    g[np.arange(n), y] -= 1
    g /= n
    dh = (g @ out.T) * (h > 0)
    grads: list[np.ndarray] = []
    row = np.arange(n)[:, None]
    for i, f in enumerate(filters):
        gf = np.zeros_like(f)
        for k in range(len(f)):
            np.add.at(gf[k], (x[row, where[i] + k], np.arange(count)[None, :]), dh[:, i * count : (i + 1) * count])
        grads.append(gf)
    return loss, [*grads, dh.sum(axis=0), a.T @ g, g.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, labels: list[str], steps: int = STEPS) -> ByteConvNet:
    """Adam on the cross-entropy of windows x; labels are drawn evenly."""
    rng = np.random.default_rng(SEED)
    total = FILTERS * len(WIDTHS)
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(total, np.float32)
    out = rng.normal(0, 0.2, (total, len(labels))).astype(np.float32)
    out_bias = np.zeros(len(labels), np.float32)
    params = [*filters, bias, out, out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of = [np.flatnonzero(y == k) for k in range(len(labels))]
    of = [o for o in of if len(o)]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[k % len(of)]) for k in range(BATCH)])
        _, grads = gradients(filters, bias, out, out_bias, x[pick], y[pick])
        for p, q, mm, vv in zip(params, grads, m, v, strict=True):
            mm += 0.1 * (q - mm)
            vv += 0.01 * (q * q - vv)
            p -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-6)
    return ByteConvNet(labels, filters, bias, out, out_bias)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id isn't held out (and not learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _windows_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SAMPLE_WINDOWS windows spread evenly over each text (all, if it has fewer)."""
    for batch in batches:
        cut = []
        for t in batch.column("text").to_pylist():
            w = windows(t.encode())
            cut.append(w[np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int))].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("th"), pa.array(cut, pa.binary())], ["lang", "th", "cut"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteConvNet:
    """The network learned from text and lang of at most sample_docs documents.

    The labels are the languages of all documents that aren't held out and have an id, a lang and a
    letter in the text (the LANGUAGES most frequent, ties by name); of each, an equal number of distinct
    texts is drawn, those of smallest hash, with SAMPLE_WINDOWS windows of each, which the tasks cut.
    With no such document the only label is `und`.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("th"), "text")
    texts = stored(rows.select("lang", "th").distinct())
    counts = texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return ByteConvNet([UNKNOWN], [np.zeros((w, 256, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros((FILTERS * len(WIDTHS), 1), np.float32), np.zeros(1, np.float32))
    labels = sorted(r.lang for r in counts)
    each = max(1, sample_docs // len(labels))
    # hashes under a bound that some four times as many texts keep, so that no task orders all of a language
    bound = F.create_map(*(F.lit(v) for r in counts for v in (r.lang, min(1 << 32, (1 << 32) * (4 * each + 100) // r.n))))
    drawn = texts.where(F.pmod(F.xxhash64("th"), F.lit(1 << 32)) < F.try_element_at(bound, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("th"), F.lit(1 << 32)), "th"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= each).select("lang", "th")
    found = rows.join(F.broadcast(drawn), ["lang", "th"]).mapInArrow(_windows_step, "lang string, th long, cut binary")  # sample_docs rows at most
    found = sorted(found.groupBy("lang", "th").agg(F.min("cut").alias("cut")).collect(), key=lambda r: (r.lang, r.th))
    x = [np.frombuffer(r.cut, np.uint8).reshape(-1, WINDOW) for r in found]
    y = np.repeat([labels.index(r.lang) for r in found], [len(w) for w in x])
    return train(np.concatenate(x), y, labels)


def _predict_step(net: ByteConvNet):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = text_and_kept(batch)
            for i, j in slices(texts, 500_000):
                part = [t or "" for t in texts[i:j]]
                langs, scores = net.predict(part)
                blank = [not _LETTER.search(t) for t in part]
                lang = [UNKNOWN if b else x for x, b in zip(langs, blank, strict=True)]
                score = [0.0 if b else x for x, b in zip(scores, blank, strict=True)]
                yield pa.RecordBatch.from_arrays([kept.slice(i, j - i), pa.array(lang), pa.array(score)], ["kept", "lang_pred", "score"])

    return step


def identify(docs: DataFrame, net: ByteConvNet, keep: list[str]) -> DataFrame:
    """kept (a struct of the columns `keep`, so that names don't clash), lang_pred and score for each
    row of docs.

    All windows of a text count. Null text, and text without a letter, gives `und` and 0. Repeated
    rows stay; an empty table gives no rows. The network (under 2 MB, whatever the input) goes to
    the tasks with the function; nothing is shuffled.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    rows = with_kept(docs, keep)
    schema = StructType([rows.schema["kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    light = ByteConvNet.__new__(ByteConvNet)
    light.__dict__.update({k: v for k, v in net.__dict__.items() if k != "pairs"})

    def step(batches):
        light.__post_init__()
        yield from _predict_step(light)(batches)

    return rows.mapInArrow(step, schema)


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents by the network of fit(); a null doc_id isn't held out. See there for
    null, empty and repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs), ["doc_id", "held_out"])
    return told.select("kept.doc_id", "kept.held_out", "lang_pred", "score")
