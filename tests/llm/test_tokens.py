import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import bytebpe, packing, rank_bpe, token_orc
from plumbline.llm.bytebpe import byte_bpe, default_path
from plumbline.llm.common import shared_dir

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def ids_of(text):
    return np.array([*BYTE.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_byte_bpe_equals_the_library(awkward):
    odd = ["", " ", "  ", "a ", "a\n", "\n", "\na", " a", "a\n b", "a   b", "x   y", "foo\u0085 bar", "ét́", "aβγ b", "x²y 12²", "<|endoftext|", "퟿"]
    all_texts = odd + [t for _, t in texts_of(awkward)]
    for got, t in zip(byte_bpe(default_path()).encode(all_texts), all_texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == BYTE.encode(t, add_special_tokens=False).ids


def test_token_orc(spark, awkward, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = shared_dir(spark)
    token_orc.write_tokens(docs, path)
    got = token_orc.token_starts(spark, path).orderBy("doc_id").collect()
    start = 0
    for (doc_id, text), r in zip(sorted(texts_of(docs)), got, strict=True):
        ids = ids_of(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    one = token_orc.read_tokens(spark, path, [5]).collect()
    assert [r.doc_id for r in one] == [5] and one[0].ids == np.frombuffer(ids_of(dict(texts_of(docs))[5]), "<u4").tolist()
    path = shared_dir(spark)
    token_orc.write_tokens(awkward, path)
    got = token_orc.token_starts(spark, path).collect()
    assert len(got) == awkward.count() and min(r.start for r in got) == 0
    assert sum(r.n_tokens for r in got) == sum(len(ids_of(t)) // 4 for _, t in texts_of(awkward))
    path = shared_dir(spark)
    token_orc.write_tokens(nothing, path)
    assert token_orc.token_starts(spark, path).count() == 0


def check_packing(rows, texts, capacity=1024):
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts:
        ids, at = ids_of(text), 0
        own = sorted(docs[doc_id], key=lambda r: r.piece)
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (r.length == capacity or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4 and len(own) == -(-at // capacity)
    total = sum(len(ids_of(t)) // 4 for _, t in texts)
    return len(places), -(-total // capacity)


def test_packing(spark, awkward, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    used, least = check_packing(packing.op7_pack_sum_of_squares(spark, small).collect(), texts_of(docs))
    assert used <= least + 2
    assert packing.pack(nothing).count() == 0
    distinct = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(distinct).collect(), texts_of(distinct))
    assert len({(r.sequence_id, r.offset) for r in packing.pack(awkward).collect()}) == packing.pack(awkward).count()


def test_equal_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(None, "the same text")] * 400 + [(5, "another one")] * 400, "doc_id long, text string")
    rows = packing.pack(df, chunk_rows=100).collect()
    assert Counter(r.doc_id for r in rows) == {None: 400, 5: 400}
    chunks = Counter((r.sequence_id >> 32, r.doc_id) for r in rows)
    assert len(chunks) == 16 and max(chunks.values()) < 100


def test_sum_of_squares_choice():
    """Each item goes where the sum of squares becomes smallest, by trying every open bin."""
    rng = np.random.default_rng(3)
    items = rng.integers(1, 20, 200)
    where, offset = packing.sum_of_squares(items, 20)
    gaps = {}
    for size, b, at in zip(items.tolist(), where.tolist(), offset.tolist(), strict=True):
        cost = lambda g, size=size: sum(n * n for n in np.bincount([x for x in [*(v for k, v in gaps.items() if k != g), gaps[g] - size] if x > 0], minlength=21))
        fit = [g for g, v in gaps.items() if v >= size]
        assert (b in gaps) == bool(fit)
        if fit:
            assert cost(b) == min(cost(g) for g in fit)
        gaps[b] = gaps.get(b, 20) - size
        assert at + size + gaps[b] == 20


def test_rank_bpe_equals_the_library(spark, awkward, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for df in (docs, awkward):
        got = rank_bpe.encode_decode(df).collect()
        assert len(got) == df.count()
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append((r.n_tokens, r.ids, r.decoded))
        for doc_id, text in texts_of(df):
            ids = WORD.encode(text, add_special_tokens=False).ids
            assert (len(ids), ids, WORD.decode(ids, skip_special_tokens=False)) in by[doc_id]
    assert rank_bpe.encode_decode(nothing).count() == 0
    digest = {r.doc_id: r for r in rank_bpe.op4_rank_bpe(spark, small).collect()}
    for doc_id, text in texts_of(docs)[:50]:
        ids = WORD.encode(text, add_special_tokens=False).ids
        assert digest[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digest[doc_id].decoded_sha256 == hashlib.sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_words_equal_the_library():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), n)) for n in (511, 512, 513, 700, 30_000)] + ["a" * 3000, "ab" * 700, "ééé" * 900, "thequickbrown" * 90]
    text = " ".join(words)
    bpe = rank_bpe.RankBpe(rank_bpe.default_path())
    ids = [int(x) for w in bpe.encode([text])[0] for x in bpe.cache[w][1].split()]
    assert ids == WORD.encode(text, add_special_tokens=False).ids
    bpe.encode(["short"])
    assert max(map(len, bpe.cache)) <= rank_bpe.SHORT  # long words aren't kept


def test_matrices_are_bounded(monkeypatch):
    bpe, shapes = rank_bpe.RankBpe(rank_bpe.default_path()), []
    rows = bpe._merge_rows
    monkeypatch.setattr(bpe, "_merge_rows", lambda d: shapes.append((len(d), max(map(len, d)))) or rows(d))
    letters = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    bpe.encode([" ".join([letters(i) for i in range(9000)] + ["x" * 500 + letters(i) for i in range(3000)] + ["y" * 100_000])])
    assert all(n * w <= rank_bpe.CELLS and w <= rank_bpe.SHORT for n, w in shapes) and len(shapes) > 5


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return plan.metrics().apply("numOutputRows").value()


def test_orc_skips_by_row_index_and_bloom_filter(spark):
    path = shared_dir(spark)
    docs = spark.createDataFrame([(2 * i, f"text {i}") for i in range(20_000)], "doc_id long, text string")
    token_orc.write_tokens(docs, path)
    assert rows_read(token_orc.read_tokens(spark, path)) == 20_000
    one = token_orc.read_tokens(spark, path, [10_000])
    assert [r.doc_id for r in one.collect()] == [10_000] and rows_read(one) <= 2000  # by the row index
    assert rows_read(token_orc.read_tokens(spark, path, [10_001])) == 0  # within the bounds: by the Bloom filter


def test_starts_follow_the_files_order_in_equal_ids(spark):
    path = shared_dir(spark)
    texts = ["z", "a b c d", "m m", "a b c d", ""]
    token_orc.write_tokens(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string"), path)
    stored = spark.read.schema(token_orc.STORED).orc(path).orderBy("place").collect()
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_orc.token_starts(spark, path).collect())
    start = 0
    for r, (at, n, crc), text in zip(stored, got, sorted(texts), strict=True):
        assert (at, n, crc) == (start, r.n_tokens, zlib.crc32(ids_of(text)))
        start += n


def test_scratch_needs_a_shared_folder_off_the_driver(spark, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(context, "_plumbline_scratch", None, raising=False)
    monkeypatch.setattr(context, "master", "spark://host:7077")
    monkeypatch.setattr(context, "getConf", dict)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)


def test_few_kept_units_give_the_same_ids():
    """A worker's encoder keeps no more units than it was told to; the pipeline's keeps less than packing alone."""
    texts = [" ".join(f"word{i * j} and\nLine{j}, x{i}" for j in range(40)) for i in range(30)]
    few, many = bytebpe.ByteBpe(bytebpe.default_path(), 25), bytebpe.ByteBpe(bytebpe.default_path())
    for text in texts:
        assert few.encode([text]) == many.encode([text])
        assert len(few.units) <= 25
    assert len(many.units) > 500
    assert corpus_pipeline.PACKING_CACHE < bytebpe.CACHE / 4


def test_units_are_kept_without_the_signs_after_them():
    """A word's ids are found once, whatever sign follows it; texts are cut on bytes, odd ones not at all."""
    bpe = bytebpe.ByteBpe(bytebpe.default_path())
    texts = [f"Alpha{s} bé{s}\nGamma{s}" for s in ",.;!?"]
    parts = ["a", "Bc", "é", "ñ", "×", "Ł", " ", "\n", "  ", "\n ", "\t", "'s", "<|endoftext|>", "<|", "1", ".", "$$", "日本", "\u0301", "\xa0", "\x1c", "Ġ", "\r", "\0", "ª"]
    odd = ["".join(t) for n in (1, 2, 3) for t in itertools.product(parts, repeat=n)]
    assert bpe.encode(texts) == [np.array(BYTE.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert set(bpe.units) == {b"Alpha", " bé".encode(), b"\n", b"Gamma", b",", b".", b";", b"!", b"?"}
    for got, t in zip(bpe.encode(["", *odd]), ["", *odd], strict=True):
        assert got == np.array(BYTE.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
