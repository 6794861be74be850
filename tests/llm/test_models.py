import zlib

import numpy as np
import pytest

from plumbline.llm import langid, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    rows = langid.op9_byte_cnn(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert 120 < len(held) < 280 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward(spark, awkward, nothing):
    net = langid.fit(awkward)
    got = {r.kept.doc_id: r for r in langid.identify(awkward, net, ["doc_id", "part", "score", "lang_pred"]).collect()}
    assert {got[i].lang_pred for i in (1, 2, 4)} == {"und"} and got[1].score == 0
    assert got[0].lang_pred in {"en", "fr", "de", "es"}
    assert langid.identify(awkward, net, ["doc_id"]).count() == awkward.count()
    flags = {r.doc_id: r.h for r in awkward.select("doc_id", langid.held_out().alias("h")).collect()}
    assert flags == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in flags}
    empty = langid.fit(nothing)
    assert empty.labels == ["und"] and langid.identify(nothing, empty, ["doc_id"]).count() == 0


def test_pair_tables_equal_plain_convolution():
    rng = np.random.default_rng(0)
    f = [rng.normal(size=(w, 256, 5)).astype(np.float32) for w in langid.WIDTHS]
    net = langid.ByteConvNet(["a", "b"], f, np.zeros(15, np.float32), rng.normal(size=(15, 2)).astype(np.float32), np.zeros(2, np.float32))
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    pooled = np.concatenate([np.max([sum(g[k][x[:, i + k]] for k in range(len(g))) for i in range(langid.WINDOW - len(g) + 1)], axis=0) for g in f], axis=1)
    z = np.maximum(pooled, 0) @ net.out
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert net.probabilities(x) == pytest.approx(want, abs=1e-4)


def test_toxic_accuracy_on_unseen(spark):
    """Fitted on labels of ids that aren't divisible by 4, judged on the others."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.score(docs, chain, ["doc_id"]).select("kept.doc_id", "p_toxic").join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    toxic = [r.p_toxic >= 0.5 for r in rows if r.toxic]
    clean = [r.p_toxic >= 0.5 for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.03


def test_chain_feeds_forward():
    """A category that only the earlier one's probability tells is learned through the chain."""
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, 400)
    texts = [("bad" if x else "good") + f" w{rng.integers(50)}" for x in a]
    chain = toxicity.fit_chain(texts, np.stack([a, a], axis=1), ["first", "second"])
    assert chain.models[0].chain.shape == (0,) and chain.models[1].chain.shape == (1,) and chain.models[1].chain[0] > 0
    p = chain.scores([{"bad": 1.0}, {"good": 1.0}])
    assert p[0, 1] > 0.5 > p[1, 1]


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1, 1), (3, 1, 0), (3, 1, 0), (5, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(awkward, labels)
    got = toxicity.score(awkward, chain, ["doc_id", "label", "p_toxic", "text"]).collect()
    assert len(got) == awkward.count() and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.toxic_ids(nothing, labels.limit(0)).count() == 0
    none = toxicity.toxic_ids(awkward, labels.limit(0)).collect()
    assert not any(r.toxic for r in none)


def test_links_are_learned_out_of_fold():
    """The first category is noise that a model only knows of documents it has seen. With in-sample
    probabilities the second model would lean on them."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 200)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 150, 25)) + f" id{i}" for i in range(200)]
    chain = toxicity.fit_chain(texts, np.stack([y, y], axis=1), ["first", "second"])
    x = toxicity.incidence(texts)
    model, weights = toxicity.fit_linear(x, np.zeros((200, 0)), y)
    seen = 1 / (1 + np.exp(-(np.bincount(x.row, weights[x.col] * x.value, 200) + model.bias)))
    assert np.mean((seen > 0.5) == (y == 1)) > 0.9
    leaning, _ = toxicity.fit_linear(x, seen[:, None], y)
    assert leaning.chain[0] > 2 and chain.models[1].chain[0] < leaning.chain[0] / 2


def test_copies_are_in_one_fold_and_fit_equals_plain_fit(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.01', '0.001')}/documents.parquet")
    labels = spark.read.parquet(f"{DATA.replace('0.01', '0.001')}/labels.parquet")
    assert toxicity.fold_of("a b") == toxicity.fold_of("a b")
    found = sorted((r.doc_id, r.text, int(r.quality == 0), int(r.toxic == 1)) for r in docs.join(labels, "doc_id").collect())
    plain = toxicity.fit_chain([r[1] for r in found], np.array([r[2:] for r in found]), ["low_quality", "toxic"])
    own = toxicity.fit(docs, labels)
    for a, b in zip(own.models, plain.models, strict=True):
        assert a.weights.keys() == b.weights.keys() and a.bias == pytest.approx(b.bias, abs=1e-6)
        assert all(a.weights[k] == pytest.approx(b.weights[k], abs=1e-6) for k in a.weights)


def test_scores_equal_a_plain_chain():
    rng = np.random.default_rng(1)
    models = [toxicity.Linear({f"f{k}": float(rng.normal()) for k in range(6)}, rng.normal(size=i), float(rng.normal())) for i in range(3)]
    rows = [{f"f{k}": float(rng.random()) for k in rng.integers(0, 9, 4)} for _ in range(20)]
    got = toxicity.Chain(["a", "b", "c"], models).scores(rows)
    for r, found in zip(rows, got, strict=True):
        told = []
        for m in models:
            z = m.bias + sum(m.weights.get(f, 0) * v for f, v in r.items()) + sum(w * p for w, p in zip(m.chain, told, strict=True))
            told.append(1 / (1 + np.exp(-z)))
        assert found == pytest.approx(told)


def test_vocabulary_is_bounded_by_class_difference(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VOCABULARY", 3)
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "") + " ".join(f"w{k}" for k in range(10))) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    assert "bad" in chain.models[1].weights and len(chain.models[1].weights) <= 3


def test_rare_languages_are_learned(spark):
    """One document in 5000 is of the rare language: it is among the labels, and told."""
    words = {"aa": ["kala", "mura", "tipo", "sanu"], "bb": ["wexx", "yzzq", "qwvv", "zxxw"]}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words["bb" if i % 5000 == 7 else "aa"], 30)) + f" {i}", "bb" if i % 5000 == 7 else "aa") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, 200)
    assert net.labels == ["aa", "bb"]
    told, _ = net.predict([" ".join(rng.choice(words[k], 30)) for k in ("aa", "bb")])
    assert told == ["aa", "bb"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    filters = [rng.normal(0, 0.5, (w, 256, 3)) for w in (2, 3)]
    rest = [rng.normal(0, 0.5, 6), rng.normal(0, 0.5, (6, 4)), rng.normal(0, 0.5, 4)]
    x, y = rng.integers(0, 256, (5, 12)), rng.integers(0, 4, 5)
    _, grads = langid.gradients(filters, *rest, x, y)
    params = [*filters, *rest]
    for p, g in zip(params, grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(40)] + ([tuple(np.argwhere(g)[0])] if g.any() else []):
            old, step = p[at], 1e-6
            p[at] = old + step
            up = langid.gradients(filters, *rest, x, y)[0]
            p[at] = old - step
            down = langid.gradients(filters, *rest, x, y)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-5)
