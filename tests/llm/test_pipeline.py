from collections import Counter

import corpus_pipeline as P
from plumbline.llm import langid, toxicity
from tests.llm.test_similarity import brute
from tests.llm.test_tokens import check_packing

DATA = "/root/testdata/sf0.001"


def test_run_equals_plain_python(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    fitted = sorted((d["doc_id"], d["text"]) for d in docs if d["doc_id"] in labels)
    import numpy as np

    y = np.array([[int(labels[i].quality == 0), int(labels[i].toxic == 1)] for i, _ in fitted])
    chain = toxicity.fit_chain([t for _, t in fitted], y, ["low_quality", "toxic"])
    features = [toxicity.features(toxicity.words(d["text"])) for d in docs]
    clean = [d for d, p in zip(docs, chain.scores(features)[:, 1], strict=True) if p < toxicity.THRESHOLD]
    net = langid.fit(spark.createDataFrame(clean))
    langs, scores = net.predict([d["text"] for d in clean])
    told = [d for d, s in zip(clean, scores, strict=True) if langid._LETTER.search(d["text"]) and s >= P.LEAST_LANGUAGE]
    groups = brute([(d["doc_id"], d["text"]) for d in told], 5, 80, 100)
    kept = [(d["doc_id"], d["text"]) for d in told if groups[d["doc_id"]][1] == d["doc_id"]]
    assert 0 < len(kept) < len(told) <= len(clean) < len(docs)
    rows = P.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in kept}
    used, least = check_packing(rows, kept)
    assert used <= least + 2


def test_stages_keep_columns_and_take_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            before, after = (Counter(map(str, d.collect())) for d in (docs, out))
            assert not after - before
            docs = out
        P.STAGES[-1][1](spark, docs, DATA).collect()
