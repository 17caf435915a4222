import numpy as np

import corpus_pipeline
from tests.llm.test_classifiers import plain_counts, plain_quality, plain_toxicity
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_tokens import check_pieces
from wireloom.llm import quality, toxicity


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "simhash near-dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().groupby("doc_id").max()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        texts, ids = [t for _, t in rows], [i for i, _ in rows]
        some = [ids.index(i) for i in sorted(set(ids) & set(labels.index))]
        mine = labels.loc[[ids[k] for k in some]]
        unsure: set[int] = set()  # so near a threshold that n-grams in one bucket may decide
        if name == "quality rules":
            p = plain_quality(texts, some, mine.quality.to_numpy())
            want = {i for (i, t), q in zip(rows, p) if not plain_counts(t)[-1] and q >= quality.KEEP}
            unsure = {i for i, q in zip(ids, p) if abs(q - quality.KEEP) < 0.03}
        elif name == "toxicity":
            p = plain_toxicity(texts, some, mine.toxic.to_numpy())
            want = {i for i, q in zip(ids, p) if q < toxicity.TOXIC}
            unsure = {i for i, q in zip(ids, p) if abs(q - toxicity.TOXIC) < 1e-3}
        elif name == "simhash near-dedup":
            prints = [(i, plain_fingerprint(t)) for i, t in rows]
            want = set(plain_components(prints))
        else:
            check_pieces(rows, out.collect(), 1024)
            break
        assert out.columns == docs.columns
        found = [r.doc_id for r in out.collect()]
        assert len(found) == len(set(found)) and set(found) - unsure == want - unsure and len(unsure) < 0.05 * len(rows)
        assert len(want) > 0
        docs = out
    assert np.isfinite(len(rows))


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert found and {"doc_id", "sequence_id"} <= set(found[0].asDict())


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"word{k}" for k in range(70))
    labels = [(k, k % 2, 0) for k in range(4)]
    for name, rows in {"none": [], "odd": [(1, None, None, None, None), (None, words, "en", "s", 1), (2, words, "en", "s", 1), (2, words, "en", "s", 1), (3, "", "en", "s", 0)]}.items():
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        found = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in found} <= {None, 2}
        assert not found or len([r for r in found if r.doc_id == 2 and r.start == 0]) <= 1
