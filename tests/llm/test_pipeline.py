import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from factsheet.llm import byte_bpe

SF = "/root/testdata/sf0.01"


def test_stages_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = [r.doc_id for r in docs.collect()]
        assert after and set(after) <= before
        if name == "quality classifier":
            good = {d for d in before if labels.get(d) == 1}
            assert len(good & set(after)) >= 0.98 * len(good)
            assert not [d for d in after if labels.get(d) == 0]
        if name == "near-duplicates":
            assert len(after) == len(set(after)) < len(before)
        before = set(after)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    with open(P.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = tokens.collect()
    assert len(rows) == docs.count()
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and rows.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_keep_documents_without_labels(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.classifier(spark, docs, str(tmp_path)).count() == docs.count() > 0
    assert corpus_pipeline.rules(spark, docs, str(tmp_path)).count() > 0
