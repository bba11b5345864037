import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgerloom.llm import byte_bpe, decontaminate, ngram_join, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, [set(r.doc_id for r in docs.collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.collect()})
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.quality_rules(whole).where("kept").collect()}
    assert ids[1] == good
    kept = whole.where(whole.doc_id.isin(list(good)))
    assert ids[2] == {r.doc_id for r in ngram_join.ngram_groups(kept, 5, 80).where("doc_id = component_id").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = whole.where(whole.doc_id.isin(list(ids[2])))
    assert ids[3] == ids[2] - {r.doc_id for r in decontaminate.find_leaks(kept, bench).collect()}
    assert ids[4] == ids[3]
    assert secrets.scan_secrets(docs).where("size(spans) > 0").count() == 0
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.ranks_file()), special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(encoding.encode_ordinary(t)) for i, t in texts.items()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
