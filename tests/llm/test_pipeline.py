"""The pipeline against plain Python on what it keeps."""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from civicspan.llm import order_minhash, queries
from test_free import brute_hits
from test_native import signals


def test_the_pipeline_on_whole_documents(spark, small, small_docs):
    texts = dict(zip(small_docs.doc_id, small_docs.text, strict=True))
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    good = [i for i, t in texts.items() if signals(t)[0] >= 10 and 100 * signals(t)[4] <= 20 * signals(t)[0]]
    assert rows and set(rows) <= set(good)
    for doc, row in rows.items():
        assert np.frombuffer(row["ids"], "<u4").tolist() == tokenizer.encode(row["text"], add_special_tokens=False).ids
        assert row["n_chars"] == len(row["text"]) and brute_hits(row["text"], items)[1] == 0
        if not brute_hits(texts[doc], items)[1] and not any(c.isdigit() or c == "@" for c in texts[doc]):
            assert row["text"] == texts[doc]
    hashed = {i: order_minhash.word_hashes(texts[i].encode()) for i in sorted(rows)}
    kept = list(hashed)
    for at, a in enumerate(kept):
        assert not any(order_minhash.similar(hashed[a], hashed[b]) for b in kept[at + 1 :])


def test_stages_return_the_documents_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
