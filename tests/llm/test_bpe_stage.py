"""The BPE stage of the pipeline decodes what it encodes."""

import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from regionscore.llm.bpe import WordBpe
from test_llm_operators import PROSE, SCHEMA


def test_stage_decodes(spark):
    texts = [PROSE, "", None, "\u00e9t\u00e9 Sa\u03c2 x"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "r", 1, "s", 1, 1, 1) for i, t in enumerate(texts)], SCHEMA)
    own = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.bpe(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    assert len(got) == len(texts)
    for r in got:
        decoded = own.decode(np.frombuffer(r.ids, "<u4"))
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
