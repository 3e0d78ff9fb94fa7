"""The pipeline on the smallest documents table, every stage against brute force on what the stage before it kept."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from conftest import SF_SMALL
from regionscore.llm.bpe import WordBpe
from regionscore.llm.common import documents
from regionscore.llm.queries import QUERIES
from test_line_runs import brute_runs
from test_llm_operators import brute_fingerprint, brute_mix, components, words


def test_stages_and_run(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights",
                     "BPE encoding and decoding"]
    docs, kept = documents(spark, SF_SMALL), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = sorted(map(tuple, docs.select("doc_id", "text" if k < 4 else "ids", "lang", "source", "n_chars").collect()), key=repr)
    quality, lines, near, mixed, encoded = kept.values()

    good = {r.doc_id for r in QUERIES["op1_quality"](spark, SF_SMALL).filter("predicted = 1").select("doc_id").collect()}
    first = sorted((tuple(r) for r in documents(spark, SF_SMALL).collect() if r.doc_id in good), key=repr)
    first = sorted(((r[0], r[columns.index("text")], r[columns.index("lang")], r[columns.index("source")], r[columns.index("n_chars")])
                    for r in first), key=repr)
    assert quality == first and 0 < len(good) < documents(spark, SF_SMALL).count()

    order = sorted(quality)
    expect = [(r[0], text, *r[2:4], len(text)) for r, text in zip(order, brute_runs([r[1] for r in order], 10), strict=True)]
    assert lines == sorted(expect, key=repr) and lines != quality

    prints = {r[0]: brute_fingerprint(r[1]) for r in lines}
    part, least = components(set(prints.values()), 3), {}
    for doc_id in sorted(prints):
        least.setdefault(part[prints[doc_id]], doc_id)
    assert near == sorted((r for r in lines if r[0] in least.values()), key=repr)

    copies = {int(i): c for i, _, _, _, c, _ in brute_mix([(r[0], r[1], r[2], r[3]) for r in near])}
    assert mixed == sorted((r for r in near for _ in range(copies[r[0]])), key=repr)
    assert sum(len(words(r[1])) for r in mixed) <= 1.5 * sum(len(words(r[1])) for r in near)

    bpe = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    assert [(r[0], bytes(r[1])) for r in sorted(encoded, key=lambda r: r[0])] == [
        (r[0], np.array(bpe.encode(r[1]), "<u4").tobytes()) for r in sorted(mixed, key=lambda r: r[0])]

    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted((r.doc_id, bytes(r.ids)) for r in whole.collect()) == sorted((r[0], bytes(r[1])) for r in encoded)


def test_bpe_stage_with_clashing_and_dotted_names(spark):
    docs = spark.createDataFrame([(1, "two words", 5, "x", 7, "dot"), (2, None, 5, "x", 7, "dot")],
                                 "doc_id long, text string, n_tokens int, ids string, decoded_sha256 int, `a.b` string")
    got = corpus_pipeline.bpe(spark, docs, SF_SMALL)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and {"n_tokens", "ids", "a.b"} <= set(got.columns)
    assert sorted((r.doc_id, r.ids, r["a.b"], r._n_tokens > 0) for r in got.collect()) == [(1, "x", "dot", True), (2, "x", "dot", False)]


def test_stages_of_nothing_and_of_odd_texts(spark, tmp_path):
    """Null, empty, very long and repeated texts, null ids and names with dots, through every stage."""
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "One line of text. And more of it, here.\n" * 3000, "en", "a"),
            (None, "A text without an id. It has two sentences.", "fr", "b"), (4, "A text without an id. It has two sentences.", "fr", "b"),
            (4, "A text without an id. It has two sentences.", "fr", "b")]
    docs = spark.createDataFrame([(*r, 1, "dot") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for at, given in (("some", docs), ("none", docs.limit(0))):
            out = stage(spark, given, SF_SMALL)
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{at}{k}"))
            assert at == "some" or spark.read.parquet(str(tmp_path / f"{at}{k}")).count() == 0
