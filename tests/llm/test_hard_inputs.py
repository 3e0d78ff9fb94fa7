"""Repeated rows, many spans and names with dots."""

import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from conftest import SF_SMALL
from regionscore.llm import merkle, mixing, quality_model, quality_rules, secret_scan
from regionscore.llm.bpe import encode_documents
from regionscore.llm.queries import QUERIES, tokenizer_path
from regionscore.sources.tables import read_table


def test_repeated_rows_certify_nothing(spark):
    """Thirty good and three bad labelled texts are too few, each forty times as well."""
    rows = [(i, "plain words of a good text that say little about number " + str(i), "en") for i in range(30)]
    rows += [(100 + i, "## x ** y && z %% " * 9, "en") for i in range(3)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows], "doc_id long, label int")
    for times in (1, 40):
        docs = spark.createDataFrame(rows * times, "doc_id long, text string, lang string")
        assert quality_rules.judge(docs, labels).filter("size(failed) > 0").count() == 0


def test_verdicts_follow_from_the_cutoffs(spark):
    """kept, recomputed from shares and labels without the operator's histogram."""
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, SF_SMALL, "labels").select("doc_id", F.col("quality").alias("label"))
    got = quality_rules.judge(docs, labels, risk=0.5, delta=0.9, cells=50).collect()
    good = dict(labels.collect())
    shares = {r.row.doc_id: r for r in got}
    rejected = {i: set() for i in shares}
    strata = sorted({r.row.lang for r in shares.values() if r.row.doc_id in good})
    for lang in strata:
        held = [r for r in shares.values() if r.row.lang == lang and r.row.doc_id in good]
        n = sum(good[r.row.doc_id] == 1 for r in held)
        for rule in quality_rules.RULES:
            cell = {r.row.doc_id: int(np.ceil(r[rule] * 50)) for r in held}
            best, gain = None, 0
            for cut in range(49, -1, -1):
                k = sum(c > cut and good[i] == 1 for i, c in cell.items())
                tail = quality_rules.binomial_tail(k, n, 0.5 / len(quality_rules.RULES))
                if k > 0.5 / len(quality_rules.RULES) * n or tail > 0.9 / (len(quality_rules.RULES) * len(strata)):
                    break
                value = sum(c > cut and good[i] == 0 for i, c in cell.items()) - k
                if value > gain:
                    best, gain = cut, value
            for r in shares.values():
                if best is not None and r.row.lang == lang and np.ceil(r[rule] * 50) > best:
                    rejected[r.row.doc_id].add(rule)
    assert all(set(r.failed) == rejected[i] and r.kept == (not r.base_failed and not rejected[i]) for i, r in shares.items())
    assert any(rejected.values())


def test_many_secrets_in_a_text(spark):
    """A log of patterns and runs is walked once."""
    text = "".join(f"token={i:08d}x {'x7Gq2LpZ9vKw4TbN8rYcD1' if i % 2 else 'word'} " for i in range(40_000))
    spans = secret_scan.pattern_spans(text)
    start = time.perf_counter()
    found = list(secret_scan.apart(secret_scan.re.finditer(secret_scan.RUN % 20, text), sorted(spans)))
    assert time.perf_counter() - start < 5 and len(spans) == 40_000
    some = text[:4000]
    spans = sorted(secret_scan.pattern_spans(some))
    runs = [m.span() for m in secret_scan.re.finditer(secret_scan.RUN % 9, some)]
    assert [m.span() for m in secret_scan.apart(secret_scan.re.finditer(secret_scan.RUN % 9, some), spans)] == [
        (s, e) for s, e in runs if not any(a < e and s < b for a, _, b in spans)]
    assert len(found) == 20_000


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "some words. and more of them here, again", "en", "a", "x"), (2, None, None, None, None)],
                                 "doc_id long, `t.t` string, lang string, `s.s` string, `a.b` string")
    path = tokenizer_path("word_bpe_49k.json")
    assert [r.row["a.b"] for r in encode_documents(docs, path, text="t.t").orderBy("row.doc_id").collect()] == ["x", None]
    assert mixing.mix(docs, text="t.t", source="s.s").count() == 2 and mixing.mixed_documents(docs, text="t.t", source="s.s").columns == docs.columns
    assert quality_rules.text_statistics(docs, "t.t").select("row.*").columns == ["doc_id", "lang", "s.s", "a.b"]
    assert secret_scan.find_secrets(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text="t.t").count() == 2
    assert merkle.with_successor(docs, text="t.t").count() == 2
    model = quality_model.train(docs.withColumnRenamed("t.t", "text"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"))
    assert quality_model.score(docs, model, text="t.t", keep_text=True).select("row.*").columns == docs.columns


def test_quality_scores_equal_a_text_by_text_pass(spark):
    """op1's forward pass against plain numpy, one text at a time."""
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text").limit(60)
    labels = read_table(spark, SF_SMALL, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_model.train(docs, labels)
    got = {r.row.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    for r in docs.collect():
        bag = quality_model.passage_features(r.text or "", 64)
        alone = model.scores(bag, np.zeros(len(bag), int), 1)[0]
        assert abs(got[r.doc_id] - alone) < 1e-5 and 0 <= alone <= 1
    assert QUERIES["op1_quality"](spark, SF_SMALL).count() == read_table(spark, SF_SMALL, "documents").count()
