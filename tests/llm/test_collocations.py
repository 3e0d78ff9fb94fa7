"""Collocations against plain counting of every phrase."""

import collections
import random
import re

import numpy as np
import pytest

from conftest import SF_SMALL
from regionscore.llm import collocations as co
from regionscore.llm.queries import QUERIES
from regionscore.sources.tables import read_table

SCHEMA = "doc_id long, text string, lang string, phrase string, k int, n long, `a.b` int"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_counts(rows, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w))
    return f, n


def brute(rows, min_count, longest=5, top=2000):
    f, n = brute_counts(rows, longest)
    some = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= min_count}
    gone = {(lang, p[i:i + k]) for (lang, p), c in some.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
            if 100 * c >= 100 * f[lang, p[i:i + k]]}
    out = []
    for (lang, p), a in some.items():
        if (lang, p) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                        for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = collections.Counter()
    return [(r[0], rank.update([r[0]]) or rank[r[0]], *r[1:]) for r in out if rank[r[0]] < top]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 7, 7, 7) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def texts(seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "and", "Mill", "river", "ÉTÉ", "été", "한국", "x\x85y", "\x1c", "a-b", "it's", "𝔘", "#"]
    out = [(None, "en"), ("", None), (" \t\n.,", "en"), ("One", "en"), ("two words", ""), (None, None)]
    for i in range(240):
        n = rng.randrange(1, 120)
        said = "".join(words[min(13, int(rng.expovariate(0.45)))] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ", "\x0b"]) for _ in range(n))
        out.append((said, rng.choice(["en", "en", "fr", None, ""])))
    out += [("A long passage that stands in many texts and is the same in all of them, word for word", "en")] * 60
    out += [("again and " * 3000, "fr"), ("of the " * 2000 + "end", "en")]
    return out


@pytest.mark.parametrize("min_count,longest", [(5, 5), (100, 5), (3, 3), (20, 2)])
def test_equal_plain_counting(spark, min_count, longest):
    rows = texts()
    got = [tuple(r) for r in co.collocations(table(spark, rows), min_count, longest).orderBy("lang", "rank").collect()]
    assert got == sorted(brute(rows, min_count, longest))
    assert got


def test_many_buckets_chunks_and_frequent_phrases(spark, monkeypatch):
    """Flows in parts: nearly every word, pair and triple is frequent, and its grams are dealt by all their words."""
    rows = texts(3)
    monkeypatch.setattr(co, "LEAST_SHARE", 1 / 3000)
    options = {"chunk_chars": 2000, "bucket_chars": 600}
    expect = {(x[0], " ".join(x[1])): c for x, c in brute_counts(rows)[0].items() if c >= 4}
    got = co.phrase_counts(table(spark, rows), 4, **options).filter("k > 0").collect()
    assert {(r.lang, r.phrase): r.f for r in got} == expect and len(got) == len(expect)
    assert [tuple(r) for r in co.collocations(table(spark, rows), 4, top=7, **options).orderBy("lang", "rank").collect()] == sorted(brute(rows, 4, top=7))
    hot = co.frequent_phrases(table(spark, rows).select("text", "lang").fillna("und", ["lang"]).fillna("", ["text"]), len(rows), 1 / 3000, 5)
    assert {len(p.split(" ")) for _, p in hot} == {1, 2, 3, 4}


def test_paths_are_compacted():
    """A copied passage is one path with its number as weight."""
    said = " ".join(f"w{i}" for i in range(200))
    blocks = list(co.chunk_blocks([("en", said)] * 9 + [("en", "w3 other words")], co.Frequent([], 5), 1, 5))
    assert len(blocks) == 1
    _, (_, _, tokens, size, held, weight, _, _) = co.unpacked(blocks[0][1], 8)
    assert sorted(zip(size.tolist(), held.tolist(), weight.tolist(), strict=True)) == [(3, 2, 1), (200, 199, 9)] and len(tokens) == 203
    words, (one,) = co.unpacked(co.packed([], np.zeros(0, np.int64)), 1)
    assert words == [] and len(one) == 0


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Scores of counts whose products pass 64 bits."""
    big = 4_000_000_019 * 1000
    rows = [("en", 0, "", 3 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)]
    monkeypatch.setattr(co, "phrase_counts", lambda *a, **b: spark.createDataFrame(rows, "lang string, k int, phrase string, f long"))
    got = co.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big, 2 * big, big + 1, 3 * big, 1000 * big * 3 * big // (2 * big * (big + 1)))]


def test_query_and_empty_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF_SMALL, "documents").select("text", "lang").collect()]
    got = QUERIES["op12_collocations"](spark, SF_SMALL)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [tuple(r) for r in got.orderBy("lang", "rank").collect()] == sorted(brute(rows, 100))
    assert co.collocations(table(spark, [])).count() == 0
