"""Line dedup on repeated runs, against brute force and on passages that chunks alone don't tell."""

import collections
import itertools
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from regionscore.llm import line_dedup, simhash
from test_llm_operators import LONG, PROSE, SHARED, TEXTS, words

#: Sixty words, two to a line: no chunk of it has ten words.
MENU = "".join(f"{a}{i} {b}{i}\n" for i, (a, b) in enumerate([("soup", "five"), ("bread", "two"), ("plum", "nine")] * 10))

#: Unpunctuated words, and characters of a script without spaces.
BARE = " ".join(f"b{i * i % 97}u{i}" for i in range(70))
HAN = "".join(chr(0x4E00 + i * i * 37 % 5000) for i in range(120))

SPLIT = rf"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])|(?<=[{line_dedup.UNSPACED}])"


def stored(spark, tmp_path, texts):
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def cleaned(docs, **options):
    return [r.row.text for r in sorted(line_dedup.dedup_lines(docs, **options).collect(), key=lambda r: r.row.doc_id)]


def hashed(value, seed=42):
    out = xxhash.xxh64_intdigest(value if isinstance(value, bytes) else struct.pack("<q", value), seed)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_starts(parts):
    h, place = [signed(hashed(x.encode())) for x in parts], []
    for i in range(len(h)):
        place.append(place[-1] + 1 if i and h[i] == h[i - 1] else 0)
    t = [signed(xxhash.xxh64_intdigest(struct.pack("<i", k), hashed(x))) if k else x for x, k in zip(h, place, strict=True)]
    r = [signed(hashed(t[i - 1], hashed(x)) if i else hashed(x)) for i, x in enumerate(t)]
    return [i for i in range(len(r)) if i == 0 or i >= 2 and r[i - 1] < r[i - 2] and r[i - 1] < r[i]]


def pieces(parts, starts):
    return [parts[a:b] for a, b in zip(starts, [*starts[1:], len(parts)], strict=False)]


def brute_lines(text):
    out = []
    for line in [x for x in re.split(line_dedup.LINE_END, text) if x]:
        if len(line.encode()) <= line_dedup.LONG_LINE:
            out.append(line)
        else:
            parts = [x for x in re.split(SPLIT, line) if x]
            out += ["".join(x) for x in pieces(parts, brute_starts(parts))]
    return out


def brute_runs(texts, min_words=0):
    """Texts in their order, without runs of later copies of min_words words or more, extended line by line into the
    two chunks before and the one behind the first place."""
    lines = [brute_lines(t or "") for t in texts]
    places, low, high = collections.defaultdict(list), {}, {}
    for d, x in enumerate(lines):
        s = brute_starts(x)
        low |= {(d, a): s[max(j - 2, 0)] for j, a in enumerate(s)}
        high |= {(d, b): [*s, len(x)][j + 2] if j + 2 <= len(s) else len(x) for j, b in enumerate([*s[1:], len(x)])}
        for a, c in zip(s, pieces(x, s), strict=True):
            if len(c) > 1:
                places["".join(c)].append((d, a, a + len(c)))
    places = {k: v for k, v in places.items() if len(v) > 1}
    stay = {(d, i) for v in places.values() for d, a, b in v[:1] for i in range(a, b)}
    later = {(d, a): (b, v[0], k) for k, v in places.items() for d, a, b in v[1:]}
    gone = [set() for _ in texts]
    for (d, a), (b, (sd, sa, sb), k) in later.items():
        if any(e == a for (x, _), (e, _, _) in later.items() if x == d):
            continue  # not the start of a run
        n, last = len(re.findall(line_dedup.UNIT, k)), sb
        while (d, b) in later:
            b, (ld, _, last), k = later[d, b]
            n += len(re.findall(line_dedup.UNIT, k))
            sd2 = ld
        sd2 = sd if (d, a) in later and later[d, a][0] == b else sd2
        if n < min_words:
            continue
        x, y, z = a, b, 0
        while x > 0 and sa - z > low[sd, sa] and lines[d][x - 1] == lines[sd][sa - z - 1]:
            x, z = x - 1, z + 1
        z = 0
        while y < len(lines[d]) and last + z < high[sd2, last] and lines[d][y] == lines[sd2][last + z]:
            y, z = y + 1, z + 1
        gone[d] |= {i for i in range(x, y) if (d, i) not in stay}
    return [None if t is None else "".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d, t in enumerate(texts)]


@pytest.mark.parametrize("floor", [0, 10])
def test_runs_equal_brute_force(spark, tmp_path, floor):
    texts = [x if x is None else x[:4000] for x in TEXTS]
    texts += ["Before it. Other lines.\n" + MENU + "After it. More.\n", MENU, SHARED + MENU + PROSE, LONG[:5000], HAN + PROSE, "\u4e00" + HAN,
              "Tior, " * 90 + "End.", "Now. " + "Tior, " * 200, BARE, "A\x01b. " + SHARED, "Something else " + BARE + " and more"]
    assert cleaned(stored(spark, tmp_path, texts), min_words=floor) == brute_runs(texts, floor)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_passages_of_short_lines_lose_most_words(spark, tmp_path, n):
    """The floor holds for the run: a passage of lines of n words goes as one of long lines does."""
    line = [" ".join(f"w{i}x{k}" for k in range(n)) + "\n" for i in range(60 // n)]
    passage = "".join(line)
    texts = ["One start. Some words, then.\n" + passage + "An end. Of it.\n", "Another text! It has this:\n" + passage + "Done now. Bye.\n"]
    first, second = cleaned(stored(spark, tmp_path, texts), min_words=10)
    assert first == texts[0]
    assert not set(words(passage)) & set(words(second))


def test_short_repeats_stay_under_a_floor(spark, tmp_path):
    texts = ["a. b. c. d.\n" + PROSE, "Not so. a. b. c. d.\nOther words of one line"]
    assert cleaned(stored(spark, tmp_path, texts), min_words=10) == texts
    assert re.findall(r"\S+", texts[1])[2:6] == ["a.", "b.", "c.", "d."]


@pytest.mark.parametrize("passage", [BARE + " ", HAN, "Tior, " * 120])
def test_passages_without_marks_go(spark, tmp_path, passage):
    """One line however long, or equal lines in a row: the passage is found in other surroundings."""
    texts = ["Some words to start with " + passage + "and then an end", "These are different ones for a change " + passage + "until it stops"]
    first, second = cleaned(stored(spark, tmp_path, texts))
    assert len(second) < len(texts[1]) - 0.6 * len(passage)
    assert second.startswith("These are") and second.endswith("stops")


def test_runs_of_equal_lines_of_other_lengths(spark, tmp_path):
    texts = ["Tior, " * 200 + "End.", "Now. " + "Tior, " * 90 + "Other."]
    assert len(cleaned(stored(spark, tmp_path, texts))[1]) < 100


def test_rows_keep_their_numbers_when_a_scan_is_split_anew(spark, tmp_path, monkeypatch):
    """Between two steps the input comes in other partitions, as after the loss of an executor."""
    texts = [f"Start {i}. Of text {i}, yes.\n" + (MENU if i % 2 else PROSE * 3) + f"End {i}. Of it.\n" for i in range(40)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    before = cleaned(docs)
    assert before != texts
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    for module in (line_dedup, simhash):
        monkeypatch.setattr(module, "shared_table", moved(spark, module.shared_table))
    try:
        assert cleaned(spark.read.parquet(path)) == before
        kept = simhash.one_of_each(spark.read.parquet(path), radius=3).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    monkeypatch.undo()
    assert sorted(kept) == sorted(simhash.one_of_each(docs, radius=3).collect())


def moved(spark, plain):
    """shared_table, after which scans come in one partition or in many, by turns."""
    turns = itertools.cycle(["1", "64"])

    def table(*args, **options):
        out = plain(*args, **options)
        spark.conf.set("spark.sql.files.minPartitionNum", next(turns))
        return out
    return table


def test_short_repeats_go_without_a_floor(spark, tmp_path):
    short = "".join(f"{c}. " for c in "abcdefghijklmnop")
    texts = ["One way. " + short + PROSE, "Not so. " + short + "Other words of one line"]
    first, second = cleaned(stored(spark, tmp_path, texts))
    assert first == texts[0] and second == "Not so. Other words of one line"


def test_runs_are_extended_through_long_rows_of_single_lines(spark, tmp_path):
    """Every common line goes, wherever in a passage the boundaries fall."""
    texts, expect = [], []
    for k in range(12):
        passage = "".join(f"Common line {k} number {i}.\n" for i in range(24))
        texts += [f"Own {k}. Here {k}.\n{passage}Its end {k}.\n", f"Different {k}! There {k}.\nMore of it {k}.\n{passage}Another end {k}.\n"]
        expect += [texts[-2], texts[-1].replace(passage, "")]
    assert cleaned(stored(spark, tmp_path, texts)) == expect


def test_line_ends_are_found_in_one_search(spark):
    texts = ["a. b\n\nc", "x.y. z.", "\n", "", "end. ", "q\u3002\uff1f r\u061f s\u061ft", ", , ,", "a.  b", "tail\n", "\u3001\u3001"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(line_dedup.lines_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [[x for x in re.split(line_dedup.LINE_END, t) if x] for t in texts]


def test_long_lines_are_cut_alike_with_marks_and_as_arrays(spark):
    lines = [BARE, HAN, "Tior " * 90, "a  b\t\tc " * 40, " lead " + BARE, HAN[:40] + " " + HAN[40:] + "\n", "\u2014dash\u2014 \uac00\uac01 \u00e9t\u00e9 " * 30, "x" * 200]
    got = spark.createDataFrame([(t,) for t in lines], "t string").select(
        line_dedup.cut_line(F.col("t")), F.split(line_dedup.mark_line(F.col("t")), line_dedup.MARK)).collect()
    for t, (a, b) in zip(lines, got, strict=True):
        parts = [x for x in re.split(SPLIT, t) if x]
        assert a == b == ["".join(x) for x in pieces(parts, brute_starts(parts))]


def test_chunks_are_hashed_without_a_copy_of_all_lines_each(spark, tmp_path):
    """In a lambda, slice copies the whole array for each chunk, so that time grows with the square of a text's lines."""
    docs = stored(spark, tmp_path, TEXTS).select(line_dedup.lines_of(F.col("text")).alias("lines"))
    plan = line_dedup.chunked(docs, F.col("lines"))._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and "hash, xxhash64(slice(" not in plan


def test_words_are_counted_for_a_floor_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "UNIT", "[")  # no pattern: raises where it is used
    texts = ["One. Two. Three. " + SHARED, "Four. Five. " + SHARED]
    assert cleaned(stored(spark, tmp_path, texts)) == brute_runs_without_words(texts)


def brute_runs_without_words(texts):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(line_dedup, "UNIT", "x")
        return brute_runs(texts)
