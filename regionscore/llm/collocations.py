"""Operator 12: phrase collocations from a weighted de Bruijn graph.

Nodes are the (longest - 1)-grams of a language, edges its longest grams; an edge
weighs as often as it occurs inside pieces of text. Near the end of a piece the
grams get shorter: these are the piece-end corrections. The count of a phrase is
the flow through it: the weights of all grams, long or cut short, it begins.

1. A task takes a chunk of texts and counts its edges. Edges that follow each
   other without a branch and weigh the same are compacted to one path, so that a
   copied text is one path with a weight, and paths hold their words once and not
   once per edge. A path is cut where the owner of its edges changes.
2. An edge's owner is a bucket told by its first two words, so that the flows of
   all phrases of two words and more that begin an edge meet in one bucket, which
   sums them level by level. A pair's bucket is that of the lesser of its words'
   hashes, which neighbouring pairs share, so paths stay long. Frequent words
   never lend their hash if the other word can; a frequent pair goes by three
   words, a frequent triple by four, and so on. The flow of such a phrase comes in
   parts, which Spark adds up. What is frequent is told by a bounded sample: it
   decides where a gram is counted and never how often.
3. Phrases above ``min_count`` are scored by joins on Spark: every cut's parts are
   phrases above it as well, since they occur at least as often.

Counts are integers throughout, scores decimals of 38 digits, so that they are
exact up to 10**15 words. Python holds a chunk or a bucket of words, both bounded
by parameters but for a single text, which is read whole; a bucket is bounded as
far as the sample is like the whole. There are as many exchanged rows as chunks
times buckets until these get sparse: raise ``chunk_chars`` and ``bucket_chars``
with the executors' memory.

Defined results: null text is empty; null language is ``und``, apart from no
other; repeated rows count again; ties end by phrase in order of its bytes; an
empty table gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionscore.llm.common import partitions, shared_table

#: Ends of pieces, as bytes; blank and tab part words.
ENDS = b".,;:!?\n\x0b\x0c\r"
END = b"\xff"  # in no UTF-8 text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TABLE = bytes.maketrans(UPPER.encode() + ENDS + b"\t", LOWER.encode() + END * len(ENDS) + b" ")
#: Texts from which frequent words and phrases are told, and the least share that may be looked for.
SAMPLE_ROWS, LEAST_SHARE = 2000, 1 / 20_000
#: Above this many languages their totals are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
FLOWS = "lang string, k int, phrase string, f long"
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = (a ^ (b + MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * MIX
    return x ^ (x >> np.uint64(29))


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by index, exact below 2**53."""
    return np.bincount(at, values, n).astype(np.int64)


def packed(words: list[bytes], *arrays: np.ndarray) -> bytes:
    """Words and arrays of integers as one compressed value."""
    parts = [b" ".join(words), *(a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)).tobytes() for a in arrays)]
    sizes = [np.min_scalar_type(int(a.max()) if len(a) else 0).itemsize for a in arrays]
    head = np.array([len(parts[0]), *(x for a, s in zip(arrays, sizes, strict=True) for x in (s, len(a)))], "<i8").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(parts))


def unpacked(blob: bytes, arrays: int) -> tuple[list[bytes], list[np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(data, "<i8", 1 + 2 * arrays)
    at = head.nbytes + int(head[0])
    words, out = data[head.nbytes:at].split(b" ") if head[0] else [], []
    for size, n in head[1:].reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, f"<u{size}", n, at).astype(np.int64))
        at += size * n
    return words, out


class Frequent:
    """Words and phrases that are frequent, as ids of one chunk or bucket."""

    def __init__(self, phrases: Iterable[tuple[str, str]], longest: int):
        self.of: dict[int, list[tuple[str, tuple[bytes, ...]]]] = {k: [] for k in range(1, longest)}
        for lang, phrase in phrases:
            words = tuple(phrase.encode().split(b" "))
            if len(words) in self.of:
                self.of[len(words)].append((lang, words))

    def words(self, ids: dict[str, dict[bytes, int]], n: int) -> np.ndarray:
        """Which of n ids are frequent words; also begins the levels of ``among``."""
        self.ids, self.found = ids, {(lang, w): at for lang, w in self.of[1] if (at := ids.get(lang, {}).get(w[0])) is not None}
        out = np.zeros(n, bool)
        out[list(self.found.values())] = True
        return out

    def among(self, k: int, keys: np.ndarray, base: int) -> np.ndarray:
        """Which of the sorted ``keys`` (id of the first k - 1 words * base + id of the k-th) are frequent phrases."""
        out = np.zeros(len(keys), bool)
        named = [(x, self.found[x[0], x[1][:-1]] * base + last) for x in self.of.get(k, [])
                 if (x[0], x[1][:-1]) in self.found and (last := self.ids[x[0]].get(x[1][-1])) is not None]
        asked = np.array([key for _, key in named], np.int64)
        at = np.searchsorted(keys, asked)
        self.found = {x: int(i) for (x, key), i in zip(named, at, strict=True) if i < len(keys) and keys[i] == key}
        out[list(self.found.values())] = True
        return out


def chunk_blocks(texts: list[tuple[str, str]], frequent: Frequent, buckets: int, longest: int) -> Iterator[tuple[int, bytes]]:
    """The compacted paths of a chunk of (language, text) and its word counts, as a block for every bucket."""
    number = count(1)
    ids: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))
    parts = []
    for lang, text in texts:
        own = ids[lang]
        own[END] = 0
        said = text.encode().translate(TABLE).replace(END, b" \xff ").split()
        said.append(END)
        parts.append(np.fromiter(map(own.__getitem__, said), np.int64, len(said)))
    codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    names, langs = [b""] * next(number), sorted(ids)
    lang_of = np.zeros(len(names), np.int64)
    for k, lang in enumerate(langs):
        for w, i in ids[lang].items():
            names[i], lang_of[i] = w, k
    if len(names) == 1:
        return
    seeds = [xxhash.xxh64_intdigest(lang.encode()) for lang in langs]
    hashes = np.array([0, *(xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(names[1:], lang_of[1:].tolist(), strict=True))], np.uint64)

    n, base, place = len(codes), len(names), np.arange(len(codes))
    ends = np.where(codes == 0, place, n)
    left = np.minimum.accumulate(ends[::-1])[::-1] - place  # words to the end of the piece
    # ids of grams, level by level; an edge is the longest gram that begins at a place, or the rest of its piece
    hot_word = frequent.words(ids, base)
    order = hashes >> np.uint64(1) | hot_word.astype(np.uint64) << np.uint64(63)
    gram, edge, edges = codes, np.full(n, -1), 0
    owner = np.zeros(n, np.uint64)
    split = np.zeros(n, bool)
    for k in range(2, longest + 1):
        at = place[left >= k]
        keys, inverse = np.unique(gram[at] * base + codes[at + k - 1], return_inverse=True)
        if k == 2:
            first, second = codes[at], codes[at + 1]
            pair = mixed(hashes[first], hashes[second])
            owner[at] = np.where(hot_word[first] & hot_word[second], pair, np.minimum(order[first], order[second]))
        elif split.any():
            more = at[split[at]]
            owner[more] = mixed(owner[more], hashes[codes[more + k - 1]])
        hot = frequent.among(k, keys, base)
        split[:] = False
        split[at] = hot[inverse]
        gram = np.zeros(n, np.int64)
        gram[at] = inverse
        last = at[(left[at] == k) | (k == longest)]
        edge[last] = edges + gram[last]
        edges += len(keys)
    bucket = (owner % np.uint64(buckets)).astype(np.int64)

    is_edge = left >= 2
    used = place[is_edge]
    weight = np.bincount(edge[used], minlength=edges)
    first_at = np.full(edges, n)
    first_at[edge[used[::-1]]] = used[::-1]
    first = np.zeros(n, bool)
    first[used] = first_at[edge[used]] == used
    # a path goes on where all occurrences of an edge are followed by the next edge, and all of that one follow it
    step = used[left[used] >= 3]
    _, inverse, links = np.unique(edge[step] * max(edges, 1) + edge[step + 1], return_inverse=True, return_counts=True)
    unary = (links[inverse] == weight[edge[step]]) & (links[inverse] == weight[edge[step + 1]])
    goes_on = np.zeros(n, bool)
    goes_on[step] = unary & first[step] & (bucket[step] == bucket[step + 1])
    begins = first.copy()
    begins[1:] &= ~goes_on[:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(first & ~goes_on)
    held = stops - starts + 1  # edges of each path
    length = held - 1 + np.minimum(left[stops], longest)

    occurs = np.bincount(codes, minlength=base)
    word_bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    by_bucket, by_word = np.argsort(bucket[starts], kind="stable"), np.argsort(word_bucket[1:], kind="stable") + 1
    cuts = np.searchsorted(bucket[starts][by_bucket], np.arange(buckets + 1))
    word_cuts = np.searchsorted(word_bucket[by_word], np.arange(buckets + 1))
    for b in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(word_cuts) > 0)).tolist():
        paths, counted = by_bucket[cuts[b]:cuts[b + 1]], by_word[word_cuts[b]:word_cuts[b + 1]]
        size = length[paths]
        offset = np.repeat(starts[paths] - (np.cumsum(size) - size), size)
        said = codes[offset + np.arange(len(offset))]
        mine, local = np.unique(np.concatenate([said, counted]), return_inverse=True)
        words = [names[i] for i in mine.tolist()]
        blob = packed([lang.encode().hex().encode() or b"-" for lang in langs] + words, np.array([len(langs)]), lang_of[mine], local[:len(said)],
                      size, held[paths], weight[edge[starts[paths]]], local[len(said):], occurs[counted])
        yield b, blob


def bucket_flows(blobs: Iterable[bytes], frequent: Frequent, min_count: int, longest: int) -> Iterator[tuple[str, int, str, int]]:
    """Flows of the phrases that a bucket owns: all parts of split ones, else those of ``min_count`` or more."""
    number = count(0)
    ids: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))
    parts: list[list[np.ndarray]] = [[], [], [], []]
    words_at, words_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in blobs:
        names, (many, lang_of, said, size, held, weight, counted, occurs) = unpacked(blob, 8)
        langs = ["" if x == b"-" else bytes.fromhex(x.decode()).decode() for x in names[:many[0]]]
        own = np.array([ids[langs[k]][w] for w, k in zip(names[many[0]:], lang_of.tolist(), strict=True)], np.int64)
        for x, y in zip(parts, (own[said], size, held, weight), strict=True):
            x.append(y)
        words_at.append(own[counted])
        words_n.append(occurs)
    base = next(number) or 1
    names = [(lang, w.decode()) for lang, w, _ in sorted(((lang, w, i) for lang, d in ids.items() for w, i in d.items()), key=lambda x: x[2])]
    codes, size, held, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)

    n_of = summed(np.concatenate(words_at), np.concatenate(words_n), base)
    totals: dict[str, int] = defaultdict(int)
    for (lang, word), f in zip(names, n_of.tolist(), strict=False):
        totals[lang] += f
        if f >= min_count:
            yield lang, 1, word, f
    for lang, f in totals.items():
        yield lang, 0, "", f

    begin = np.cumsum(size) - size
    offset = np.repeat(begin - (np.cumsum(held) - held), held)
    at = offset + np.arange(len(offset))
    left, weight = np.repeat(begin + size, held) - at, np.repeat(weight, held)
    gram = codes[at]
    frequent.words(ids, base)
    for k in range(2, longest + 1):
        some = left >= k
        at, left, weight, gram = at[some], left[some], weight[some], gram[some]
        keys, where, inverse = np.unique(gram * base + codes[at + k - 1], return_index=True, return_inverse=True)
        flow = summed(inverse, weight, len(keys))
        hot = frequent.among(k, keys, base)
        kept = (flow >= min_count) | hot
        for i in np.flatnonzero(kept).tolist():
            p = at[where[i]]
            said = [names[c] for c in codes[p:p + k].tolist()]
            yield said[0][0], k, " ".join(w for _, w in said), int(flow[i])
        # a longer phrase occurs no more often than its beginning
        on = kept[inverse]
        at, left, weight, gram = at[on], left[on], weight[on], inverse[on]


def frequent_phrases(docs: DataFrame, rows: int, share: float, longest: int) -> list[tuple[str, str]]:
    """(language, phrase) of at most ``rows`` texts' phrases of up to longest - 1 words with at least that share of all words."""
    some = docs.sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), 7) if rows > SAMPLE_ROWS else docs
    piece = F.explode(F.split(F.translate("text", UPPER, LOWER), r"[.,;:!?\x0A-\x0D]")).alias("p")
    words = F.filter(F.split("p", r"[\x20\x09]+"), lambda w: w != "").alias("w")
    of = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest - 1), F.size("w") - i)),
                               lambda k: F.array_join(F.slice("w", i + 1, k), " "))
    grams = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), of)))
    counts = (some.select("lang", piece).select("lang", words).filter("size(w) > 0").select("lang", grams.alias("phrase"))
              .groupBy("lang", "phrase").agg(F.count("*").alias("n")))
    counts = shared_table(counts, "sample")
    total = counts.filter(~F.contains("phrase", F.lit(" "))).agg(F.sum("n")).first()[0] or 0
    return [tuple(r) for r in counts.filter(F.col("n") >= max(2, share * total)).select("lang", "phrase").collect()]


def phrase_counts(docs: DataFrame, min_count: int = 100, longest: int = 5, chunk_chars: int = 8_000_000, bucket_chars: int = 4_000_000,
                  text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, k, phrase, f of all phrases of one to ``longest`` words with f >= min_count; with k = 0, f is all words of the language."""
    docs = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    sized = docs.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    buckets = max(1, math.ceil((sized["chars"] or 0) / bucket_chars))
    hot = frequent_phrases(docs, sized["n"], max(LEAST_SHARE, 1 / (4 * buckets)), longest) if buckets > 1 else []

    def blocks(batches):
        frequent, texts, chars = Frequent(hot, longest), [], 0

        def told():
            found = list(chunk_blocks(texts, frequent, buckets, longest))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())],
                                              ["bucket", "block"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.append(row)
                chars += len(row[1])
                if chars >= chunk_chars:
                    yield told()
                    texts, chars = [], 0
        yield told()

    def flows(table: pa.Table) -> pa.Table:
        found = list(bucket_flows(table.column("block").to_pylist(), Frequent(hot, longest), min_count, longest))
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "k", "phrase", "f"])

    found = docs.mapInArrow(blocks, "bucket int, block binary").groupBy("bucket").applyInArrow(flows, FLOWS)
    found = found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return shared_table(found.filter((F.col("f") >= min_count) | (F.col("k") == 0)), "flows")


def words_of(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, **options) -> DataFrame:
    """Each language's first ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, min_count, longest, **options)
    # dropped: a phrase inside a longer one that occurs as often; such a one exists with one word more
    longer = counts.filter("k > 2").withColumn("w", F.split("phrase", " "))
    inside = longer.select("lang", F.explode(F.array(words_of(F.lit(1), F.col("k") - 1), words_of(F.lit(2), F.col("k") - 1))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    own = counts.filter("k >= 2").join(inside, ["lang", "phrase"], "left").filter("most is null or most < f")

    cuts = (own.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", F.col("f").alias("a"), "cut", words_of(F.lit(1), F.col("cut")).alias("head"),
                    words_of(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")))
    part = lambda name, f: counts.filter("k > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))  # one row a language
    total = F.broadcast(total) if total.count() <= BROADCAST_LANGUAGES else total
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", (F.col("a") * 1000).cast("decimal(19,0)") * wide("n")).withColumn("down", wide("l") * wide("r"))
    scored = (cuts.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("best")).select("lang", "phrase", "best.*"))

    # the first of each language from the first of its parts, so that no language's phrases meet in one task
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    many = partitions(docs.sparkSession)
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(many)).cast("int"))
    while many > 1:
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
        many = math.isqrt(many) if many > 3 else 1
        scored = scored.withColumn("part", F.col("part") % many)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
