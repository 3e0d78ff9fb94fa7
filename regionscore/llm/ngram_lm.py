"""Operator 5: scores of an n-gram language model held in Elias-Fano tries.

Model: words and one end per text. Unigrams by absolute discounting, whose mass
goes to the unknown word; longer n-grams interpolated with shorter ones by a
Dirichlet prior of ``prior`` words: p(w|h) = (c(hw) + prior p(w|h'))/(c(h) + prior).
The first word follows the end of the text before. Shares c(hw)/(c(h) + prior)
and prior/(c(h) + prior) are quantised to two bytes in the trie, in equal
steps of the logarithm.

Nothing of the corpus is in one place. Texts are cut into blocks of about
``block_chars`` characters, each turned into numbers of its own sorted words.
1. Blocks send their distinct words with counts to shards by word; a shard adds
   them up, numbers its words by count, and answers with numbers and counts.
2. Blocks send their distinct n-grams with counts to shards by first word (by
   the first two for words above ``hot`` counts, so that a frequent word is
   spread over all shards). A shard builds the trie of its n-grams, whose levels
   lie in memory-mapped files while it answers every block's n-grams, by
   successor search relative to the context.
3. Blocks put the answers together for each token and add them up by text.
Words and n-grams are pre-aggregated in blocks, so that one that makes up a
third of the corpus is one entry for each block. What is sent and gathered grows
with the corpus; the driver gets four sums. Blocks and the words' answers are
tables in the shared folder.

Defined results: null text counts as empty, and an empty text is one end; a
repeated row is learned from and scored as often as it occurs; a null id counts
as the empty text for the choice of training rows; an empty table gives no rows,
and with no training rows only the smoothing counts.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionscore.llm.common import partitions, shared_table
from regionscore.llm.elias_fano import NgramTrie, path_order, prefix_starts

#: Quantised logarithms, in two bytes: 0 is zero, 1 is one, STEPS + 1 is 10^-RANGE.
RANGE, STEPS = 9.0, 65534
END = b""


def squeeze(x: np.ndarray, level: int = 3) -> bytes:
    """An integer array, each byte of its items apart, compressed; all zeros leave nothing."""
    x = np.ascontiguousarray(x, "<u8" if x.dtype.itemsize == 8 else "<u4" if x.dtype.itemsize == 4 else "u1")
    planes = x.view(np.uint8).reshape(len(x), -1).T
    used = max([k + 1 for k, p in enumerate(planes) if p.any()], default=0)  # the upper bytes are mostly zero
    return bytes([used]) + zstandard.compress(planes[:used].tobytes(), level)


def expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1) if raw[0] else None
    if planes is None:
        return np.zeros(0, np.int64)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.reshape(-1).view("<i8")


def squeeze_codes(codes: np.ndarray) -> bytes:
    """Rows of two-byte codes, column by column, the bytes of each apart, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(codes, "<u2").view(np.uint8).T).tobytes(), 3)


def expand_codes(raw: bytes, width: int) -> np.ndarray:
    """A row for each column of codes."""
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(2 * width, -1)
    return planes[0::2].astype("<u2") | planes[1::2].astype("<u2") << np.uint16(8)


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) / RANGE * STEPS), 0, STEPS) + 1, 0).astype("<u2")


VALUES = np.concatenate(([0.0], 10 ** (-np.arange(STEPS + 1) / STEPS * RANGE)))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit hash of integers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Numbers(dict):
    """Numbers of words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def make_block(texts: list[bytes], held: np.ndarray, shards: int) -> dict:
    """Tokens as numbers of the block's words, which are sorted by shard and spelling."""
    number = Numbers()
    number[END]  # noqa: B018  the end is number 0
    stream, sizes = [], []
    for text in texts:
        words = text.split()  # bytes: ASCII white space only
        stream.extend(map(number.__getitem__, words))
        stream.append(0)
        sizes.append(len(words) + 1)
    stream, sizes = np.array(stream, np.int64), np.array(sizes, np.int64)
    words = sorted(number)
    of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
    order = np.argsort(of, kind="stable")
    of, words = of[order], [words[i] for i in order.tolist()]
    place = np.empty(len(words), np.int64)
    place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    stream = place[stream]
    counts = np.bincount(stream[np.repeat(~held, sizes)], minlength=len(words))
    parts = []
    for s in np.unique(of):
        own = range(np.searchsorted(of, s), np.searchsorted(of, s, "right"))
        spelled = b" ".join(words[own.start:own.stop])
        parts.append({"shard": int(s), "words": zstandard.compress(spelled, 3), "counts": squeeze(counts[own.start:own.stop])})
    return {"sizes": squeeze(sizes), "stream": squeeze(stream, 9), "end": int(place[0]), "parts": parts}


PART = pa.struct([("shard", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


def blocks_of(docs: DataFrame, text: str, doc_id: str, held: Column, shards: int, block_chars: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), held.alias("held"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        ids, held_, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            made = make_block(texts, np.array(held_, bool), shards)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held_], pa.list_(pa.bool_())),
                 pa.array([made["sizes"]], pa.binary()), pa.array([made["stream"]], pa.binary()), pa.array([made["end"]], pa.int64()),
                 pa.array([made["parts"]], pa.list_(PART))], ["block", "ids", "held", "sizes", "stream", "end", "parts"])

        for batch in batches:
            for i, h, x in zip(*[batch.column(c) for c in range(3)], strict=True):
                raw = x.as_py().encode("utf-8").lower()  # bytes: A-Z only
                ids.append(i.as_py())
                held_.append(bool(h.as_py()))
                texts.append(raw)
                size += len(raw)
                if size >= block_chars:
                    yield block()
                    ids, held_, texts, size, k = [], [], [], 0, k + 1
        if texts:
            yield block()

    return rows.mapInArrow(run, "block long, ids array<long>, held array<boolean>, sizes binary, stream binary, end long, "
                                "parts array<struct<shard:long,words:binary,counts:binary>>")


def word_shard(shards: int):
    def run(part: pa.Table) -> pa.Table:
        """Add up the words of all blocks, number them by falling count, and answer each block."""
        spelled = [zstandard.decompress(x).split(b" ") for x in part["words"].to_pylist()]
        counts = [expand(x) for x in part["counts"].to_pylist()]
        total: dict[bytes, int] = {}
        for words, c in zip(spelled, counts, strict=True):
            c = c.tolist() if len(c) else [0] * len(words)
            for w, n in zip(words, c, strict=True):
                total[w] = total.get(w, 0) + n
        shard = part["shard"][0].as_py()
        order = sorted(total, key=lambda w: (-total[w], w))
        number = {w: 1 + shard + k * shards for k, w in enumerate(order)}
        c = np.fromiter(total.values(), np.int64, len(total))
        rows = [(b.as_py(), squeeze(np.array([number[w] for w in words], np.int64)), squeeze(np.array([total[w] for w in words], np.int64)))
                for b, words in zip(part["block"], spelled, strict=True)]
        sums = [0] * (len(rows) - 1)  # once for the shard
        cols = [[b for b, _, _ in rows], [shard] * len(rows), [x for _, x, _ in rows], [x for _, _, x in rows]]
        extra = [[int(c.sum()), *sums], [int((c > 0).sum()), *sums], [int((c == 1).sum()), *sums], [int((c == 2).sum()), *sums]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        return pa.table([pa.array(x, k) for x, k in zip(cols + extra, kinds, strict=True)],
                        names=["block", "shard", "numbers", "counts", "tokens", "types", "once", "twice"])
    return run


class Block:
    """A block's tokens with the words' answers: number, count, and the distinct paths of n-grams."""

    def __init__(self, row: dict, numbers: list[bytes], counts: list[bytes], order: int, shards: int, hot: int, send: bool):
        self.number = np.concatenate([expand(x) for x in numbers])
        self.count = [expand(x) for x in counts]
        self.count = np.concatenate([c if len(c) else np.zeros(len(expand(n)), np.int64) for c, n in zip(self.count, numbers, strict=True)])
        self.sizes = expand(row["sizes"])
        words = len(self.number)
        stream = expand(row["stream"])
        self.stream = stream if len(stream) else np.zeros(int(self.sizes.sum()), np.int64)
        n = len(self.stream)
        self.last = np.cumsum(self.sizes) - 1
        self.first = self.last - self.sizes + 1
        self.held = np.array(row["held"], bool)
        before = np.empty(n, np.int64)
        before[1:] = self.stream[:-1]
        before[self.first] = row["end"]
        self.before = before
        ends = np.repeat(self.last, self.sizes)
        columns = [before, self.stream]
        for k in range(1, order - 1):
            at = np.arange(n) + k
            inside = at <= ends
            columns.append(np.where(inside, self.stream[np.minimum(at, n - 1)], words))  # words: the text has ended
        key = columns[0]
        for c in columns[1:]:
            if int(key.max()) + 1 > (1 << 62) // (words + 1):
                key = np.unique(key, return_inverse=True)[1]
            key = key * (words + 1) + c
        _, at, path = np.unique(key, return_index=True, return_inverse=True)
        number = np.append(self.number, 0)
        head, one, two = self.count[columns[0][at]], number[columns[0][at]], number[columns[1][at]]
        shard = (mix(one.astype(np.uint64) ^ np.where(head > hot, mix(two), np.uint64(0))) % np.uint64(shards)).astype(np.int64)
        # by shard, and in it by number: neighbours share their first words, and compress well
        sort = np.lexsort([*[number[c[at]] for c in columns[:1:-1]], two, one, shard])
        back = np.empty(len(sort), np.int64)
        back[sort] = np.arange(len(sort))
        self.path = back[path]
        if send:
            weights = np.bincount(path[np.repeat(~self.held, self.sizes)], minlength=len(at))
            self.paths = np.stack([one[sort], two[sort], *[number[c[at[sort]]] for c in columns[2:]]], axis=1)
            self.shard, self.weights, self.head = shard[sort], weights[sort], head[sort]


def send_paths(order: int, shards: int, hot: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct n-grams of a block, one row a shard."""
        right = right.sort_by("shard")
        b = Block(left.to_pylist()[0], right["numbers"].to_pylist(), right["counts"].to_pylist(), order, shards, hot, send=True)
        cut = np.flatnonzero(np.concatenate(([True], b.shard[1:] != b.shard[:-1], [True]))) if len(b.shard) else np.array([0])
        rows = []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            p = b.paths[a:z]
            heads = np.flatnonzero(prefix_starts(p, 1))
            rows.append({"block": left["block"][0].as_py(), "shard": int(b.shard[a]), "n": int(z - a),
                         "heads": squeeze(np.diff(p[heads, 0], prepend=0)), "runs": squeeze(np.diff(np.append(heads, z - a))), "sums": squeeze(b.head[a:z][heads]),
                         "tails": [squeeze(p[:, k]) for k in range(1, order)], "weights": squeeze(b.weights[a:z])})
        return pa.Table.from_pylist(rows, PATHS)
    return run


PATHS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("heads", pa.binary()), ("runs", pa.binary()),
                   ("sums", pa.binary()), ("tails", pa.list_(pa.binary())), ("weights", pa.binary())])
PATHS_DDL = ("block long, shard long, n long, heads binary, runs binary, sums binary, tails array<binary>, weights binary")


def full(raw: bytes, n: int) -> np.ndarray:
    out = expand(raw)
    return out if len(out) else np.zeros(n, np.int64)


def trie_shard(order: int, prior: float):
    def run(part: pa.Table) -> pa.Table:
        """Build the trie of a shard's n-grams, and answer each block with its codes."""
        rows = part.to_pylist()
        runs = [full(r["runs"], 0) for r in rows]
        heads = np.concatenate([np.cumsum(full(r["heads"], len(k))) for r, k in zip(rows, runs, strict=True)])
        sums = np.concatenate([full(r["sums"], len(k)) for r, k in zip(rows, runs, strict=True)])
        runs, weights = np.concatenate(runs), np.concatenate([full(r["weights"], r["n"]) for r in rows])
        asked = np.empty((len(weights), order), np.int64, order="F")  # columns are worked on one by one
        asked[:, 0] = np.repeat(heads, runs)
        for j in range(1, order):
            asked[:, j] = np.concatenate([full(r["tails"][j - 1], r["n"]) for r in rows])
        sums, first = np.repeat(sums, runs), np.repeat(np.unique(heads, return_inverse=True)[1], runs)
        sort = path_order(asked, first)
        asked = np.asfortranarray(asked[sort])
        fresh = prefix_starts(asked, order)
        row = np.empty(len(sort), np.int64)
        row[sort] = np.cumsum(fresh) - 1
        own = np.flatnonzero(fresh)
        weights, asked, sums = np.add.reduceat(weights[sort], own), np.asfortranarray(asked[own]), sums[sort[own]]
        known = weights > 0
        p, c, above = np.asfortranarray(asked[known]), weights[known], sums[known]  # above: count of the context of each path
        codes = []
        for k in range(2, order + 1):
            fresh = np.flatnonzero(prefix_starts(p, k))
            here = np.add.reduceat(c, fresh) if len(fresh) else c
            values = [quantise(here / (above[fresh] + prior))]
            if k < order:
                values.append(quantise(prior / (here + prior)))
            codes.append(np.stack(values, axis=1))
            above = np.repeat(here, np.diff(np.append(fresh, len(p))))
        with tempfile.TemporaryDirectory() as folder:
            found = np.hstack(NgramTrie.build(p, codes).saved(folder).lookup(asked)) if len(p) else \
                np.zeros((len(asked), 2 * (order - 1) - 1), "<u2")
        found = found[row]
        at = np.cumsum([0, *[r["n"] for r in rows]])
        return pa.table([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["shard"] for r in rows], pa.int64()),
                         pa.array([squeeze_codes(found[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                        names=["block", "shard", "codes"])
    return run


def score_block(order: int, shards: int, hot: int, prior: float, tokens: int, types: int, once: int, twice: int):
    discount = once / (once + 2 * twice) if once else 0.5
    base_total = np.log10(tokens + 0.1 * (types + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Scores of a block's texts from the answers to its words and n-grams."""
        words = right.filter(pc.is_valid(right["numbers"])).sort_by("shard")
        grams = right.filter(pc.is_valid(right["codes"])).sort_by("shard")
        row = left.to_pylist()[0]
        b = Block(row, words["numbers"].to_pylist(), words["counts"].to_pylist(), order, shards, hot, send=False)
        width = 2 * (order - 1) - 1
        parts = [expand_codes(x, width) for x in grams["codes"].to_pylist()]
        codes = np.hstack(parts)[:, b.path] if parts else np.zeros((width, len(b.stream)), "<u2")
        count = b.count[b.stream].astype(float)
        if tokens:
            p = np.where(count > 0, np.maximum(count - discount, 0) / tokens, discount * types / tokens)
        else:
            p = np.ones(len(count))
        left_over = prior / (b.count[b.before] + prior)
        p = VALUES[codes[0]] + left_over * p
        start = np.repeat(b.first, b.sizes)
        for k in range(3, order + 1):  # the path of an n-gram is that of its first word
            at = np.arange(len(p)) - (k - 2)
            inside = at >= start
            at = np.maximum(at, 0)
            # rows of codes: share and left-over share of level 2, of level 3 .., share of the last level
            lam, share = codes[2 * (k - 3) + 1][at], codes[2 * (k - 2)][at]
            p = np.where(inside, VALUES[share] + np.where(lam > 0, VALUES[lam], 1.0) * p, p)
        logs = np.log10(np.clip(p, 1e-300, 1.0))
        base = np.log10(count + 0.1) - base_total
        add = lambda x: np.add.reduceat(x, b.first) if len(b.first) else x
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(b.held, pa.bool_()), pa.array(b.sizes, pa.int64()),
                         pa.array(add((count > 0).astype(np.int64)), pa.int64()), pa.array(add(base), pa.float64()),
                         pa.array(add(logs), pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def score_texts(docs: DataFrame, held: Column, order: int = 3, text: str = "text", doc_id: str = "doc_id", prior: float = 4.0,
                block_chars: int = 8_000_000, hot: int = 100_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    held: whether a row is only scored, not learned from.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), -(-size // block_chars))
    blocks = shared_table(blocks_of(docs, text, doc_id, held, shards, block_chars), "blocks", "uncompressed")
    words = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.*").repartition(shards, "shard")
    words = shared_table(words.groupBy("shard").applyInArrow(
        word_shard(shards), "block long, shard long, numbers binary, counts binary, tokens long, types long, once long, twice long"),
        "words", "uncompressed")
    sums = words.agg(*[F.sum(c) for c in ("tokens", "types", "once", "twice")]).first()
    tokens, types, once, twice = (int(x or 0) for x in sums)

    streams = blocks.drop("parts").repartition(shards, "block")
    answers = words.select("block", "shard", "numbers", "counts")
    paths = (streams.groupBy("block").cogroup(answers.groupBy("block"))
             .applyInArrow(send_paths(order, shards, hot), PATHS_DDL).repartition(shards, "shard"))
    codes = paths.groupBy("shard").applyInArrow(trie_shard(order, prior), "block long, shard long, codes binary")
    none = F.lit(None).cast("binary")
    both = answers.withColumn("codes", none).unionByName(codes.select("block", "shard", none.alias("numbers"), none.alias("counts"), "codes"))
    found = streams.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        score_block(order, shards, hot, prior, tokens, types, once, twice),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(tokens).cast("long"))
