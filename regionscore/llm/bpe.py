"""Operator 2: BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary file are compiled into a deterministic automaton over
tokens, one gadget per merge in rank order. At first there is one state, with an
arc to itself for every symbol. The gadget of a merge (u, v) splits the state
reached by u: the copy, which u now leads to, has no arc v, and wherever an arc
u leaves, a new arc uv leaves too, to where v led. What the automaton accepts
are exactly the token sequences that BPE gives.

States and arcs are kept by gadget, not written out: ``splits[u, v]`` is the
step at which the state after u lost its arc v. The state after a token is the
chain of splits of its last parts, each within the steps during which that part
was the last token; the arcs of a long token stand and fall with those of its
first parts at the time. An arc is worked out once and then read from a table.

A word is encoded by looking for the automaton's one path over it. The tokens
that match at a place come from a trie, longest first; one is taken if the table
has its arc. Since BPE is deterministic, one path only reaches each place, and a
place from which the end cannot be reached is left for good: every place is
tried once at most. Decoding emits the labels of the arcs.

Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded alike; other columns pass through in a struct, so that
their names cannot clash. Texts are processed whole. Memory: tables of the
vocabulary's size, a word table of ``WORDS`` entries at most, an Arrow batch.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import row_of, whole_text

#: Bounds of the tables that a task fills in; when full they are emptied.
WORDS, ARCS = 800_000, 1_000_000
END = "</w>"
#: Texts with code points from here on are cut into words by the tokenizers library.
COMMON = 0x530
#: Unicode white space below COMMON.
WHITE = "\t\n\v\f\r \x85\xa0"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class MergeAutomaton:
    """Automaton of an ordered list of merges over integer symbols.

    symbols: number of symbols, 0 .. symbols-1. The k-th merge (u, v) makes token symbols+k.
    """

    def __init__(self, symbols: int, merges: list[tuple[int, int]]):
        n = symbols + len(merges)
        self.made = [-1] * symbols + list(range(len(merges)))
        self.first, self.last = list(range(n)), list(range(n))
        self.splits: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        self.size = n
        spelling: list[tuple[int, ...]] = [(s,) for s in range(symbols)]
        live = [True] * n
        for k, (u, v) in enumerate(merges):
            x = symbols + k
            self.first[x], self.last[x] = u, v
            spelling.append(spelling[u] + spelling[v])
            # without an arc v in the state after u, no gadget: the token never occurs
            live[x] = live[u] and live[v] and self._leads(u, v)
            if live[x]:
                self.splits[u, v] = k
        self.next: dict[int, int] = {}  # trie of the spellings: node * symbols + symbol -> node
        self.token = [-1]
        self.symbols = symbols
        self.length = list(map(len, spelling))
        for x in range(n):
            if live[x]:
                at = 0
                for s in spelling[x]:
                    at = self.next.setdefault(at * symbols + s, len(self.token))
                    if at == len(self.token):
                        self.token.append(-1)
                self.token[at] = x
        self.shorter = [-1] * n  # the next shorter token that begins alike
        for x in range(n):
            at = 0
            for s in spelling[x][:-1] if live[x] else ():
                at = self.next[at * symbols + s]
                if self.token[at] >= 0:
                    self.shorter[x] = self.token[at]

    def _leads(self, t: int, x: int) -> bool:
        """Whether the state after token t has an arc x."""
        made, splits = self.made, self.splits
        z, until = t, len(made)
        while True:
            y, end = x, len(made)
            while True:
                k = splits.get((z, y))
                # z was the last token, and y the next one, when the state was split
                if k is not None and max(made[z], made[y]) < k < until and k <= end:
                    return False
                if made[y] < 0:
                    break
                y, end = self.first[y], made[y]
            if made[z] < 0:
                return True
            z, until = self.last[z], made[z]

    def arc(self, t: int, x: int) -> bool:
        """One entry of the transition table, worked out when first read."""
        if len(self.arcs) >= ARCS:
            self.arcs.clear()
        leads = self.arcs[t * self.size + x] = self._leads(t, x)
        return leads

    def encode(self, word: list[int]) -> list[int]:
        """Tokens of a word of symbols: the automaton's one path over the word, longest tokens tried first."""
        n, size, step, token, known = len(word), self.size, self.next.get, self.token, self.arcs.get
        length, shorter, symbols = self.length, self.shorter, self.symbols
        out, dead, pos, t, x = [], set(), 0, -1, -2
        while pos < n:
            if x == -2:  # the longest token that begins here
                at = 0
                for j in range(pos, n):
                    at = step(at * symbols + word[j])
                    if at is None:
                        break
                    if token[at] >= 0:
                        x = token[at]
            while x >= 0:
                if pos + length[x] not in dead:
                    if t < 0:
                        break
                    leads = known(t * size + x)
                    if leads or leads is None and self.arc(t, x):
                        break
                x = shorter[x]
            if x >= 0:
                out.append(x)
                pos += length[x]
                t, x = x, -2
            else:  # the path to a place is unique, so that a place that leads nowhere stays dead
                dead.add(pos)
                x = out.pop()
                pos -= length[x]
                t, x = out[-1] if out else -1, shorter[x]
        return out


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends (byte-level BPE, lower case)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        symbols = letters + [x + END for x in letters]
        index = {x: i for i, x in enumerate(symbols)}
        pairs = []
        for k, pair in enumerate(spec["model"]["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append((index[u], index[v]))
            index[u + v] = len(symbols) + k
        self.automaton = MergeAutomaton(len(symbols), pairs)
        self.ids = [0] * len(index)
        for x, i in index.items():
            self.ids[i] = vocab[x]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: x for x, i in (vocab | self.special).items()}
        self.labels = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.words = word_pattern(spec).findall
        self.rare = re.compile(f"[{chr(COMMON)}-\U0010ffff]").search
        self.library = tokenizers.Tokenizer.from_file(path)
        self.bytes = {x: b for b, x in enumerate(letters)}
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = self.known[word] = self.symbols([*raw])
        if len(self.known) > WORDS:
            self.known.clear()
        return ids

    def symbols(self, raw: list[int]) -> list[int]:
        raw[-1] += 256
        return [self.ids[t] for t in self.automaton.encode(raw)]

    def plain(self, text: str, out: list[int]) -> None:
        low = text.lower()
        if not text.isascii():
            # the final sigma rule of str.lower() looks at neighbours; vocabularies map letter by letter
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if self.rare(low):
                # letters and numbers by the Unicode version of the library that defines the result
                text = self.library.normalizer.normalize_str(text)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
                    out.extend(self.symbols([self.bytes[x] for x in piece]))
                return
        known, word = self.known, self.word
        for w in self.words(low):
            if w in known:
                out += known[w]
            else:
                out += word(w)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        if self.marks is not None and "<|" in text:
            for m in self.marks.finditer(text):
                self.plain(text[at:m.start()], out)
                out.append(self.special[m[0]])
                at = m.end()
        self.plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in ids])


def word_pattern(spec: dict) -> re.Pattern:
    """The vocabulary's rule for words, for code points below COMMON, with its classes written out for ``re``."""
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    classes = {r"\p{L}": "", r"\p{N}": "", r"\s": ""}
    for c in map(chr, range(COMMON)):
        kind = r"\s" if c in WHITE else rf"\p{{{unicodedata.category(c)[0]}}}"
        if kind in classes:
            classes[kind] += re.escape(c)
    for kind, chars in classes.items():
        split = split.replace(kind, chars)
    return re.compile(split)


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """row (a struct of the columns of ``docs`` but the text), ids (little-endian unsigned 32-bit), and the decoded text.

    ``path``: a vocabulary file that every executor can read at this place.
    """
    row = row_of(docs, text) if len(docs.columns) > 1 else row_of(docs)
    rows = docs.select(row.alias("row"), whole_text(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [bpe.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([np.array(x, dtype="<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([bpe.decode(x) if decoded else None for x in ids], pa.string())], ["row", "ids", "decoded"])

    return rows.mapInArrow(run, schema)
