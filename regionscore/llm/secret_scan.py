"""Operator 9: secrets by patterns and by token efficiency.

Patterns find keys that announce themselves (kinds assign, access, hex). Other
random strings are found by how badly a byte-pair vocabulary compresses them:
words and names take several characters a token, random strings hardly two. A
run of ``min_length`` letters, digits and ``+/_=-`` that overlaps no pattern's
span is a secret (kind token) if it takes fewer than ``max_ratio`` characters a
token, a shorter one of ``short_length`` or more if it takes fewer than
``short_ratio``, and if it is no known digest (hexadecimal, of the length of a
common hash), UUID, number or rule of signs, nor an identifier: letters in one
case in parts by ``_=-``, each of which is one token or takes ``max_ratio``
characters a token. A run without such signs is judged by the ratio alone.

Defined results: null text counts as empty and has no spans; repeated rows have
the same spans; other columns pass through in a struct. Spans are code points,
end exclusive, by start, then kind. Texts are scanned whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionscore.llm.common import row_of, whole_text

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
NUMBER = re.compile(r"[_=/+-]+|(?=.*[0-9])[0-9TZ_=/+-]+")
ONE_CASE = re.compile(r"[A-Z]?[a-z_=-]+|[A-Z_=-]+")

_LOADED: dict[str, tiktoken.Encoding] = {}


def load(path: str, pattern: str) -> tiktoken.Encoding:
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that are long enough."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and rules of signs are not secrets."""
    return bool(NUMBER.fullmatch(run) or UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and ALL_HEX.fullmatch(run))


def identifier(run: str, count, max_ratio: float) -> bool:
    """Words in one case, joined by signs."""
    parts = [x for x in re.split("[_=-]+", run) if x]
    if len(parts) < 2 or not ONE_CASE.fullmatch(run):
        return False
    return all((n := len(count(x))) == 1 or len(x) >= max_ratio * n for x in parts)


def apart(runs: Iterator[re.Match], spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The runs that touch none of the spans (start, kind, end); both in order of their starts, so that one walk does."""
    at, end = 0, 0  # spans before ``at`` begin before the run ends, the last of them to end does so at ``end``
    for m in runs:
        while at < len(spans) and spans[at][0] < m.end():
            end, at = max(end, spans[at][2]), at + 1
        if end <= m.start():
            yield m


def find_secrets(docs: DataFrame, path: str, pattern: str, text: str = "text", min_length: int = 20,
                 max_ratio: float = 2.2, short_length: int = 16, short_ratio: float = 1.8) -> DataFrame:
    """row (a struct of the columns of ``docs`` but the text) and spans: array of (kind, start, end).

    path, pattern: a tiktoken vocabulary file that every executor can read, and its rule for words.
    """
    rows = docs.select(row_of(docs, text).alias("row"), whole_text(text).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["row"], T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, runs = load(path, pattern).encode_ordinary, re.compile(RUN % min(short_length, min_length)).finditer
        for batch in batches:
            out = []
            for value in batch.column(1):
                x = value.as_py()
                found = pattern_spans(x)
                extra = [(m.start(), 3, m.end()) for m in apart(runs(x), found) if not known(m[0])
                         and len(m[0]) < (max_ratio if len(m[0]) >= min_length else short_ratio) * len(count(m[0]))
                         and not identifier(m[0], count, max_ratio)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found + extra)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow_span)], ["row", "spans"])

    return rows.mapInArrow(run, schema)
