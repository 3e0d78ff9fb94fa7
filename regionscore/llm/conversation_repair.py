"""Operator 13: conversation structure repair by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state of what is written); the states are
nothing, a system turn, a user turn, an assistant turn, and the legal ends are
nothing and an assistant turn, so that initials read ``(s?(ua)+)?``. Edges keep a
row, set its role, delete it, or insert an empty turn. A forward and a reverse
heap settle nodes by cost, the side with the smaller top first; every edge from a
node settled forward to one settled in reverse is a crossing. Both go on as long
as their tops could still meet at the least cost found, so that all crossings of
that cost are seen, and the least concatenated audit wins. Of two audits of one
cost at one node none begins the other (the rest would be insertions, which
cost), hence the least prefix and suffix of each node make the least audit.

Scale: rows are stored by ranges of (conversation, turn, role, text, place) and
read in that order; Python holds a segment of one conversation, of at most
``rows`` rows or ``chars`` characters. A conversation inside a segment is solved
there. Of a longer one, or one over the edge of two ranges, each segment gives a
matrix: for each state it may be entered and left in, the cheapest, least audit.
Matrices are joined in groups of at most ``JOINED``, round by round, so that a
conversation with a third of all rows is no task of its own. Its repeated turns
are found by Spark (least place of equal role and text), those of others by a set
in the task. What stays in order of size one is the contract's digest: SHA-256 of
a whole conversation is one chain, so that one task reads its repaired segments
one after the other, without holding them.

Defined results: a null role or text counts as one space; an empty role has the
initial of one space, which no legal sequence has; turns in order, null first,
rows of one turn by role, text and place in the input; null is a conversation of
its own; a conversation without rows has zeros, an empty audit and the digest of
nothing; repeated rows are duplicates; an empty table gives no rows. Other
columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from regionscore.llm.common import shared_table
from regionscore.llm.ordering import in_ranges

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: What may follow each state: initial and state.
FOLLOWS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state and role that a set or inserted turn has in each state.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Matrices joined at once.
JOINED = 64

SUMMARY = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
SEGMENT = ("conv_key {conv}, `range` int, segment int, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, "
           "turns long, first_initial string, last_initial string, first_turn {turn}, last_turn {turn}, cost long, audit string, "
           "digest string, cells array<struct<enter:int,leave:int,cost:long,audit:string,via:array<struct<`range`:int,segment:int,enter:int,leave:int>>>>, "
           "roles array<string>, texts array<string>")


def initial(role: str) -> str:
    return role[:1] or " "


def edges(q: int, row: tuple[str, int] | None) -> Iterator[tuple[str, int, int, int]]:
    """From state q with ``row`` (initial, fault) next: letter, cost, rows read, new state."""
    yield "I", INSERT, 0, NEXT[q]
    if row is None:
        return
    first, fault = row
    yield "D", DELETE, 1, q
    if fault not in (BLANK, DUPLICATE):
        more = fault == TRUNCATED
        yield "R", REROLE + more, 1, NEXT[q]
        if first in FOLLOWS[q]:
            yield "K", KEEP + more, 1, FOLLOWS[q][first]


def cheapest(rows: list[tuple[str, int]], enter: int, leaves: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, and the least audit of that cost, from state ``enter`` over all rows to one of ``leaves``."""
    n = len(rows)
    ahead: dict = {(0, enter): (0, "")}
    behind: dict = {(n, q): (0, "") for q in leaves}
    # among equal costs the rows farthest from the goal of a heap come first: only keeping is free, and it reads a row
    front, back = [(0, 0, enter)], [(0, 0, q) for q in leaves]
    heapq.heapify(back)
    ahead_done: set = set()
    behind_done: set = set()
    best = None

    def crossing(cost, audit):
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    into: dict = {}

    def before(i: int, q: int):
        """Edges into (i, q): letter, cost, the node they come from."""
        row = rows[i - 1] if i else None
        key = (row, q)
        if key not in into:
            into[key] = [(letter, cost, read, p) for p in range(4) for letter, cost, read, to in edges(p, row) if to == q]
        return into[key]

    while front or back:
        if best is not None and (not front or not back or front[0][0] + back[0][0] > best[0]):
            break
        if front and (not back or front[0][0] <= back[0][0]):
            cost, i, q = heapq.heappop(front)
            if (i, q) in ahead_done:
                continue
            ahead_done.add((i, q))
            audit = ahead[i, q][1]
            if (i, q) in behind_done:
                crossing(cost + behind[i, q][0], audit + behind[i, q][1])
            for letter, w, read, to in edges(q, rows[i] if i < n else None):
                at, label = (i + read, to), (cost + w, audit + letter)
                if at in behind_done:
                    crossing(label[0] + behind[at][0], label[1] + behind[at][1])
                if at not in ahead_done and (at not in ahead or label < ahead[at]):
                    if at not in ahead or label[0] < ahead[at][0]:
                        heapq.heappush(front, (label[0], at[0], to))
                    ahead[at] = label
        else:
            cost, j, q = heapq.heappop(back)
            i = n - j
            if (i, q) in behind_done:
                continue
            behind_done.add((i, q))
            audit = behind[i, q][1]
            if (i, q) in ahead_done:
                crossing(ahead[i, q][0] + cost, ahead[i, q][1] + audit)
            for letter, w, read, p in before(i, q):
                at, label = (i - read, p), (cost + w, letter + audit)
                if at in ahead_done:
                    crossing(ahead[at][0] + label[0], ahead[at][1] + label[1])
                if at not in behind_done and (at not in behind or label < behind[at]):
                    if at not in behind or label[0] < behind[at][0]:
                        heapq.heappush(back, (label[0], n - at[0], p))
                    behind[at] = label
    return best


def applied(audit: str, enter: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The turns that an audit leaves, from state ``enter`` on."""
    q, k = enter, 0
    for letter in audit:
        if letter == "I":
            q = NEXT[q]
            yield ROLE[q], ""
            continue
        if letter == "R":
            q = NEXT[q]
            yield ROLE[q], texts[k]
        elif letter == "K":
            q = FOLLOWS[q][initial(roles[k])]
            yield roles[k], texts[k]
        k += 1


class Segment:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv, range_, number):
        self.conv, self.range, self.number = conv, range_, number
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.rows: list[tuple[str, int]] = []
        self.turns: list = []
        self.chars = 0

    def add(self, turn, role, text, again):
        solid = text.rstrip(SPACE)
        fault = BLANK if not solid else DUPLICATE if again else 0 if solid[-1] in ".!?" else TRUNCATED
        self.rows.append((initial(role), fault))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def result(self, whole: bool) -> dict:
        letters, faults = [r[0] for r in self.rows], [r[1] for r in self.rows]
        out = {"conv_key": self.conv, "range": self.range, "segment": self.number, "whole": whole, "n": len(self.rows),
               "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
               "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False)), "turns": len(self.turns),
               "first_initial": letters[0], "last_initial": letters[-1], "first_turn": self.turns[0] if self.turns else None,
               "last_turn": self.turns[-1] if self.turns else None}
        if whole:
            cost, audit = cheapest(self.rows, NOTHING, ENDS)
            said = "\n".join(f"{r}:{t}" for r, t in applied(audit, NOTHING, self.roles, self.texts))
            return out | {"cost": cost, "audit": audit, "digest": hashlib.sha256(said.encode()).hexdigest(),
                          "cells": None, "roles": None, "texts": None}
        cells = []
        for enter in range(4):
            for leave in range(4):
                if (found := cheapest(self.rows, enter, (leave,))) is not None:
                    cells.append({"enter": enter, "leave": leave, "cost": found[0], "audit": found[1], "via": [
                        {"range": self.range, "segment": self.number, "enter": enter, "leave": leave}]})
        return out | {"cost": None, "audit": None, "digest": None, "cells": cells, "roles": self.roles, "texts": self.texts}


def segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (range, conversation, turn, ...) as segments, one output row each."""
    at, seen, out = None, set(), []
    edge = True  # no other conversation of this range came before
    for batch in batches:
        for conv, range_, turn, role, text, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            same = at is not None and at.range == range_
            if same and at.conv == conv:
                if len(at.rows) >= rows or at.chars >= chars:
                    out.append(at.result(False))
                    at = Segment(conv, range_, at.number + 1)
            else:
                if at is not None:
                    out.append(at.result(same and not edge and at.number == 0))
                edge, seen = not same, set()
                at = Segment(conv, range_, 0)
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            at.add(turn, role, text, again or key in seen)
            seen.add(key)
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if at is not None:
        out.append(at.result(False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def joined(parts: list[dict]) -> dict:
    """Several neighbouring segments of one conversation, in order, as one."""
    out = dict(parts[0])
    table = {(c["enter"], c["leave"]): (c["cost"], c["audit"], [c["via"]]) for c in out["cells"]}
    for p in parts[1:]:
        out["illegal"] += p["illegal"] + (out["last_initial"] + p["first_initial"] not in LEGAL)
        shared = out["last_turn"] is not None and out["last_turn"] == p["first_turn"]
        out["turns"] += p["turns"] - shared
        for c in ("n", "blank", "duplicate", "truncated"):
            out[c] += p[c]
        out["last_initial"] = p["last_initial"]
        out["first_turn"] = p["first_turn"] if out["first_turn"] is None else out["first_turn"]
        out["last_turn"] = out["last_turn"] if p["last_turn"] is None else p["last_turn"]
        more = {}
        for (a, b), (cost, audit, via) in table.items():
            for c in p["cells"]:
                if c["enter"] == b:
                    found = (cost + c["cost"], audit + c["audit"])
                    if (a, c["leave"]) not in more or found < more[a, c["leave"]][:2]:
                        more[a, c["leave"]] = (*found, [*via, c["via"]])
        table = more
    out["cells"] = [{"enter": a, "leave": b, "cost": cost, "audit": audit, "via": [x for v in via for x in v]}
                    for (a, b), (cost, audit, via) in table.items()]
    return out


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_key, turn, role, text and place of the rows, with faults planted by the checksum of ``conversation:turn``."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = rows.select(F.col(f"`{conv_id}`").alias("conv_key"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text"),
                       (F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.filter("kind != 0")
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def repeated_over_ranges(stored: DataFrame) -> DataFrame:
    """``stored`` with again: of conversations that lie in several ranges, whether role and text came before."""
    span = stored.groupBy("conv_key").agg(F.min("range").alias("a"), F.max("range").alias("b")).filter("a < b").select("conv_key")
    span = F.broadcast(shared_table(span, "spanning"))  # fewer than ranges
    rest = stored.alias("r").join(span.alias("s"), F.expr("r.conv_key <=> s.conv_key"), "left_anti")
    over = stored.alias("r").join(span.alias("s"), F.expr("r.conv_key <=> s.conv_key"), "left_semi")
    first = over.groupBy("conv_key", "role", "text").agg(F.min(F.struct("turn", "place")).alias("first"), F.count("*").alias("k")).filter("k > 1")
    over = over.alias("r").join(first.alias("f"), F.expr("r.conv_key <=> f.conv_key and r.role = f.role and r.text = f.text"), "left").select(
        "r.*", F.coalesce(F.expr("struct(r.turn, r.place) > f.first"), F.lit(False)).alias("again"))
    return rest.withColumn("again", F.lit(False)).unionByName(over)


def in_segments(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, most_rows: int, most_chars: int) -> DataFrame:
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = rows.select(F.col(f"`{conv_id}`").alias("conv_key"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text"),
                       F.monotonically_increasing_id().alias("place"))
    order = [F.col("conv_key").asc_nulls_first(), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "text", "place"))]
    stored = in_ranges(rows, order, "turns")
    types = {"conv": stored.schema["conv_key"].dataType.simpleString(), "turn": stored.schema["turn"].dataType.simpleString()}
    schema = SEGMENT.format(**types)
    arrow = to_arrow_schema(stored.sparkSession.createDataFrame([], schema).schema)
    read = (repeated_over_ranges(stored).repartition("range").sortWithinPartitions("range", *order)
            .select("conv_key", "range", "turn", "role", "text", "again"))
    return shared_table(read.mapInArrow(lambda batches: segments(batches, arrow, most_rows, most_chars), schema), "segments")


def join_rounds(parts: DataFrame) -> DataFrame:
    """One row per conversation of those in several segments."""
    schema, names = parts.schema, parts.columns
    arrow = to_arrow_schema(schema)

    def join_group(table: pa.Table) -> pa.Table:
        first = lambda r: (r["cells"][0]["via"][0]["range"], r["cells"][0]["via"][0]["segment"])
        found = sorted(table.to_pylist(), key=first)
        return pa.Table.from_pylist([joined(found)], arrow)

    most = parts.agg(F.max("segment").alias("segment"), F.max("range").alias("range")).first()
    for c, keys in (("segment", ["conv_key", "range"]), ("range", ["conv_key"])):
        top = most[c] or 0
        while top > 0:
            parts = parts.withColumn(c, F.floor(F.col(c) / JOINED).cast("int"))
            parts = shared_table(parts.groupBy(*keys, c).applyInArrow(join_group, schema).select(*names), "joined")
            top //= JOINED
    return parts


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation whose repaired segments come in order."""
    def done():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_key", "digest"])

    digest, conv, some, kind = None, None, False, None
    for batch in batches:
        kind = batch.schema.field("conv_key").type
        for row in batch.to_pylist():
            if digest is None or row["conv_key"] != conv:
                if digest is not None:
                    yield done()
                digest, conv, some = hashlib.sha256(), row["conv_key"], False
            for role, text in applied(row["audit"], row["enter"], row["roles"], row["texts"]):
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
    if digest is not None:
        yield done()


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           most_rows: int = 256, most_chars: int = 4_000_000) -> DataFrame:
    """One row per conversation that has rows: conv_key, gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    found = in_segments(rows, conv_id, turn, role, text, most_rows, most_chars)
    ends = ["conv_key", *SUMMARY[1:], "first_turn", "last_turn", "cost", "audit", "digest"]
    parts = found.filter("not whole")
    if not parts.isEmpty():
        light = parts.drop("roles", "texts")
        best = F.array_min(F.transform(F.filter("cells", lambda c: (c.enter == NOTHING) & c.leave.isin(*ENDS)),
                                       lambda c: F.struct(c.cost.alias("cost"), c.audit.alias("audit"), c.via.alias("via"))))
        long = shared_table(join_rounds(light).withColumn("best", best), "long")
        way = long.select("conv_key", F.explode("best.via").alias("v")).select("conv_key", "v.*")
        part = (parts.alias("p").join(way.alias("w"), F.expr("p.conv_key <=> w.conv_key and p.`range` = w.`range` and p.segment = w.segment"))
                .select("p.conv_key", "p.range", "p.segment", "w.enter", "p.roles", "p.texts",
                        F.expr("filter(p.cells, c -> c.enter = w.enter and c.leave = w.leave)[0].audit").alias("audit")))
        kind = found.schema["conv_key"].dataType.simpleString()
        digests = (part.repartition("conv_key").sortWithinPartitions("conv_key", "range", "segment")
                   .mapInArrow(chained, f"conv_key {kind}, digest string"))
        long = long.alias("l").join(digests.alias("d"), F.expr("l.conv_key <=> d.conv_key"))
        long = long.select("l.conv_key", *[f"l.{c}" for c in [*SUMMARY[1:], "first_turn", "last_turn"]],
                           "l.best.cost", "l.best.audit", "d.digest")
        found = found.filter("whole").select(ends).unionByName(long.select(ends))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return found.select("conv_key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest")


def repaired_or_empty(conversations: DataFrame, rows: DataFrame, conv_id: str = "conv_id", **options) -> DataFrame:
    """``repair`` of ``rows`` (as ``damaged`` gives them), with a row for every conversation of ``conversations``."""
    every = conversations.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.count("*").alias("rows"))
    found = repair(rows, "conv_key", **options)
    none = {"audit": F.lit(""), "digest": F.lit(hashlib.sha256(b"").hexdigest())}
    zero: Column = F.lit(0).cast("long")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    return every.join(found, F.expr("conv_id <=> conv_key"), "left").select(
        "conv_id", *[F.coalesce(F.col(c), none.get(c, zero)).alias(c) for c in names])
