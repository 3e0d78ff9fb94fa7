"""Repairs against a plain relaxation over the whole lattice, in one segment and in many."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from conftest import SF_SMALL
from regionscore.llm import conversation_repair as cr
from regionscore.llm.queries import QUERIES
from regionscore.sources.tables import read_table

SCHEMA = "conv_id long, turn long, role string, text string, cost string, `range` int, `a.b` int"


def brute_best(rows):
    """Least (cost, audit) by relaxing every edge until nothing changes."""
    grammar = re.compile(r"(s?(ua)+)?")
    state = {"": 0, "s": 1, "u": 2, "a": 3}
    best = {(0, 0): (0, "")}
    todo = collections.deque(best)
    while todo:
        i, q = todo.popleft()
        cost, audit = best[i, q]
        steps = [(i, {0: "u", 1: "u", 2: "a", 3: "u"}[q], 2, "I")]
        if i < len(rows):
            first, fault = rows[i]
            steps.append((i + 1, None, 3, "D"))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                steps.append((i + 1, {0: "u", 1: "u", 2: "a", 3: "u"}[q], 2 + extra, "R"))
                if first in {0: "su", 1: "u", 2: "a", 3: "u"}[q]:
                    steps.append((i + 1, first, extra, "K"))
        for j, letter, w, edit in steps:
            at = (j, q if letter is None else state[letter])
            label = (cost + w, audit + edit)
            if label[0] <= 3 * len(rows) and (at not in best or label < best[at]):
                best[at] = label
                todo.append(at)
    assert grammar.fullmatch("") and grammar.fullmatch("suaua")
    return min(best[x] for x in ((len(rows), 0), (len(rows), 3)) if x in best)


def brute_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]  # noqa: B018
        said = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(said).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append((role[:1] or " ", "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
        seen.add((role, text))
    cost, audit = brute_best(faults)
    said, k, q = [], 0, ""
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[q]
        if edit == "K":
            role = rows[k][1]
        said.append(f"{role}:{'' if edit == 'I' else rows[k][2]}")
        k += edit != "I"
        q = role[:1]
    turns = {t for t, _, _ in rows if t is not None}
    count = collections.Counter(f for _, f in faults)
    letters = [x for x, _ in faults]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters)), cost, audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest())


def test_search_equals_relaxation():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice("suaux "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(9))]
        named = [(a, ["", "blank", "duplicate", "truncated"][f]) for a, f in rows]
        assert cr.cheapest(rows, cr.NOTHING, cr.ENDS) == brute_best(named), rows


def conversations():
    rng, rows = random.Random(1), []
    texts = ["Yes.", "No!", "And then", "", " \t", None, "What? ", "\x85"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    for conv in [*range(60), None]:
        for k in range(rng.randrange(12)):
            role = roles[k % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, None if rng.random() < 0.05 else k + 3 * (rng.random() < 0.1), role, f"Turn {k}." if rng.random() < 0.6 else rng.choice(texts)))
    rows += [(7, 5000 + k // 2, roles[k % 2], f"Long {k % 90}." if k % 3 else "cut off") for k in range(900)]
    rows += [(1000, 1, "user", "x" * 300_000 + "."), (1000, 2, "assistant", "y " * 200_000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"most_rows": 3}, {"most_chars": 20}])
def test_conversations_in_segments(spark, options):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", 7, 7) for r in rows], SCHEMA).repartition(3)
    got = cr.repaired_or_empty(df, cr.damaged(df), **options).collect()
    expect = {c: brute_repair(r) for c, r in brute_damage(rows).items()}
    assert len(got) == len(expect)
    assert {r.conv_id: tuple(r)[1:] for r in got} == expect


def test_one_conversation_holds_nearly_all(spark, monkeypatch):
    """Joined over several rounds, with repeats far apart."""
    monkeypatch.setattr(cr, "JOINED", 3)
    rows = [(1, k, ["user", "assistant"][k % 2], f"Line {k % 700}.") for k in range(2000)] + [(2, 1, "user", "Hm.")]
    df = spark.createDataFrame([(*r, "clash", 7, 7) for r in rows], SCHEMA)
    got = cr.repair(cr.damaged(df), "conv_key", most_rows=40).collect()
    assert {r.conv_key: tuple(r)[1:] for r in got} == {c: brute_repair(r) for c, r in brute_damage(rows).items() if r}


def test_query_and_empty_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, SF_SMALL)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {c: brute_repair(r) for c, r in brute_damage(rows).items()}
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repaired_or_empty(none, cr.damaged(none)).count() == 0
