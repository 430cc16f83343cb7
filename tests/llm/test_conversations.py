"""Operator 13 against all edits (small) and a plain dynamic programme that carries whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kgrec.llm import conversations as C
from kgrec.llm import queries

SF = "/root/testdata/sf0.001"
ROLES = ["user", "assistant", "system", "tool"]
TURNED = {0: 2, 1: 2, 2: 3, 3: 2}


def kept_state(state, role):
    initial = role[:1]
    return 1 if initial == "s" and state == 0 else TURNED[state] if initial and initial == {2: "u", 3: "a"}[TURNED[state]] else None


def edited(state, cost, audit, out, row):
    """All ways to deal with one row, without insertions."""
    role, text, must_go, truncated = row
    yield state, cost + 4, audit + "D", out
    if not must_go:
        extra = 3 if truncated else 0
        yield TURNED[state], cost + 3 + extra, audit + "R", (*out, (C.ROLE[TURNED[state]], text))
        if kept_state(state, role) is not None:
            yield kept_state(state, role), cost + extra, audit + "K", (*out, (role, text))


def inserted(state, cost, audit, out, most):
    for _ in range(most + 1):
        yield state, cost, audit, out
        state = TURNED[state]
        cost, audit, out = cost + 3, audit + "I", (*out, (C.ROLE[state], ""))


def by_all_edits(rows):
    ways = [(0, 0, "", ())]
    for row in rows:
        ways = [w for way in ways for more in inserted(*way, 3) for w in edited(*more, row)]
    return min((c, a, o) for way in ways for s, c, a, o in inserted(*way, 3) if s in (0, 3))


def by_whole_audits(rows):
    best = {0: (0, "", ())}
    for row in rows:
        new = {}
        for state, way in best.items():
            for more in inserted(state, *way, 2):
                for s, *w in edited(*more, row):
                    new[s] = min(new.get(s, (1 << 60,)), tuple(w))
        best = new
    return min((c, a, o) for state, way in best.items() for s, c, a, o in inserted(state, *way, 2) if s in (0, 3))


def letters(rows):
    return "".join("-" if gone else (i.upper() if cut else i) for role, _, gone, cut in rows for i in [role[:1] if role[:1] in tuple("sua") else "x"])


def ours(rows, size=None):
    code = letters(rows)
    blocks = [code[k:k + size] for k in range(0, len(code), size)] if size else [code]
    way, cost = C.through([C.transfer(b) for b in blocks if b])
    return cost, "".join(C.hirschberg(b, way[k], way[k + 1]) for k, b in enumerate(blocks) if b) + C.TAIL[way[-1]]


def test_audits_are_the_least_of_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(ROLES), str(k), rng.random() < 0.25, rng.random() < 0.3) for k in range(rng.randint(0, 3))]
        want = by_all_edits(rows)
        assert want == by_whole_audits(rows)
        assert ours(rows) == want[:2]


def test_long_conversations_in_blocks():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice(ROLES), str(k), rng.random() < 0.2, rng.random() < 0.3) for k in range(rng.randint(1, 120))]
        want = by_whole_audits(rows)[:2]
        assert ours(rows) == want == ours(rows, rng.randint(1, 9))


def expected(raw):
    said = lambda v: " " if v is None else str(v)
    conversations = {}
    for conv, turn, role, text in raw:
        rows = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in rows:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, kept = by_whole_audits(marked)
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal,
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark):
    raw = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_hirschberg_repair(spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(raw) and len(got) == len({r[0] for r in raw})


SCHEMA = "conv_id bigint, turn bigint, role string, text string, at int, audit string, block string"


def test_odd_rows_and_one_hot_conversation(spark):
    rng = random.Random(3)
    raw = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(200)]), rng.choice([*ROLES, None, "", "ß", "s\nx"]),
            rng.choice([None, "", " \t", "a.", "b", "c! ", "d?\n", "e.x", "ok. ", f"{rng.random()}.", "long " * 4000 + "end."])) for _ in range(900)]
    raw += [raw[0]] * 5 + [(k, None, "user", "hi.") for k in (50, 51)] + [(k, 1, None, None) for k in range(60, 90)]
    rows = spark.createDataFrame([(*r, 1, "a", "b") for r in raw], SCHEMA).repartition(6)
    got = C.repair(C.damaged(rows), rows).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(raw)
    assert len(got) == len({r[0] for r in raw})


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damaged(rows), rows).count() == 0


@pytest.mark.parametrize("n", [1, 2000])
def test_all_rows_gone(spark, n):
    rows = spark.createDataFrame([(1, k, "user", " ") for k in range(n)], "conv_id bigint, turn bigint, role string, text string")
    (got,) = C.repair(rows, rows).collect()
    assert got.repaired_sha256 == hashlib.sha256(b"").hexdigest() and got.audit == "D" * n and got.cost == 4 * n and got.blank == n
