"""Repaired conversations against a plain search over strings of edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import oracle_check
import pytest

from assetloom.llm import conversation, queries

SF = f"{oracle_check.DATA}/sf0.001"
WS = " \t\n\v\f\r"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_damage(rows):
    out = {}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        mine = out.setdefault(c, [])
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        mine += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """Best (cost, audit) to each state row by row, as whole strings; the winner is replayed."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    turns = [t for t, _, _ in rows if t is not None]
    count = dict.fromkeys(FIELDS, 0) | {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0}
    faults, seen = [], set()
    for _, r, x in rows:
        core = x.strip(WS)
        fault = "blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((r, x))
        faults.append(fault)
        if fault:
            count[fault] += 1
    initials = [r[:1] for _, r, _ in rows]
    count["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for s, (c, e) in list(best.items()):
                best[after[s]] = min(best.get(after[s], (9e9, "")), (c + 2, e + "I"))
        return best
    best = {"": (0, "")}
    for fault, i in zip(faults, initials):
        new = {}
        for s, (c, e) in inserted(best).items():
            options = [(s, c + 3, e + "D")]
            if fault not in ("blank", "duplicate"):
                add = fault == "truncated"
                options.append((after[s], c + 2 + add, e + "R"))
                if i == after[s] or (s == "" and i == "s"):
                    options.append((i, c + add, e + "K"))
            for to, cost, edits in options:
                new[to] = min(new.get(to, (9e9, "")), (cost, edits))
        best = new
    best = inserted(best)
    count["cost"], count["audit"] = min(best[s] for s in ("", "a") if s in best)
    lines, at, s = [], iter(rows), ""
    for e in count["audit"]:
        name = "user" if after[s] == "u" else "assistant"
        if e == "I":
            lines.append(f"{name}:")
            s = after[s]
            continue
        _, r, x = next(at)
        if e == "D":
            continue
        r = name if e == "R" else r
        s = r[0]
        lines.append(f"{r}:{x}")
    count["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return tuple(count[f] for f in FIELDS)


def by_operator(spark, rows, damage=False):
    df = spark.createDataFrame(rows, SCHEMA)
    out = conversation.digested(conversation.repair(conversation.damaged(df) if damage else df, ids=df)).collect()
    assert len(out) == len({r.conv_id for r in out})
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in out}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op13_conversation"](spark, SF).collect()}
    assert got == {c: plain_repair(v) for c, v in plain_damage(rows).items()}


def test_random_conversations(spark, monkeypatch):
    """Short chunks, so that conversations have many; roles and texts that tie, repeat and are null."""
    monkeypatch.setattr(conversation, "CHUNK", 7)
    pick = random.Random(5)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "u"], ["Yes.", "No", "Why?", "", " \n", None, "ok."]
    rows = []
    for c in [None, *range(150)]:
        n = pick.choice([1, 2, 5, 9, 60])
        for k in range(n):
            words = pick.choice([*texts, f"line {k}.", f"line {k}"])
            rows.append((c, pick.choice([k, k, k, None, n - k]), pick.choice(roles), words))
    clean = {}
    for c, t, r, x in rows:
        clean.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert by_operator(spark, rows) == {c: plain_repair(v) for c, v in clean.items()}
    assert by_operator(spark, rows, damage=True) == {c: plain_repair(v) for c, v in plain_damage(rows).items()}


def test_long_conversation_and_shared_rules(spark):
    pick = random.Random(8)
    rows = [(1, k, pick.choice(["user", "assistant", "system"]), pick.choice(["Yes.", "and", f"n{k}."])) for k in range(9000)]
    rows += [(c, k, ("user", "assistant")[k % 2], f"{c} {k}.") for c in range(2, 60) for k in range(40)]
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r, x))
    assert by_operator(spark, rows) == {c: plain_repair(v) for c, v in want.items()}
    out = conversation.repair(spark.createDataFrame(rows, SCHEMA))
    kept = out.where("conv_id = 7 and at > 0").orderBy("at").collect()
    assert [(r.at, r.edit, r.role, r.text) for r in kept] == [(k + 1, "K", ("user", "assistant")[k % 2], f"7 {k}.") for k in range(40)]


def test_one_matrix_per_rule():
    """A rule's matrix equals the product over the rows it stands for, ties included."""
    pick = random.Random(3)
    grammar = conversation.Grammar()
    for turn in range(5):
        pairs = {(pick.randrange(len(grammar.parts)), pick.randrange(len(grammar.parts))) for _ in range(12)}
        grammar.add([(p, conversation._product(grammar.transfers[p[0]], grammar.transfers[p[1]])) for p in sorted(pairs)])

    def leaves(s):
        return [s] if grammar.parts[s] is None else leaves(grammar.parts[s][0]) + leaves(grammar.parts[s][1])
    for s in range(16, len(grammar.parts)):
        rows, t = leaves(s), grammar.transfers[s]
        for p in range(4):
            best = {p: (0, "")}
            for x in rows:
                row, new = conversation._row(x), {}
                for a, (c, e) in best.items():
                    for q in range(4):
                        if row.cost[4 * a + q] < conversation.NONE:
                            new[q] = min(new.get(q, (1 << 50, "")), (c + row.cost[4 * a + q], e + row.mid[4 * a + q]))
                best = new
            assert {q: (t.cost[4 * p + q], grammar.edits(s, p, q)) for q in range(4) if t.cost[4 * p + q] < conversation.NONE} == best


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(None, None, None, None)] * 5, [(3, None, "user", "Hi.")]])
def test_odd_tables(spark, rows):
    want = plain_damage(rows)
    assert by_operator(spark, rows, damage=True) == {c: plain_repair(v) for c, v in want.items()}
