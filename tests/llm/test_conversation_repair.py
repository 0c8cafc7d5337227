"""Conversation repair against a search over all edits of the grammar's states, and against every edit sequence of short conversations."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from motion_tables.llm.conversation_repair import align, audits, damage, repair_conversations, repaired_turns
from motion_tables.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import same

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """The least (cost, audit), state by state: what may follow is decided by the last initial alone."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit, kept) in list(best.items()):
                nxt = due[state]
                new = (cost + 3, audit + "I", (*kept, ({"u": "user", "a": "assistant"}[nxt], "")))
                best[nxt] = min(best.get(nxt, new), new)
        return best

    for (_, _, role, text), fault in zip(rows, found):
        after = {}
        for state, (cost, audit, kept) in inserts(best).items():
            options = [(state, (cost + 4, audit + "D", kept))]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] == due[state] or role[:1] == "s" and state == "":
                    options.append((role[:1], (cost + extra, audit + "K", (*kept, (role, text)))))
                options.append((due[state], (cost + extra + 3, audit + "R", (*kept, ({"u": "user", "a": "assistant"}[due[state]], text)))))
            for s, new in options:
                after[s] = min(after.get(s, new), new)
        best = after
    best = inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(original, rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in original}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[1] for r in own if r[1] is not None]
        found = faults(own)
        cost, audit, kept = cheapest(own, found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)
    return out


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = QUERIES["op11_conversation_repair"](spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(got) == brute(rows, damaged(rows))


def test_query_against_sql(spark):
    same(spark, "/root/testdata/sf0.01", QUERIES["op11_conversation_repair"], ORACLE_SQL["op11_conversation_repair"])


def test_random_conversations(spark):
    r = np.random.default_rng(5)
    texts = ["one.", "two!", "three", "", " \n", "four?", "five .\t", None, "six "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, int(t) if t < 30 else None, roles[r.integers(len(roles))], texts[r.integers(len(texts))] if r.random() < 0.4 else f"text {t}" + ".?! x"[r.integers(5)]) for c in range(120) for t in r.permutation(40)[: r.integers(1, 25)]]
    rows = [x for i, x in enumerate(rows) if x[1] is not None or not any(y[0] == x[0] and y[1] is None for y in rows[:i])]
    rows += [(None, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    plain = [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    assert as_dict(repair_conversations(df)) == brute(plain, plain)
    assert as_dict(repair_conversations(damage(df), df)) == brute(rows, damaged(rows))


def test_alignment_is_the_cheapest_of_all_edit_sequences():
    grammar = re.compile("(s?(ua)+)?")
    for kinds in itertools.product("suax", repeat=2):
        for states in itertools.product(range(3), repeat=2):
            codes = bytes(3 * "suax".index(k) + s for k, s in zip(kinds, states))
            best = None
            for slots in itertools.product(("", "u", "a", "ua", "au"), repeat=3):
                for edits in itertools.product("DKua", repeat=2):
                    if any(e != "D" and s == 2 for e, s in zip(edits, states)):
                        continue
                    text, audit, cost = "", "", 0
                    for i in range(3):
                        text, audit, cost = text + slots[i], audit + "I" * len(slots[i]), cost + 3 * len(slots[i])
                        if i < 2:
                            e = edits[i]
                            text += "" if e == "D" else kinds[i] if e == "K" else e
                            audit += e if e in "DK" else "R"
                            cost += 4 if e == "D" else (0 if e == "K" else 3) + 3 * (states[i] == 1)
                    if grammar.fullmatch(text) and (best is None or (cost, audit) < best):
                        best = cost, audit
            assert align(codes) == best


def test_long_conversations_stay_narrow():
    r = np.random.default_rng(1)
    n = 20_000
    roles = np.array(["user", "assistant"] * (n // 2))
    roles[r.random(n) < 0.05] = "user"
    rows = [(1, i, roles[i], "x" * (r.random() > 0.03) + ".!"[i % 2] * (r.random() > 0.1) + f"{i}." * (r.random() > 0.05)) for i in range(n) if r.random() > 0.05]
    found = faults(rows)
    state = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
    codes = bytes(3 * "sua".index(row[2][0]) + state[f] for row, f in zip(rows, found))
    cost, audit = align(codes)
    # the search keeps whole audits, so it is held against a tenth
    assert align(codes[:2000]) == cheapest(rows[:2000], found[:2000])[:2]
    assert cost > 0 and sum(c != "I" for c in audit) == len(rows)


def test_repaired_turns_match_the_digests(spark):
    df = damage(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    want = {r.conv_id: r.repaired_sha256 for r in repair_conversations(df).collect()}
    got = {}
    for r in sorted(repaired_turns(df).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    empty = hashlib.sha256().hexdigest()
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in got.items()} == {k: v for k, v in want.items() if k in got}
    assert all(v == empty for k, v in want.items() if k not in got)


def test_edges(spark):
    kind = "conv_id string, turn int, role string, text string, cost string, audit int, grp string, same int"
    none = spark.createDataFrame([], kind)
    assert repair_conversations(none).count() == 0 and audits(none).count() == 0 and repaired_turns(none).count() == 0
    rows = [(None, None, None, None, "x", 1, "y", 2)] * 2 + [("a", 1, "user", "hi." * 200_000, None, 1, None, 2), ("a", 1, "user", "hi." * 200_000, None, 1, None, 2), ("b", 3, "", "ok.", None, None, None, None)]
    got = {r.conv_id: r for r in repair_conversations(spark.createDataFrame(rows, kind)).collect()}
    assert got[None].audit == "DD" and got[None].blank == 2 and got[None].cost == 8
    assert got["a"].audit == "KDI" and got["a"].duplicate == 1 and got["a"].cost == 7
    assert got["b"].audit == "D" and got["b"].cost == 4
