"""Conversation repair against a plain row-by-row version and full enumeration."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from fieldsense.llm import conversations as C
from fieldsense.llm import transfer as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        def s(v):
            return " " if v is None else str(v)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_cost(marks):
    """Cheapest (cost, audit): a table over rows and states, audits as plain strings."""
    def insert(best):
        for _ in range(3):
            for (state, role), to in STEP.items():
                if role != "s" and state in best:
                    new = (best[state][0] + 3, best[state][1] + "I")
                    best[to] = min(best.get(to, new), new)
        return best

    best = insert({"": (0, "")})
    for initial, fault in marks:
        after = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for role in "sua":
                    to = STEP.get((state, role))
                    if to is not None and role == initial:
                        ways.append((to, extra, "K"))
                    if to is not None and role != "s":
                        ways.append((to, 3 + extra, "R"))
            for to, c, mark in ways:
                new = (cost + c, audit + mark)
                after[to] = min(after.get(to, new), new)
        best = insert(after)
    return min(best[s] for s in ("", "a") if s in best)


def plain_repair(rows, conversations):
    """Report rows by conversation."""
    out = {}
    for conv in conversations:
        mine = [r for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:C.HEAD], hashlib.sha256(r[3].encode()).digest()))
        seen, marks = set(), []
        for _, _, role, text in mine:
            body = text.rstrip(WHITE)
            marks.append((role[:1], "blank" if not body else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit = plain_cost(marks)
        turns = [r[1] for r in mine if r[1] is not None]
        lines, state, left = [], "", iter(mine)
        for mark in audit:
            role, text = ("", "") if mark == "I" else next(left)[2:]
            if mark in "IR":
                role = "assistant" if state == "u" else "user"
            if mark != "D":
                state = STEP[state, role[0]]
                lines.append(f"{role}:{text}")
        faults = [f for _, f in marks]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p + q not in ("su", "ua", "au") for (p, _), (q, _) in zip(marks, marks[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def report(df):
    out = {}
    for r in df.collect():
        assert r["conv_id"] not in out
        out[r["conv_id"]] = tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                                 "repaired_sha256"))
    return out


def check(spark, rows, parts=3, columns=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = report(C.repair_report(columns(df) if columns else df, df))
    want = plain_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows],
                        dict.fromkeys(r[0] for r in rows))
    assert got == {k: v[:-1] for k, v in want.items()}
    return want


def some_rows(seed, conversations=40, most=9):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  \n", "Yes.  ", "more words here.", "and then"]
    return [(conv, turn if rnd.random() < 0.9 else None, rnd.choice(["system", "user", "assistant", "user", "assistant",
                                                                     "tool", None, ""]), rnd.choice(texts))
            for conv in range(conversations) for turn in sorted(rnd.choices(range(most + 3), k=rnd.randint(0, most)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version(spark, seed):
    check(spark, some_rows(seed))


def test_long_conversation_over_partitions_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 7)
    rows = some_rows(3, 12) + [(77, t, "user" if t % 3 else "assistant", f"Line {t % 31}." if t % 5 else "open")
                               for t in range(400)] + [(77, 3, "user", "Line 3.")] * 60
    check(spark, rows, parts=5)


def test_query_on_given_table(spark):
    from fieldsense.llm.catalog import QUERIES
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = plain_repair(plain_damage(rows), dict.fromkeys(r[0] for r in rows))
    assert report(QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01")) == {
        k: v[:-1] for k, v in want.items()}


def test_unusual_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, None), (2, 1, "user", "Same."),
            (2, 1, "user", "Same."), (2, 5, "user", "Same."), (2, None, "user", "Same."), (3, 1, "system", "Only."),
            (4, 1, "user", "é" * 200_000 + "."), (4, 2, "assistant", " " * 100_000), (5, 1, "user", "A "),
            (6, -3, "user", "B."), (6, 4, "assistant", " "), (7, 1, "uncle", "x."), (7, 2, "aunt", "y.")]
    want = check(spark, rows, columns=lambda d: d.selectExpr(
        "*", "'x' AS audit", "1 AS copies", "2 AS kind", "3 AS later", "'y' AS head", "0 AS result"))
    assert want[1][6] == "D" and want[7][6] == "KK"


def test_damage_and_empty_tables(spark):
    rows = some_rows(9) + [(None, None, "user", "Hi."), (50, None, None, None)]
    got = sorted(map(repr, (tuple(r) for r in C.damaged(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(map(repr, plain_damage(rows)))
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(empty, empty).count() == 0 and C.repaired(empty).count() == 0
    ids = spark.createDataFrame([(5, 1, "user", "x")], SCHEMA)
    assert report(C.repair_report(empty, ids)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = some_rows(4)
    want = plain_repair([(c, t, " " if r is None else r, x) for c, t, r, x in rows], dict.fromkeys(r[0] for r in rows))
    got: dict = {}
    for r in sorted(C.repaired(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["conv_id"], r["place"])):
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert got == {k: v[-1] for k, v in want.items() if v[-1]}


def legal(audit, marks):
    """Cost of an audit, or None where it is not allowed."""
    state, cost, left = "", 0, iter(marks)
    for mark in audit:
        if mark == "I":
            role, cost = ("a" if state == "u" else "u"), cost + 3
        else:
            initial, fault = next(left)
            if mark == "D":
                cost += 4
                continue
            if fault == "d":
                return None
            cost += 3 * (fault == "t") + 3 * (mark == "R")
            role = initial if mark == "K" else ("a" if state == "u" else "u")
        state = STEP.get((state, role))
        if state is None:
            return None
    return cost if state in ("", "a") else None


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_audit_enumerated(n):
    grammar = T.Grammar([])
    for symbols in itertools.product("dsuaxUA", repeat=n):
        marks = [(s.lower(), "d" if s == "d" else "t" if s.isupper() else "") for s in symbols]
        best = None
        for more in range(n + 2):
            for audit in itertools.product("DIKR", repeat=n + more):
                if audit.count("I") == more:
                    cost = legal(audit, marks)
                    if cost is not None:
                        best = min(best or (cost, "".join(audit)), (cost, "".join(audit)))
        assert grammar.whole("".join(symbols)) == best


def test_grammar_changes_nothing():
    rnd = random.Random(8)
    strings = ["".join(rnd.choices("uaUAsxd", weights=[9, 9, 2, 2, 1, 1, 2], k=rnd.randint(0, 90))) for _ in range(150)]
    rounds, top = [], len(T.SYMBOLS)
    for _ in range(5):
        best = T.pair_counts(((s, 1) for s in strings), rounds).most_common(6)
        rounds.append({p: top + i for i, (p, _) in enumerate(best)})
        top += 6
    plain, grammar = T.Grammar([]), T.Grammar(rounds)
    for s in strings:
        assert grammar.whole(s) == plain.whole(s) == plain_cost(
            [(c.lower(), "blank" if c == "d" else "truncated" if c.isupper() else "") for c in s])
    assert sum(len(T.parsed(s, rounds)) for s in strings) < 0.6 * sum(map(len, strings))


def test_ropes_compare_like_strings():
    rnd = random.Random(3)

    def rope(s, cuts):
        if len(s) < 2 or not cuts:
            return s
        k = rnd.randint(1, len(s) - 1)
        return T.Rope(rope(s[:k], cuts - 1), rope(s[k:], cuts - 1))

    for _ in range(500):
        a = "".join(rnd.choices("DK", weights=[1, 30], k=rnd.randint(1, 120)))
        b = a[:rnd.randint(0, len(a))] + "".join(rnd.choices("DK", weights=[1, 30], k=rnd.randint(0, 40)))
        x, y = rope(a, 5), rope(b, 4)
        assert T.text_of(x) == a and T.less(x, y) == (a < b) and T.less(y, x) == (b < a)
