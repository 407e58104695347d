import re
import zlib
from collections import defaultdict

import pytest

from fieldsense.llm.catalog import ORACLE_SQL, QUERIES
from fieldsense.llm.mix import mix_report, mixed_rows
from fieldsense.llm.shard import byte_shards

ROWS = ([(i, "w " * (i % 37 + 1), None, "hot") for i in range(400)]
        + [(1000 + i, "tok\tX\n" * (1 + i % 5), None, f"s{i % 4}") for i in range(60)]
        + [(2000, None, None, "s1"), (2001, "", None, "s2"), (2002, " ", None, None), (2003, "q r s", None, None),
           (2004, "é " * 900, None, "big"), (2004, "é " * 900, None, "big"), (None, "a b", None, "s0"),
           (None, "a b", None, "s0"), (3000, "", None, "nothing"), (3001, "solo", None, "Z")])


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]


def brute_targets(rows, weights=(3, 1, 2), share=1.5):
    total = defaultdict(int)
    for r, n in zip(rows, sizes(rows)):
        total[r[3]] += n
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] >= 2 * total[s]]
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    return total, target


def test_mix_targets_and_takes(docs_of, clashing):
    total, target = brute_targets(ROWS)
    got = mix_report(clashing(docs_of(ROWS))).collect()
    assert len(got) == len(ROWS)
    source = {r[0]: r[3] for r in ROWS}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in total:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1


def test_mix_is_native_and_repeatable(docs_of):
    a, b = (sorted(map(str, mix_report(docs_of(ROWS, parts=p)).collect())) for p in (2, 5))
    assert a == b
    plan = mix_report(docs_of(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixed_rows_are_the_report(docs_of, clashing):
    d = clashing(docs_of(ROWS))
    mixed = mixed_rows(d)
    assert mixed.columns == d.columns
    rows = mixed.select("doc_id", "text").collect()
    words = sum(len((r.text or "").split()) for r in rows)
    assert words == sum(r.taken for r in mix_report(docs_of(ROWS)).collect())


def test_mix_sql(spark, in_duckdb, docs_of, same_rows):
    same_rows(mix_report(docs_of(ROWS)).drop("target").collect(),
              [{k: v for k, v in r.items() if k != "target"} for r in in_duckdb(ORACLE_SQL["op6_mix_sources"], ROWS)])
    same_rows(QUERIES["op6_mix_sources"](spark, "/root/testdata/sf0.001").collect(),
              in_duckdb(ORACLE_SQL["op6_mix_sources"]))


def test_mix_of_nothing(docs_of):
    assert mix_report(docs_of([])).collect() == []
    empty = mix_report(docs_of([(1, None), (2, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 2


def brute_shards(rows, shards=8):
    d = sorted(((r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows))
    total, at, out, slot = sum(x[3] for x in d), 0, [], defaultdict(int)
    for none, i, crc, size in d:
        s = (2 * at + size) * shards // (2 * total)
        out.append({"doc_id": None if none else i, "size": size, "text_crc32": crc, "law": "bytes", "shard": s,
                    "slot": slot[s], "grown_shard": None})
        slot[s] += 1
        at += size
    return out


def test_shards_against_brute_force(docs_of, clashing, same_rows):
    same_rows(byte_shards(clashing(docs_of(ROWS))).collect(), brute_shards(ROWS))


def test_shards_are_balanced_and_native(spark):
    df = QUERIES["op9_byte_shards"](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    largest = max(r.size for r in rows)
    each = [sum(r.size for r in x) for x in by.values()]
    assert max(each) - min(each) <= 2 * largest
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards_of_nothing(docs_of):
    assert byte_shards(docs_of([])).collect() == []
    assert [(r.size, r.slot) for r in byte_shards(docs_of([(1, None)])).collect()] == [(1, 0)]
