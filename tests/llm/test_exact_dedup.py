import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldsense.llm.catalog import ORACLE_SQL, QUERIES
from fieldsense.llm.exact_dedup import Polynomial, drop_exact_copies, exact_dedup, fingerprints, normalise

LONG = "word " * 30_000
ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, ""), (2, None), (4, " "), (7, "\n\r "), (8, "x\x00y"), (10, "x\x00y"),
        (11, "a b"), (11, "a b"), (None, "a b"), (None, "q"), (None, "q"), (12, "other"), (12, "text"),
        (20, LONG), (21, LONG.replace(" ", "\n")), (22, LONG + "!"), (23, "é" * 70_000), (24, "é" * 70_000)]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in ((r[0], norm(r[1])) for r in rows):
        groups.setdefault(t, []).append(i)
    seen, out = Counter(), []
    for i, t in ((r[0], norm(r[1])) for r in rows):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        seen[i, t] += 1
        out.append({"doc_id": i, "keep_id": keep, "group_size": len(groups[t]),
                    "kept": i == keep and seen[i, t] == 1, "text_sha256": hashlib.sha256(t.encode()).hexdigest()})
    return out


@given(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\xa0é", max_size=30))
def test_normalise_is_the_pattern(text):
    assert normalise(text).decode() == norm(text)


@settings(max_examples=50)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_hashes_compose(a, b):
    p = Polynomial(piece=16)
    whole, ha, hb = p.hash(a + b), p.hash(a), p.hash(b)
    mask = (1 << 31) - 1
    assert whole == p.combine(ha >> 31, hb >> 31, len(b), 0) << 31 | p.combine(ha & mask, hb & mask, len(b), 1)
    assert whole == Polynomial(piece=7).hash(a + b)


def test_against_brute_force(docs_of, clashing, same_rows):
    got = exact_dedup(clashing(docs_of(ROWS)), huge_bytes=1000)
    same_rows(got.drop("fp", "n_bytes").collect(), brute(ROWS))


def test_pieces_on_many_tasks_hash_like_whole_texts(docs_of):
    d = docs_of(ROWS)
    def key(df):
        return sorted((str(r.doc_id), bytes(r.sha), r.fp, r.n_bytes, r.m) for r in df.collect())
    assert key(fingerprints(d, huge_bytes=0)) == key(fingerprints(d, huge_bytes=1 << 40))


@pytest.mark.parametrize("huge", [0, 1 << 20])
def test_colliding_fingerprints_are_told_apart(docs_of, same_rows, huge):
    """With residues modulo 2 and 3 most texts of one length collide."""
    rows = ROWS[:16] + [(100 + i, f"t{i % 7}") for i in range(40)]
    weak = ((2, 3), (3, 5), 2)
    got = exact_dedup(docs_of(rows), huge_bytes=huge, poly_args=weak)
    same_rows(got.drop("fp", "n_bytes").collect(), brute(rows))


def test_empty_table(docs_of):
    assert exact_dedup(docs_of([])).collect() == []
    assert drop_exact_copies(docs_of([])).collect() == []


def test_stage_keeps_one_row_a_group_with_all_columns(docs_of, clashing):
    d = clashing(docs_of(ROWS))
    got = drop_exact_copies(d)
    assert got.columns == d.columns
    want = [(r["doc_id"], r["text_sha256"]) for r in brute(ROWS) if r["kept"]]
    have = [(r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in got.collect()]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_query_and_sql(spark, in_duckdb, same_rows):
    same_rows(QUERIES["op1_exact_dedup"](spark, "/root/testdata/sf0.001").collect(), in_duckdb(ORACLE_SQL["op1_exact_dedup"]))


def test_rows_without_id_do_not_meet_in_pairs(docs_of, same_rows):
    """Every text once with an id and once without: each row meets its own member only."""
    rows = [(i if k else None, f"text number {i}") for i in range(3000) for k in (0, 1)]
    same_rows(exact_dedup(docs_of(rows)).drop("fp", "n_bytes").collect(), brute(rows))
    shared = [(7, f"text number {i // 2}") for i in range(3000)]
    same_rows(exact_dedup(docs_of(shared)).drop("fp", "n_bytes").collect(), brute(shared))
