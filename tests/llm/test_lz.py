import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldsense.llm import lz as Z
from fieldsense.llm.catalog import QUERIES


def slow_parse(text):
    known, phrases, cur = set(), [], ""
    for c in text:
        cur += c
        if cur not in known:
            known.add(cur)
            phrases.append(cur)
            cur = ""
    return phrases + ([cur] if cur else [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=120))
def test_parse_is_the_letter_by_letter_parse(text):
    starts = Z.parse(text, set())
    assert [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])] == slow_parse(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ", max_size=80), st.text(alphabet="ab ", max_size=80), st.data())
def test_reused_phrases_give_the_full_fingerprint(text, tail, data):
    keep = data.draw(st.integers(0, len(text)))
    got = Z.edited_fingerprint(text, Z.parse(text, set()), keep, tail)
    assert (got == Z.fingerprint(text[:keep] + tail)).all()


def test_likeness_follows_shared_phrases():
    import random
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    base = " ".join(rng.choices(words, k=800))
    small = base[:3800] + " ".join(rng.choices(words, k=100))
    other = "".join(rng.choices("klmnopqrs ", k=4000))
    a = Z.fingerprint(base)
    assert Z.likeness(a, a) == 1
    assert Z.likeness(a, Z.fingerprint(small)) > 0.6 > 0.1 > Z.likeness(a, Z.fingerprint(other))
    exact = len(set(slow_parse(base)) & set(slow_parse(small))) / len(set(slow_parse(base)) | set(slow_parse(small)))
    assert Z.likeness(a, Z.fingerprint(small)) == pytest.approx(exact, abs=0.15)
    empty = Z.fingerprint("")
    assert Z.likeness(empty, empty) == 1 and Z.likeness(empty, a) == 0


def brute(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], (r[1] or "").encode()))
    pairs = [(a, order[(i + 1) % len(order)]) for i, a in enumerate(order)] + [(r, None) for r in rows if r[0] is None]
    out = []
    for (i, t), nxt in pairs:
        t = t or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + ((nxt[1] or "")[:half] if nxt else "")
        f, e = Z.fingerprint(t), Z.fingerprint(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), Z.to_hex(f), Z.to_hex(e), Z.likeness(f, e),
                    Z.likeness(f, Z.fingerprint(nxt[1] or "")) if nxt else None))
    return sorted(map(str, out))


ROWS = ([(i * 3, f"text {i} " * (i % 9) + "ü") for i in range(40)]
        + [(7, "twin a"), (7, "twin b"), (7, "twin b"), (1000, None), (1001, ""), (1002, "long " * 30_000), (None, "nobody's"),
           (None, "nobody's"), (None, None), (-5, "first of all")])


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_documents_across_ranges(docs_of, clashing, ranges):
    from pyspark.sql import functions as F
    got = (Z.with_next(clashing(docs_of(ROWS)), ranges).withColumn("e", F.sha2("edited", 256))
           .select("doc_id", "n_chars", "e", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute([r[:2] for r in ROWS])


@pytest.mark.parametrize("rows", [[], [(1, "only one here")], [(None, "x")], [(4, None), (4, None)]])
def test_small_tables(docs_of, rows):
    got = Z.lz_report(docs_of(rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_documents(spark, documents):
    got = QUERIES["op3_lz_fingerprint"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(str(tuple(r)) for r in got) == brute([(r.doc_id, r.text) for r in documents.collect()])
    assert sum(r.near_edited for r in got) > sum(r.near_next for r in got)
