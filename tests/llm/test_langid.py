import zlib

import pytest

from fieldsense.llm import langid as L
from fieldsense.llm.catalog import QUERIES

SENTENCE = {"en": "the house of this man and that thing with the other", "de": "der Hund und die Katze nicht auf dem Weg über",
            "fr": "les maisons du village où elle était déjà venue pour être", "es": "los niños que están en la casa del señor año"}


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def sample(n=30):
    return [(i * 4 + k, f"{t} {i} " * (1 + i % 3), lang, None) for i in range(n)
            for k, (lang, t) in enumerate(SENTENCE.items())]


def test_held_out_accuracy(spark):
    got = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(out) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) >= 0.98


def test_labels_of_held_out_rows_are_never_learned(docs_of):
    """Wrong labels on held-out rows change nothing."""
    rows = sample()
    wrong = [(i, t, "xx" if held(i) else lang, None) for i, t, lang, _ in rows]
    def run(r):
        return sorted(map(str, L.language_report(docs_of(r)).collect()))
    assert run(rows) == run(wrong)
    assert "xx" not in str(run(wrong))


def test_unusual_rows(docs_of, clashing):
    rows = sample() + [(900, None, "en", None), (901, "", "en", None), (902, "123 ... ### _", "en", None),
                       (None, SENTENCE["de"], None, None), (903, SENTENCE["fr"] * 20_000, None, None),
                       (5, SENTENCE["es"], None, None), (904, "É", None, None), (905, "日本", "ja", None)]
    got = [tuple(r) for r in L.language_report(clashing(docs_of(rows))).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got if g[0] != 5}
    assert all(by[i][2:] == ("und", 0.0) for i in (900, 901, 902))
    assert by[None][1:3] == (False, "de") and by[903][2] == "fr" and by[904][2] != "und"


def test_family_comes_first(docs_of):
    model = L.train(docs_of(sample()))
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model.between) == {("germanic", "romance")}
    assert set(model.within["romance"]) == {("es", "fr")}


def test_sample_is_bounded(docs_of):
    d = docs_of(sample(60))
    small = L.train(d, per_lang=5, max_rows=12)
    assert set(sum(small.languages.values(), [])) <= set(SENTENCE)


@pytest.mark.parametrize("rows,want", [([], {}), ([(0, "abc", None, None)], {"und"}), ([(0, "abc", "it", None), (3, "x y", None, None)], {"it"})])
def test_few_labels(docs_of, rows, want):
    rows = [(i if not held(i) else i + 100, *r) for i, *r in rows]
    got = L.language_report(docs_of(rows)).collect()
    assert {r.lang_pred for r in got} == (set(want) or set())


def test_stage_keeps_clean_documents(docs_of, clashing, spark):
    rows = sample() + [(900, None, "en", None), (901, "#### 12", "de", None)]
    d = clashing(docs_of(rows))
    kept = L.keep_identified(d, L.train(d))
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in sample()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert L.keep_identified(docs, L.train(docs)).count() >= 0.99 * docs.count()


def test_numeric_signs_are_no_letters(docs_of):
    rows = sample() + [(900, "½ ⅓", None, None), (901, "x² ³", None, None), (902, "² ³ ①②", None, None), (903, "Ⅷ ⅻ ৪", None, None)]
    d = docs_of(rows)
    model = L.train(d)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(d, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (900, 902, 903)) and got[901][0] != "und"
    assert {r.doc_id for r in L.keep_identified(d, model).where("doc_id >= 900").collect()} == {901}
