"""Language identification in two steps: family, then language.

Features are hashed byte trigrams of the lower-cased letters of the whole text
(square roots of counts, unit length). Linear support vector machines, one
for each pair, first decide the family, then the languages within the winning
family only. They are fitted on a bounded sample of labelled rows
(``per_lang`` a language, ``max_rows`` in all), chosen by a hash of the id;
tasks turn the sampled texts into feature rows and only these reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, id_text

DIM = 4096
PER_LANG = 500
MAX_ROWS = 2000
MIN_SCORE = 0.25         # a toss between two families and two languages, their least score; less only by cyclic votes
UNKNOWN = "und"
BYTES_AT_ONCE = 1 << 20
STEEPNESS = 4.0

# fixed values: language families (ISO 639-1); a language not listed is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "ur", "pa", "gu", "mr", "ne", "si"),
    "semitic": ("ar", "he", "mt", "am"),
    "austronesian": ("id", "ms", "tl", "jv"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

# ASCII letters (lower case) and bytes of other characters stay, the rest separates
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed trigram counts, whole text."""
    counts = np.zeros(DIM)
    step = BYTES_AT_ONCE
    for lo in range(0, len(text), step):
        data = text[max(0, lo - 2):lo + step].lower().encode("utf-8").translate(_KEEP)
        a = np.frombuffer(b" " + b" ".join(data.split()) + b" ", dtype=np.uint8).astype(np.uint32)
        if len(a) > 2:
            h = (a[:-2] * np.uint32(65536) + a[1:-1] * np.uint32(256) + a[2:]) * np.uint32(2654435761) >> np.uint32(20)
            counts += np.bincount(h, minlength=DIM)
    x = np.sqrt(counts)
    norm = np.sqrt(x @ x)
    return (x / norm if norm else x).astype(np.float32)


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (``\\p{L}``, as in ``train``): fractions,
    superscripts, circled digits and Roman numeral signs are none."""
    return any(map(str.isalpha, text or ""))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 40, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by dual
    coordinate descent; classes weigh the same in total."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    n = len(x)
    share = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    diag = 0.5 / (cost * share)
    q = np.einsum("ij,ij->i", x, x) + diag
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * (x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def one_versus_one(x: np.ndarray, labels: np.ndarray, classes: list[str]) -> dict[tuple[str, str], np.ndarray]:
    out = {}
    for a, b in combinations(classes, 2):
        pick = (labels == a) | (labels == b)
        out[a, b] = linear_svm(x[pick], np.where(labels[pick] == a, 1.0, -1.0)).astype(np.float32)
    return out


def decide(x: np.ndarray, classes: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winner (index) per row by votes, then margin; its weakest confidence."""
    n, k = len(x), len(classes)
    if k == 1:
        return np.zeros(n, dtype=np.int64), np.ones(n)
    margin = np.zeros((n, k, k))
    for (a, b), w in machines.items():
        i, j = classes.index(a), classes.index(b)
        d = x @ w[:-1] + w[-1]
        margin[:, i, j], margin[:, j, i] = d, -d
    votes = (margin > 0).sum(axis=2) + 1e-3 * np.tanh(margin.sum(axis=2))
    best = votes.argmax(axis=1)
    own = margin[np.arange(n), best]
    own[np.arange(n), best] = np.inf
    return best, 1.0 / (1.0 + np.exp(-STEEPNESS * own.min(axis=1)))


@dataclass
class Model:
    """Families with their languages; machines between families and within each."""
    families: list[str]
    languages: dict[str, list[str]]
    between: dict
    within: dict[str, dict]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        fam, sure = decide(x, self.families, self.between)
        out, score = np.empty(len(x), dtype=object), np.array(sure, dtype=np.float64)
        for i, f in enumerate(self.families):
            rows = np.nonzero(fam == i)[0]
            if len(rows):
                lang, inner = decide(x[rows], self.languages[f], self.within[f])
                out[rows] = np.array(self.languages[f], dtype=object)[lang]
                score[rows] *= inner
        return out.tolist(), score


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    langs = sorted(set(labels.tolist()))
    languages: dict[str, list[str]] = {}
    for lang in langs:
        languages.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = sorted(languages)
    fam = np.array([FAMILY_OF.get(v, v) for v in labels.tolist()], dtype=object)
    return Model(families, languages, one_versus_one(x, fam, families),
                 {f: one_versus_one(x, labels, ls) for f, ls in languages.items()})


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 3, is 1 (a NULL id counts as no text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``per_lang`` rows a language and ``max_rows`` in all.

    The rows are those of the smallest hash of the id; the ``max_rows`` most
    frequent languages at most are learned (so the counts broadcast are
    bounded). Every row of a sampled id counts towards the bound. Rows whose
    text has no letter are no use and left out.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                        & F.col("text").rlike(r"\p{L}"))
    ids = usable.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("h"))
    # the smallest hashes of a language lie below a limit known from its count: about
    # eight times the wanted rows pass it, however many tasks read the table
    n = (ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
         .orderBy(F.desc("n"), "lang").limit(max_rows))
    near = (ids.join(F.broadcast(n), "lang")
            .where(F.col("h").cast("double") * F.col("n") < F.lit(float(8 * per_lang * (1 << 32)))))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = (near.withColumn("rn", F.row_number().over(order))
              .where(F.col("rn") <= per_lang).orderBy("rn", "lang").limit(max_rows)
              .select(F.col("doc_id").alias("_id")).distinct())
    rows = (usable.select("doc_id", "lang", "text")
            .join(F.broadcast(picked), F.col("doc_id") == F.col("_id"), "left_semi"))    # at most max_rows ids

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())])
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), b.column("lang").cast(pa.string()),
                pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], schema=schema)

    table = (rows.select("doc_id", "lang", "text").mapInArrow(run, "doc_id bigint, lang string, x binary")
             .limit(max_rows).collect())
    table.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    if not table:
        return Model([], {}, {}, {})
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in table])
    return fit(x, np.array([r["lang"] for r in table], dtype=object))


def predict_texts(model: Model, texts: list) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if has_letter(t)]
    for lo in range(0, len(use), 512):
        part = use[lo:lo + 512]
        ls, sc = model.predict(np.stack([features(texts[i]) for i in part]))
        for i, a, s in zip(part, ls, sc.tolist()):
            langs[i], scores[i] = a, s
    return langs, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` per row, from the text alone.

    NULL, empty and letterless texts are ``und`` with score 0. Ties go to the
    language first by name. Without any labelled row everything is ``und``;
    with one language every text with a letter has it. Repeated rows stay
    repeated; NULL ids stay; other columns are not read. An empty table gives
    no rows. Texts of any length are read to their end, ``BYTES_AT_ONCE`` at a time.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            langs, scores = predict_texts(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` with the model learned from the
    rows of ``docs`` that are not held out."""
    return (identify(docs, train(docs))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` (all columns) without rows that are ``und`` or score below
    ``min_score``.

    At the default only rows without a letter go (``und``): of two classes the
    winner has a confidence of at least 0.5, of one class 1.0, so two steps of at
    most two classes never score below 0.25. Guesses, noise with a few letters and
    languages never learned keep their guessed label and stay. With more classes
    cyclic votes can score lower and go. NULL and empty texts are letterless;
    repeated rows, rows without id and columns of any name stay as they are, and
    an empty table stays empty. Long texts are read whole."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        langs, scores = predict_texts(model, text.to_pylist())
        return pa.array([a != UNKNOWN and s >= min_score for a, s in zip(langs, scores)], pa.bool_())

    return docs.where(accepted(F.coalesce(F.col("text"), F.lit(""))))
