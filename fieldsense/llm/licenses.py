"""Licence scan by canonical digest.

A text is brought to one canonical form: ASCII lower case, copyright lines
removed, punctuation to space, equivalent spellings to one of them, white space
collapsed. Tasks take the SHA-256 of the whole canonical text and of each of its
lines; only digests leave them. The whole text's digest is hash-joined with
the digests of known licences, those of the lines with the digests of known
one-line notices.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, id_text, saved
from fieldsense.llm.license_texts import known

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a line that opens with a copyright mark and has a year, a mark or a placeholder after it
COPYRIGHT_LINE = (r"(?m)^[^a-z0-9\n]*(?:copyright|copr\.|©|\(c\))[^\n]*"
                  r"(?:[12][0-9][0-9][0-9]|\(c\)|©|<year>|\[year\]|\[yyyy\])[^\n]*$")
# ASCII except letters, digits and the line feed, and common typographic marks
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F“”‘’–—…•©®™]+"
# equivalent spellings: (pattern of a whole word, replacement); words stand between single spaces
SPELLINGS = (
    (r"(sub)?licenc(e|es|ed|ing|ee|ees|or|ors)", r"{1}licens{2}"),
    (r"(authori|organi|reali|recogni|utili|capitali|initiali)s(e|es|ed|ing|ation|ations)", r"{1}z{2}"),
    (r"(acknowledg|judg)ement(s?)", r"{1}ment{2}"),
    (r"(fav|hon|col|lab|behavi|harb)our(s|ed|ing|able|ably)?", r"{1}or{2}"),
    (r"(fulfi|wi)l(ful|ment)?", r"{1}ll{2}"),
    (r"(noncommercial|noninfringement)", r"{1}"),
    (r"v([0-9]+)", r"version {1}"),
    (r"(l?gpl|agpl)v([0-9]+)", r"{1} version {2}"),
)


KEPT_BYTES = 24 << 20           # spellings a worker remembers, in bytes of memory

_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# ASCII except letters, digits and the line feed becomes a space
_SPACED = bytes(b if b == 10 or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKS = re.compile("|".join(re.escape(c) for c in "“”‘’–—…•©®™").encode())
_COPYRIGHT = re.compile(COPYRIGHT_LINE.encode())
_MAY_BE_COPYRIGHT = re.compile("copyright|copr\\.|©|\\(c\\)".encode())
_RULES = [(re.compile(f" {p} ".encode()), f" {to} ".replace("{1}", "\\1").replace("{2}", "\\2").encode())
          for p, to in SPELLINGS]
_spelled: dict[bytes, bytes] = {}
_held = 0


def spelled(word: bytes) -> bytes:
    """The word in its canonical spelling (remembered)."""
    global _held
    t = b" " + word + b" "
    for rule, to in _RULES:
        t = rule.sub(to, t)
    out = b" ".join(t.split(b" ")).strip(b" ")
    _held += 180 + len(word) + len(out)
    if _held > KEPT_BYTES:
        _spelled.clear()
        _held = 180 + len(word) + len(out)
    _spelled[word] = out
    return out


def canonical_lines(text: str | None) -> list[bytes]:
    """Canonical form of every line that has any."""
    t = (text or "").encode("utf-8").translate(_LOWER_BYTES)
    if _MAY_BE_COPYRIGHT.search(t):
        t = _COPYRIGHT.sub(b"", t)
    if not t.isascii():
        t = _MARKS.sub(b" ", t)
    get = _spelled.get
    lines = []
    for line in t.translate(_SPACED).split(b"\n"):
        words = [get(w) or spelled(w) for w in line.split(b" ") if w]
        if words:
            lines.append(b" ".join(words))
    return lines


def digests(lines: list[bytes]) -> tuple[bytes, list[bytes]]:
    """SHA-256 of the whole canonical text and of each line."""
    return hashlib.sha256(b" ".join(lines)).digest(), [hashlib.sha256(x).digest() for x in lines]


def known_digests(spark: SparkSession) -> DataFrame:
    """``known_digest, kind, license_id``: the canonical digests of the known texts."""
    rows = {}
    for name, kind, text in known():
        key = digests(canonical_lines(text))[0], kind
        rows[key] = min(name, rows.get(key, name))
    table = pa.table({"known_digest": pa.array([d for d, _ in rows], pa.binary()),
                      "kind": pa.array([k for _, k in rows], pa.string()),
                      "license_id": pa.array(list(rows.values()), pa.string())})
    return spark.createDataFrame(table)


_DIGEST_ROWS = "doc_id bigint, text_digest binary, line_digests array<binary>"


def _digest_rows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_digest", pa.binary()), ("line_digests", pa.list_(pa.binary()))])
    for b in batches:
        both = [digests(canonical_lines(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id").cast(pa.int64()), pa.array([w for w, _ in both], pa.binary()),
            pa.array([x for _, x in both], pa.list_(pa.binary()))], schema=schema)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, text_digest, license_id, notice_ids, n_notices``.

    ``license_id`` names the licence whose whole text the document is;
    ``notice_ids`` lists (sorted, comma-joined) the licences that lines of the
    document name, ``n_notices`` counts such lines. NULL and empty texts have
    the digest of the empty text and no licence. Repeated rows stay
    repeated, NULL ids stay, other columns are not read. An empty table gives
    no rows. Texts, lines and words of any length are read whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table = known_digests(spark)           # one row per known text: a few hundred, sized by Spark
    notices = table.where("kind = 'notice'").select("known_digest", F.col("license_id").alias("notice_id"))
    texts = table.where("kind = 'text'").select("known_digest", "license_id")
    rows = saved(id_text(docs).mapInArrow(_digest_rows, _DIGEST_ROWS))
    found = (rows.select("doc_id", "text_digest", F.explode("line_digests").alias("known_digest"))
             .join(notices, "known_digest")
             .groupBy("doc_id", "text_digest")
             .agg(F.array_join(F.array_sort(F.collect_set("notice_id")), ",").alias("notice_ids"),
                  F.count(F.lit(1)).alias("lines"))
             .select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_digest"), "notice_ids", "lines"))
    per_row = (rows.groupBy("doc_id", "text_digest").agg(F.count(F.lit(1)).alias("m"))
               .join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_digest") == F.col("_digest")),
                     "left")
               .join(texts, F.col("text_digest") == F.col("known_digest"), "left"))
    return (per_row.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("_k"))
            .select("doc_id", F.lower(F.hex("text_digest")).alias("text_digest"), "license_id",
                    F.coalesce("notice_ids", F.lit("")).alias("notice_ids"),
                    F.coalesce(F.expr("lines div m"), F.lit(0)).cast("bigint").alias("n_notices")))


def sql() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(col: str) -> str:
        t = f"translate(coalesce({col}, ''), '{UPPER}', '{LOWER}')"
        t = f"regexp_replace({t}, {quoted(COPYRIGHT_LINE)}, '', 'g')"
        t = f"regexp_replace({t}, {quoted(PUNCTUATION)}, ' ', 'g')"
        t = f"regexp_replace(' ' || {t} || ' ', '[ \\n]', ' \\0 ', 'g')"
        for pattern, to in SPELLINGS:
            to = to.replace("{1}", "\\1").replace("{2}", "\\2")
            t = f"regexp_replace({t}, ' {pattern} ', ' {to} ', 'g')"
        t = f"regexp_replace({t}, ' +', ' ', 'g')"
        t = f"regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g')"
        return f"regexp_replace({t}, '^[ \\n]+|[ \\n]+$', '', 'g')"

    rows = ",\n".join(f"({quoted(i)}, {quoted(k)}, {quoted(t)})" for i, k, t in known())
    return f"""
WITH k AS (
  SELECT sha256(translate({canon('text')}, chr(10), ' ')) AS digest, kind, min(license_id) AS license_id
  FROM (VALUES {rows}) AS v(license_id, kind, text) GROUP BY ALL
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {canon('text')} AS c FROM documents
), l AS (
  SELECT r, unnest(string_split(c, chr(10))) AS line FROM d
), n AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n
  FROM l JOIN k ON k.kind = 'notice' AND k.digest = sha256(l.line) GROUP BY r
)
SELECT d.doc_id, sha256(translate(d.c, chr(10), ' ')) AS text_digest, k.license_id,
       coalesce(n.ids, '') AS notice_ids, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN n USING (r)
LEFT JOIN k ON k.kind = 'text' AND k.digest = sha256(translate(d.c, chr(10), ' '))
"""
