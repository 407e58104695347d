"""Conversation structure repair by grammar-compressed dynamic programming.

1. Rows without their texts (digest and first characters instead) are collapsed
   where equal, told whether role and text came in an earlier turn, and
   range-partitioned in the order (conversation, turn, role, text head, digest). A
   conversation larger than a partition spreads over several.
2. Each partition writes its rows as symbol strings, at most ``PIECE`` rows a
   string, with the counts that neighbouring pieces can add up.
3. Re-Pair: the pairs of neighbouring symbols are counted over all strings on
   Spark, the most frequent become rules, and so on with the shorter strings. The
   rules (bounded in number) and their transfer matrices go to every task.
4. Conversations of one piece are evaluated where they lie. Pieces of longer
   ones become matrices first, then are multiplied in order.
5. The audits meet the texts in one shuffle; each conversation streams in
   order through a task that replays its edits and keeps only a running hash.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.llm import transfer as T
from fieldsense.llm.common import bounded_batches, same, saved

PIECE = 1024                 # rows a symbol string holds
HEAD = 64                    # first characters of a text that order rows of one turn and role
ROUNDS, PAIRS = 8, 32        # rounds of Re-Pair, rules a round
BATCH = 2000
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    sentence ends, 3 repeats it, 4 makes it a user's. NULL role, text and parts
    of the checksum count as one space; NULL ids and turns stay NULL."""
    kind = F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn")))) % 20
    text = _or_space(F.col("text"))
    return (rows.select("conv_id", "turn", _or_space(F.col("role")).alias("role"), text.alias("text"),
                        kind.alias("kind")).where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
                    .alias("copy"))
            .drop("copy"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _or_space(F.col("role")).alias("role"),
                       _or_space(F.col("text")).alias("text"))


def _ordered_keys(rows: DataFrame, *more: str | Column) -> DataFrame:
    """The columns that order rows: turn, role, text head, SHA-256 of the text."""
    return rows.select("conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"),
                       F.unhex(F.sha2("text", 256)).alias("digest"), *more)


# ---------------------------------------------------------------- rows to pieces
def _light(rows: DataFrame) -> DataFrame:
    """Distinct rows without texts: their faults and number of copies."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    light = _ordered_keys(rows, (trimmed == "").alias("blank"),
                          (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    distinct = (light.groupBy("conv_id", "turn", "role", "head", "digest", "blank", "truncated")
                .agg(F.count(F.lit(1)).alias("copies")))
    # role and text on several turns: all but the first turn (NULL comes first) repeat it
    several = (distinct.where(~F.col("blank")).groupBy("conv_id", "role", "digest")
               .agg(F.min("turn").alias("first"), F.max("turn").alias("last"),
                    F.bool_or(F.col("turn").isNull()).alias("unset"))
               .where("first < last OR (unset AND first IS NOT NULL)")
               .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"),
                       "first", "unset"))
    return (distinct.join(several, same(F.col("conv_id"), F.col("_conv")) & (F.col("role") == F.col("_role"))
                          & (F.col("digest") == F.col("_digest")), "left")
            .withColumn("later", F.coalesce((F.col("turn") > F.col("first"))
                                            | (F.col("unset") & F.col("turn").isNotNull()), F.lit(False)))
            .select("conv_id", "turn", "role", "head", "digest", "blank", "truncated", "copies", "later"))


_KEY = [("turn", pa.int64()), ("role", pa.string()), ("head", pa.string()), ("digest", pa.binary())]
_STATS = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
_STATS_DDL = ", ".join(f"{c} bigint" for c in _STATS)


class _Piece:
    """Symbols of neighbouring rows of one conversation and what they count."""
    __slots__ = ("key", "number", "symbols", "size", "first", "last", "blank", "duplicate", "truncated", "illegal",
                 "low", "high", "turns")

    def __init__(self, key, number):
        self.key, self.number, self.symbols, self.size, self.first, self.last = key, number, [], 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, initial, fault, symbol, n=1):
        """``n`` equal rows."""
        if self.last is not None:
            self.illegal += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        self.illegal += (n - 1) * ((initial, initial) not in LEGAL)
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            setattr(self, fault, getattr(self, fault) + n)
        self.symbols.append(symbol * n)
        self.size += n

    def row(self, conv, whole):
        return (conv, *self.key, self.number, whole, "".join(self.symbols), self.first, self.last, self.blank,
                self.duplicate, self.truncated, self.illegal, self.low, self.high, self.turns)


def _pieces(schema: pa.Schema, batches):
    """Rows of a partition, in order, as pieces. ``whole``: the conversation is
    this piece alone. The first and last of a partition may go on elsewhere."""
    out: list[tuple] = []
    nothing = object()
    conv, piece, count, at_edge = nothing, None, 0, True

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for b in batches:
        columns = ("conv_id", "turn", "role", "head", "digest", "blank", "truncated", "copies", "later")
        for c, turn, role, head, digest, blank, cut, copies, later in zip(
                *(b.column(x).to_pylist() for x in columns)):
            if conv is nothing or c != conv:
                if piece is not None:
                    out.append(piece.row(conv, count == 1 and not at_edge))
                at_edge = conv is nothing
                conv, piece, count = c, _Piece((turn, role, head, digest), 0), 1
            initial = role[:1]
            symbol = initial if initial and initial in "sua" else "x"
            if blank:
                runs = [("blank", "d", copies)]
            else:
                first = ("duplicate", "d") if later else ("truncated", symbol.upper()) if cut else ("", symbol)
                runs = [(*first, 1), ("duplicate", "d", copies - 1)]
            for fault, mark, n in runs:
                while n:
                    if piece.size >= PIECE:
                        out.append(piece.row(conv, False))
                        piece, count = _Piece((turn, role, head, digest), count), count + 1
                    take = min(n, PIECE - piece.size)
                    piece.add(turn, initial, fault, mark, take)
                    n -= take
                    if len(out) >= BATCH:
                        yield batch()
                        out.clear()
    if piece is not None:
        out.append(piece.row(conv, False))
    if out:
        yield batch()


def pieces(rows: DataFrame) -> DataFrame:
    """Saved pieces of all conversations of ``rows`` (``conv_id, turn, role, text``)."""
    light = _light(rows)
    ordered = (light.repartitionByRange("conv_id", "turn", "role", "head")
               .sortWithinPartitions("conv_id", "turn", "role", "head", "digest"))
    kind = rows.schema["conv_id"].dataType
    ddl = (f"conv_id {kind.simpleString()}, turn bigint, role string, head string, digest binary, number bigint, "
           f"whole boolean, symbols string, first string, last string, {_STATS_DDL}")
    return saved(ordered.mapInArrow(partial(_pieces, _arrow(rows, [
        *_KEY, ("number", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.string()), ("first", pa.string()),
        ("last", pa.string()), *((c, pa.int64()) for c in _STATS)])), ddl))


def _arrow(rows: DataFrame, fields) -> pa.Schema:
    """Arrow schema of rows that begin with the conversation's id."""
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), *fields])


# ------------------------------------------------------------------------ grammar
def learned_rules(strings: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> T.Rounds:
    """Re-Pair over ``symbols, n`` (distinct strings): in each round the most
    frequent pairs that occur more than once become rules. Only they reach the
    driver."""
    found: T.Rounds = []
    top = len(T.SYMBOLS)
    for _ in range(rounds):
        def count(batches, found=found):
            total = T.Counter()
            for b in batches:
                total += T.pair_counts(zip(b.column("symbols").to_pylist(), b.column("n").to_pylist()), found)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.int32()),
                                              pa.array([b for _, b in total], pa.int32()),
                                              pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])

        best = (strings.mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
                .where("n > 1").orderBy(F.desc("n"), "a", "b").limit(pairs).collect())
        if not best:
            break
        found = [*found, {(r["a"], r["b"]): top + i for i, r in enumerate(best)}]
        top += len(best)
    return found


def grammar_of(cut: DataFrame) -> T.Grammar:
    """The grammar of all pieces; equal strings are counted once, with their number."""
    strings = saved(cut.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")))
    return T.Grammar(learned_rules(strings))


# --------------------------------------------------------------------- evaluation
def _gaps(low, high, turns):
    return high - low + 1 - turns if low is not None else 0


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT_FIELDS = [*((c, pa.int64()) for c in _RESULT), ("audit", pa.string())]
_RESULT_DDL = ", ".join(f"{c} bigint" for c in _RESULT) + ", audit string"


def _evaluate_whole(grammar: T.Grammar, schema: pa.Schema, batches):
    for b in batches:
        out = [grammar.whole(s) for s in b.column("symbols").to_pylist()]
        gaps = [_gaps(*x) for x in zip(*(b.column(c).to_pylist() for c in ("low", "high", "turns")))]
        yield pa.RecordBatch.from_arrays([
            b.column("conv_id"), pa.array(gaps, pa.int64()), b.column("blank"), b.column("duplicate"),
            b.column("truncated"), b.column("illegal"), pa.array([c for c, _ in out], pa.int64()),
            pa.array([a for _, a in out], pa.string())], schema=schema)


def _evaluate_parts(grammar: T.Grammar, batches):
    """Pieces with their matrices instead of their symbols."""
    for b in batches:
        flat = [[e for row in grammar.part(s) for e in row] for s in b.column("symbols").to_pylist()]
        kept = [c for c in b.schema.names if c not in ("whole", "symbols")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in kept),
             pa.array([[None if e is None else e[0] for e in m] for m in flat], pa.list_(pa.int64())),
             pa.array([[None if e is None else T.text_of(e[1]) for e in m] for m in flat], pa.list_(pa.string()))],
            names=[*kept, "costs", "audits"])


def _fold(schema: pa.Schema, batches):
    """Pieces of conversations, in order: matrices multiply, counts add up."""
    nothing = object()
    conv, row, last, total = nothing, None, None, None

    def result():
        cost, audit = T.finished(row)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (conv, _gaps(total["low"], total["high"], total["turns"]), total["blank"], total["duplicate"],
             total["truncated"], total["illegal"], cost, audit), schema)], schema=schema)

    for b in batches:
        for r in b.to_pylist():
            if conv is nothing or r["conv_id"] != conv:
                if conv is not nothing:
                    yield result()
                conv, row, last = r["conv_id"], T.FIRST_ROW, None
                total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {
                    "low": None, "high": None}
            if last is not None:
                total["illegal"] += (last, r["first"]) not in LEGAL
            last = r["last"]
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                total[c] += r[c]
            if r["low"] is not None:
                total["turns"] -= r["low"] == total["high"]
                total["low"] = r["low"] if total["low"] is None else total["low"]
                total["high"] = r["high"]
            cells = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])]
            row = T.row_times(row, [cells[i:i + 4] for i in range(0, 16, 4)])
    if conv is not nothing:
        yield result()


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per
    conversation with rows; the audit spells the cheapest edits in order."""
    bounded_batches(rows.sparkSession)
    cut = pieces(_plain(rows))
    grammar = grammar_of(cut)
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT_DDL}"
    schema = _arrow(rows, _RESULT_FIELDS)
    alone = cut.where("whole").mapInArrow(partial(_evaluate_whole, grammar, schema), ddl)
    names = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("whole", "symbols")]
    parts = (cut.where("NOT whole")
             .mapInArrow(partial(_evaluate_parts, grammar),
                         ", ".join([*names, "costs array<bigint>", "audits array<string>"]))
             .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "head", "digest", "number"))
    return alone.unionByName(parts.mapInArrow(partial(_fold, schema), ddl))


# ------------------------------------------------------------------------- replay
def _edits(columns, batches):
    """For each conversation in order: (result or None, iterator of (edit, role, text))."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns)))
    ahead = next(rows, None)
    while ahead is not None:
        conv, result = ahead[0], ahead[2]

        def steps():
            """The repaired rows; reads the rows of this conversation only."""
            nonlocal ahead
            audit, state, at = result["audit"] if result else "", T.START, 0
            ahead = next(rows, None)
            while True:
                while at < len(audit) and audit[at] == "I":
                    role = "assistant" if state == T.USER else "user"
                    state, at = T.NEXT[state, role[0]], at + 1
                    yield "I", role, ""
                if ahead is None or ahead[0] != conv or ahead[1] != 1:
                    break
                mark, role, text = audit[at], ahead[3], ahead[4]
                at += 1
                if mark != "D":
                    if mark == "R":
                        role = "assistant" if state == T.USER else "user"
                    state = T.NEXT[state, role[0]]
                    yield mark, role, text
                ahead = next(rows, None)
            while ahead is not None and ahead[0] == conv:
                ahead = next(rows, None)

        yield conv, result, steps()


_STREAM = ("conv_id", "kind", "result", "role", "text")


def _stream(rows: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Results, rows and bare ids of each conversation behind each other."""
    plain = _plain(rows)
    found = audits(rows)
    none = F.lit(None)
    parts = [
        found.select("conv_id", F.lit(0).alias("kind"), F.struct(*_RESULT, "audit").alias("result"),
                     none.cast("bigint").alias("turn"), none.cast("string").alias("role"),
                     none.cast("string").alias("head"), none.cast("binary").alias("digest"),
                     none.cast("string").alias("text")),
        _ordered_keys(plain, "text").select(
            "conv_id", F.lit(1).alias("kind"), none.cast(f"struct<{_RESULT_DDL.replace(' ', ':').replace(',:', ',')}>")
            .alias("result"), "turn", "role", "head", "digest", "text")]
    if conversations is not None:
        parts.append(conversations.select("conv_id").distinct().select(
            "conv_id", F.lit(2).alias("kind"), *[none.cast(f.dataType).alias(f.name) for f in parts[0].schema[2:]]))
    joined = parts[0].unionByName(parts[1])
    for p in parts[2:]:
        joined = joined.unionByName(p)
    return (joined.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "head", "digest")
            .select(*_STREAM))


def _hashed(schema: pa.Schema, batches):
    out = []
    nothing = dict.fromkeys(_RESULT, 0) | {"audit": ""}

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for conv, result, steps in _edits(_STREAM, batches):
        h, between = hashlib.sha256(), b""
        for _, role, text in steps:
            h.update(between + f"{role}:{text}".encode())
            between = b"\n"
        r = result or nothing
        out.append((conv, *(r[c] for c in _RESULT), r["audit"], h.hexdigest()))
        if len(out) >= BATCH or len(r["audit"]) > 1 << 20:
            yield batch()
            out.clear()
    if out:
        yield batch()


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` for each conversation of ``rows`` (``conv_id, turn, role,
    text``) and each other id of ``conversations``, which has zeros, an empty
    audit and the empty text's hash.

    Rows of a conversation stand by turn (NULL first), rows of one turn by role,
    first ``HEAD`` characters and SHA-256 of the text. NULL role and text count as
    one space; rows with a NULL id form one conversation. Repeated rows are
    duplicates of the first; a blank one is blank. Other columns are not read. An
    empty table gives no rows. A conversation of any length and texts of any
    length work: DP and counts spread over tasks, the hash streams through one.
    """
    schema = _arrow(rows, [*_RESULT_FIELDS, ("repaired_sha256", pa.string())])
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT_DDL}, repaired_sha256 string"
    return _stream(rows, conversations).mapInArrow(partial(_hashed, schema), ddl)


def _rows_out(schema: pa.Schema, batches):
    out, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for conv, _, steps in _edits(_STREAM, batches):
        for place, (mark, role, text) in enumerate(steps):
            out.append((conv, place, role, text, mark))
            size += len(text)
            if len(out) >= BATCH or size > 1 << 20:
                yield batch()
                out.clear()
                size = 0
    if out:
        yield batch()


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text, edit`` (edit:
    I inserted, K kept, R given the role). Unusual rows as in ``repair_report``;
    a conversation that is deleted whole has no rows."""
    schema = _arrow(rows, [("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place bigint, role string, text string, edit string"
    return _stream(rows, None).mapInArrow(partial(_rows_out, schema), ddl)
