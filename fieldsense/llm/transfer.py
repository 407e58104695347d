"""Min-plus transfer matrices with audit ropes, and the Re-Pair grammar over them.

A conversation is a string of symbols, one per row: the row's role (``s``,
``u``, ``a``, ``x`` for any other; upper case when the row is truncated) or
``d`` for a row that must be deleted. A matrix holds, for every pair of states
of the target pattern ``(s?(ua)+)?``, the least cost of editing a string from one
state to the other and, among the cheapest, the ASCII-least audit. Matrices of
neighbouring strings multiply. Two audits of one string, states and cost never
are prefixes of each other (an audit fixes its path, and more inserts cost
more), so the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

# fixed values: what edits cost
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SYMBOLS = "dsuaxSUAX"
START, SYSTEM, USER, ASSISTANT = range(4)         # states: what the pattern saw last
STATES = range(4)
FLAT = 64                                         # ropes up to this length are plain strings
_MOD, _BASE = (1 << 61) - 1, 911382323

# state that a kept or inserted role leads to
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)


class Rope:
    """A concatenation of two strings or ropes, with its length and hash."""
    __slots__ = ("left", "right", "size", "hash")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.size = _size(left) + _size(right)
        self.hash = (_hash(left) * pow(_BASE, _size(right), _MOD) + _hash(right)) % _MOD

    def __getstate__(self):
        return self.left, self.right, self.size, self.hash

    def __setstate__(self, state):
        self.left, self.right, self.size, self.hash = state


def _size(r) -> int:
    return len(r) if isinstance(r, str) else r.size


def _hash(r) -> int:
    if not isinstance(r, str):
        return r.hash
    h = 0
    for c in r:
        h = (h * _BASE + ord(c)) % _MOD
    return h


def joined(a, b):
    """Concatenation; short ones stay plain strings."""
    if not a or not b:
        return b if not a else a
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= FLAT:
        return a + b
    return Rope(a, b)


def text_of(rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += (r.right, r.left)
    return "".join(out)


def less(a, b) -> bool:
    """Whether rope ``a`` reads before ``b``: equal parts (same object, or same
    length and hash) are skipped, so only the path to the first difference is read."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        n, m = _size(x), _size(y)
        if x is y or (n == m and _hash(x) == _hash(y)):
            continue
        if isinstance(x, str) and isinstance(y, str):
            k = min(n, m)
            if x[:k] != y[:k]:
                return x[:k] < y[:k]
            if n > k:
                left.append(x[k:])
            if m > k:
                right.append(y[k:])
            continue
        if not isinstance(x, str) and (n >= m or isinstance(y, str)):
            left += (x.right, x.left)
            right.append(y)
        else:
            left.append(x)
            right += (y.right, y.left)
    return bool(right) and not left


def better(a, b):
    """The cheaper of two (cost, audit) or None; of equals the least audit."""
    if a is None or b is None:
        return a if b is None else b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def row_times(row: list, matrix: list) -> list:
    """A vector of states through a matrix (both min-plus)."""
    out = [None] * 4
    for i in STATES:
        if row[i] is not None:
            cost, audit = row[i]
            for j in STATES:
                step = matrix[i][j]
                if step is not None:
                    total = cost + step[0]
                    if out[j] is None or total <= out[j][0]:
                        out[j] = better(out[j], (total, joined(audit, step[1])))
    return out


def times(a: list, b: list) -> list:
    return [row_times(row, b) for row in a]


def _unit() -> list:
    return [[(0, "") if i == j else None for j in STATES] for i in STATES]


def inserts() -> list:
    """Any number of inserts: the cheapest way from state to state."""
    one = [[None] * 4 for _ in STATES]
    for (i, role), j in NEXT.items():
        if role != "s":
            one[i][j] = (INSERT, "I")
    total = power = _unit()
    for _ in STATES:
        power = times(power, one)
        total = [[better(x, y) for x, y in zip(*rows)] for rows in zip(total, power)]
    return total


def edit(symbol: str) -> list:
    """One row: kept, given another role or deleted."""
    out = [[None] * 4 for _ in STATES]
    extra = TRUNCATED if symbol.isupper() else 0
    for i in STATES:
        out[i][i] = (DELETE, "D")
        if symbol != "d":
            for role in "sua":
                j = NEXT.get((i, role))
                if j is not None:
                    if symbol.lower() == role:
                        out[i][j] = better(out[i][j], (extra, "K"))
                    if role != "s":
                        out[i][j] = better(out[i][j], (REROLE + extra, "R"))
    return out


INSERTS = inserts()
BASE = {k: times(INSERTS, edit(s)) for k, s in enumerate(SYMBOLS)}
FIRST_ROW = [(0, ""), None, None, None]


def finished(row: list) -> tuple[int, str]:
    """Cost and audit of the whole from its vector: closing inserts, accepting states."""
    last = row_times(row, INSERTS)
    best = None
    for state in ACCEPTING:
        best = better(best, last[state])
    return best[0], text_of(best[1])


# ------------------------------------------------------------------------ Re-Pair
Rounds = list[dict[tuple[int, int], int]]


def numbers(symbols: str) -> list[int]:
    return [SYMBOLS.index(c) for c in symbols]


def replaced(seq: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """One pass from the left: every pair with a rule becomes its symbol."""
    out, i, n = [], 0, len(seq)
    while i < n:
        rule = rules.get((seq[i], seq[i + 1])) if i + 1 < n else None
        if rule is None:
            out.append(seq[i])
            i += 1
        else:
            out.append(rule)
            i += 2
    return out


def parsed(symbols: str, rounds: Rounds) -> list[int]:
    """The string in the symbols of the grammar."""
    seq = numbers(symbols)
    for rules in rounds:
        if len(seq) < 2:
            break
        seq = replaced(seq, rules)
    return seq


def pair_counts(rows: Iterable[tuple[str, int]], rounds: Rounds) -> Counter:
    """How often each pair of neighbours stands in the parsed strings."""
    out: Counter = Counter()
    for symbols, n in rows:
        seq = parsed(symbols, rounds)
        for pair in zip(seq, seq[1:]):
            out[pair] += n
    return out


def evaluated(rounds: Rounds) -> dict[int, list]:
    """A matrix per symbol: the rules bottom-up, each the product of its two."""
    out = dict(BASE)
    for rules in rounds:
        for (a, b), rule in rules.items():
            out[rule] = times(out[a], out[b])
    return out


class Grammar:
    """Rules in rounds with their matrices; what a worker evaluated is kept, within a bound in bytes."""

    def __init__(self, rounds: Rounds, kept_bytes: int = 32 << 20):
        self.rounds, self.matrix = rounds, evaluated(rounds)
        self.kept_bytes, self.held, self.known = kept_bytes, 0, {}

    def whole(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of a complete conversation."""
        hit = self.known.get(symbols)
        if hit is None:
            row = FIRST_ROW
            for s in parsed(symbols, self.rounds):
                row = row_times(row, self.matrix[s])
            hit = finished(row)
            self.held += 300 + len(symbols) + len(hit[1])
            if self.held > self.kept_bytes:
                self.known.clear()
                self.held = 300 + len(symbols) + len(hit[1])
            self.known[symbols] = hit
        return hit

    def part(self, symbols: str) -> list:
        """The matrix of a piece."""
        out = None
        for s in parsed(symbols, self.rounds):
            out = self.matrix[s] if out is None else times(out, self.matrix[s])
        return out or _unit()
