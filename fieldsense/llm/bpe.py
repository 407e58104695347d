"""BPE encoding and decoding: speculate and verify.

Text is cut at white space; distinct pieces are encoded once per worker and
remembered (bounded). A piece is normalised and split into words the way the
tokenizer file says. For every new word greedy longest match proposes tokens.
A proposal is the exact encoding when each of its neighbouring pairs (a, b) is
what merging the text of a and b gives; the pairs of all new words are
checked together against the known verdicts, unknown pairs are merged once
and remembered. Only words with a failing pair are merged exactly.

The vocabulary is read from a tokenizer file (JSON, BPE model with an
end-of-word suffix, byte-level alphabet); nothing is trained.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, give_back, id_text

KEPT_BYTES = 48 << 20          # pieces and words a worker remembers, in bytes of memory
PAIRS_KEPT = 200_000           # verdicts on pairs a worker remembers (about 110 bytes each)
ROWS_AT_ONCE = 250             # texts that are cut into pieces at once

# fixed values: the white space of the tokenizer's normaliser, and its word
# pattern restricted to lower-case Latin-1 text without white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LATIN_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"

_WHITE_RUN = re.compile(f"[{WHITE}]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f]")       # white space for str.split, not for the tokenizer
_LATIN_WORDS = re.compile(LATIN_WORDS)
_LATIN = re.compile("[\x00-\xff]*")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(others)) for b in range(256)]


class Kept:
    """Words and pieces by number; their tokens lie one after the other in
    ``flat``. ``held`` estimates the memory in bytes."""
    __slots__ = ("words", "pieces", "flat", "start", "count", "held")

    def __init__(self):
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.flat, self.start, self.count = array("i"), array("i"), array("i")
        self.held = 0

    def add(self, names: dict[str, int], name: str, ids) -> None:
        """A word or piece with its tokens, or (an int) the number that has them."""
        if not isinstance(ids, int):
            self.start.append(len(self.flat))
            self.count.append(len(ids))
            self.flat.extend(ids)
            self.held += 8 + 4 * len(ids)
            ids = len(self.start) - 1
        names[name] = ids
        self.held += 150 + len(name)

    def tokens(self, number: int) -> array:
        at = self.start[number]
        return self.flat[at:at + self.count[number]]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[a, b] = i
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # tokens that end a word, by their text; longest other token by its first three characters
        self.final = {t.removesuffix(self.suffix): i for t, i in self.vocab.items() if t.endswith(self.suffix)}
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            if not t.endswith(self.suffix):
                self.reach[t[:3]] = max(self.reach.get(t[:3], 1), len(t))
        self.longest_final = max(map(len, self.final))
        self.alphabet = "".join(byte_alphabet())
        self.pair_ok: dict[int, bool] = {}
        self.kept, self.earlier = Kept(), Kept()
        top = max(self.token) + 1
        self.token_text = pa.array([self.token.get(i, "") for i in range(top)], pa.string())
        self.is_token = np.array([i in self.token for i in range(top)])
        self.merged_words = 0
        self._path, self._library = path, None

    # ------------------------------------------------------------ exact merging
    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix]

    def merge(self, parts: list[str]) -> list[int]:
        """Exact BPE: always the leftmost pair of the lowest rank."""
        if len(parts) > 48:
            return self.merge_long(parts)
        get, vocab, none = self.rank.get, self.vocab, 1 << 30
        ranks = [get(x, none) for x in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return [vocab[p] for p in parts]

    def merge_word(self, word: str) -> list[int]:
        """Exact BPE of a whole word: the library's own merging where it has
        one for a word, this class's loop for the very long (n log n)."""
        if len(word) > 400:
            return self.merge_long(self.symbols(word))
        return [t.id for t in self.library.model.tokenize(word)]

    def merge_long(self, parts: list[str]) -> list[int]:
        """The same with a heap over a linked list: n log n for a very long word."""
        n = len(parts)
        parts, left, right = list(parts), list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        vocab = self.vocab
        return [vocab[p] for p in parts if p]

    def split_token(self, token: str) -> list[str]:
        body = token.removesuffix(self.suffix)
        return [*body] if body == token else self.symbols(body)

    def compatible(self, a: int, b: int) -> bool:
        """Merging the symbols of both tokens gives the two tokens again
        (``b`` < 0: the token ``a`` alone gives itself)."""
        own = self.split_token(self.token[a])
        if b < 0:
            return self.merge(own) == [a]
        return self.merge(own + self.split_token(self.token[b])) == [a, b]

    # ------------------------------------------------------ speculate and verify
    def greedy(self, word: str) -> list[int]:
        get, final, reach, longest, n, i, out = (self.vocab.get, self.final.get, self.reach.get, self.longest_final,
                                                 len(word), 0, [])
        while i < n:
            if n - i <= longest and (t := final(word[i:])) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + reach(word[i:i + 3], 2)), i, -1):
                if (t := get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def learn(self, new: list[str]) -> None:
        """Encode new words: propose, check all pairs at once, merge the rest."""
        if not new:
            return
        proposals = [self.greedy(w) for w in new]
        counts = np.fromiter(map(len, proposals), dtype=np.int64, count=len(new))
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64, count=int(counts.sum()))
        last = np.cumsum(counts) - 1
        follow = np.empty_like(flat)
        follow[:-1] = flat[1:]
        follow[last] = -1                        # no neighbour after the last token of a word
        single = np.zeros(len(flat), dtype=bool)
        single[last[counts == 1]] = True
        key = flat * (1 << 20) + follow + 1
        wanted = (follow >= 0) | single
        distinct, where = np.unique(key[wanted], return_inverse=True)
        verdict = np.empty(len(distinct), dtype=bool)
        for i, k in enumerate(distinct.tolist()):
            ok = self.pair_ok.get(k)
            if ok is None:
                ok = self.pair_ok[k] = self.compatible(k >> 20, (k & ((1 << 20) - 1)) - 1)
            verdict[i] = ok
        bad = np.zeros(len(flat), dtype=np.int64)
        bad[wanted] = ~verdict[where]
        failing = np.add.reduceat(bad, last - counts + 1) > 0
        kept = self.kept
        for w, p, f in zip(new, proposals, failing.tolist()):
            kept.add(kept.words, w, self.merge_word(w) if f else p)
        self.merged_words += int(failing.sum())

    # ------------------------------------------------------------------- pieces
    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self._path)
        return self._library

    def split_words(self, piece: str) -> list[str]:
        """Words of a piece without white space, in the byte alphabet. The
        library's own normaliser and splitter do pieces beyond Latin-1."""
        if _LATIN.fullmatch(piece):
            words = _LATIN_WORDS.findall(piece.lower())
            return words if piece.isascii() and piece.isprintable() else [
                w.encode().decode("latin-1").translate(self.alphabet) for w in words]
        t = self.library
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(piece))]

    def learn_pieces(self, new: set[str]) -> None:
        kept, earlier = self.kept, self.earlier
        parts: dict[str, list] = {}
        unknown: dict[str, None] = {}
        for piece in new:
            if (n := earlier.pieces.get(piece)) is not None:
                kept.add(kept.pieces, piece, earlier.tokens(n))
                continue
            if self.specials and "<" in piece:
                cut = [x for x in self.specials.split(piece) if x]
            else:
                cut = [piece]
            out = []
            for x in cut:
                if x in self.special:
                    out.append(self.special[x])
                    continue
                ws = self.split_words(x)
                out += ws
                for w in ws:
                    if w not in kept.words:
                        if (n := earlier.words.get(w)) is not None:
                            kept.add(kept.words, w, earlier.tokens(n))
                        else:
                            unknown[w] = None
            parts[piece] = out
        self.learn(list(unknown))
        words = kept.words
        for piece, out in parts.items():
            if len(out) == 1 and not isinstance(out[0], int):
                kept.add(kept.pieces, piece, words[out[0]])         # one word: it shares the word's tokens
            else:
                ids = array("i")
                for w in out:
                    if isinstance(w, int):
                        ids.append(w)
                    else:
                        ids.extend(kept.tokens(words[w]))
                kept.add(kept.pieces, piece, ids)

    def cut(self, text: str) -> list[str]:
        return [x for x in _WHITE_RUN.split(text) if x] if _OTHER_SPACE.search(text) else text.split()

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts (None: empty) in one array, and where each text
        begins and ends in it."""
        cut = [self.cut(t or "") for t in texts]
        if self.kept.held > KEPT_BYTES // 2:         # what is still in use comes over from the earlier half
            self.earlier, self.kept = self.kept, Kept()
        if len(self.pair_ok) > PAIRS_KEPT:
            self.pair_ok.clear()
        known, kept = self.kept.pieces, self.kept
        self.learn_pieces(set().union(*cut) - known.keys())
        number = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), dtype=np.int64,
                             count=sum(map(len, cut)))
        count = np.frombuffer(kept.count, dtype=np.int32)[number] if len(number) else np.zeros(0, dtype=np.int32)
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        bounds = np.concatenate([[0], np.cumsum([len(ps) for ps in cut], dtype=np.int64)])
        offsets = np.concatenate([[0], ends])[bounds]
        if not total:
            return np.zeros(0, dtype=np.int32), offsets
        # token k of a piece lies k places after the piece's start
        begin = np.frombuffer(kept.start, dtype=np.int32)[number] - (ends - count)
        return np.frombuffer(kept.flat, dtype=np.int32)[np.repeat(begin, count) + np.arange(total)], offsets

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of every text (None: empty)."""
        values, offsets = self.encode_flat(texts)
        return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]

    def decode_flat(self, values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of token rows: token texts joined by one space, special tokens
        included (the file names no decoder, so this is what its library
        gives); ids that are no token are left out."""
        known = (values >= 0) & (values < len(self.is_token))
        known[known] = self.is_token[values[known]]
        if not known.all():
            offsets = np.concatenate([[0], np.cumsum(known, dtype=np.int64)])[offsets]
            values = values[known]
        rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.token_text.take(pa.array(values)))
        return pc.binary_join(rows, " ")

    def decode(self, ids) -> str:
        return self.decode_flat(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0].as_py()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """The tokenizer of this process, read once."""
    return Bpe(path)


def _local(path: str | None) -> str:
    return path or os.environ.get("WORD_BPE_FILE") or default_path()


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_BOTH = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])


def _encode(path: str | None):
    def run(batches):
        model = bpe(_local(path))
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                values, offsets = model.encode_flat(part.column("text").to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids], schema=_IDS)
        give_back()
    return run


def _decode(path: str | None):
    def run(batches):
        model = bpe(_local(path))
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                ids = part.column("ids").cast(pa.list_(pa.int32()))
                size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                values = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids,
                                                  model.decode_flat(values, offsets)], schema=_BOTH)
    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array<int>) per row.

    NULL, empty and blank texts have no tokens. Repeated rows stay repeated, NULL
    ids stay. Other columns are not read. An empty table gives no rows. The
    strings of special tokens in a text become those tokens, as in the library.
    Texts and words of any length are encoded whole.
    ``path`` is the tokenizer file on the workers (default: the installed
    public file).
    """
    bounded_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(_encode(path), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text`` from ``doc_id, ids``; unknown ids are left out
    and NULL ids decode to the empty text, as no tokens do."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id bigint, ids array<int>, text string")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one worker per task (one vocabulary in memory)."""
    bounded_batches(docs.sparkSession)
    there, back = _encode(path), _decode(path)
    return id_text(docs).mapInArrow(lambda batches: back(there(batches)), "doc_id bigint, ids array<int>, text string")


def bpe_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from the encoded and
    decoded rows."""
    both = encode_decode(docs, path)
    return both.select("doc_id", F.size("ids").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
