"""Byte-level BPE, encoded by backtracking over longest matches.

A token sequence is what the merges would give if and only if every adjacent pair of its tokens is what the
merges give for the two tokens' bytes alone. So a piece is encoded greedily with the longest token at each
byte, a candidate is taken only if it fits its left neighbour, shorter prefixes are tried next, and a byte
position from which nothing fits is marked and never entered again: linear in the piece's length. Longest
tokens come from an Aho-Corasick automaton over the bytes, mapped to Latin-1 characters.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from factweave.llm.shared import for_python

#: White space as the rank files' pattern means it (the Unicode property).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of one generation of a worker's memo, and the longest key kept there.
MEMO, MEMO_KEY = 150_000, 48
SHIFT = 20


class Vocabulary:
    """Tokens by rank, with what the encoder needs to know of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.ranks = ranks
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.tokens)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.tokens)
        self.merged: dict[int, int] = {}
        self.memo: dict[int, bool] = {}
        for rank, token in enumerate(self.tokens):
            self._learn(rank, token)
        self.memo.clear()

    def _learn(self, rank: int, token: bytes) -> None:
        """The longest proper prefix, and the two tokens whose merge made this one."""
        ranks = self.ranks
        for cut in range(len(token) - 1, 0, -1):
            left = ranks.get(token[:cut])
            if left is None:
                continue
            if self.shorter[rank] < 0:
                self.shorter[rank] = left
            right = ranks.get(token[cut:])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self.halves[rank] = (left, right)
                self.merged[left << SHIFT | right] = rank
                return

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        key = left << SHIFT | right
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            known = self.memo[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later merge of the two again and again; a merge across the border that would have come
        # before the one undone last means that the border would not have lasted.
        before = 1 << 40
        while True:
            if self.merged.get(left << SHIFT | right, before) < before:
                return False
            if left > right:
                undone, parts = left, self.halves[left]
                if parts:
                    before, left = undone, parts[1]
                    continue
                parts = self.halves[right]
                if not parts:
                    return True
                before, right = right + 1, parts[0]
            else:
                undone, parts = right, self.halves[right]
                if parts:
                    before, right = undone + 1, parts[0]
                    continue
                parts = self.halves[left]
                if not parts:
                    return True
                before, left = left, parts[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        lengths, shorter, memo, size = self.lengths, self.shorter, self.memo, len(piece)
        longest = [0] * size
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # ends ascend, so the longest comes last
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token, left = 0, longest[0], -1
        while True:
            after = at + lengths[token]
            if not dead[after]:
                good = left < 0 or memo.get(left << SHIFT | token)
                if good or good is None and self.fits(left, token):
                    out.append(token)
                    if after == size:
                        return out
                    at, left, token = after, token, longest[after]
                    continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                last = out.pop()
                left = out[-1] if out else -1
                at -= lengths[last]
                token = shorter[last]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Memo:
    """Little-endian 32-bit ids by chunk of text, in two generations of bounded size.

    A text is cut at each space that follows a character other than white space. No match of the pattern
    crosses such a place, and none looks beyond it, so chunks are encoded apart and equal chunks only once.
    The key of a chunk that begins with a space lacks it; the key of a text's first chunk is a tuple.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = MEMO):
        self.encode, self.entries = encode, entries
        self.young: dict[str | tuple, bytes] = {}
        self.old: dict[str | tuple, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [keys(t) for t in texts]
        young, old, long = self.young, self.old, []
        new = []
        for key in set().union(*cut).difference(young):
            known = old.get(key)
            if known is None:
                new.append(key)
            else:
                young[key] = known
        for key, made in zip(new, self.encode([k[0] if type(k) is tuple else f" {k}" for k in new]), strict=True):
            young[key] = made
            if type(key) is tuple or len(key) > MEMO_KEY:
                long.append(key)
        out = [b"".join(map(young.__getitem__, parts)) for parts in cut]
        for key in long:
            del young[key]
        if len(young) > self.entries:
            self.old, self.young = young, {}
        return out


_AFTER_SPACE = re.compile(r" (?<=\s )")


def keys(text: str) -> list:
    """The keys of a text's chunks, in order."""
    words: list = text.split(" ")
    first = words[0]
    if not _AFTER_SPACE.search(text):
        words[0] = (first,)
        return words
    joined, closed = [], not first or not first[-1].isspace()
    for word in words[1:]:
        if closed:
            joined.append(word)
        elif joined:  # the space belongs to a longer run
            joined[-1] += f" {word}"
        else:
            first += f" {word}"
        closed = word != "" and not word[-1].isspace()
    return [(first,), *joined]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@functools.cache
def _encoder(path: str, pattern: str) -> Memo:
    known, split = vocabulary(path), regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"))
    pieces: dict[str, bytes] = {}
    little = [i.to_bytes(4, "little") for i in range(len(known.tokens))]

    def one(piece: str) -> bytes:
        made = b"".join([little[i] for i in known.encode_piece(piece.encode())])
        if len(piece) <= MEMO_KEY:
            if len(pieces) > MEMO:
                pieces.clear()
            pieces[piece] = made
        return made

    return Memo(lambda names: [b"".join([pieces.get(p) or one(p) for p in split.findall(name)]) for name in names])


def encoded(texts: list[str], path: str, pattern: str) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in _encoder(path, pattern).ids(texts)]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4_000_000, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches whose texts (column ``text``) hold about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        column = batch.column(text)
        if column.nbytes <= most:
            if batch.num_rows:
                yield batch
            continue
        begin = held = 0
        for i, size in enumerate(pc.binary_length(column).to_pylist()):
            if held and held + (size or 0) > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def round_trip(docs: DataFrame, vocab: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = True) -> DataFrame:
    """(id, token_ids array<int>, decoded binary): every text's tokens, and the bytes that they decode to.

    One pass without a shuffle. Null text counts as empty and gives no tokens; ids may be null or repeat;
    other columns are ignored. Without ``decode``, decoded is null.
    """
    for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocab)
        for batch in slices(batches):
            ids = encoded([t or "" for t in batch.column(1).to_pylist()], vocab, pattern)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids).astype(np.int32)
            back = pa.array([known.decode(x.tolist()) for x in ids] if decode else [None] * len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), back], ["doc_id", "token_ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, token_ids array<int>, decoded binary").withColumnRenamed("doc_id", id_column)
