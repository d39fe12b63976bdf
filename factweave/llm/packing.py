"""Packing of token sequences by bounded-space online best fit."""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.bpe import Memo, slices
from factweave.llm.shared import dropped, for_python, stored

CAPACITY, END = 1024, 2
#: Open bins of a task, and how many tasks' open bins the next round packs together.
OPEN, FAN_IN = 1024, 8


class Bins:
    """At most ``most`` open bins, in a bitset keyed by free space, each bit with its bins.

    A piece goes to the open bin with the least sufficient space; if there is none, to a new one, for which the
    fullest bin closes first where all are open. Rows are given out when their bin closes.
    """

    def __init__(self, capacity: int, most: int, number: int):
        self.capacity, self.most, self.number = capacity, most, number
        self.mask, self.count = 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rows: dict[int, list[tuple]] = {}
        self.closed: list[tuple] = []

    def put(self, row: tuple, length: int) -> None:
        above = self.mask >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            held = self._take(free)
        else:
            if self.count == self.most:
                fullest = (self.mask & -self.mask).bit_length() - 1
                self.closed += self.rows.pop(self._take(fullest))
            free, held = self.capacity, self.number
            self.number += 1
            self.rows[held] = []
        self.rows[held].append((*row, held, self.capacity - free))
        free -= length
        if free:
            self.at[free].append(held)
            self.mask |= 1 << free
            self.count += 1
        else:
            self.closed += self.rows.pop(held)

    def _take(self, free: int) -> int:
        held = self.at[free].pop()
        if not self.at[free]:
            self.mask ^= 1 << free
        self.count -= 1
        return held


#: Texts of these characters alone, on whose classes all Unicode tables agree, may go to the faster library.
_COMMON = re.compile("[\n\r\t -~\u00a1-\u024f]*")
#: The split that ByteLevel stands for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, then the others in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _merger(path: str):
    """tiktoken's encoder of the file's merges, if its tokens are numbered in the order of merges; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    model, before = known["model"], known["pre_tokenizer"]
    if model.get("type") != "BPE" or model.get("ignore_merges") or known.get("normalizer") or (before or {}).get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    special = {t["content"] for t in known["added_tokens"]}
    of, vocab = _byte_of(), {t: i for t, i in model["vocab"].items() if t not in special}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if len(vocab) != len(made) + 256 or made != sorted(set(made)) or min(made, default=256) < 256:
        return None
    return tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks={bytes(of[c] for c in t): i for t, i in vocab.items()}, special_tokens={})


@functools.cache
def _encoder(path: str) -> Memo:
    """Ids as the tokenizers library gives them. Its merges are run by tiktoken, which is faster, for common chunks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True  # their strings in a text are ordinary text
    fast = _merger(path)

    lengths = np.zeros(known.get_vocab_size(), np.int64)  # bytes; a token is spelled with one character for each
    for token, rank in known.get_vocab().items():
        lengths[rank] = len(token)

    def together(names: list[str], encode: Callable[[str], list[int]]) -> list[bytes]:
        # Chunks with a space before and none at the end split where they meet, so many are encoded as one text.
        out = []
        for at in range(0, len(names), 256):
            run = names[at : at + 256]
            ids = np.array(encode("".join(run)), "<u4")
            ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum([len(n.encode()) for n in run])) + 1
            told, begin = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                out.append(told[begin:end])
                begin = end
        return out

    def encode(names: list[str]) -> list[bytes]:
        common, plain, other = [], [], []
        for n in names:
            joins = n[:1] == " " and not n[-1].isspace()
            (other if not joins else common if fast and _COMMON.fullmatch(n) else plain).append(n)
        made = dict(zip(other, [np.array(e.ids, "<u4").tobytes() for e in known.encode_batch_fast(other, add_special_tokens=False)], strict=True))
        made |= zip(plain, together(plain, lambda t: known.encode(t, add_special_tokens=False).ids), strict=True)
        made |= zip(common, together(common, fast.encode_ordinary if fast else list), strict=True)
        return [made[n] for n in names]

    return Memo(encode)


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of texts: those of common characters go to tiktoken whole, others through the memo."""
    fast = _merger(path)
    out = [np.array(fast.encode_ordinary(t), "<u4").tobytes() if fast and _COMMON.fullmatch(t) else None for t in texts]
    rest = [i for i, ids in enumerate(out) if ids is None]
    for i, ids in zip(rest, _encoder(path).ids([texts[i] for i in rest]) if rest else [], strict=True):
        out[i] = ids
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids binary): every text's tokens and the end id, cut only if over ``capacity``.

    All pieces of a cut text but the first are full, so it needs as few as can be. ids are unsigned 32-bit
    little-endian, null without ``keep_ids``; ids_crc32 is their unsigned crc32. Null text counts as empty: its one token is the end id. Document ids may be null or repeat, and
    are only carried along; other columns are ignored; no rows give no rows. Nothing is shuffled.
    """
    for_python(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [x + last for x in token_ids([t or "" for t in batch.column(1).to_pylist()], tokenizer)]
            rows, pieces, starts, parts = [], [], [], []
            for i, ids in enumerate(made):
                total = len(ids) // 4
                cut = [0, *range(total % capacity or min(capacity, total), total, capacity), total]
                for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    rows.append(i)
                    pieces.append(k)
                    starts.append(a)
                    parts.append(ids[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(parts if keep_ids else [None] * len(parts), pa.binary())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary").withColumnRenamed("doc_id", id_column)


def packed(pieces: DataFrame, capacity: int = CAPACITY, most: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """pieces (with ``length``, 1 to ``capacity``) and for each its sequence_id and offset; offsets have no gaps.

    Each task packs its rows as they come, online. What its open bins hold at the end, a bounded number of rows,
    is packed anew with that of ``fan_in`` - 1 other tasks, round by round until one task is left. That one may
    open ``fan_in`` times as many bins, enough for all it gets, and takes the longest pieces first.
    """
    for_python(pieces.sparkSession)
    names = pieces.columns
    where = names.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def packer(level: int, final: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            bins = Bins(capacity, most * (fan_in if final else 1), level << 57 | part << 34)
            kinds = None

            def out(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int64(), pa.int64()], strict=True)]
                return pa.RecordBatch.from_arrays([*arrays, pa.array([part if is_open else None] * len(rows), pa.int32())], [*names, "sequence_id", "offset", "tail"])

            def rows_in() -> Iterator[tuple]:
                nonlocal kinds
                for batch in batches:
                    kinds = [f.type for f in batch.schema][: len(names)]
                    yield from zip(*[c.to_pylist() for c in batch.columns[: len(names)]], strict=True)

            def place(row: tuple) -> tuple:
                told = str(row)
                return (-row[where] if final else 0, zlib.crc32(told.encode()), told)

            for row in sorted(rows_in(), key=place) if level else rows_in():
                bins.put(row, row[where])
                if len(bins.closed) >= 10_000:
                    yield out(bins.closed, False)
                    bins.closed = []
            if bins.closed:
                yield out(bins.closed, False)
            if left := [r for rows in bins.rows.values() for r in rows]:
                yield out(left, True)

        return run

    done, level = [], 0
    pieces = stored(pieces, "pieces")  # else tokenizing and packing workers are alive side by side
    state = stored(pieces.mapInArrow(packer(0), schema + ", tail int"), "packed")
    while True:
        last = state.agg(F.max("tail")).first()[0]
        if not last:
            done.append(state.drop("tail"))
            break
        done.append(state.where("tail is null").drop("tail"))
        level += 1
        again = state.where("tail is not null").withColumn("tail", F.floor(F.col("tail") / fan_in).cast("int"))
        groups = last // fan_in + 1
        again = again.repartition(groups, "tail") if groups > 1 else again.coalesce(1)
        state = stored(again.select(*names).mapInArrow(packer(level, groups == 1), schema + ", tail int"), "packed")
        if groups == 1:
            done.append(state.drop("tail"))
            break
    return functools.reduce(DataFrame.unionByName, done)
