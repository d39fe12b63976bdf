"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the sum over n of the cosine of their sets of character n-grams (presence, not
counts), with n-grams hashed into a block of dimensions for each n. Long texts are compared by windows.
Nystroem features over landmark windows feed a ridge regression for each language against the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.bpe import slices
from factweave.llm.shared import for_python

#: Dimensions of each n's block, n from 1; characters of a window.
BLOCKS, WINDOW = (512, 1536, 2048), 1024
WIDTH, ENDS = sum(BLOCKS), np.cumsum(BLOCKS)[:-1]
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each window's n-gram presence, scaled so that a dot product is the kernel, and its text's place in the list."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    counts = np.array([max(1, round(len(p) / WINDOW)) for p in points])
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    every = np.concatenate(points)
    window = np.concatenate([f + np.arange(len(p)) * c // len(p) for p, f, c in zip(points, first, counts, strict=True)])
    seen = np.zeros((len(owner), WIDTH), np.float32)
    flat, code, begin = seen.ravel(), np.zeros(len(every), np.uint32), 0
    base = window * WIDTH
    for n, size in enumerate(BLOCKS, 1):
        code = code[: len(every) - n + 1] * np.uint32(0x9E3779B1) + every[n - 1 :] + np.uint32(1)
        mixed = code ^ (code >> np.uint32(15))
        inside = window[: len(code)] == window[n - 1 :]
        flat[(base[: len(code)] + begin + mixed % np.uint32(size))[inside]] = 1
        begin += size
    for block in np.split(seen, ENDS, axis=1):
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1))
    return seen, owner


@dataclass
class Model:
    """``weights`` folds landmarks, Nystroem map and ridge coefficients: window features to one value a language."""

    languages: list[str]
    weights: np.ndarray
    offset: np.ndarray

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        """The best language of each text and its share of all positive values, averaged over the text's windows."""
        values = np.zeros((len(texts), len(self.languages)), np.float64)
        for at in range(0, len(texts), 64):
            seen, owner = presence(texts[at : at + 64])
            np.add.at(values, owner + at, np.clip(seen @ self.weights + self.offset, 0, 1))
        total = values.sum(axis=1)
        best = values.argmax(axis=1)
        return [(self.languages[b], float(v[b] / t) if t else 0.0) for b, v, t in zip(best, values, total, strict=True)]


#: Windows that fit() holds unpacked at a time.
CHUNK = 1024


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Features of windows from their packed presence bits."""
    seen = np.unpackbits(bits, axis=1, count=WIDTH).astype(np.float32)
    for block in np.split(seen, ENDS, axis=1):
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1))
    return seen


def fit(bits: np.ndarray, labels: list[str], shares: np.ndarray | None = None, landmarks: int = 256, ridge: float = 1e-2) -> Model:
    """Kernel ridge regression, each language against the rest, on Nystroem features of evenly spaced landmarks.

    ``bits`` are the windows' packed presence bits, ``shares`` each window's weight (all windows of a text together
    have 1). Only CHUNK windows are unpacked at a time.
    """
    languages, n = sorted(set(labels)), len(labels)
    shares = np.ones(n) if shares is None else shares
    order = np.lexsort((np.arange(n), np.array(labels)))
    marks = unpacked(bits[order[np.unique(np.linspace(0, n - 1, min(landmarks, n)).astype(int))]])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    to_features = marks.T.astype(np.float64) @ (vector[:, good] / np.sqrt(value[good]))
    narrow = to_features.astype(np.float32)
    features = np.concatenate([(unpacked(bits[at : at + CHUNK]) @ narrow).astype(np.float64) for at in range(0, n, CHUNK)])
    targets = np.array([[x == y for y in languages] for x in labels], np.float64)
    weight = shares * (shares.sum() / (len(languages) * (targets * shares[:, None]).sum(axis=0)))[targets.argmax(axis=1)]
    weight = np.sqrt(weight)[:, None]
    mean, aim = (features * weight**2).sum(0) / (weight**2).sum(), (targets * weight**2).sum(0) / (weight**2).sum()
    x, y = (features - mean) * weight, (targets - aim) * weight
    beta = np.linalg.solve(x.T @ x + ridge * shares.sum() * np.eye(x.shape[1]), x.T @ y)
    return Model(languages, (to_features @ beta).astype(np.float32), aim - mean @ beta)


def learned(docs: DataFrame, training: Column, per_language: int = 600, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> Model | None:
    """A model from about ``per_language`` labelled rows of each language, chosen by a hash of their ids.

    All windows of a chosen row's text count, each with an equal share of the row. The executors turn windows into
    packed presence bits, so the driver gets about 500 bytes for each 1,024 characters of the chosen rows. None
    if no row has a label and a letter.
    """
    for_python(docs.sparkSession)
    rows = docs.where(training & F.col(language_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(language_column).count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit(9)), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, int((1 << 20) * min(1.0, per_language / n))))])
    chosen = rows.where(draw < share[F.col(language_column)]).select(language_column, text_column, id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                seen, owner = presence(texts[at : at + 64])
                bits = np.packbits(seen > 0, axis=1)
                rows = pa.array(owner + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(1 / np.bincount(owner)[owner]), batch.column(2).take(rows)], ["lang", "bits", "share", "key"])

    kind = docs.schema[id_column].dataType.simpleString()
    got = sorted(chosen.mapInArrow(run, f"lang string, bits binary, share double, key {kind}").collect(), key=lambda r: (r["lang"], str(r["key"]), r["bits"]))
    bits = np.array([np.frombuffer(r["bits"], np.uint8) for r in got])
    return fit(bits, [r["lang"] for r in got], np.array([r["share"] for r in got]))


def least_score(model: Model) -> float:
    """A little over an equal share for each language: a text that scores no more tells none of them apart."""
    return 1.05 / len(model.languages)


def labelled(docs: DataFrame, model: Model | None, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` of docs, lang_pred and score; ``und`` and 0 if the text is null or has no letter, or without a model.

    The whole text counts, window by window, as batched matrix products. Nothing is shuffled. Columns of docs
    named lang_pred or score are replaced.
    """
    for_python(docs.sparkSession)
    keep = [c for c in keep if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000, 0):
            texts = batch.column(0).to_pylist()
            there = [i for i, t in enumerate(texts) if model and has_letter(t)]
            out = [(UNKNOWN, 0.0)] * len(texts)
            for i, told in zip(there, model.judge([texts[i] for i in there]) if there else [], strict=True):
                out[i] = told
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text_column).alias("_text"), *keep).mapInArrow(run, f"{schema}, lang_pred string, score double")


def predicted(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; ids may be null or repeat, other columns are ignored."""
    return labelled(docs, model, [id_column], text_column)
