"""Near-duplicate classes: ProbMinHash over weighted word shingles, banding, exact verification.

Words are runs of letters, digits and underscores in lower case; a shingle is five consecutive words, its weight
the number of times it occurs. A text of one to four words is one shingle; one without words is like no other.
Two texts are near duplicates when the probability Jaccard similarity of their weighted shingles, or the plain
Jaccard similarity of their shingle sets, is at least the threshold. Classes are connected components.

Links are sought in three steps, each on what the one before left apart. First every text is compared with one
other: the most popular text of all its buckets. Then every bucket's most popular text is compared with the
members of other components. Last, within each bucket that still holds several components, every text outside
the bucket's largest component is compared with all texts of other components, so no link between components
is lost. Buckets are cut into blocks for that, and each pair comes out of one bucket only. In all steps parity
marks rule out, without loss, most pairs that are no links before their shingles are fetched.

Joins are sort-merge joins by hint, or broadcast tables that were counted and have few rows. Spark takes an exploded
array for one row and a table for the size of its compressed file, so by itself it would send tables to the driver
that are many times what it allows for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm import shared
from factweave.llm.bpe import slices
from factweave.llm.shared import components, for_python, scratch, stored, told_apart

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts of a bucket that meet in one block, on either side.
BLOCK = 1024
#: 64-bit words of a parity mark.
MARK = 16
_MARK_TYPE = f"struct<n: long, total: long, {', '.join(f'm{i}: long' for i in range(MARK))}>"
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hash by word, forgotten as a whole when too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


_hashes = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct shingle hashes in order, and their weights."""
    words = word_hashes(text)
    if not len(words):
        return words, np.zeros(0, np.int64)
    span = min(size, len(words))
    total = np.zeros(len(words) - span + 1, np.uint64)
    for k in range(span):
        total += words[k : k + len(total)] * _ODD[k]
    return np.unique(mixed(total), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures (texts, size): two components agree with the probability Jaccard similarity.

    Every shingle is a Poisson process with its weight as rate; each arrival falls on a random component, which
    keeps the shingle that arrives first. A process ends as soon as it is later than the text's latest component.
    """
    counts = [len(h) for h, _ in sets]
    first = np.full(len(sets) * size, np.inf)
    kept = np.zeros(len(sets) * size, np.uint64)
    which = np.concatenate([h for h, _ in sets]) if sets else np.zeros(0, np.uint64)
    rate = np.concatenate([w for _, w in sets]).astype(np.float64) if sets else np.zeros(0)
    owner = np.repeat(np.arange(len(sets)), counts)
    seed, time = mixed(which + np.uint64(1)), np.zeros(len(which))
    while len(which):
        seed = mixed(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        spot = owner * size + (mixed(seed ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, spot, time)
        best = first[spot] == time
        kept[spot[best]] = which[best]
        going = time < first.reshape(-1, size).max(axis=1)[owner]
        which, rate, owner, seed, time = which[going], rate[going], owner[going], seed[going], time[going]
    return kept.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(rows):
        key = mixed(key * _ODD[0] + parts[:, :, k])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the probability Jaccard similarity of weighted and the Jaccard similarity of plain shingles."""
    (ha, wa), (hb, wb) = a, b
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(ha) + len(hb) - len(both))
    if wa.max() == wb.max() == 1:
        return plain
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # For element i the union counts x_j / x_i where x_j / y_j >= x_i / y_i, else y_j / y_i.
    x_after = np.cumsum(x[::-1])[::-1] + (wa.sum() - x.sum())
    y_before = np.cumsum(y) - y + (wb.sum() - y.sum())
    return max(plain, float((1 / (x_after / x + y_before / y)).sum()))


def parity_marks(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, MARK): bit by bit, whether an odd number of the text's distinct shingles falls on that bit."""
    bits = 64 * MARK
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    which = np.concatenate([h for h, _ in sets]) if sets else np.zeros(0, np.uint64)
    counts = np.bincount(owner * bits + (which % np.uint64(bits)).astype(np.int64), minlength=len(sets) * bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(len(sets), MARK)


def may_be_near(a: Column, b: Column, threshold: float) -> Column:
    """False only where the marks (_MARK_TYPE) prove that similarity() is below the threshold.

    The shingles that one text alone has number at least the difference of the counts, and at least the bits in
    which the parities differ. Plain Jaccard t allows (1 - t) / (1 + t) of the sum of the counts. Probability
    Jaccard t puts the distance of the normalised weights at 1 - t at most and the weight outside the common
    shingles at (1 - t) (1 + distance) at most, and no shingle weighs less than one part of the larger total.
    """
    apart = F.abs(a["n"] - b["n"])
    parity = sum((F.bit_count(a[f"m{i}"].bitwiseXOR(b[f"m{i}"])) for i in range(1, MARK)), F.bit_count(a["m0"].bitwiseXOR(b["m0"])))
    plain = (a["n"] + b["n"]) * ((1 - threshold) / (1 + threshold)) + 1e-3
    weighted = F.greatest(a["total"], b["total"]) * ((1 - threshold) * (2 - threshold)) + 1e-3
    most = F.when((a["n"] == a["total"]) & (b["n"] == b["total"]), plain).otherwise(F.greatest(plain, weighted))
    return (apart <= most) & (parity <= most)


def _sketches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, same, bands, mark): a digest of the weighted shingles, null without words, band keys (of weighted and plain shingles) and parity mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            keys = list(band_keys(signatures(sets)))
            # Plain Jaccard: a text that repeats a shingle is also signed with all weights 1, as all others are anyway.
            again = [i for i, (_, w) in enumerate(sets) if len(w) and w.max() > 1]
            for i, plain in zip(again, band_keys(signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in again])), strict=True):
                keys[i] = np.union1d(keys[i], plain)
            same = [xxhash.xxh3_128_digest(h.tobytes() + w.tobytes()) if len(h) else None for h, w in sets]
            bands = pa.array([k if len(h) else [] for k, (h, _) in zip(keys, sets, strict=True)], pa.list_(pa.int64()))
            sizes = [pa.array([f(x) for x in sets], pa.int64()) for f in (lambda x: len(x[0]), lambda x: int(x[1].sum()))]
            mark = pa.StructArray.from_arrays([*sizes, *map(pa.array, np.ascontiguousarray(parity_marks(sets).T))], ["n", "total", *[f"m{i}" for i in range(MARK)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), bands, mark], ["doc_id", "same", "bands", "mark"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, same binary, bands array<long>, mark {_MARK_TYPE}")


def _shingle_sets(docs: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            weights = [w.astype("<u4").tobytes() if len(w) and w.max() > 1 else b"" for _, w in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array(weights, pa.binary())], ["doc", "hashes", "weights"])

    return docs.mapInArrow(run, f"doc {kind}, hashes binary, weights binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(a, b, near) for the pairs (a, b), which are stored."""

    def unpacked(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(hashes, np.uint64)
        return h, np.frombuffer(weights, "<u4").astype(np.int64) if weights else np.ones(len(h), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(unpacked(*row[:2]), unpacked(*row[2:])) >= threshold for row in zip(*[batch.column(c).to_pylist() for c in range(2, 6)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    if pairs.count() <= shared.FEW_ROWS:  # then not all shingles need be dealt out
        ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        sets = sets.join(F.broadcast(ends), "doc", "left_semi")
    left = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    right = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ha", "wa", "hb", "wb")
    return joined.mapInArrow(run, f"a {kind}, b {kind}, near boolean")


def _plausible(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that their marks do not rule out."""
    one, two = (marks.select(F.col("doc").alias(c), F.col("mark").alias(f"mark_{c}")) for c in "ab")
    near = may_be_near(F.col("mark_a"), F.col("mark_b"), threshold)
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(near).select("a", "b")


def _ordered(one: Column, two: Column) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _apart(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with their component, of buckets that hold more than one; a text without links is its own component."""
    now = entries.join(told_apart(labels.withColumnRenamed("node", "doc")), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("label"))
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return stored(now.join(told_apart(stored(mixed, "near-mixed")), "key"), "near-apart")


def _block_pairs(now: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The plausible pairs of different components within buckets (key, doc, label), each pair once.

    One text of a pair is outside the bucket's largest component. A bucket of n texts, m of them outside, is cut
    into n / BLOCK times m / BLOCK blocks, so no task holds a large bucket.
    """
    sizes = now.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    sizes = stored(sizes.select("key", F.col("top.label").alias("major"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("columns")), "near-sizes")
    known = now.join(told_apart(sizes), "key").join(marks.hint("merge"), "doc")
    draw = F.xxhash64("doc")
    row, column = F.pmod(draw, "rows").cast("int"), F.pmod(draw, "columns").cast("int")
    one = known.where("label <> major").select("key", column.alias("column"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.col("doc").alias("x"), F.col("label").alias("label_x"), F.col("mark").alias("mark_x"), F.col("bands").alias("bands_x"))
    two = known.select("key", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), row.alias("row"), F.col("doc").alias("y"), F.col("label").alias("label_y"), (F.col("label") == F.col("major")).alias("is_major"), F.col("mark").alias("mark_y"), F.col("bands").alias("bands_y"))
    # Both in the smallest bucket that they share: the pair comes from there alone.
    here = F.array_min(F.array_intersect("bands_x", "bands_y")) == F.col("key")
    differ = (F.col("label_x") != F.col("label_y")) & (F.col("is_major") | (F.col("x") < F.col("y")))
    met = stored(one, "near-one").join(stored(two, "near-two").hint("merge"), ["key", "row", "column"])
    return met.where(differ & may_be_near(F.col("mark_x"), F.col("mark_y"), threshold) & here).select(*_ordered(F.col("x"), F.col("y")))


def _labels(texts: DataFrame, docs: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(node, root) for the texts that have a link; docs: (doc, text), for the shingles of the texts in shared buckets."""
    spread = texts.select("doc", F.explode("bands").alias("key"))
    met_in = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    entries = stored(spread.join(met_in.hint("merge"), "key"), "near-buckets")
    weight = stored(entries.groupBy("doc").agg(F.sum("n").alias("weight")), "near-weights")
    entries = stored(entries.join(weight.hint("merge"), "doc").select("key", "doc", "weight"), "near-entries")
    marks = stored(texts.join(weight.select("doc").hint("merge"), "doc", "left_semi").select("doc", "mark", "bands"), "near-marks")
    sets = stored(_shingle_sets(docs.join(weight.select("doc").hint("merge"), "doc", "left_semi"), kind), "near-sets")
    if not sets.groupBy("doc").count().where("count > 1").isEmpty():  # ids that repeat
        sets = stored(sets.dropDuplicates(["doc"]), "near-sets")

    def joined(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        told = stored(_verified(stored(pairs, "near-pairs"), sets, threshold, kind), "near-told").where("near").select("a", "b")
        return components(told if labels is None else told.union(labels.where("node <> root").select("node", "root")), "near-components")

    heads = stored(entries.groupBy("key").agg(F.max(F.struct("weight", "doc")).alias("top")), "near-heads")
    met = entries.join(heads.hint("merge"), "key").where(F.col("doc") != F.col("top.doc"))
    best = met.groupBy("doc").agg(F.max("top").alias("top")).select(*_ordered(F.col("doc"), F.col("top.doc"))).distinct()
    labels = joined(_plausible(best, marks, threshold), None)

    now = _apart(entries, labels)
    tops = stored(heads.select("key", F.col("top.doc").alias("doc")).join(now.hint("merge"), ["key", "doc"]).select("key", F.col("doc").alias("head"), F.col("label").alias("head_label")), "near-tops")
    other = now.join(told_apart(tops), "key").where("label <> head_label").select(*_ordered(F.col("doc"), F.col("head"))).distinct()
    labels = joined(_plausible(other, marks, threshold), labels)
    return joined(_block_pairs(_apart(now.select("key", "doc"), labels), marks, threshold), labels)


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, class_id, kept) for every row; class_id is the smallest id of the class, and that row is kept.

    Texts with equal weighted shingles are one text from the start, so copies cost no comparisons. Null text counts
    as empty; rows without words and rows with a null id are alone (class_id is their id); rows that repeat an id
    are one document; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    for_python(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    with scratch(spark) as result:
        sketches = stored(_sketches(docs, id_column, text_column), "near-sketches")
        named = sketches.where("doc_id is not null and same is not null")
        texts = stored(named.groupBy("same").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("mark", "doc_id").alias("mark"), F.count("*").alias("copies")), "near-texts")
        labels = _labels(texts, docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text")), threshold, kind)
        known = texts.select("same", "doc", "copies").join(labels.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").where("copies > 1 or root is not null")
        known = stored(known.select("same", F.coalesce("root", "doc").alias("class")), "near-classes")
        out = sketches.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(told_apart(known), "same", "left")
        found = F.coalesce("class", "doc_id")
        return result(out.select(F.col("doc_id").alias(id_column), found.alias("class_id"), F.col("doc_id").eqNullSafe(found).alias("kept")), "near-result")


def kept_rows(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay: one document of each class, with all its columns (rows that repeat its id too).

    The texts are dealt by id once, at every size, and met there by the ids that go.
    """
    with scratch(docs.sparkSession) as result:
        gone = result(classes(docs, threshold, id_column, text_column).where("not kept").select(F.col(id_column)).distinct(), "near-gone")
    return docs.join(gone.hint("merge"), id_column, "left_anti").select(*docs.columns)
