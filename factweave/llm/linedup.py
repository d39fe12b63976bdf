"""Substring deduplication: lines by the hash of their normalised text, and passages within lines.

A unit is a line, normalised to its words in lower case (without words: to its characters but white space). Passages that repeat within longer lines have no unit of
their own, so a second kind of unit covers them: 25-word windows, chosen by content (the smallest hash of every 25
neighbouring windows), of which any repeated stretch of 49 words or more has one at the same place. Digests of both
kinds are grouped globally, the occurrence with the smallest (id, offset) is kept, and the others are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.bpe import slices
from factweave.llm.neardup import mixed, word_hashes
from factweave.llm.shared import for_python, scratch, stored

#: Least words of a line and of a passage; words of a window, and windows of which one is chosen.
LINE_WORDS, PASSAGE_WORDS, SPAN, CHOICE = 20, 50, 25, 25
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, SPAN - 1 - k, 1 << 64) for k in range(SPAN)], np.uint64)


def chosen_windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen windows of a text's word hashes; none in under SPAN words."""
    n = len(words) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(SPAN):
        total += words[k : k + n] * _POWERS[k]
    total = mixed(total)
    if n <= CHOICE:
        places = np.array([total.argmin()])
    else:
        places = np.unique(sliding_window_view(total, CHOICE).argmin(axis=1) + np.arange(n - CHOICE + 1))
        if (total[places[1:]] == total[places[:-1]]).any():
            places = _thinned(places, total)
    return places, total[places]


def _thinned(places: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of equal hashes (the text repeats itself), one in every CHOICE neighbouring windows is enough."""
    kept, last = [], {}
    values = total[places].tolist()
    for i, (place, value) in enumerate(zip(places.tolist(), values, strict=True)):
        if value not in last or i + 1 == len(values) or values[i + 1] != value or places[i + 1] - last[value] > CHOICE:
            kept.append(place)
            last[value] = place
    return np.array(kept)


def lines_of(text: str, least: int) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each non-blank line with at least so many words; offsets in code points."""
    out, start = [], 0
    for line in text.split("\n"):
        if len(line) >= 2 * least - 1 and not line.isspace() and line:
            words = _WORD.findall(line.lower())
            if len(words) >= least:
                plain = " ".join(words) if words else "\0" + "".join(line.split())
                out.append((start, start + len(line), len(words), xxhash.xxh3_128_digest(plain)))
        start += len(line) + 1
    return out


def _units(docs: DataFrame, kind: str, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [word_hashes(t) for t in texts]
            sizes, windows = [len(w) for w in words], [chosen_windows(w) for w in words]
            lines = [lines_of(t, least) for t in texts]
            flat = list(zip(*[x for doc in lines for x in doc], strict=True)) or [(), (), (), ()]
            units = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["start", "end", "words", "digest"])
            told = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lines)]), pa.int32()), units)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array([p for p, _ in windows], pa.list_(pa.int32())), pa.array([h.view(np.int64) for _, h in windows], pa.list_(pa.int64())), told],
                ["doc", "n", "places", "hashes", "lines"],
            )

    return docs.mapInArrow(run, f"doc {kind}, n int, places array<int>, hashes array<long>, lines array<struct<start:long,end:long,words:long,digest:binary>>")


def _again(units: DataFrame) -> DataFrame:
    """(doc, place, n, hash, source, source_place, other) for windows that an earlier document has: the smallest such id, its first place, and whether there are more such documents or places. n: words of doc."""
    with scratch(units.sparkSession) as result:
        spread = units.select("doc", "n", F.inline(F.arrays_zip("places", "hashes"))).withColumnsRenamed({"places": "place", "hashes": "hash"})
        first = spread.groupBy("hash").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source < last").select("hash", "source")
        shared = stored(spread.join(first, "hash"), "repeat-windows")
        own, later = F.col("doc") == F.col("source"), F.col("doc") > F.col("source")
        place = shared.groupBy("hash").agg(F.min(F.when(own, F.col("place"))).alias("source_place"), F.max(F.when(own, F.col("place"))).alias("source_last"), F.min(F.when(later, F.col("doc"))).alias("second"))
        again = shared.where(later).join(place, "hash").withColumn("other", (F.col("doc") > F.col("second")) | (F.col("source_last") > F.col("source_place")))
        return result(again.select("doc", "place", "n", "hash", "source", "source_place", "other").distinct(), "repeat-again")


def _runs(again: DataFrame, width: int) -> DataFrame:
    """Stretches of neighbouring windows that an earlier document has at the same distance; end: the place of the last SPAN words."""
    order = Window.partitionBy("doc").orderBy("place")
    shift = F.col("place") - F.col("source_place")
    same = (F.col("place") - F.lag("place").over(order) <= SPAN) & (F.lag("source").over(order) == F.col("source")) & (F.lag(shift).over(order) == shift)
    marked = again.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc", "run").agg(F.min("place").alias("begin"), (F.max("place") + (width - SPAN)).cast("int").alias("end"), F.first("source").alias("source"), F.min("source_place").alias("source_begin"))


def _outside(places: DataFrame, covered: DataFrame, left: Column, right: Column) -> DataFrame:
    """The places whose words from left to right are not all within one of the covered stretches (doc, low, high), which are apart."""
    rows = places.withColumns({"_at": left.cast("long"), "_right": right.cast("long"), "_high": F.lit(None).cast("long")})
    names = [c for c in rows.columns if c not in ("doc", "_at", "_high")]
    stretches = covered.select("doc", F.col("low").alias("_at"), F.col("high").alias("_high"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names])
    order = Window.partitionBy("doc").orderBy("_at", F.col("_right").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(stretches).withColumn("_reach", F.max("_high").over(order))
    return both.where(F.col("_right").isNotNull() & (F.coalesce("_reach", F.lit(0)) < F.col("_right"))).select(*places.columns)


def _wide_units(docs: DataFrame, kind: str, width: int) -> DataFrame:
    """(doc, n, places, hashes) of all windows of width words that hold a SPAN-word window at one of the wanted places."""
    powers = np.array([pow(0x9E3779B97F4A7C15, width - 1 - k, 1 << 64) for k in range(width)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                words = word_hashes(text or "")
                places = np.unique(np.array(wanted)[:, None] - np.arange(width - SPAN + 1))
                places = places[(places >= 0) & (places <= len(words) - width)]
                total = np.zeros(len(places), np.uint64)
                for k in range(width):
                    total += words[places + k] * powers[k]
                yield pa.RecordBatch.from_arrays([pa.array([doc], batch.column(0).type), pa.array([len(words)], pa.int32()), pa.array([places], pa.list_(pa.int32())), pa.array([mixed(total).view(np.int64)], pa.list_(pa.int64()))], ["doc", "n", "places", "hashes"])

    return docs.mapInArrow(run, f"doc {kind}, n int, places array<int>, hashes array<long>")


def _contexts(docs: DataFrame, kind: str) -> DataFrame:
    """For each wanted stretch (begin, end: places of its first and last window) of a document: a digest of its words, the hashes of up to SPAN - 1 words on either side, and the offsets of all these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                lower = (text or "").lower()
                words = word_hashes(text or "")
                spans = np.array([m.span() for m in _WORD.finditer(lower)], np.int32).reshape(-1, 2)
                if len(lower) != len(text or ""):  # a letter's lower case is longer: back to the text's own offsets
                    origin = np.repeat(np.arange(len(text), dtype=np.int32), [len(c.lower()) for c in text])
                    if len(origin) == len(lower):
                        spans = np.stack([origin[spans[:, 0]], origin[spans[:, 1] - 1] + 1], axis=1)
                rows = []
                for w in wanted:
                    begin, after = w["begin"], w["end"] + SPAN
                    left, right = max(0, begin - SPAN + 1), min(len(words), after + SPAN - 1)
                    rows.append((
                        doc, begin, w["end"], xxhash.xxh3_128_digest(words[begin:after].tobytes()), words[left:begin].tobytes(), words[after:right].tobytes(),
                        spans[left : begin + 1, 0].tobytes(), spans[after - 1 : right, 1].tobytes() if w["own"] else b"",
                    ))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [batch.column(0).type, pa.int32(), pa.int32(), *[pa.binary()] * 5], strict=True)], ["doc", "begin", "end", "digest", "left", "right", "starts", "ends"])

    return docs.mapInArrow(run, f"doc {kind}, begin int, end int, digest binary, left binary, right binary, starts binary, ends binary")


def _agreeing(a: bytes, b: bytes, backwards: bool) -> int:
    """How many words agree from the stretch outwards."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    x, y = (x[::-1], y[::-1]) if backwards else (x, y)
    size = min(len(x), len(y))
    differ = np.flatnonzero(x[:size] != y[:size])
    return int(differ[0]) if len(differ) else size


def _stretched(pairs: DataFrame, kind: str) -> DataFrame:
    """Verifies each stretch and extends it on both sides as far as the words agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, begin, end, left, right, starts, ends, source, source_left, source_right, source_starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                back, on = _agreeing(left, source_left, True), _agreeing(right, source_right, False)
                start, source_start = (int(np.frombuffer(x, np.int32)[-1 - back]) for x in (starts, source_starts))
                out.append((doc, start, int(np.frombuffer(ends, np.int32)[on]), end - begin + SPAN + back + on, source, source_start, begin - back))
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), batch.column(0).type, pa.int64(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], ["doc", "start", "end", "n_words", "first_doc", "first_start", "word"])

    return pairs.mapInArrow(run, f"doc {kind}, start long, end long, n_words long, first_doc {kind}, first_start long, word long")


def _made(runs: DataFrame, plain: DataFrame, kind: str) -> DataFrame:
    """The verified and extended stretches of the runs. The texts are dealt by id at every size."""
    with scratch(plain.sparkSession) as result:
        runs = stored(runs, "repeat-runs")
        ends = F.col("source_begin") + F.col("end") - F.col("begin")
        wanted = runs.select("doc", "begin", "end", F.lit(True).alias("own")).union(runs.select("source", "source_begin", ends.cast("int"), F.lit(False)))
        wanted = wanted.groupBy("doc", "begin", "end").agg(F.bool_or("own").alias("own"))
        wanted = stored(wanted.groupBy("doc").agg(F.collect_list(F.struct("begin", "end", "own")).alias("wanted")), "repeat-wanted")
        contexts = stored(_contexts(plain.join(wanted.hint("merge"), "doc").select("doc", "text", "wanted"), kind), "repeat-contexts").dropDuplicates(["doc", "begin", "end"])
        source = contexts.select(F.col("doc").alias("source"), F.col("begin").alias("source_begin"), F.col("end").alias("source_end"), F.col("digest").alias("source_digest"), F.col("left").alias("source_left"), F.col("right").alias("source_right"), F.col("starts").alias("source_starts"))
        pairs = runs.withColumn("source_end", ends.cast("int")).join(contexts, ["doc", "begin", "end"]).join(source, ["source", "source_begin", "source_end"]).where("digest = source_digest")
        made = _stretched(pairs.select("doc", "begin", "end", "left", "right", "starts", "ends", "source", "source_left", "source_right", "source_starts"), kind)
        return result(made, "repeat-made")


def _grouped(made: DataFrame) -> DataFrame:
    """Stretches with the number of their group of touching ones, and the words these have together."""
    order = Window.partitionBy("doc").orderBy("word", "n_words", "first_doc", "first_start")
    reach = F.max(F.col("word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    made = made.withColumn("new", F.when(F.col("word") <= reach, 0).otherwise(1)).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("doc", "group")
    return made.withColumn("together", F.max(F.col("word") + F.col("n_words")).over(group) - F.min("word").over(group))


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", line_words: int = LINE_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, start, end, kind, n_words, first_id, first_start): every stretch to be removed, and what it repeats.

    Offsets are code points of the original text, end exclusive. Kind ``line``: a line of at least ``line_words``
    words (0: any line that is not blank) whose words an earlier line has, of this document or one with a smaller
    id; a line without words repeats one with the same characters but white space. Kind ``passage``: words that
    a document with a smaller id has in the same order; touching stretches have at least ``passage_words``
    together. Shorter units stay. Null text counts as empty; rows with a null id are left alone; rows that repeat
    an id are one document; other columns are ignored; no rows give no rows.
    """
    for_python(docs.sparkSession)
    with scratch(docs.sparkSession) as result:
        return result(_repeats(docs, id_column, text_column, line_words, passage_words), "repeats")


def _repeats(docs: DataFrame, id_column: str, text_column: str, line_words: int, passage_words: int) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text")).where("doc is not null")
    units = stored(_units(plain, kind, line_words), "repeat-units")

    lines = units.select("doc", F.inline("lines"))
    first = lines.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")).where("first < last").select("digest", "first")
    lines = lines.join(first, "digest").where("struct(doc, start) > first").select("doc", "start", "end", F.lit("line").alias("kind"), F.col("words").alias("n_words"), F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start")).distinct()

    again = _again(units)
    made = _made(_runs(again, SPAN), plain, kind)
    # Where the chosen source's stretch ends and others have the window, all windows of a whole passage get a source of their own.
    width = max(passage_words, SPAN + CHOICE - 1)
    covered = stored(_grouped(made).where(F.col("together") >= passage_words).groupBy("doc", "group").agg(F.min("word").alias("low"), F.max(F.col("word") + F.col("n_words")).alias("high")), "repeat-covered")
    left, right = F.greatest(F.col("place") - (width - SPAN), F.lit(0)), F.least(F.col("place") + width, F.col("n"))
    open_hashes = stored(_outside(again.where("other"), covered, left, right).select("hash").distinct(), "repeat-open")
    spread = units.select("doc", F.inline(F.arrays_zip("places", "hashes"))).withColumnsRenamed({"places": "place", "hashes": "hash"})
    near = spread.join(open_hashes, "hash", "left_semi").groupBy("doc").agg(F.collect_set("place").alias("wanted"))
    wide = stored(_wide_units(plain.join(stored(near, "repeat-near").hint("merge"), "doc").select("doc", "text", "wanted"), kind, width), "repeat-wide").dropDuplicates(["doc"])
    further = _outside(_again(wide), covered, F.col("place"), F.col("place") + width)
    made = _grouped(made.union(_made(_runs(further, width), plain, kind)))
    passages = made.where(F.col("together") >= passage_words).select("doc", "start", "end", F.lit("passage").alias("kind"), "n_words", "first_doc", "first_start").distinct()
    return lines.union(passages).withColumnsRenamed({"doc": id_column, "first_doc": f"first_{id_column}"})


def cleaned(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the spans of repeats() cut out of their texts; the original offsets that remain are in ``kept_spans``.

    A column kept_spans of docs is replaced; other columns may have any names. A null text stays null.
    """
    one = "array<struct<start:bigint,end:bigint>>"
    none = F.array().cast(one)
    docs = docs.drop("kept_spans")
    cuts = spans.groupBy(F.col(id_column).alias("cut_id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_column).alias("own_id"))

    def step(state, cut):
        piece = F.when(cut["start"] > state["at"], F.array(F.struct(state["at"].alias("start"), cut["start"].alias("end")))).otherwise(none)
        return F.struct(F.concat(state["kept"], piece).alias("kept"), F.greatest(state["at"], cut["end"]).alias("at"))

    whole = F.col("row")[text_column]
    size = F.length(whole).cast("long")
    start = F.struct(none.alias("kept"), F.lit(0).cast("long").alias("at"))
    joined = rows.join(cuts, F.col("own_id") == F.col("cut_id"), "left").withColumn("state", F.aggregate(F.coalesce("cuts", none), start, step))
    tail = F.when(size > F.col("state.at"), F.array(F.struct(F.col("state.at").alias("start"), size.alias("end")))).otherwise(none)
    joined = joined.withColumn("kept", F.concat("state.kept", tail))
    text = F.when(F.col("cuts").isNull(), whole).otherwise(F.array_join(F.transform("kept", lambda s: F.substr(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))
    return joined.select(*[text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns], F.col("kept").alias("kept_spans"))
