"""Language-model scoring with a class-based bigram model, whose classes are found by exchange.

P(text) is the product over its tokens of P(class | history) * P(token | class). A token's history is the history class
of the token before it: the most frequent words are clustered by the two-sided exchange for that, and every other word
takes the class that the clustered words with its longest ending mostly have, so a history needs no table. The class
that a token is predicted by comes from the one-sided (predictive) exchange over the whole training vocabulary: from
the counts of (history, word), gathered over all training texts, every word moves, sweep by sweep, to the class with
which its histories are most likely, its own counts taken out. All words of a sweep move at once, as in distributed
clustering, so that a sweep is one pass over a table with one row a word. Unseen words take their history class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.bpe import slices
from factweave.llm.shared import dropped, for_python, scratch, stored

#: Words clustered for histories, classes, longest ending in bytes; a frequent word has at least 1 of so many tokens.
CLUSTERED, CLASSES, ENDING, FREQUENT = 1024, 32, 4, 1 << 20
#: Sweeps of the exchange over all words; added to a count of (history, class) in it, and words taken at a time.
SWEEPS, FLOOR, WORDS = 2, 0.5, 8192
#: Added to a word's count within its class, and the weight of the class's own frequency in a transition.
DELTA, ALPHA = 0.5, 8.0
FLUSH = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case, as UTF-8."""
    return (text or "").encode().lower().split()


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = 8) -> np.ndarray:
    """Classes of the words 0 to n-1, given bigram counts (n+1, n+1) whose last row and column are the text's end.

    Each word in turn moves to the class where the bigram likelihood of classes is largest, until a sweep moves
    none. The end has a class of its own, the last.
    """
    n = len(counts) - 1
    where = np.append(np.arange(n) % classes, classes)
    joint = np.zeros((classes + 1, classes + 1))
    np.add.at(joint, (where[:, None], where[None, :]), counts)

    def phi(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    own = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            out = np.bincount(where, counts[w], classes + 1)
            into = np.bincount(where, counts[:, w], classes + 1)
            here, self_count = where[w], counts[w, w]
            out[here] -= self_count
            into[here] -= self_count
            joint[here] -= out
            joint[:, here] -= into
            joint[here, here] -= self_count
            rows, columns = joint[:classes], joint[:, :classes].T
            gain = (phi(rows + out) - phi(rows)).sum(1) + (phi(columns + into) - phi(columns)).sum(1)
            diagonal = joint[own, own]
            gain -= phi(diagonal + out[own]) + phi(diagonal + into[own]) - phi(diagonal) - phi(diagonal + out[own] + into[own] + self_count)
            left, right = rows.sum(1), columns.sum(1)
            gain -= phi(left + out.sum() + self_count) - phi(left) + phi(right + into.sum() + self_count) - phi(right)
            best = int(gain.argmax())
            if gain[best] <= gain[here] + 1e-9:
                best = int(here)
            moved += best != here
            where[w] = best
            joint[best] += out
            joint[:, best] += into
            joint[best, best] += self_count
        if not moved:
            break
    return where[:n]


@dataclass
class Classes:
    """The class of every possible word. ``codes``: frequent words, most frequent first; ``of_code``: their classes."""

    codes: dict[bytes, int]
    of_code: np.ndarray
    endings: dict[bytes, int]
    default: int

    def of(self, word: bytes) -> int:
        for size in range(min(ENDING, len(word)), 0, -1):
            found = self.endings.get(word[-size:])
            if found is not None:
                return found
        return self.default

    @staticmethod
    def made(frequent: list[tuple[bytes, int]], clustered: np.ndarray) -> Classes:
        votes: dict[bytes, np.ndarray] = {}
        total = np.zeros(CLASSES)
        for (word, n), k in zip(frequent, clustered, strict=False):
            total[k] += n
            for size in range(1, min(ENDING, len(word)) + 1):
                votes.setdefault(word[-size:], np.zeros(CLASSES))[k] += n
        out = Classes({w: i for i, (w, _) in enumerate(frequent)}, np.zeros(0, int), {e: int(v.argmax()) for e, v in votes.items()}, int(total.argmax()))
        out.of_code = np.array([*clustered, *(out.of(w) for w, _ in frequent[len(clustered) :])], int)
        return out

    def sequence(self, words: list[bytes], memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (-1: not frequent) and classes."""
        codes = np.fromiter((self.codes.get(w, -1) for w in words), np.int64, len(words))
        kinds = self.of_code[codes] if len(self.of_code) else np.zeros(len(words), int)
        for i in np.flatnonzero(codes < 0):
            word = words[i]
            kind = memo.get(word)
            if kind is None:
                if len(memo) > FLUSH:
                    memo.clear()
                kind = memo[word] = self.of(word)
            kinds[i] = kind
        return codes, kinds


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in the column ``text``; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                held.update(words_of(text))
                if len(held) > FLUSH:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(texts: DataFrame, side: int, steps) -> np.ndarray:
    """A (side, side) matrix of counts over all texts: steps(words) gives each text's row and column numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(side * side, np.int64)
        for batch in slices(batches):
            seen = [before * side + after for before, after in (steps(words_of(t)) for t in batch.column(1).to_pylist())]
            held += np.bincount(np.concatenate(seen), minlength=side * side)
        there = np.flatnonzero(held)
        for at in range(0, len(there), 100_000):
            part = there[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(held[part], pa.int64())], ["at", "n"])

    rows = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(side, side)


def context_counts(texts: DataFrame, coded: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], frequent: Callable[[], list[bytes]]) -> DataFrame:
    """(word, h array, n array): how often each word, and b"" for a text's end, follows each history.

    ``coded`` gives the codes (-1: not frequent) and history classes of words, ``frequent`` the words by code. A task
    counts frequent words in a table of at most FREQUENT times CLASSES + 1 numbers and gives them out once, so a word
    of any frequency sends a few dozen rows a task; others are counted by word. All meet in one exchange by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, width = frequent(), CLASSES + 1
        table = np.zeros(len(names) * width, np.int32)
        held: Counter = Counter()

        def out(words: list[bytes], before: list[int] | np.ndarray, times: list[int] | np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(before, pa.int32()), pa.array(times, pa.int64())], ["word", "h", "n"])

        def rest() -> pa.RecordBatch:
            words, before = zip(*held, strict=True)
            return out(words, before, list(held.values()))

        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                codes, own = coded(words)
                before = np.concatenate([[CLASSES], own])
                there = codes >= 0
                np.add.at(table, codes[there] * width + before[:-1][there], 1)
                places = np.flatnonzero(~there)
                held.update(zip([words[i] for i in places], before[places].tolist(), strict=True))
                held[b"", int(before[-1])] += 1
                if len(held) > FLUSH:
                    yield rest()
                    held.clear()
        if held:
            yield rest()
        some = np.flatnonzero(table)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield out([names[i] for i in part // width], part % width, table[part])

    rows = texts.mapInArrow(run, "word binary, h int, n long").repartition("word").groupBy("word", "h").agg(F.sum("n").alias("n"))
    return rows.groupBy("word").agg(F.collect_list(F.struct("h", "n")).alias("c")).select("word", F.col("c.h").alias("h"), F.col("c.n").alias("n"))


def moved(counts: np.ndarray, now: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The classes of words after a sweep, from their counts by history (words, histories) and their classes now.

    ``joint`` are the counts of (history, class) of all words. A word's own counts are taken out of its class first;
    of equal classes the first is taken, but a word stays where it is as well off.
    """
    total = joint.sum(0)
    scores = counts @ np.log(joint + FLOOR) - counts.sum(1, keepdims=True) * np.log(total + FLOOR * len(joint))
    own = np.log(np.maximum(joint.T[now] - counts, 0) + FLOOR)
    left = np.maximum(total[now] - counts.sum(1), 0) + FLOOR * len(joint)
    here = (counts * own).sum(1) - counts.sum(1) * np.log(left)
    at = np.arange(len(now))
    scores[at, now] = here
    best = scores.argmax(1)
    return np.where(scores[at, best] > here + 1e-9, best, now)


def _classed(rows: pa.RecordBatch, joints: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, counts by history, classes) of the words in rows (word, h, n, kind), as the sweeps with these joint counts leave them."""
    sizes = np.diff(rows.column(1).offsets.to_numpy())
    for at in range(0, rows.num_rows, WORDS):
        part = rows.slice(at, WORDS)
        owner = np.repeat(np.arange(part.num_rows), sizes[at : at + WORDS])
        counts = np.zeros((part.num_rows, CLASSES + 1))
        counts[owner, part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
        now = part.column(3).to_numpy()
        for joint in joints:
            now = moved(counts, now, joint)
        yield np.arange(at, at + part.num_rows), counts, now


def _exchanged(words: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(word, n, kind) for words (word, h array, n array, kind at first), and the counts of (history, class), after all sweeps.

    The words' classes are kept nowhere between sweeps: each pass finds them again from the joint counts of those
    before, which are CLASSES + 1 rows of CLASSES numbers.
    """
    joints: list[np.ndarray] = []

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((CLASSES, CLASSES + 1))
        for batch in batches:
            for _, counts, now in _classed(batch, joints):
                np.add.at(held, now, counts)
        yield pa.RecordBatch.from_arrays([pa.array(range(held.size), pa.int32()), pa.array(held.ravel().astype(np.int64))], ["at", "n"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, counts, now in _classed(batch, joints):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(places[0], len(places)), pa.array(counts.sum(1).astype(np.int64)), pa.array(now.astype(np.int32))], ["word", "n", "kind"])

    while True:
        joint = np.zeros(CLASSES * (CLASSES + 1))
        for r in words.mapInArrow(summed, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            joint[r["at"]] = r["n"]
        joint = joint.reshape(CLASSES, CLASSES + 1).T
        if len(joints) == SWEEPS or joints and (joint == joints[-1]).all():
            return words.mapInArrow(classes, "word binary, n long, kind int"), joint
        joints.append(joint)


def scored(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    Tokens are a text's words and one end. ``training`` says which rows are learned from (null: no). base_score
    is the add-one unigram log10 probability, score that of the class model, perplexity its inverse a token. Null text
    counts as empty; ids may be null or repeat; other columns are ignored; without training rows every count is 0.

    Frequent words, of which there can be at most FREQUENT, go to all workers with their counts. Every other word
    is counted and looked up by a join on the word, of whose rows none can have more than 1 in FREQUENT.
    """
    spark = docs.sparkSession
    for_python(spark)
    with scratch(spark) as result:
        return result(_scored(docs, training, id_column, text_column), "lm-scores")


def _scored(docs: DataFrame, training: Column, id_column: str, text_column: str) -> DataFrame:
    spark = docs.sparkSession
    learn = docs.where(training).select(id_column, text_column)
    counts = stored(word_counts(learn), "lm-counts")
    ends = learn.count()
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = (total or 0) + ends, kinds + (ends > 0)
    rows = counts.where(F.col("n") * FREQUENT >= tokens).collect()
    frequent = sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    clustered = min(CLUSTERED, len(frequent))
    shared = spark.sparkContext.broadcast({w: i for i, (w, _) in enumerate(frequent[:clustered])})

    def neighbours(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known = shared.value
        code = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        code = np.concatenate([[clustered], code, [clustered]])
        there = (code[:-1] >= 0) & (code[1:] >= 0)
        return code[:-1][there], code[1:][there]

    model = spark.sparkContext.broadcast(Classes.made(frequent, exchange(_summed(learn, clustered + 1, neighbours))))
    memo: dict[bytes, int] = {}

    def histories(words: list[bytes]) -> np.ndarray:
        return model.value.sequence(words, memo)[1]

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(histories(batch.column(0).to_pylist()).astype(np.int32))], ["word", "h", "n", "kind"])

    ended = F.col("word") == F.lit(b"")
    def coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return model.value.sequence(words, memo)

    contexts = stored(context_counts(learn, coded, lambda: list(model.value.codes)).mapInArrow(begun, "word binary, h array<int>, n array<long>, kind int"), "lm-contexts")
    made, joint = _exchanged(contexts.where(~ended))
    words = stored(made, "lm-words")
    dropped(counts)
    into_end = np.zeros(CLASSES + 1)
    for r in contexts.where(ended).collect():
        into_end[r["h"]] = r["n"]
    sizes = np.zeros(CLASSES)
    for r in words.groupBy("kind").agg(F.count("*").alias("n")).collect():
        sizes[r["kind"]] = r["n"]
    steps = np.column_stack([joint, into_end])
    into = steps.sum(0)
    share = (into + 1) / (into.sum() + CLASSES + 1)
    log_step = np.log10((steps + ALPHA * share) / (steps.sum(1, keepdims=True) + ALPHA))
    log_room = np.log10(into[:CLASSES] + DELTA * (sizes + 1))
    n = np.array([c for _, c in frequent], np.float64)
    predicted = np.zeros(len(frequent), np.int64)
    for r in words.where(F.col("n") * FREQUENT >= tokens).select("word", "kind").toLocalIterator():
        predicted[model.value.codes[bytes(r["word"])]] = r["kind"]
    log_base, log_word = np.log10(n + 1), np.log10(n + DELTA) - log_room[predicted]
    room = float(np.log10(tokens + distinct + 1))
    tables = spark.sparkContext.broadcast((log_step, log_base, log_word, predicted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_step, log_base, log_word, predicted = tables.value
        known = model.value
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                codes, own = known.sequence(words, memo)
                before = np.concatenate([[CLASSES], own])
                there = codes >= 0
                at = codes[there]
                places = np.flatnonzero(~there)
                rest = Counter(zip([words[i] for i in places], before[places].tolist(), own[places].tolist(), strict=True))
                length = len(words) + 1
                base = log_base[at].sum() + np.log10(ends + 1) - length * room
                value = log_step[before[:-1][there], predicted[at]].sum() + log_word[at].sum() + log_step[before[-1], CLASSES]
                names, left, ending = zip(*rest, strict=True) if rest else ((), (), ())
                out.append((length, len(at) + (ends > 0), float(base), float(value), names, left, ending, list(rest.values())))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, types, strict=True)]], ["doc_id", "n_tokens", "known", "base", "value", "words", "left", "endings", "times"])

    kind = docs.schema[id_column].dataType.simpleString()
    made = docs.select(id_column, text_column).mapInArrow(score, f"doc_id {kind}, n_tokens long, known long, base double, value double, words array<binary>, left array<int>, endings array<int>, times array<long>")
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "lm-partial")
    rare = made.select("row", F.inline(F.arrays_zip("words", "left", "endings", "times"))).withColumnsRenamed({"words": "word", "times": "k"})
    rare = rare.join(words.where(F.col("n") * FREQUENT < tokens), "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("kind", F.coalesce("kind", "endings"))
    k, n = F.col("k"), F.col("n")
    step = F.get(F.lit(log_step[:, :CLASSES].ravel().tolist()), F.col("left") * CLASSES + F.col("kind")) - F.get(F.lit(log_room.tolist()), F.col("kind"))
    rare = rare.groupBy("row").agg(F.sum(F.when(n > 0, k).otherwise(0)).alias("k"), F.sum(k * F.log10(n + 1)).alias("b"), F.sum(k * (F.log10(n + DELTA) + step)).alias("v"))
    whole = made.drop("words", "left", "endings", "times").join(rare, "row", "left")
    value = F.col("value") + F.coalesce("v", F.lit(0.0))
    return whole.select(
        F.col("doc_id").alias(id_column), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )
