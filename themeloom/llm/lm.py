"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(group | history) P(leaf | group, history) P(word | leaf).  The first two
factors are softmaxes over ``WAYS`` outcomes each, so ``WAYS`` * ``WAYS`` leaves cost twice
``WAYS`` outputs.  Their weights are looked up by hashed n-gram and skip features of the two
words before, for the second factor together with the group; every template has rows of
its own, and their number grows with the number of different words learned from.  The
most frequent words are leaves of their own; other words are put in leaves by their ending,
and share what their leaf has by discounted relative frequency, the maximum-entropy
solution with one indicator per word, where the discount is left to unknown words.

Counts cover all training texts.  Training goes over all training texts in rounds: every
task starts from the weights sent, makes gradient updates with its texts, and for every
row of weights the mean of the changes by the tasks that had it, summed block by block, is
the next start.  Scoring is by numpy batches
of tokens; counts of frequent words are sent to the tasks (at most ``HEAD`` of them), the
others are joined.

Defined results: A-Z are lower-cased; words are separated by the six ASCII white space
bytes; every text ends with one end token, also an empty or null one; with no training
texts, leaves are equally likely and all words unknown; rows where it is unknown whether
they are for training, such as those without id in the query, are scored and not learned
from; repeated rows give repeated results; other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.bpe import _id_type
from themeloom.llm.words import FACTORS, GOLD, Slice, find_words, lower_ascii, mix, slices, word_hashes
from themeloom.session import materialize

WAYS = 16
SINGLES = 128
ENDINGS = 128
CLASSES = SINGLES + ENDINGS
# Templates of features, each with from 2 to the 12th to 2 to the 17th rows: one for about
# every 128 different words.  A task sends the changes of all rows once a round.
FEATURES = 3
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 17
WORDS_PER_ROW = 128
BLOCKS = 64
ROUNDS = 1
RATE = 0.6
BATCH = 16_384
# Tasks whose changes are summed before they meet those of others.
TASKS_AT_ONCE = 256
HEAD = 1 << 18
DISCOUNT = 0.75
END, BEGIN = np.uint64(1), np.uint64(2)


@dataclass
class Tokens:
    token: np.ndarray
    ending: np.ndarray
    row: np.ndarray
    before: list[np.ndarray]


def tokens_of(part: Slice, history: bool = True) -> Tokens:
    """Tokens of a slice in order, each text closed by an end, and the two before each."""
    data = lower_ascii(part.data)
    words = find_words(part)
    count = len(words.starts) + part.rows
    at = np.arange(len(words.starts)) + words.row
    token = np.full(count, END, np.uint64)
    token[at] = word_hashes(data, words)
    ending = np.zeros(count, np.int64)
    if len(at):
        last = words.ends - 1
        mark = data[last]
        marked = (mark < 128) & ~((mark >= 97) & (mark <= 122)) & ~((mark >= 48) & (mark <= 57))
        last = np.maximum(last - marked, words.starts)
        code = np.zeros(len(at), np.uint64)
        for back in range(3):
            code = code * np.uint64(257) + data[np.maximum(last - back, words.starts)]
        ending[at] = (mix(code * np.uint64(2) + marked) % np.uint64(ENDINGS)).astype(np.int64)
    row = np.repeat(np.arange(part.rows), np.diff(words.first) + 1)
    before = []
    if history:
        place = np.arange(count) - (words.first[:-1] + np.arange(part.rows))[row]
        for back in (1, 2):
            earlier = np.full(count, BEGIN, np.uint64)
            earlier[back:] = np.where(place[back:] >= back, token[:-back], BEGIN)
            before.append(earlier)
    return Tokens(token, ending, row, before)


def features(t: Tokens) -> np.ndarray:
    """Hashes of the word before, the two before, and the word before the last."""
    a, b = t.before
    return np.stack([mix(x) for x in (
        a * np.uint64(FACTORS[0]), a * np.uint64(FACTORS[1]) ^ mix(b), b * np.uint64(FACTORS[2]))])


def rows_of(codes: np.ndarray, rows: int, group: np.ndarray | None = None) -> np.ndarray:
    """The weight row of each feature, those of a template in a range of their own."""
    if group is not None:
        codes = mix(codes ^ ((group + 1).astype(np.uint64) * GOLD))
    return (codes % np.uint64(rows)).astype(np.int64) + np.arange(FEATURES)[:, None] * rows


@dataclass
class Vocabulary:
    """What is sent: frequent words with their counts, and the sums of each class."""

    words: np.ndarray
    counts: np.ndarray
    singles: np.ndarray
    total: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def classes(self, t: Tokens) -> np.ndarray:
        out = t.ending + SINGLES
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, t.token), len(self.singles) - 1)
            out = np.where(self.singles[at] == t.token, at, out)
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """``word, ending, n`` of all tokens of column ``text``."""
    schema = pa.schema([("word", pa.int64()), ("ending", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                t = tokens_of(part, history=False)
                word, first, n = np.unique(t.token, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(word.view(np.int64)), pa.array(t.ending[first], pa.int32()), pa.array(n),
                ], schema=schema)

    return (
        docs.select("text").mapInArrow(run, "word long, ending int, n long")
        .groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))
    )


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Frequent words and class sums; what reaches the driver is bounded by ``HEAD``."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    # The least count that at most HEAD words reach, from a histogram of counts.
    steps = sorted(
        counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n"))
        .collect(), key=lambda r: -r["step"])
    held, least = 0, None
    for r in steps:
        held += r["words"]
        if held > HEAD:
            break
        least = r["n"]
    head = counts.where(F.col("n") >= least).select("word", "n", "ending") if least else counts.limit(0)
    frame = head.toPandas()
    words = frame["word"].to_numpy(np.int64).view(np.uint64)
    n, ending = frame["n"].to_numpy(np.int64), frame["ending"].to_numpy(np.int64)
    order = np.argsort(words)
    words, n, ending = words[order], n[order], ending[order]
    top = np.argsort(-n, kind="stable")[:SINGLES]
    if total and END not in words[top] and END in words:
        top[-1] = int(np.flatnonzero(words == END)[0])
    top = np.sort(top)
    sums = {r["ending"]: r for r in counts.groupBy("ending").agg(
        F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    tokens, distinct_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for e, r in sums.items():
        tokens[SINGLES + e], distinct_words[SINGLES + e] = r["n"], r["words"]
    tokens[:len(top)], distinct_words[:len(top)] = n[top], 1
    np.subtract.at(tokens, SINGLES + ending[top], n[top])
    np.subtract.at(distinct_words, SINGLES + ending[top], 1)
    return Vocabulary(words, n, words[top], int(total or 0), int(distinct), tokens, distinct_words)


def table_rows(v: Vocabulary) -> int:
    """Rows of a template: the power of two nearest to a row for every ``WORDS_PER_ROW`` words, within bounds."""
    wanted = 1 << round(math.log2(max(1, v.distinct / WORDS_PER_ROW)))
    return min(max(wanted, LEAST_ROWS), MOST_ROWS)


@dataclass
class Model:
    """Weights of both factors, (group, leaf), and the biases they start from."""

    groups: np.ndarray
    leaves: np.ndarray
    group_bias: np.ndarray
    leaf_bias: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.groups) // FEATURES


def first_model(v: Vocabulary) -> Model:
    """No weights, and log frequencies as biases; a leaf of no use keeps a little."""
    share = (v.class_tokens + 0.5).reshape(WAYS, WAYS)
    groups = share.sum(axis=1)
    size = (FEATURES * table_rows(v), WAYS)
    return Model(
        np.zeros(size, np.float32), np.zeros(size, np.float32), np.log(groups / groups.sum()).astype(np.float32),
        np.log(share / groups[:, None]).astype(np.float32))


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of weights of each token, the largest at 0."""
    z = bias + weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(axis=1, keepdims=True)
    return z


def log_chosen(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Log probability of each token's outcome."""
    z = logits(weights, bias, rows)
    own = z[np.arange(len(label)), label]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def log_leaf(model: Model, codes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Log probability of each token's leaf after its history."""
    out = np.empty(len(leaf))
    for at in range(0, len(leaf), BATCH):
        part, own = codes[:, at:at + BATCH], leaf[at:at + BATCH]
        group, way = np.divmod(own, WAYS)
        out[at:at + BATCH] = log_chosen(model.groups, model.group_bias, rows_of(part, model.rows), group) \
            + log_chosen(model.leaves, model.leaf_bias[group], rows_of(part, model.rows, group), way)
    return out


class Trainer:
    """Gradient updates with a step per weight row that shrinks as the row is used."""

    def __init__(self, model: Model):
        self.model = Model(model.groups.copy(), model.leaves.copy(), model.group_bias, model.leaf_bias)
        self.used = [np.ones(len(model.groups), np.float32) for _ in range(2)]
        self.seen = 0

    def learn(self, codes: np.ndarray, leaf: np.ndarray) -> None:
        m = self.model
        for at in range(0, len(leaf), BATCH):
            part, own = codes[:, at:at + BATCH], leaf[at:at + BATCH]
            group, way = np.divmod(own, WAYS)
            self._step(m.groups, self.used[0], m.group_bias, rows_of(part, m.rows), group)
            self._step(m.leaves, self.used[1], m.leaf_bias[group], rows_of(part, m.rows, group), way)
            self.seen += len(own)

    @staticmethod
    def _step(weights: np.ndarray, used: np.ndarray, bias: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
        slope = np.exp(logits(weights, bias, rows))
        slope /= slope.sum(axis=1, keepdims=True)
        slope[np.arange(len(label)), label] -= 1
        for r in rows:
            # Only rows that the batch has are touched.
            order = np.argsort(r)
            first = np.flatnonzero(np.diff(r[order], prepend=-1))
            sums = np.add.reduceat(slope[order], first, axis=0)
            touched = r[order[first]]
            used[touched] += (sums * sums).sum(axis=1)
            weights[touched] -= sums * (RATE / np.sqrt(used[touched]))[:, None]


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` over column ``text``."""
    context = docs.sparkSession.sparkContext
    model = first_model(v)
    schema = pa.schema([("block", pa.int32()), ("scale", pa.float64()), ("change", pa.binary()), ("tasks", pa.binary())])
    ddl = "block int, scale double, change binary, tasks binary"

    def message(block: int, change: np.ndarray, tasks: np.ndarray) -> pa.RecordBatch:
        """Changes (row, factor, outcome) of a block, and how many tasks changed each (row, factor)."""
        scale = float(np.abs(change).max()) or 1.0
        return pa.RecordBatch.from_arrays([
            pa.array([block], pa.int32()), pa.array([scale]),
            pa.array([(change / scale).astype(np.float16).tobytes()], pa.binary()),
            pa.array([tasks.astype(np.uint32).tobytes()], pa.binary()),
        ], schema=schema)

    def read(scale: float, change: bytes, tasks: bytes) -> tuple[np.ndarray, np.ndarray]:
        return scale * np.frombuffer(change, np.float16).astype(np.float32).reshape(-1, 2, WAYS), \
            np.frombuffer(tasks, np.uint32).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = sent.value
        v, start = Vocabulary(**known), Model(**start)
        trainer = Trainer(start)
        for batch in batches:
            for part in slices(batch.column(0)):
                t = tokens_of(part)
                trainer.learn(features(t), v.classes(t))
        if trainer.seen:
            changes = np.stack([trainer.model.groups - start.groups, trainer.model.leaves - start.leaves], axis=1)
            tasks = (changes != 0).any(axis=2)
            for block, (change, own) in enumerate(zip(np.split(changes, BLOCKS), np.split(tasks, BLOCKS))):
                yield message(block, change, own)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block at a time in memory, however many tasks have sent it; as sums, which can be summed again.
        sums: dict[int, list] = {}
        for batch in batches:
            for block, *sent_parts in zip(*(c.to_pylist() for c in batch.columns)):
                change, tasks = read(*sent_parts)
                own = sums.setdefault(block, [0.0, 0])
                own[0], own[1] = own[0] + change, own[1] + tasks
        for block, (change, tasks) in sums.items():
            yield message(block, change, tasks)

    for _ in range(rounds):
        sent = context.broadcast((vars(v), vars(model)))
        # Neighbouring tasks are summed first, so a block's last sum has few parts.
        found = (
            docs.select("text").mapInArrow(run, ddl)
            .repartition(F.col("block"), F.floor(F.spark_partition_id() / TASKS_AT_ONCE)).mapInArrow(summed, ddl)
            .repartition(BLOCKS, "block").mapInArrow(summed, ddl).collect()
        )
        both = np.stack([model.groups, model.leaves], axis=1)
        parts = np.split(both, BLOCKS)
        for r in found:
            change, tasks = read(r["scale"], bytes(r["change"]), bytes(r["tasks"]))
            parts[r["block"]] += change / np.maximum(tasks, 1)[:, :, None]
        model = Model(both[:, 0].copy(), both[:, 1].copy(), model.group_bias, model.leaf_bias)
        sent.unpersist()
    return model


def _partial(sent, arrow_kind):
    """Per text what the frequent words give, and the other words with their numbers."""
    pair = pa.struct([("word", pa.int64()), ("class", pa.int32()), ("n", pa.int64())])
    schema = pa.schema([
        ("uid", pa.int64()), ("_id", arrow_kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pair)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = sent.value
        v, model = Vocabulary(**known), Model(**model)
        uid = TaskContext.get().partitionId() << 40
        norm = math.log10(v.total + v.distinct + 1)
        for batch in batches:
            for part in slices(batch.column(1)):
                t = tokens_of(part)
                label = v.classes(t)
                chosen = log_leaf(model, features(t), label) / math.log(10)
                if len(v.words):
                    at = np.minimum(np.searchsorted(v.words, t.token), len(v.words) - 1)
                    head = v.words[at] == t.token
                    n = np.where(head, v.counts[at], 0)
                else:
                    head = np.zeros(len(label), bool)
                    n = np.zeros(len(label), np.int64)
                own = head & (label >= SINGLES)
                chosen[own] += np.log10((n[own] - DISCOUNT) / v.class_tokens[label[own]])
                base = np.where(head, np.log10(n + 1.0) - norm, 0)
                row, other = t.row, np.flatnonzero(~head)
                order = other[np.lexsort((t.token[other], row[other]))]
                new = np.ones(len(order), bool)
                new[1:] = (row[order][1:] != row[order][:-1]) | (t.token[order][1:] != t.token[order][:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(order)))
                word = order[first]
                offsets = np.searchsorted(row[word], np.arange(part.rows + 1))
                rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(t.token[word].view(np.int64)), pa.array(label[word], pa.int32()),
                     pa.array(size.astype(np.int64))], fields=list(pair)))
                count = lambda w: np.bincount(row, w, part.rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid + np.arange(part.rows)), batch.column(0).slice(part.first, part.rows),
                    pa.array(np.bincount(row, minlength=part.rows)), pa.array(count(head).astype(np.int64)),
                    pa.array(count(base)), pa.array(count(chosen)), rare,
                ], schema=schema)
                uid += part.rows

    return run


def by_class(values: np.ndarray) -> Column:
    """A class's value as a column over ``class``."""
    return F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("class") + 1)


def score(
    df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """Learn from the rows where ``training`` holds and score every row.

    Returns ``id_col``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one
    unigrams) and ``score``, both log10 probabilities of the whole text.
    """
    kind, arrow_kind = _id_type(df, id_col)
    text = F.col(text_col).cast("string").alias("text")
    learned = df.where(training).select(text)
    counts = materialize(count_words(learned), "counts")
    v = vocabulary(counts)
    sent = df.sparkSession.sparkContext.broadcast((vars(v), vars(train(learned, v, rounds))))
    told = materialize(
        df.select(F.col(id_col).alias("_id"), text).mapInArrow(
            _partial(sent, arrow_kind),
            f"uid long, _id {kind}, n_tokens long, n_known long, base double, score double, "
            "rare array<struct<word: long, class: int, n: long>>"),
        "scored")
    # Known words of a class share what the discount leaves, unknown ones the discount.
    tokens, words = by_class(v.class_tokens), by_class(v.class_words)
    c = F.coalesce(F.col("c"), F.lit(0))
    within = F.when(tokens <= 0, F.lit(0.0)).when(
        c > 0, F.log10((c - DISCOUNT) / tokens)).otherwise(F.log10(DISCOUNT * words / tokens))
    rare = (
        told.select("uid", F.inline("rare"))
        .join(counts.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("uid").agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * (F.log10(c + 1.0) - math.log10(v.total + v.distinct + 1))).alias("more_base"),
            F.sum(F.col("n") * within).alias("more_score"))
    )
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return told.drop("rare").join(rare, "uid", "left").select(
        F.col("_id").alias(id_col), "n_tokens", add("n_known", "more_known").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), add("base", "more_base").alias("base_score"),
        add("score", "more_score").alias("score"))
