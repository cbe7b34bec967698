"""Hashed maximum-entropy language model with a class-factored softmax.

Every word has a class and, inside it, a member group, named by its hash; CLASSES of each, whose
number follows the vocabulary. A text's probability is, token by token,

    P(class | context) * P(member | class, context) * P(word | class, member)

The first two are softmaxes over sums of weights, one row of a hashed table for each feature of
the context: bias, the last word, the last two words, and the word before the last (a skip). The
third is the add-one share of the word's training count in its group.

Sizes come from the counts (``sizes``): classes and members grow with the vocabulary's fifth root, so
groups with the power 0.4, and feature rows with the training tokens. Every task holds the tables
until both together have TABLE_BYTES. Beyond that, as many rows as the tokens ask for are dealt to
tasks, by the last two words, whose rows are then nowhere else; rows of single words stay in the
tables that every task holds, and share them.

Training: counts of all training words first; they set the sizes and the bias. Then ROUNDS
passes, each over another part of the training documents and together over all of them: every
task takes gradient steps (AdaGrad) from the shared weights in blocks of tokens, and the changes
are summed by Spark, weighted by tokens, into the next shared weights. Dealt rows are never written:
the context and target of every token go to the task of its last two words, which trains its rows on
the training tokens, once each, beside the finished shared weights, then scores all tokens and sends
back sums by text. Contexts that would fill several tasks are dealt by their texts too, and each of
these tasks trains a row for them.

Words above a share of 1 / FREQUENT of all tokens are broadcast as hashes and counts, at most
FREQUENT whatever the corpus; the counts of all other words reach the documents by a join.

Edge cases: a null text is empty and scored as its end alone; with no training documents all
counts are zero and the softmaxes uniform; repeated rows and null ids are scored one by one (a
null id has the remainder of an empty text); texts of any length are read whole, some at a time;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from .common import query, table, text_runs, texts

HELD_OUT = (7, 2)  # crc32(doc_id) mod 7 is 2
ROUNDS = 2
RATE = 0.1
FREQUENT = 1 << 20
#: Training tokens per feature row, bytes of the two tables at most, bytes of text a training task has at least.
ROW_TOKENS, TABLE_BYTES, TASK_BYTES = 8, 8 << 20, 64 << 20
#: Training tokens whose last two words meet in one task, in the mean, and bits of a word's hash that go there.
PART_TOKENS, WORD_BITS = 1 << 20, 40
_BLOCK = 1 << 14
_BATCH_WORDS = 500_000
_SLICES = 16
_RUN_BYTES = 4 << 20


def sizes(n_words: int, n_tokens: int) -> tuple[int, int]:
    """(classes, rows), powers of two, from the training words and tokens."""
    classes = 1 << max(2, round(math.log2(max(2, n_words)) / 5))
    return classes, min(wanted_rows(n_tokens), 1 << int(math.log2(TABLE_BYTES / (8 * classes))))


def wanted_rows(n_tokens: int) -> int:
    return 1 << max(10, math.ceil(math.log2(max(2, n_tokens / ROW_TOKENS))))


# --- counts ------------------------------------------------------------------------------------


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, part: crc32 of the id modulo HELD_OUT."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return texts(docs).withColumn("part", crc % HELD_OUT[0])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts, each text followed by its end, and where each text stops."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # A gap behind the last word makes an empty one; a text without words is an empty one already.
    gap = pc.if_else(pc.equal(pc.binary_length(bare), 0), pa.scalar("", bare.type), pa.scalar(" ", bare.type))
    lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(bare, gap, pa.scalar("", bare.type)))
    return lists.flatten().cast(pa.binary()), np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)


def _count_batches(batches):
    held, rows = [], 0
    for batch in batches:
        for _, docs in text_runs(batch, 0, _RUN_BYTES):
            seen = split(docs)[0].value_counts()
            held.append(pa.table([seen.field("values"), seen.field("counts")], names=["word", "c"]))
            rows += len(seen)
            if rows >= 2 * _BATCH_WORDS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows >= _BATCH_WORDS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def _merged(held: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
    return sums.select(["word", "c_sum"]).rename_columns(["word", "c"])


def word_counts(training: DataFrame) -> DataFrame:
    """word (bytes, empty: the end), its hash and c over all training texts."""
    parts = training.select("text").mapInArrow(_count_batches, "word binary, c long")
    sums = parts.groupBy("word").agg(F.sum("c").alias("c"))
    return stage(sums.mapInArrow(_hash_batches, "word binary, c long, h long"), "counts")


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _hashed(words: pa.Array) -> np.ndarray:
    """Hashes of a binary array's words, cut from its bytes at once."""
    _, at, data = words.buffers()
    cuts = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    cut = map((data.to_pybytes() if data else b"").__getitem__, map(slice, cuts, cuts[1:]))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), dtype=np.uint64, count=len(words))


def _hash_batches(batches):
    for batch in batches:
        h = _hashed(batch.column(0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=["word", "c", "h"])


class Lexicon:
    """Hashes and counts of frequent words, in order of hash, and the add-one mass of every group."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_tokens: int, n_words: int, mass: np.ndarray, rows: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.n_tokens, self.n_words, self.rows = n_tokens, n_words, rows
        #: Tasks among which the rows of the last two words are dealt, and rows in each; none where ``rows`` are all wanted ones.
        self.parts = -(-n_tokens // PART_TOKENS) if wanted_rows(n_tokens) > rows else 0
        self.part_rows = wanted_rows(n_tokens) // max(1, self.parts)
        #: (classes, members): counts plus one of all words of the group, plus one for words never seen.
        self.mass = mass

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places among the frequent words, -1 for others."""
        if not self.hashes.size:
            return np.full(hashes.size, -1, dtype=np.int64)
        order = np.argsort(hashes)  # a search in order stays in the cache
        at = np.empty(hashes.size, dtype=np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), self.hashes.size - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def groups(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of words by their hashes."""
        n = np.uint64(len(self.mass))
        return (hashes % n).astype(np.int64), (hashes // n % n).astype(np.int64)


def lexicon(counts: DataFrame) -> Lexicon:
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_tokens, n_words = int(total[0] or 0), int(total[1] or 0)
    classes, rows = sizes(n_words, n_tokens)
    mass = np.ones((classes, classes))
    # The groups are powers of two: the low bits of the hash, and the next ones.
    low, high = F.col("h").bitwiseAND(classes - 1), F.shiftrightunsigned("h", classes.bit_length() - 1).bitwiseAND(classes - 1)
    for r in counts.groupBy(low.alias("a"), high.alias("b")).agg(F.sum(F.col("c") + 1).alias("m")).collect():  # classes squared
        mass[r.a, r.b] += r.m
    top = counts.where(F.col("c") * F.lit(FREQUENT) >= n_tokens).select("h", "c").toArrow()  # FREQUENT rows at most
    return Lexicon(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), n_tokens, n_words, mass, rows)


# --- model -------------------------------------------------------------------------------------


class Weights:
    """Two hashed tables: class logits and member logits by context feature."""

    def __init__(self, by_class: np.ndarray, by_member: np.ndarray):
        self.by_class, self.by_member = by_class, by_member

    @staticmethod
    def fresh(words: Lexicon) -> "Weights":
        n = len(words.mass)
        by_class, by_member = np.zeros((words.rows, n), np.float32), np.zeros((words.rows, n), np.float32)
        classes = words.mass.sum(axis=1)
        by_class[0] = np.log(classes / classes.sum())
        by_member[:n] = np.log(words.mass / classes[:, None])
        return Weights(by_class, by_member)


_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def features(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Feature hashes of each token's context: last word, last two words, the one before the last.

    ``ends`` marks each document's last token; a context doesn't reach into another document.
    """
    return mixed(*context_words(hashes, ends))


def context_words(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word of each token's context and the one before."""
    first = np.empty_like(ends)
    first[:1], first[1:] = True, ends[:-1]
    one = np.empty_like(hashes)
    one[:1], one[1:] = _C, hashes[:-1]
    one[first] = _C
    two = np.empty_like(hashes)
    two[:1], two[1:] = _D, one[:-1]
    two[first] = _D
    return one, two


def mixed(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    return [x ^ (x >> np.uint64(29)) for x in (one * _A, (one * _B) ^ (two * _C), two * _D + _A)]


def short_words(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``context_words`` in WORD_BITS."""
    one, two = context_words(hashes, ends)
    return one & np.uint64((1 << WORD_BITS) - 1), two & np.uint64((1 << WORD_BITS) - 1)


def shared_features(words: Lexicon, hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Feature hashes that have their rows in the table every task holds: not the last two words if those are dealt."""
    return mixed(*short_words(hashes, ends))[::2] if words.parts else features(hashes, ends)


def _rows_of(feature: np.ndarray, salt: np.ndarray | int, low: int, rows: int) -> np.ndarray:
    """Table rows from ``low`` on (rows below hold biases)."""
    x = (feature + np.asarray(salt, dtype=np.uint64) * _B) * _A
    return low + ((x >> np.uint64(32)) % np.uint64(rows - low)).astype(np.int64)


def table_rows(context: list[np.ndarray], classes: np.ndarray, n_classes: int, rows: int) -> tuple[list, list]:
    """Rows of the class table (its bias, row 0, is left out) and of the member table, bias first."""
    for_class = [_rows_of(f, 0, 1, rows) for f in context]
    for_member = [classes] + [_rows_of(f, classes + 1, n_classes, rows) for f in context]
    return for_class, for_member


def exp_logits(weights: np.ndarray, rows: list[np.ndarray], bias: bool, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, held between -60 and 60, their exponentials, and the exponentials' sums."""
    x = np.take(weights, rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        x += np.take(weights, r, axis=0, mode="clip")
    if bias:
        x += weights[0]
    if more is not None:
        x += more
    np.clip(x, -60, 60, out=x)
    e = np.exp(x)
    return x, e, e @ np.ones(x.shape[1], dtype=np.float32)


def log_prob(weights: Weights, context: list, classes: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context) P(member | class, context), token by token."""
    for_class, for_member = table_rows(context, classes, weights.by_class.shape[1], len(weights.by_class))
    each = np.arange(classes.size)
    out = np.zeros(classes.size)
    for table_, rows, target, bias in ((weights.by_class, for_class, classes, True), (weights.by_member, for_member, members, False)):
        x, _, total = exp_logits(table_, rows, bias)
        out += x[each, target] - np.log(total.astype(np.float64))
    return out


def _step(weights: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], target: np.ndarray, bias: bool) -> None:
    _, grad, total = exp_logits(weights, rows, bias)
    grad /= total[:, None]
    grad[np.arange(target.size), target] -= 1
    sums = [(np.zeros(1, np.int64), grad.sum(axis=0, keepdims=True))] if bias else []
    for r in rows:
        sums.append(_row_sums(grad, r, len(weights)))
    for at, change in sums:
        _move(weights, squares, at, change)


def _move(weights: np.ndarray, squares: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    moved = np.take(squares, at, axis=0, mode="clip")
    moved += change * change
    squares[at] = moved
    moved += 1e-3
    np.sqrt(moved, out=moved)
    np.divide(RATE * change, moved, out=moved)
    weights[at] = np.subtract(np.take(weights, at, axis=0, mode="clip"), moved, out=moved)


def _row_sums(grad: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, ascending, and the sum of ``grad`` over the tokens of each."""
    order = np.argsort(rows.astype(np.uint16 if n_rows <= 1 << 16 else np.uint32), kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    lengths = np.diff(starts, append=rows.size)
    total = np.take(grad, order[starts], axis=0, mode="clip")
    many = lengths > 1  # most rows have one token, which is its own sum
    if many.any():
        own = lengths[many]
        of_many = np.take(grad, order[np.repeat(many, lengths)], axis=0, mode="clip")
        total[many] = np.add.reduceat(of_many, np.cumsum(own) - own, axis=0)
    return sorted_rows[starts], total


# --- reading texts -----------------------------------------------------------------------------


def read(docs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(different words, their hashes, each token's place among them, stops of the texts); ends are tokens."""
    tokens, stops = split(docs)
    coded = tokens.dictionary_encode()
    return coded.dictionary, _hashed(coded.dictionary), coded.indices.to_numpy().astype(np.int64), stops


def _ends(stops: np.ndarray, n_tokens: int) -> np.ndarray:
    last = np.zeros(n_tokens, dtype=bool)
    last[stops - 1] = True
    return last


def train(training: DataFrame, words: Lexicon) -> Weights:
    """ROUNDS passes, each over the documents whose hash falls to it."""
    spark = training.sparkSession
    weights = Weights.fresh(words)
    shared_words = spark.sparkContext.broadcast(words)
    n, rows = weights.by_class.shape[1], words.rows
    cut_rows = max(1, rows // _SLICES)
    # Each task sends changes of a whole table, so it has a fair share of text.
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(size // TASK_BYTES))
    for turn in range(ROUNDS):
        part = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn).select("text").coalesce(tasks)
        shared = spark.sparkContext.broadcast((weights.by_class, weights.by_member))

        def changes(batches, shared=shared):
            lex = shared_words.value
            old = shared.value
            new = [x.copy() for x in old]
            squares = [np.zeros_like(x) for x in old]
            n_tokens = 0
            for batch in batches:
                for _, docs in text_runs(batch, 0, _RUN_BYTES):
                    _, different, own, stops = read(docs)
                    classes, members = (x[own] for x in lex.groups(different))
                    context = shared_features(lex, different[own], _ends(stops, own.size))
                    for a in range(0, classes.size, _BLOCK):
                        cut = slice(a, a + _BLOCK)
                        for_class, for_member = table_rows([c[cut] for c in context], classes[cut], n, rows)
                        _step(new[0], squares[0], for_class, classes[cut], True)
                        _step(new[1], squares[1], for_member, members[cut], False)
                    n_tokens += classes.size
            for k in range(0, rows if n_tokens else 0, cut_rows):
                cut = slice(k, k + cut_rows)
                parts = [((x[cut] - y[cut]) * np.float32(n_tokens)).ravel() for x, y in zip(new, old)]
                parts += [(s[cut] != 0).any(axis=1).astype(np.float32) * n_tokens for s in squares]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.concatenate(parts).astype("<f4").tobytes()], pa.binary())], names=["row", "moved"])

        summed = part.mapInArrow(changes, "row int, moved binary").groupBy("row").applyInArrow(_sum_slices, "row int, moved binary")
        for r in summed.collect():  # the weight tables, of TABLE_BYTES at most, in slices
            flat = np.frombuffer(r.moved, dtype="<f4")
            cut = slice(r.row, r.row + cut_rows)
            a, b = cut_rows * n, 2 * cut_rows * n
            by = np.maximum(flat[b:].reshape(2, cut_rows, 1), 1)
            weights.by_class[cut] += flat[:a].reshape(cut_rows, n) / by[0]
            weights.by_member[cut] += flat[a:b].reshape(cut_rows, n) / by[1]
        shared.unpersist()
    return weights


def _sum_slices(rows: pa.Table) -> pa.Table:
    total = None
    for x in rows.column("moved"):
        flat = np.frombuffer(x.as_buffer(), dtype="<f4").astype(np.float64)
        total = flat if total is None else total + flat
    return pa.table({"row": pa.array([rows.column("row")[0].as_py()], pa.int32()), "moved": pa.array([total.astype("<f4").tobytes()], pa.binary())})


# --- rows of the last two words, dealt to tasks ---------------------------------------------------

#: Of the texts read at once (a chunk) those with tokens for a task: their numbers, as steps, and how many tokens, of which
#: the context, the target in two bytes, and whether they are for training. One row of a chunk names all its texts.
_SENT = "deal long, chunk long, names binary, steps binary, sizes binary, learn binary, one binary, two binary, low binary, high binary"
_DEALT = "chunk long, names binary, steps binary, sizes binary, dealt binary"


def _bytes_of(values: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def _numbers(flat: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(flat), 8), dtype=np.uint8)
    wide[:, : flat.shape[1]] = flat
    return wide.view("<u8").ravel().astype(np.uint64)


def deals(pair: np.ndarray, same: np.ndarray, parts: int) -> np.ndarray:
    """The task of each token by its last two words; contexts of several tasks' tokens by the document too, a row in each."""
    _, of, count = np.unique(pair, return_inverse=True, return_counts=True)
    hot = (count > 64 + 4 * pair.size / parts)[of]
    salted = pair + np.where(hot, same.view(np.uint64), np.uint64(0)) * _B
    salted = (salted ^ (salted >> np.uint64(32))) * _D
    return ((salted >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)


def _sent(batches, words: Lexicon):
    """Every token's context and target, a row for each task they are dealt to; ``same`` names a document by its id and text."""
    size, chunk, names = WORD_BITS // 8, TaskContext.get().partitionId() << 32, [x.split()[0] for x in _SENT.split(", ")]
    for batch in batches:
        for first, docs in text_runs(batch, 1, _RUN_BYTES):
            _, different, own, stops = read(docs)
            classes, members = words.groups(different)
            target = (classes * len(words.mass) + members).astype("<u2")[own]
            one, two = short_words(different[own], _ends(stops, own.size))
            doc = np.repeat(np.arange(len(docs)), np.diff(stops, prepend=0))
            same = batch.column(0).slice(first, len(docs)).to_numpy()
            learn = batch.column(2).slice(first, len(docs)).to_numpy() != HELD_OUT[1]
            deal = deals(mixed(one, two)[1], same[doc], words.parts)
            order = np.argsort(deal, kind="stable")
            deal, doc, target = deal[order], doc[order], target[order]
            one, two = _bytes_of(one[order], size), _bytes_of(two[order], size)
            new = np.concatenate([[True], (deal[1:] != deal[:-1]) | (doc[1:] != doc[:-1])])  # a document's tokens in a task
            runs = np.flatnonzero(new)
            lengths = np.diff(runs, append=deal.size).astype("<u4")
            of_run = np.searchsorted(deal[runs], np.arange(words.parts + 1))
            ends = np.append(runs, deal.size)[of_run]
            rows = []
            for k in np.flatnonzero(np.diff(of_run)).tolist():
                held, cut = slice(of_run[k], of_run[k + 1]), slice(ends[k], ends[k + 1])
                whose = doc[runs[held]]
                low, high = (target[cut] & 255).astype(np.uint8), (target[cut] >> 8).astype(np.uint8)
                parts = (np.diff(whose, prepend=0).astype("<u4"), lengths[held], learn[whose].astype(np.uint8), one[cut], two[cut], low, high)
                rows.append((k, chunk, b"" if rows else same.astype("<i8").tobytes(), *[x.tobytes() for x in parts]))
            kinds = [pa.int64()] * 2 + [pa.binary()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)
            chunk += 1


def part_scores(rows: pa.Table, words: Lexicon, weights: Weights) -> pa.Table:
    """Trains the rows of one task on its training tokens, once each, beside the shared weights, and sums all its tokens' log probabilities by document."""
    order = np.argsort(rows.column("chunk").to_numpy(), kind="stable")
    n, low, size = len(words.mass), words.part_rows, WORD_BITS // 8
    join = lambda name, kind: np.frombuffer(b"".join([rows.column(name)[k].as_py() for k in order]), kind)
    lengths = join("sizes", "<u4").astype(np.int64)
    learn = np.flatnonzero(np.repeat(join("learn", np.uint8), lengths))
    one, two = join("one", np.uint8).reshape(-1, size), join("two", np.uint8).reshape(-1, size)
    target = join("low", np.uint8).astype(np.uint16) | join("high", np.uint8).astype(np.uint16) << 8
    tables = [np.zeros((low, n), np.float32) for _ in range(4)]

    def placed(own):
        single, pair, skip = mixed(_numbers(one[own]), _numbers(two[own]))
        classes, members = np.divmod(target[own].astype(np.int64), n)
        for_class, for_member = table_rows([single, skip], classes, n, words.rows)
        at_class, at_member = _rows_of(pair, n + 1, 0, low), _rows_of(pair, classes + n + 2, 0, low)
        return (weights.by_class, for_class, True, tables[0], tables[1], at_class, classes), (weights.by_member, for_member, False, tables[2], tables[3], at_member, members)

    for a in range(0, learn.size, _BLOCK):
        for shared, at, bias, own, squares, mine, wanted in placed(learn[a : a + _BLOCK]):
            _, grad, total = exp_logits(shared, at, bias, np.take(own, mine, axis=0))
            grad /= total[:, None]
            grad[np.arange(wanted.size), wanted] -= 1
            _move(own, squares, *_row_sums(grad, mine, low))
    found = np.zeros(target.size)
    for a in range(0, target.size, _BLOCK):
        cut = slice(a, a + _BLOCK)
        for shared, at, bias, own, _, mine, wanted in placed(cut):
            x, _, total = exp_logits(shared, at, bias, np.take(own, mine, axis=0))
            found[cut] += x[np.arange(wanted.size), wanted] - np.log(total.astype(np.float64))
    sums = (np.add.reduceat(found, np.cumsum(lengths) - lengths) / np.log(10)).astype("<f4")
    ends = np.cumsum([len(rows.column("sizes")[k].as_py()) // 4 for k in order])
    back = [pa.array([sums[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())]
    return pa.table([*[rows.column(name).take(pa.array(order)) for name in ("chunk", "names", "steps", "sizes")], *back], names=["chunk", "names", "steps", "sizes", "dealt"])


def _chunk_sums(rows: pa.Table) -> pa.Table:
    """The sums of a chunk's texts over all tasks, and how many tokens each has."""
    same = np.frombuffer(b"".join(rows.column("names").to_pylist()), "<i8")
    sums, n = np.zeros(same.size), np.zeros(same.size, dtype=np.int64)
    for steps, sizes, dealt in sorted(zip(*(rows.column(name).to_pylist() for name in ("steps", "sizes", "dealt")))):
        at = np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.int64)
        sums[at] += np.frombuffer(dealt, "<f4")
        n[at] += np.frombuffer(sizes, "<u4")
    return pa.table({"same": pa.array(same), "dealt": pa.array(sums), "n": pa.array(n)})


def dealt_scores(docs: DataFrame, shared) -> DataFrame:
    """same, the log10 probability of all groups of the texts of that name, and how many tokens these have."""
    sent = docs.select("same", "text", "part").mapInArrow(lambda batches: _sent(batches, shared.value[0]), _SENT)

    def scored(rows: pa.Table) -> pa.Table:
        words, by_class, by_member = shared.value
        return part_scores(rows, words, Weights(by_class, by_member))

    found = sent.groupBy("deal").applyInArrow(scored, _DEALT).groupBy("chunk").applyInArrow(_chunk_sums, "same long, dealt double, n long")
    return found.groupBy("same").agg(F.sum("dealt").alias("dealt"), F.sum("n").alias("n"))


_SCORED = "key long, same long, doc_id long, part long, n_tokens long, n_known long, logs double, context double, rare array<binary>"


def score(docs: DataFrame, words: Lexicon, weights: Weights, counts: DataFrame) -> DataFrame:
    """doc_id, part, n_tokens, n_known, base_score and score of every row of ``marked`` docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, weights.by_class, weights.by_member))
    schema = pa.schema(
        [("key", pa.int64()), ("same", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
        + [("logs", pa.float64()), ("context", pa.float64()), ("rare", pa.list_(pa.binary()))]
    )

    def scored(batches):
        lex, by_class, by_member = shared.value
        model = Weights(by_class, by_member)
        logs = np.log10(lex.counts + 1.0)
        shares = np.log10(lex.mass)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, docs in text_runs(batch, 1, _RUN_BYTES):
                words_, different, own, stops = read(docs)
                groups = lex.groups(different)
                classes, members = (x[own] for x in groups)
                lp = np.zeros(classes.size)
                context = [] if lex.parts else features(different[own], _ends(stops, own.size))
                for a in range(0, 0 if lex.parts else classes.size, _BLOCK):
                    cut = slice(a, a + _BLOCK)
                    lp[cut] = log_prob(model, [c[cut] for c in context], classes[cut], members[cut])
                lp /= np.log(10)
                places = lex.find(different)
                known = places >= 0
                base = np.zeros(different.size)
                base[known] = logs[places[known]] if known.any() else 0
                lp += (base - shares[groups])[own]
                known = known[own]
                starts = np.concatenate([[0], stops[:-1]])
                add = lambda x: np.add.reduceat(x, starts)
                rare = np.flatnonzero(~known)
                cuts = np.searchsorted(rare, np.concatenate([starts, [own.size]]))
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + n)),
                        batch.column(3).slice(first, n),
                        batch.column(0).slice(first, n),
                        batch.column(2).slice(first, n),
                        pa.array(stops - starts),
                        pa.array(add(known.astype(np.int64))),
                        pa.array(add(base[own])),
                        pa.array(add(lp)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words_.take(pa.array(own[rare]))),
                    ],
                    schema=schema,
                )
                key += n

    docs = docs.withColumn("same", F.xxhash64("doc_id", "text"))
    found = stage(docs.select("doc_id", "text", "part", "same").mapInArrow(scored, _SCORED), "scored")
    rare = found.select("key", F.explode("rare").alias("word"))
    few = counts.where(F.col("c") * F.lit(FREQUENT) < words.n_tokens).select("word", "c")
    more = rare.join(few, "word").groupBy("key").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    out = found.drop("rare").join(more, "key", "left")
    if words.parts:
        dealt = stage(dealt_scores(docs, shared), "dealt")
        out = out.join(dealt, "same").withColumn("context", F.col("context") + F.col("dealt") * F.col("n_tokens") / F.col("n"))
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    every = F.log10(F.lit(float(words.n_tokens + words.n_words + 1)))
    return out.select(
        "doc_id",
        "part",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        (F.col("logs") + more_logs - F.col("n_tokens") * every).alias("base_score"),
        (F.col("context") + more_logs).alias("score"),
    )


def language_model_scores(docs: DataFrame) -> DataFrame:
    own = marked(docs)
    training = own.where(F.col("part") != HELD_OUT[1])
    counts = word_counts(training)
    words = lexicon(counts)
    out = score(own, words, train(training, words), counts)
    return out.withColumn("train_tokens", F.lit(words.n_tokens).cast("long"))


@query("op6_maxent_lm")
def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_model_scores(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", (F.col("part") == HELD_OUT[1]).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
