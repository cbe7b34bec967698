"""Quality scores from a factorisation machine.

Features of a text: its words, hashed and weighted by 1 + log of their count (unit length in
all); structure statistics (lengths, shares of marks, capitals, digits, repeats), standardised
and also cut into bins; and the table's n_chars as metadata. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which takes time linear in the features that are set. Neither labels nor lang, source or doc_id
are features.

The model is fitted on a bounded sample: the TRAIN_ROWS labelled documents with the smallest id
hashes among those not held out, or as many of them as have TRAIN_BYTES of text together. Features of
all documents and all scores are computed on Spark.

Edge cases: a null text is empty and has a score like any other (that of no words); a null
n_chars counts as the text's length; labels other than 0 and 1 are left out, and the larger of
two labels of one document holds; a null doc_id is scored (its held_out is that of an empty
text); repeated rows get equal scores; with no labels of either kind every score is the share
of label 1, or one half; texts of any length are read whole; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from .common import query, table

HELD_OUT = (5, 0)  # crc32(doc_id) mod 5 is 0
TRAIN_ROWS, TRAIN_BYTES = 12_000, 96 << 20
THRESHOLD = 0.3
BUCKETS = 1 << 15
RANK = 8
BINS = 8
#: At least so many passes over the sample, and so many steps.
EPOCHS, STEPS = 6, 600
BATCH = 128
RATE = 0.05
DECAY = 1e-5
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>{}=~^_@\\"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
STATS = (
    "log_words", "log_chars", "mean_word", "symbols", "exclaims", "bars", "capitals", "digits", "stops",
    "distinct_words", "repeated_lines", "words_a_line", "closed_lines", "top_word", "marked_words", "stutters",
)


def statistics(text: bytes, words: Counter, n_chars: float, stutters: int) -> list[float]:
    """The structure statistics and the metadata, in the order of STATS."""
    n = sum(words.values())
    share = lambda drop, of: (len(text) - len(text.translate(None, drop))) / max(1, of)
    black = len(text.translate(None, SPACES))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = len(text) - len(text.translate(None, LETTERS))
    closed = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    marked = sum(c for w, c in words.items() if w[-1:] in b"*$#%&!|")
    return [
        np.log1p(n),
        np.log1p(max(0.0, n_chars)),
        black / max(1, n),
        share(SYMBOLS, black),
        share(b"!", black),
        share(b"|", black),
        share(UPPER, letters),
        share(b"0123456789", black),
        share(b".,;:?", black),
        len(words) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        closed / max(1, len(lines)),
        max(words.values(), default=0) / max(1, n),
        marked / max(1, n),
        stutters / max(1, n),
    ]


def features(text: bytes, n_chars: float | None):
    """(buckets, weights, statistics) of one text."""
    sequence = text.split()
    words, stutters = Counter(sequence), sum(map(eq, sequence, sequence[1:]))
    hashed: dict[int, float] = {}
    for word, c in words.items():
        b = xxhash.xxh32_intdigest(word.lower()) % BUCKETS
        hashed[b] = hashed.get(b, 0) + c
    at = np.fromiter(hashed.keys(), dtype=np.int32, count=len(hashed))
    x = 1 + np.log(np.fromiter(hashed.values(), dtype=np.float32, count=len(hashed)))
    length = np.sqrt((x * x).sum())
    chars = len(text.decode("utf-8", "replace")) if n_chars is None else n_chars
    return at, x / max(length, 1e-9), statistics(text, words, float(chars), stutters)


class Machine:
    """The fitted model; rows of w and v: hashed words, then statistics, then their bins."""

    def __init__(self, n_stats: int = len(STATS)):
        rng = np.random.default_rng(7)
        size = BUCKETS + n_stats + n_stats * BINS
        self.bias, self.w = 0.0, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
        self.mean, self.spread = np.zeros(n_stats), np.ones(n_stats)
        self.edges = np.zeros((n_stats, BINS - 1))

    def row(self, at, x, stats):
        """Indices and values of one document's features."""
        s = np.asarray(stats)
        k = np.arange(s.size)
        z = np.clip((s - self.mean) / self.spread, -4, 4) / 4
        bins = (self.edges < s[:, None]).sum(axis=1)
        places = np.concatenate([at, BUCKETS + k, BUCKETS + s.size + k * BINS + bins])
        return places, np.concatenate([x, z, np.ones(s.size)]).astype(np.float32)

    def raw(self, places: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[places] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[places] @ x + 0.5 * ((total * total).sum() - (vx * vx).sum()))

    def fit(self, rows: list, labels: np.ndarray) -> "Machine":
        """Mini-batch AdaGrad on the logistic loss; rows of (buckets, weights, statistics)."""
        ones = float(labels.mean()) if labels.size else 0.5
        self.bias = float(np.log(max(ones, 1e-3) / max(1 - ones, 1e-3))) if labels.size else 0.0
        if not 0 < ones < 1 or not labels.size:
            self.v[:] = 0
            return self
        stats = np.array([r[2] for r in rows])
        self.mean, self.spread = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        self.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        ready = [self.row(*r) for r in rows]
        gw, gv, gb = np.ones(self.w.shape, np.float32), np.ones(self.v.shape, np.float32), 1.0
        rng = np.random.default_rng(11)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(ready)))):
            order = rng.permutation(len(ready))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                sizes = np.array([ready[k][0].size for k in pick])
                places = np.concatenate([ready[k][0] for k in pick])
                x = np.concatenate([ready[k][1] for k in pick])
                starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(pick.size), sizes)
                vx = self.v[places] * x[:, None]
                total = np.add.reduceat(vx, starts)
                raw = self.bias + np.add.reduceat(self.w[places] * x, starts)
                raw = raw + 0.5 * ((total * total) - np.add.reduceat(vx * vx, starts)).sum(axis=1)
                err = (1 / (1 + np.exp(-raw)) - labels[pick]).astype(np.float32)
                used, slot = np.unique(places, return_inverse=True)
                dw = np.zeros(used.size, np.float32)
                np.add.at(dw, slot, err[owner] * x)
                dv = np.zeros((used.size, RANK), np.float32)
                np.add.at(dv, slot, (err[owner] * x)[:, None] * (total[owner] - vx))
                dw, dv = dw + DECAY * self.w[used], dv + DECAY * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                gb += float(err.sum()) ** 2
                self.bias -= RATE * float(err.sum()) / np.sqrt(gb)
        return self


def _own(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    doc_id = F.col("doc_id").cast("long")
    part = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0]
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), n_chars.alias("n_chars"), part.alias("part")
    )


def _featured(batches):
    for batch in batches:
        found = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column(0).cast(pa.binary()), batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(2),
                pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([f[1] for f in found], pa.list_(pa.float32())),
                pa.array([f[2] for f in found], pa.list_(pa.float64())),
            ],
            names=["label", "at", "x", "stats"],
        )


def _within(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The first of the sampled rows, by hash, whose texts together have TRAIN_BYTES at most: what a
    fit holds on the driver is bounded in bytes too."""
    known = stage(known.withColumn("h", F.xxhash64("doc_id")), "sample")  # TRAIN_ROWS rows at most
    size = _own(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id", "h").agg(F.max(F.octet_length("text")).alias("size"))
    total, cut = 0, None
    for r in size.orderBy("h", "doc_id").collect():
        total += r["size"] or 0
        if total > TRAIN_BYTES:
            cut = (r.h, r.doc_id)
            break
    if cut is not None:
        known = known.where((F.col("h") < cut[0]) | ((F.col("h") == cut[0]) & (F.col("doc_id") < cut[1])))
    return known.drop("h")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most ``train_rows`` labelled documents that aren't held out."""
    quality = F.col("quality").cast("int")
    known = labels.where(quality.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(quality).alias("label"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT[0]
    known = known.where("doc_id IS NOT NULL").where(part != HELD_OUT[1])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    known = _within(docs, known)
    rows = _own(docs).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    rows = rows.select("text", "n_chars", "label").mapInArrow(_featured, "label int, at array<int>, x array<float>, stats array<double>")
    got = rows.toArrow()
    cut = lambda name: [x.values.to_numpy() for x in got.column(name)]
    ready = list(zip(cut("at"), cut("x"), cut("stats")))
    labels = got.column("label").to_numpy().astype(np.float32)
    # Rows come in no fixed order; sorted by what they hold, a rerun fits the same model.
    order = sorted(range(len(ready)), key=lambda k: (tuple(ready[k][2]), float(labels[k])))
    return Machine().fit([ready[k] for k in order], labels[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, part and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches):
        model = shared.value
        for batch in batches:
            raw = [model.raw(*model.row(*features(t.as_py(), n.as_py()))) for t, n in zip(batch.column(2).cast(pa.binary()), batch.column(3))]
            p = 1 / (1 + np.exp(-np.array(raw, dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], names=["doc_id", "part", "score"])

    return _own(docs).select("doc_id", "part", "text", "n_chars").mapInArrow(scored, "doc_id long, part long, score double")


@query("op3_factorisation_machine")
def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        (F.col("part") == HELD_OUT[1]).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
