"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

The base finds email, ip, card and phone by their patterns and checks. The model adds spans: it
reads islands (runs of words around a digit or an @), scores every candidate segment of up to
MAX_TOKENS tokens by features of the whole span (its shape, digit count, separators, checks,
and the characters beside it), and dynamic programming over the island chooses boundaries and
types together. Tokens outside of segments have score zero, so islands apart are independent.
A segment can only be of a type whose checks it passes (an @ and a stop, parts up to 255, Luhn,
9 to 15 digits and no letters).

The model is trained here by maximum likelihood (forward and backward sums over all
segmentations) on a bounded sample: the TRAIN_ISLANDS different islands with the smallest hashes, the
base spans in them as labels, and phones once more without their country code, which the base
pattern can't find. A span is added if its posterior is at least MIN_POSTERIOR and it
meets no base span. Base spans always stay.

Edge cases: a null text is empty and has no spans; one of the base patterns may overlap another,
as each kind is matched by itself; repeated rows and null ids get results of their own; islands
are read whole, however long, at a cost that is linear in their tokens (only the model's examples
are pieces of TRAIN_CHARS characters at most); without base spans to learn from nothing is added;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from .common import query, table, texts

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 14
TRAIN_ISLANDS = 1_500
MIN_POSTERIOR = 0.95
EPOCHS = 15
RATE = 0.3
DECAY = 1e-3
FEATURES = 1 << 13
_WINDOW = 80
TRAIN_CHARS = 4 * _WINDOW
_SEGMENTS = 1 << 14

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs of digits fail from their middle where they fail from their start: no need to try there.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost, not overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        # Failed before this @, the local part can't serve a later one: an @ is between.
        done = m.end() if m else at + 1
        if m:
            out.append(("email", start, done))
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and (len(p) <= 3 or not p[:-3].strip("0")) for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- islands and segments ----------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z]{1,40}|[0-9]{1,40}|\S")
_BLANK = re.compile(r"\s")


def islands(text: str, most: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of runs of words with a digit or an @, joined over a single blank; with
    ``most``, up to so many characters."""
    out: list[list[int]] = []
    m = _TRIGGER.search(text)
    while m:
        low, high = max(0, m.start() - _WINDOW, out[-1][1] if out else 0), min(len(text), m.start() + _WINDOW)
        start = m.start()
        while start > low and not text[start - 1].isspace():
            start -= 1
        blank = _BLANK.search(text, m.start(), high)
        end = blank.start() if blank else high
        while start > low and text[start - 1] in "+(":
            start -= 1
        if out and start - out[-1][1] <= 1 and (most is None or end - out[-1][0] <= most):
            out[-1][1] = end
        else:
            out.append([start, end])
        m = _TRIGGER.search(text, end)
    return [(a, b) for a, b in out]


def _crc(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode("utf-8", "surrogatepass")) % FEATURES


def _side(c: str) -> str:
    return "^" if not c else "a" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() else c


class Island:
    """Tokens and candidate segments of a piece of text, each with its feature numbers.

    A segment that passes no type's checks is no candidate.
    """

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
        self.from_, self.to, self.span = [], [], []
        self.found, self.fits = array("H"), array("b")
        for i, (a, _) in enumerate(self.tokens):
            first = text[a]
            if not (first.isalnum() or first in "+("):
                continue
            shape, digits, ats, dots = [], 0, 0, 0
            for j in range(i, min(i + MAX_TOKENS, len(self.tokens))):
                c, d = self.tokens[j]
                token = text[c:d]
                if j > i and c > self.tokens[j - 1][1]:
                    shape.append("_")
                is_digit = token[0].isdigit()
                shape.append("a" if token[0].isalpha() else f"9{min(len(token), 20)}" if is_digit else token)
                digits += len(token) if is_digit else 0
                ats += token == "@"
                dots += token == "."
                if not (digits or ats) or not (token[-1].isalnum() or token[-1] == ")"):
                    continue
                found, fits = self._features(text, a, d, shape, digits, ats, dots, j + 1 - i)
                if any(fits):
                    self.from_.append(i)
                    self.to.append(j + 1)
                    self.span.append((a, d))
                    self.found.extend(found)
                    self.fits.extend(fits)

    def features(self) -> np.ndarray:
        """(segments, features of each)"""
        return np.frombuffer(self.found, np.uint16).reshape(len(self.span), -1)

    @staticmethod
    def _features(text, a, d, shape, digits, ats, dots, n):
        span = text[a:d]
        good_card = 13 <= digits <= 19 and not ats and span.isascii() and luhn(_digits(span))
        parts = span.split(".")
        good_ip = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        fits = (ats == 1 and dots > 0, good_ip, good_card, not ats and 9 <= digits <= 15 and "a" not in shape)
        if not any(fits):
            return (), fits
        plain = "".join("9" if s[0] == "9" else s for s in shape)
        left, right = text[a - 1 : a], text[d : d + 1]
        return [
            _crc("bias"),
            _crc("shape", plain),
            _crc("full", "".join(shape)),
            _crc("digits", min(digits, 24)),
            _crc("tokens", n),
            _crc("ats", min(ats, 2), "dots", min(dots, 4)),
            _crc("sides", _side(left), _side(right)),
            _crc("left", _side(left), shape[0][0]),
            _crc("right", shape[-1][0], _side(right)),
            _crc("checks", good_card, good_ip),
            _crc("first", span[0] if not span[0].isalnum() else _side(span[0]), "9-15", 9 <= digits <= 15),
        ], fits


class SemiMarkov:
    """Weights by type and feature; sums and best paths over an island's segmentations."""

    def __init__(self):
        self.w = np.zeros((len(KINDS), FEATURES))

    def scores(self, island: Island) -> np.ndarray:
        """(segments, types); far below any path for a type whose checks the segment fails."""
        found, fits = island.features(), np.frombuffer(island.fits, np.int8).reshape(-1, len(KINDS)) != 0
        cuts = range(0, len(found), _SEGMENTS)
        sums = np.concatenate([self.w[:, found[k : k + _SEGMENTS]].sum(axis=2).T for k in cuts])
        return np.where(fits, sums, -1e3)

    def sums(self, island: Island, scores: np.ndarray):
        """(log of all paths, posterior of each segment and type)."""
        n, m = len(island.tokens), len(island.from_)
        best = scores.max(axis=1)
        each = best + np.log(np.exp(scores - best[:, None]).sum(axis=1))
        ahead = np.full(n + 1, -np.inf)
        ahead[0] = 0.0
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k in range(m):
            by_end[island.to[k]].append(k)
            by_start[island.from_[k]].append(k)
        for j in range(1, n + 1):
            ways = [ahead[j - 1]] + [ahead[island.from_[k]] + each[k] for k in by_end[j]]
            top = max(ways)
            ahead[j] = top + np.log(sum(np.exp(x - top) for x in ways))
        behind = np.full(n + 1, -np.inf)
        behind[n] = 0.0
        for i in range(n - 1, -1, -1):
            ways = [behind[i + 1]] + [behind[island.to[k]] + each[k] for k in by_start[i]]
            top = max(ways)
            behind[i] = top + np.log(sum(np.exp(x - top) for x in ways))
        start, stop = np.array(island.from_), np.array(island.to)
        posterior = np.exp(ahead[start][:, None] + scores + behind[stop][:, None] - ahead[n])
        return ahead[n], posterior

    def best(self, island: Island, scores: np.ndarray) -> list[tuple[int, int]]:
        """The best path's (segment, type) pairs."""
        n = len(island.tokens)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        kind, top = scores.argmax(axis=1), scores.max(axis=1)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k, j in enumerate(island.to):
            by_end[j].append(k)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in by_end[j]:
                if value[island.from_[k]] + top[k] > value[j]:
                    value[j], back[j] = value[island.from_[k]] + top[k], k
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                out.append((back[j], int(kind[back[j]])))
                j = island.from_[back[j]]
        return out[::-1]

    def fit(self, samples: list[tuple[str, list]]) -> "SemiMarkov":
        """``samples``: island texts (with a character of context each side) and their labels."""
        ready = []
        for text, labels in samples:
            island = Island(text, 1, len(text) - 1)
            if not island.found:
                continue
            place = {span: k for k, span in enumerate(island.span)}
            gold = [(place.get((a, b)), KINDS.index(kind)) for kind, a, b in labels]
            if all(k is not None for k, _ in gold):
                ready.append((island, gold, island.features()))
        squares = np.full(self.w.shape, 1e-2)
        if not any(gold for _, gold, _ in ready):
            return self
        for _ in range(EPOCHS):
            for a in range(0, len(ready), 32):
                grad = np.zeros_like(self.w)
                for island, gold, found in ready[a : a + 32]:
                    _, posterior = self.sums(island, self.scores(island))
                    for kind in range(len(KINDS)):
                        np.add.at(grad[kind], found.ravel(), np.repeat(posterior[:, kind], found.shape[1]))
                    for k, kind in gold:
                        np.add.at(grad[kind], found[k], -1.0)
                grad += DECAY * self.w
                squares += grad * grad
                self.w -= RATE * grad / np.sqrt(squares)
        return self

    def added(self, text: str, base: list) -> list[tuple[str, int, int]]:
        """Spans of the best path that are sure enough and meet no base span."""
        if not self.w.any():
            return []
        taken = _joined(base)
        out = []
        for start, end in islands(text):
            island = Island(text, start, end)
            if not island.found:
                continue
            scores = self.scores(island)
            chosen = self.best(island, scores)
            chosen = [(k, t) for k, t in chosen if not _meets(taken, *island.span[k])]
            if chosen:
                _, posterior = self.sums(island, scores)
                out += [(KINDS[t], *island.span[k]) for k, t in chosen if posterior[k, t] >= MIN_POSTERIOR]
        return out


def _joined(base: list) -> tuple[list[int], list[int]]:
    """Starts and ends of what the base spans cover together."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    k = bisect_right(taken[1], a)  # the first that ends behind a
    return k < len(taken[0]) and taken[0][k] < b


# --- on Spark ----------------------------------------------------------------------------------

_ISLAND_SCHEMA = "text string, kinds array<string>, starts array<int>, ends array<int>"


def _island_batches(batches):
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            found = islands(text, TRAIN_CHARS)
            base = base_spans(text) if found else []
            for a, b in found:
                inside = [(k, s - a + 1, e - a + 1) for k, s, e in base if a <= s and e <= b]
                whole = text[a - 1 : a] if a else " ", text[a:b], text[b : b + 1] or " "
                rows.append(("".join(whole), [x[0] for x in inside], [x[1] for x in inside], [x[2] for x in inside]))
        columns = list(zip(*rows)) or [[]] * 4
        types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["text", "kinds", "starts", "ends"])


_CODE = re.compile(r"\+[0-9]{1,3}[ -]?(?=\()")


def without_code(text: str, labels: list) -> tuple[str, list] | None:
    """An island with its first phone's country code taken out, and the labels moved."""
    for kind, a, _ in labels:
        m = _CODE.match(text, a) if kind == "phone" else None
        if m:
            gone = m.end() - a
            return text[:a] + text[m.end() :], [(k, s - gone * (s > a), e - gone * (e > a)) for k, s, e in labels]
    return None


def _smallest(most: int):
    """Of each task, the ``most`` different islands with the smallest hashes, with labels and without."""

    def keep(batches):
        held: dict[bool, dict] = {False: {}, True: {}}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                h, text, kinds, starts, ends = row
                half = held[bool(kinds)]
                half[h, text.encode("utf-8", "surrogatepass"), tuple(kinds), tuple(starts), tuple(ends)] = row
                if len(half) > 4 * most:
                    for key in sorted(half)[most:]:
                        del half[key]
        rows = [half[key] for half in held.values() for key in sorted(half)[:most]]
        columns = list(zip(*rows)) or [[]] * 5
        types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["h", "text", "kinds", "starts", "ends"])

    return keep


def examples(docs: DataFrame, train_islands: int = TRAIN_ISLANDS) -> DataFrame:
    """At most ``train_islands`` different islands of ``docs``, half of them with labels."""
    found = texts(docs).select("text").mapInArrow(_island_batches, _ISLAND_SCHEMA)
    # Each half is a bounded top-k by hash of different islands: of every task first, then of all.
    found = found.select(F.xxhash64("text").alias("h"), "text", "kinds", "starts", "ends")
    found = found.mapInArrow(_smallest(train_islands // 2), "h long, " + _ISLAND_SCHEMA)
    found = stage(found.distinct(), "islands")
    has = F.size("kinds") > 0
    half = lambda where: found.where(where).orderBy("h", "text", "kinds", "starts", "ends").limit(train_islands // 2).drop("h")
    return half(has).unionByName(half(~has))


def fit(docs: DataFrame, train_islands: int = TRAIN_ISLANDS) -> SemiMarkov:
    """A model trained on the ``examples`` of ``docs``."""
    rows = examples(docs, train_islands).collect()
    samples = [(r.text, sorted(set(zip(r.kinds, r.starts, r.ends)), key=lambda x: x[1])) for r in rows]
    # Labels of a path can't overlap: an island whose base spans do is left out.
    samples = [(t, x) for t, x in samples if all(p[2] <= q[1] for p, q in zip(x, x[1:]))]
    samples += [more for s in samples if (more := without_code(*s))]
    return SemiMarkov().fit(sorted(samples, key=lambda s: hashlib.md5(s[0].encode("utf-8", "surrogatepass")).hexdigest()))


def find(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model.w)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (rank[s[0]], s[1])

    def spans(batches):
        crf = SemiMarkov()
        crf.w = shared.value
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                own = sorted(base_spans(text), key=order)
                more = sorted(crf.added(text, own), key=order)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
                added.append([dict(zip(("kind", "start", "end"), s)) for s in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], names=["doc_id", "base", "added"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return texts(docs).mapInArrow(spans, f"doc_id long, base {kind}, added {kind}")


@query("op1_semi_markov_pii")
def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    order = F.array(*map(F.lit, KINDS))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    placed = F.sort_array(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(F.transform("base", told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(placed, told), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
