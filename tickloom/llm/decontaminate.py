"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names turn into typed placeholders, all else
into its lower-case letters and digits. A run of number words, with the units behind them (glued
or not), is one placeholder, and so is a run of name words: "twenty five" is as long as "25", and
"John Smith" as "John". Windows of WINDOW tokens are hashed and joined between documents and
benchmark items; a window keeps the words behind its placeholders (its slots). A document holds
an item if the aligned windows of one stretch cover enough of the item's template and the slots
are consistent: each word of the item stands for one word of the document and the other way
round, as in the same question with other numbers or names. A stretch is a chain of aligned
windows, forward in both texts, whose shift changes by MAX_DRIFT at most from one to the next:
words put in, left out or changed cost no more than themselves.

Before the join, documents' windows pass a bitmap of the benchmark's window hashes. It has
BITMAP_BITS bits whatever the benchmark's size, so its broadcast is bounded, and it lets through
every true match; what it lets through wrongly, the join drops.

Items of fewer than WINDOW tokens are one window of their full length and match alike. A window
with fewer than MIN_LITERALS literal tokens says too little to be matched by its template. Where an
item's other windows cover less than MIN_COVERED of it, such as "12 + 7 = 19 and 30 + 4 = 34", all its
windows are searched with the words behind the placeholders, and a document holds it if one
stretch has the whole item word by word.

Edge cases: null texts hold nothing; an item of placeholders with fewer than MIN_LITERALS words in
all can't be told from chance and is not searched; repeated items and documents match one by
one; null ids stay null ids; texts of any length are read whole; other columns are ignored, whatever
their names; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import small, stage
from .common import query, table, text_runs, worker_table

WINDOW = 8
MIN_LITERALS = 4
#: Share of the item's template tokens that aligned windows must cover.
MIN_COVERED = 0.7
#: Share of the alignment's slot words, on either side, that stand for one word only.
MIN_CONSISTENT = 0.8
#: Tokens that a stretch may gain or lose between two aligned windows.
MAX_DRIFT = WINDOW
BITMAP_BITS = 1 << 22

NUMBER, QUANTITY, UNIT, NAME = "\x01num", "\x01qty", "\x01unit", "\x01name"
_KINDS = {NUMBER: 1, QUANTITY: 2, UNIT: 3, NAME: 4}  # all else is literal: 0
# Fixed word lists of the placeholders.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in ft yd mi g kg mg lb oz ml l s sec min h hr hrs hz khz mhz w kw v a j kj pa bar mph kph usd eur gbp % $ € £ meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres seconds minutes hours days weeks months years dollars euros cents degrees".split()
_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,/:]*%?\Z")
_GLUED = re.compile(r"([+-]?[$€£]?[0-9][0-9.,/:]*)([^\W\d_]+|[%€$£])\Z")
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%€$£]+\Z")
_ASCII = [chr(k) for k in range(128) if not (chr(k).isalnum() or chr(k) in "_$%")]
_ASCII_EDGES = "".join(x for x in _ASCII if x not in "+-"), "".join(_ASCII)  # as _EDGE, of ASCII words
_KIND_OF = {**dict.fromkeys(NUMBER_WORDS, NUMBER), **dict.fromkeys(UNITS, UNIT)}
#: Words of a task's table of words already read, about 200 bytes each.
TABLE_WORDS = 400_000
#: Bytes of text that are read at once, or one text.
READ_BYTES = 1 << 20


def canonical(word: str, sentence_start: bool) -> tuple[str, str, bool]:
    """(template token, the word behind it, whether the next word starts a sentence)."""
    if word.isalpha():
        bare, ends = word, False
    else:
        bare = word.lstrip(_ASCII_EDGES[0]).rstrip(_ASCII_EDGES[1]) if word.isascii() else _EDGE.sub("", word)
        ends = word[-1] in ".!?:" or word.endswith(('."', '!"', '?"'))
        if not bare.isalpha():
            glued = _GLUED.match(bare)
            if glued and glued[2].lower() in _KIND_OF:
                return QUANTITY, f"{glued[1]} {glued[2]}".lower(), ends
            if _NUMBER.match(bare):
                return NUMBER, bare.lower(), ends
            if "-" in bare and all(_KIND_OF.get(part) is NUMBER for part in bare.lower().split("-")):
                return NUMBER, bare.lower().replace("-", " "), ends
    low = bare.lower()
    if low in _KIND_OF:
        return _KIND_OF[low], low, ends
    if not sentence_start and bare[:1].isupper() and not bare.isupper():
        return NAME, low, ends
    return low, low, ends


_LINE = "\0"  # stands before every line: no token, and the next word starts a sentence
_NO_TOKENS = {_LINE.encode(): 0, b"": 1}  # white space at a text's end leaves an empty word
_LISTED = pa.array(list(_KIND_OF))
_LISTED_KINDS = np.array([*(_KINDS[k] for k in _KIND_OF.values()), 0], np.int8)


def _cut(words: pa.Array) -> list[bytes]:
    """A string array's values, cut from its bytes at once."""
    _, at, data = words.buffers()
    cuts = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def _xxh(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), dtype=np.uint64, count=len(words))


#: Hashes of the placeholders by kind; a number with its unit is a number.
_KIND_HASHES = np.concatenate([np.zeros(1, np.uint64), _xxh([NUMBER, NUMBER, UNIT, NAME])])


def canonical_all(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word as by ``canonical`` inside a sentence: its kind, its own hash, whether the next word
    starts a sentence, whether it is a token. Words of ASCII letters between marks are told by Arrow."""
    flags = lambda x: x.to_numpy(zero_copy_only=False)
    bare = pc.ascii_rtrim(pc.ascii_ltrim(words, characters=_ASCII_EDGES[0]), characters=_ASCII_EDGES[1])
    plain = flags(pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(bare)))
    low = pc.ascii_lower(bare)
    kind = _LISTED_KINDS[pc.fill_null(pc.index_in(low, value_set=_LISTED), -1).to_numpy()]
    upper = pc.and_not(pc.ascii_is_upper(pc.utf8_slice_codeunits(bare, 0, 1)), pc.ascii_is_upper(bare))
    kind[flags(upper) & (kind == 0)] = _KINDS[NAME]
    ends = flags(pc.match_substring_regex(words, r'(?:[.!?:]|[.!?]")\z'))
    hashes, token = _xxh(_cut(low)), np.ones(len(words), bool)
    rest = np.flatnonzero(~plain)
    if rest.size:
        tokens, own, ends_ = zip(*[canonical(word, False) for word in words.take(pa.array(rest)).to_pylist()])
        kind[rest] = [_KINDS.get(t, 0) for t in tokens]
        hashes[rest], ends[rest], token[rest] = _xxh([x.encode() for x in own]), ends_, [t != "" for t in tokens]
    return kind, hashes, ends, token


class Templates:
    """Template token hashes of texts, with a bounded table of words already seen."""

    def __init__(self, most: int = TABLE_WORDS):
        self.most = most
        self.place = dict(_NO_TOKENS)
        # Of each word, inside a sentence and at its start: hash and kind.
        self.hashes, self.kind = np.zeros((2, 1024), np.uint64), np.zeros((2, 1024), np.int8)
        self.ends, self.token = np.zeros(1024, bool), np.zeros(1024, bool)
        self.ends[: len(_NO_TOKENS)] = True

    def _forget(self) -> None:
        """The older half of the table goes."""
        n = len(_NO_TOKENS)
        kept = list(islice(self.place, n + (len(self.place) - n) // 2, None))
        at = np.array([*range(n), *map(self.place.__getitem__, kept)], dtype=np.int64)
        self.hashes, self.kind, self.ends, self.token = (x[..., at] for x in (self.hashes, self.kind, self.ends, self.token))
        self.place = _NO_TOKENS | dict(zip(kept, range(n, at.size)))

    def _learn(self, words: list[bytes], texts: pa.Array) -> None:
        if len(self.place) + len(words) > self.ends.size:
            room = max(2 * self.ends.size, len(self.place) + len(words))
            grow = lambda x: np.concatenate([x, np.zeros((*x.shape[:-1], room - x.shape[-1]), x.dtype)], axis=-1)
            self.hashes, self.kind, self.ends, self.token = map(grow, (self.hashes, self.kind, self.ends, self.token))
        first = len(self.place)
        self.place.update(zip(words, range(first, first + len(words))))
        cut = slice(first, first + len(words))
        kind, own, self.ends[cut], self.token[cut] = canonical_all(texts)
        # Only a name is another token where a sentence starts: itself.
        for row, kinds in ((0, kind), (1, np.where(kind == _KINDS[NAME], 0, kind))):
            self.hashes[row, cut] = np.where(kinds == 0, own, _KIND_HASHES[kinds])
            self.kind[row, cut] = kinds

    def read_all(self, texts: pa.Array):
        """(hashes, literal flags, stops of the texts, words behind a token) of the texts' tokens, one
        text after the other; bare punctuation is none."""
        mark = f"{_LINE} "
        lists = pc.utf8_split_whitespace(pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", f" {mark}"), ""))
        coded = lists.flatten().dictionary_encode()
        words = _cut(coded.dictionary)
        look = lambda: np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        places = look()
        if len(self.place) + (places < 0).sum() > self.most and len(self.place) > len(_NO_TOKENS):
            self._forget()
            places = look()
        new = np.flatnonzero(places < 0)
        if new.size:
            places[new] = np.arange(len(self.place), len(self.place) + new.size)
            self._learn([words[k] for k in new.tolist()], coded.dictionary.take(pa.array(new)))
        which = coded.indices.to_numpy().astype(np.int64)
        start = np.ones(which.size, dtype=np.int64)
        start[1:] = self.ends[places][which[:-1]]
        use = np.flatnonzero(self.token[places][which])
        which, start = which[use], start[use]
        kind = self.kind[:, places][start, which]
        text_ends = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
        begun = np.append(start == 1, True)
        begun[np.searchsorted(use, text_ends)] = True  # a text's first token, behind bare punctuation too
        first = np.flatnonzero(~joins(kind, begun[:-1]))
        pieces = np.append(first, kind.size)
        word = lambda k: " ".join([canonical(words[which[j]].decode(), bool(start[j]))[1] for j in range(pieces[k], pieces[k + 1])])
        stops = np.searchsorted(use[first], text_ends)
        return self.hashes[:, places][start[first], which[first]], kind[first] == 0, stops, word

    def read(self, text: str):
        """(hashes, literal flags, words behind a token) of one text's tokens."""
        hashes, literal, _, word = self.read_all(pa.array([text], pa.string()))
        return hashes, literal, word


def joins(kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which tokens go on with the placeholder before them: numbers behind a number, with or
    without its unit, a unit behind its number, names behind a name; not into another sentence."""
    out = np.zeros(kind.size, dtype=bool)
    if kind.size > 1:
        number = (kind == 1) | (kind == 2)
        unit = np.zeros(kind.size, dtype=bool)
        unit[1:] = (kind[1:] == 3) & (kind[:-1] == 1) & ~start[1:]
        out[1:] = (number[1:] & (number | unit)[:-1]) | ((kind[1:] == 4) & (kind[:-1] == 4))
        out = (out & ~start) | unit
    return out


_STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(hashes: np.ndarray, literal: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` tokens, and which of them have enough literal tokens."""
    n = hashes.size - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    out = np.full(n, np.uint64(size))
    lit = np.zeros(n, dtype=np.int64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * _STEP
        out ^= out >> np.uint64(31)
        lit += literal[k : k + n]
    return out, lit >= min(MIN_LITERALS, size)


def _by_words(h: int, slots: list[str]) -> int:
    """The hash of a window and the very words behind its placeholders."""
    return xxhash.xxh64_intdigest("\x1f".join([str(h), *slots]).encode("utf-8", "surrogatepass"), 11)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _rows(ids, rows, texts, sizes, read_all, bitmaps):
    """Window rows (id, row, h, place, size, n_tokens, slots, exact, raw) of documents' texts."""
    hashes, literal, stops, word = read_all(texts)
    starts = np.concatenate([[0], stops[:-1]])
    last = np.repeat(stops, stops - starts)
    for size in sizes:
        h, fit = windows(hashes, literal, size)
        inside = np.arange(size, size + h.size) <= last[: h.size]  # of one text
        bit = (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
        for exact, may, bits in ((False, inside & fit, bitmaps[0]), (True, inside, bitmaps[1])):
            if bits is None:
                continue
            likely = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            found = np.flatnonzero(may & likely)
            for at, k in zip(found.tolist(), np.searchsorted(stops, found, side="right").tolist()):
                slots = [word(at + j) for j in np.flatnonzero(~literal[at : at + size])]
                raw = int(h[at])
                place, n_tokens = at - int(starts[k]), int(stops[k] - starts[k])
                yield ids[k], rows[k], _signed(_by_words(raw, slots) if exact else raw), place, size, n_tokens, slots, exact, _signed(raw)


def _item_rows(ids, rows, texts, read):
    """Window rows of items: those with enough literal tokens, or, where these cover too little of
    the item to find it by them, all windows, to be found word by word."""
    for one, row, text in zip(ids, rows, texts):
        hashes, literal, word = read(text or "")
        if not hashes.size:
            continue
        size = min(WINDOW, hashes.size)
        h, fit = windows(hashes, literal, size)
        covered = np.zeros(hashes.size, dtype=bool)
        for place in np.flatnonzero(fit):
            covered[place : place + size] = True
        exact = bool(covered.sum() < MIN_COVERED * hashes.size)
        if exact and sum(1 if lit else word(k).count(" ") + 1 for k, lit in enumerate(literal)) < MIN_LITERALS:
            continue
        for place in range(h.size) if exact else np.flatnonzero(fit).tolist():
            slots = [word(place + k) for k in np.flatnonzero(~literal[place : place + size])]
            raw = int(h[place])
            yield one, row, _signed(_by_words(raw, slots) if exact else raw), place, size, hashes.size, slots, exact, _signed(raw)


_WINDOW_SCHEMA = "id long, row long, h long, place int, size int, n_tokens int, slots array<string>, exact boolean, raw long"


def _batch(rows):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * len(types)
    names = [c.split()[0] for c in _WINDOW_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _emit(rows, most=20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _item_windows(batches):
    read = worker_table("templates", Templates).read
    for batch in batches:
        yield from _emit(_item_rows(*(c.to_pylist() for c in batch.columns), read))


def chains(places: dict[int, list[int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Alignments of an item with a document: lists of (shift, from, to) in the item, in order.

    ``places`` has the sorted starts of matched windows by shift. All pieces of one shift are an
    alignment, and so is the best chain that ends in each piece: item and document places go
    forward, from piece to piece the shift changes by MAX_DRIFT at most, and each piece counts
    from where the one before it ends.
    """
    pieces = []
    for shift, starts in places.items():
        low = high = None
        for p in starts:
            if high is not None and p <= high:
                high = p + size
                continue
            if high is not None:
                pieces.append((low, high, shift))
            low, high = p, p + size
        pieces.append((low, high, shift))
    pieces.sort(key=lambda x: (x[1], x[0], x[2]))
    held: dict[int, list[int]] = {}
    best, back = [], []  # covered tokens of the best chain to each piece; the piece before and where to start
    for k, (low, high, shift) in enumerate(pieces):
        most, before, begin = high - low, -1, low
        for s in range(shift - MAX_DRIFT, shift + MAX_DRIFT + 1):
            for j in held.get(s, ()):
                start = max(low, pieces[j][1] + max(0, s - shift))
                if best[j] + high - start > most and start < high:
                    most, before, begin = best[j] + high - start, j, start
        held.setdefault(shift, []).append(k)
        best.append(most)
        back.append((before, begin))
    out = []
    for k in range(len(pieces)):
        chain = []
        while k >= 0:
            _, high, shift = pieces[k]
            k, begin = back[k]
            chain.append((shift, begin, high))
        out.append(chain[::-1])
    same: dict[int, list[tuple[int, int, int]]] = {}
    for low, high, shift in pieces:
        same.setdefault(shift, []).append((shift, low, high))
    return out + [x for x in same.values() if len(x) > 1]


def holds(hits: list[dict], n_tokens: int, size: int, exact: bool = False):
    """(covered share, consistent, n_places, same_slots) of the stretches that hold the item, or None."""
    slots = {(x["doc_place"] - x["place"], x["place"]): (x["slots"], x["doc_slots"]) for x in hits}
    places: dict[int, list[int]] = {}
    for shift, place in sorted(slots):
        places.setdefault(shift, []).append(place)
    found = []
    for chain in chains(places, size):
        covered = sum(high - low for _, low, high in chain)
        if covered < MIN_COVERED * n_tokens or exact and (covered < n_tokens or len({shift for shift, *_ in chain}) > 1):
            continue
        of_item: dict[str, set] = {}
        of_doc: dict[str, set] = {}
        for shift, low, high in chain:
            own = places[shift]
            for place in own[bisect_left(own, low) : bisect_right(own, high - size)]:
                for a, b in zip(*slots[shift, place]):
                    of_item.setdefault(a, set()).add(b)
                    of_doc.setdefault(b, set()).add(a)
        single = [sum(len(x) == 1 for x in side.values()) / len(side) for side in (of_item, of_doc) if side]
        consistent = min(single, default=1.0)
        if consistent >= MIN_CONSISTENT:
            same = all(x == {a} for a, x in of_item.items())
            found.append((covered / n_tokens, consistent, same, chain[0][0] + chain[0][1], chain[-1][0] + chain[-1][2]))
    if not found:
        return None
    # Stretches of the document that don't overlap, the best first.
    taken: list[tuple[int, int]] = []
    for *_, low, high in sorted(found, key=lambda x: (-x[0], -x[1], x[3], x[4])):
        k = bisect_left(taken, (low, high))
        if (k == 0 or taken[k - 1][1] <= low) and (k == len(taken) or high <= taken[k][0]):
            insort(taken, (low, high))
    return max(x[0] for x in found), max(x[1] for x in found), len(taken), any(x[2] for x in found)


_HELD = "doc_id long, doc_row long, item_id long, covered double, consistent double, n_places long, same_slots boolean"


def _held_batches(batches):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            told = holds(x["hits"], x["n_tokens"], x["size"], x["exact"])
            if told:
                rows.append((x["doc_id"], x["doc_row"], x["item_id"], *told))
        columns = list(zip(*rows)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _HELD.split(", ")])


def _row_hash(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_.cast("long"), text.cast("string"))


def _bitmap(items: DataFrame) -> np.ndarray | None:
    """Which of BITMAP_BITS places the items' template hashes have: BITMAP_BITS / 64 rows at most; None without items."""
    place = F.col("raw").bitwiseAND(BITMAP_BITS - 1)
    words = items.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(raw & 63 AS INT))")).alias("bits")
    )
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    got = words.toArrow()
    bitmap[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return bitmap.view(np.uint8) if got.num_rows else None


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, doc_row (hash of id and text), item_id, covered, consistent, n_places, same_slots: one
    row for each different text under an id and each item it holds."""
    spark = docs.sparkSession
    own = lambda rows, key: rows.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").select("id", _row_hash(F.col("id"), F.col("text")).alias("row"), "text")
    items = stage(own(benchmark, "item_id").mapInArrow(_item_windows, _WINDOW_SCHEMA), "items")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most WINDOW of them
    shared = spark.sparkContext.broadcast([_bitmap(items.where("NOT exact")), _bitmap(items.where("exact"))])

    def doc_windows(batches):
        read_all = worker_table("templates", Templates).read_all
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in text_runs(batch, 2, READ_BYTES):
                yield from _emit(_rows(ids[first:], rows[first:], run, sizes, read_all, shared.value))

    found = own(docs, "doc_id").mapInArrow(doc_windows, _WINDOW_SCHEMA)
    found = found.select(F.col("id").alias("doc_id"), F.col("row").alias("doc_row"), "h", F.col("place").alias("doc_place"), "size", F.col("slots").alias("doc_slots"), "exact")
    wanted = items.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "h", "place", "size", "n_tokens", "slots", "exact")
    hits = found.join(wanted, ["h", "size", "exact"]).where("size(doc_slots) = size(slots) AND (NOT exact OR doc_slots = slots)")
    # One text and one item meet in a row; rows that share an id stay apart by their texts.
    hit = F.struct("doc_place", "place", "slots", "doc_slots")
    pairs = hits.groupBy("doc_id", "doc_row", "item_id", "item_row", "n_tokens", "size", "exact").agg(F.collect_list(hit).alias("hits"))
    return pairs.drop("item_row").mapInArrow(_held_batches, _HELD)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered (share of the item), consistent (share of its slot words), n_places, same_slots."""
    return findings(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("covered").alias("covered"),
        F.max("consistent").alias("consistent"),
        F.sum("n_places").alias("n_places"),
        F.max("same_slots").alias("same_slots"),
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item, by id and text: a clean text under the id of a
    contaminated one stays, and a row without an id is judged by its text."""
    bad = findings(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("doc_row").alias("__row")).distinct()
    bad = small(bad, "contaminated")
    same = (_row_hash(docs["doc_id"], docs["text"]) == bad["__row"]) & docs["doc_id"].cast("long").eqNullSafe(bad["__id"])
    return docs.join(bad, same, "left_anti").select(*docs.columns)


@query("op9_template_decontamination")
def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
