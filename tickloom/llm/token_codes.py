"""Token ids in directly addressable codes: random access without decoding blocks.

Ids are cut into chunks of CHUNK bits, low chunk first. Level 0 holds the first chunk of every
id; a bitmap beside it says which ids go on, and level 1 holds the next chunk of those only, and
so on. A rank directory (how many bits are set before each 64-bit word) turns a place in one
level into its place in the next with one lookup and one popcount, so any id is read by itself.

The files are Parquet rows under the shared folder, one segment each, in ascending doc_id order:
range partitions are sorted, each task packs whole documents into segments of about
SEGMENT_IDS ids, and Spark's commit protocol makes retries safe. A segment has its documents'
ids and starts, and per level the chunk bytes, the bitmap and the rank directory.

Edge cases: a null text is empty and gets the end id alone; null doc_ids come first; rows with
one doc_id are ordered by text; a document is never cut, however long; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import small, stage
from .common import query, table, texts, worker_table

CHUNK = 8
SEGMENT_IDS = 1 << 20
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text that a range partition takes, in the mean: what two tasks fetch and sort stays small.
PARTITION_BYTES = 8 << 20
#: Bytes of text that are cut together, and whose pieces are looked up together.
PART_BYTES, GROUP_BYTES = 1 << 20, 4 << 20
#: New pieces that go to the library at a time; with more, its own structures leave the caches.
LEARN_PIECES = 200
#: New pieces that are Python strings at a time.
LIST_PIECES = 20_000
#: Bytes of a worker's table of pieces already encoded, alone and as a stage of a pipeline, whose executors
#: have other stages' memory too, and of an entry beside its piece and ids, with its place in Arrow's hash table.
TABLE_BYTES, STAGE_TABLE_BYTES, ENTRY_BYTES = 64 << 20, 16 << 20, 44
#: Ids that are read at a time, and range partitions whose offsets one task sums.
READ_IDS, RUN_PARTS = 1 << 18, 1024
SEGMENT_SCHEMA = (
    "part int, part_start long, doc_ids array<long>, starts array<long>, n_ids long, "
    "levels array<struct<chunks: binary, more: binary, ranks: binary>>"
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- codes -------------------------------------------------------------------------------------


def encode_levels(ids: np.ndarray, chunk: int = CHUNK) -> list[dict]:
    """Chunk levels of unsigned ids; chunks of up to 8 bits take a byte each."""
    rest, out = ids, []
    mask, step = ids.dtype.type((1 << chunk) - 1), ids.dtype.type(chunk)
    while True:
        high = rest >> step
        more = high != 0
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-more.size // 64) * 8, dtype=np.uint8)
        words[: bits.size] = bits
        per_word = np.bitwise_count(words.view(np.uint64)).astype(np.uint32)
        ranks = (np.cumsum(per_word, dtype=np.uint32) - per_word).astype("<u4")
        out.append({"chunks": (rest & mask).astype(np.uint8).tobytes(), "more": words.tobytes(), "ranks": ranks.tobytes()})
        if not more.any():
            return out
        rest = high[more]


def decode(levels: list[dict], chunk: int = CHUNK) -> np.ndarray:
    """All ids in order: the n-th id that goes on takes the n-th chunk of the next level."""
    ids = None
    for k in range(len(levels) - 1, -1, -1):
        chunks = np.frombuffer(levels[k]["chunks"], dtype=np.uint8)
        own = chunks.astype(np.uint32 if len(levels) * chunk <= 32 else np.uint64)
        if ids is not None:
            more = np.unpackbits(np.frombuffer(levels[k]["more"], dtype=np.uint8), count=chunks.size, bitorder="little").view(bool)
            own[more] |= ids << own.dtype.type(chunk)
        ids = own
    return ids


def access(levels: list[dict], places: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The ids at ``places``, by chunk lookups and ranks alone."""
    out = np.zeros(places.size, dtype=np.uint64)
    at, who = places.astype(np.int64), np.arange(places.size)
    for k, level in enumerate(levels):
        out[who] |= np.frombuffer(level["chunks"], dtype=np.uint8)[at].astype(np.uint64) << np.uint64(k * chunk)
        words = np.frombuffer(level["more"], dtype="<u8")
        goes_on = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        at, who = at[goes_on], who[goes_on]
        if not at.size:
            break
        word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        at = np.frombuffer(level["ranks"], dtype="<u4")[word].astype(np.int64) + np.bitwise_count(words[word] & low)
    return out


def _rank(levels: list[dict], k: int, at: int) -> int:
    """How many ids before place ``at`` of level k go on: one directory entry and one popcount."""
    word, ranks = at >> 6, np.frombuffer(levels[k]["ranks"], dtype="<u4")
    if word >= ranks.size:
        return len(levels[k + 1]["chunks"])
    bits = int(np.frombuffer(levels[k]["more"], dtype="<u8")[word]) & ((1 << (at & 63)) - 1)
    return int(ranks[word]) + bits.bit_count()


def access_range(levels: list[dict], start: int, stop: int, chunk: int = CHUNK) -> np.ndarray:
    """The ids from ``start`` to ``stop``: those that go on are a range of the next level too, whose
    ends the rank directory gives, so nothing before or behind is read."""
    parts = []
    for k, level in enumerate(levels):
        more = np.frombuffer(level["more"], dtype=np.uint8)[start >> 3 : (stop + 7) >> 3]
        more = np.unpackbits(more, bitorder="little")[start & 7 :][: stop - start].view(bool)
        parts.append((np.frombuffer(level["chunks"], dtype=np.uint8)[start:stop], more))
        if k + 1 == len(levels):
            break
        start, stop = _rank(levels, k, start), _rank(levels, k, stop)
    ids = None
    for chunks, more in reversed(parts):
        own = chunks.astype(np.uint32 if len(levels) * chunk <= 32 else np.uint64)
        if ids is not None:
            own[more] |= ids << own.dtype.type(chunk)
        ids = own
    return ids


# --- tokenization ------------------------------------------------------------------------------


#: Marks a piece that follows the one before without a blank; a text that holds it is not cut.
_GLUED = "\x00"
#: A full stop or comma that does not follow a letter or digit.
_MARKS = r"(?:\A|[^\p{L}\p{N}])[.,]"


def _ragged(values: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``at`` of values, which ``cuts`` divides, one after the other, and their cuts."""
    first = cuts[at]
    sizes = cuts[at + 1] - first
    ends = np.zeros(at.size + 1, dtype=np.int64)
    np.cumsum(sizes, out=ends[1:])
    places = np.repeat(first - ends[:-1], sizes)
    places += np.arange(ends[-1])
    return values[places], ends


class Encoder:
    """A tokenizers file with a bounded table of what it made of each piece of text.

    A byte-level pre-tokenizer cuts before every blank, line break, and full stop or comma after
    a letter or digit, so a text's ids are those of such pieces, one after the other. Where a
    mark follows something else, the text is cut at blanks and line breaks only; where blanks or
    line breaks stand in a row, or with a special token, it goes to the library as it is.

    Texts are cut and their different pieces found by Arrow, many texts at a time. The table is an
    Arrow array of pieces beside one array of all their ids: no Python object per piece.
    """

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [_GLUED, *(t.content for t in added.values())]
        #: A token that stands for itself wherever it is, put between pieces: (id, content), or none.
        self.between = next(((k, t.content) for k, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.most = table_bytes
        self._keep(np.zeros(0, dtype=np.int64), pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def _keep(self, at: np.ndarray, pieces: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> None:
        self.known = pieces.take(pa.array(at))
        self.table, self.cuts = _ragged(ids, cuts, at)
        #: In how many groups a piece was met again since the table was last full.
        self.again = np.zeros(at.size, dtype=np.int32)
        self.bytes = pc.sum(pc.binary_length(self.known)).as_py() or 0
        self.bytes += self.table.nbytes + ENTRY_BYTES * at.size

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts with a blank before every piece, and which of them can be cut there."""
        has = lambda x, s: pc.match_substring(x, s).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            whole |= has(texts, s)
        apart = texts
        for mark in ".,":
            apart = pc.replace_substring(apart, mark, f" {_GLUED}{mark}")
        apart = pc.if_else(pc.match_substring_regex(texts, _MARKS), texts, apart)
        apart = pc.replace_substring(apart, "\n", " \n")
        # Blanks or line breaks in a row, or at the end.
        whole |= has(apart, "  ") | has(apart, "\n ")
        whole |= pc.ends_with(apart, " ").to_numpy(zero_copy_only=False) | pc.ends_with(apart, "\n").to_numpy(zero_copy_only=False)
        return pc.binary_join_element_wise(pa.scalar(_GLUED, apart.type), apart, pa.scalar("", apart.type)), ~whole

    def _learn(self, pieces: list[str]) -> None:
        # A piece that is neither glued nor a line follows a blank.
        texts = [p[1:] if p[:1] == _GLUED else p if p[:1] == "\n" else " " + p for p in pieces]
        if self.between:
            runs = (texts[k : k + LEARN_PIECES] for k in range(0, len(texts), LEARN_PIECES))
            ids = np.concatenate([self._whole("".join([t + self.between[1] for t in run])) for run in runs])
            ends = np.flatnonzero(ids == self.between[0])
            ids, ends = np.delete(ids, ends), ends - np.arange(ends.size)
        else:
            made = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, dtype="<u4")
            ends = np.searchsorted(np.array(made.word_ids, dtype=np.int64), np.arange(1, len(texts) + 1))
        self.known = pa.concat_arrays([self.known, pa.array(pieces, pa.large_string())])
        self.cuts = np.concatenate([self.cuts, self.table.size + ends])
        self.table = np.concatenate([self.table, ids])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), dtype=np.int32)])
        self.bytes += sum(len(p.encode()) for p in pieces) + ids.nbytes + ENTRY_BYTES * len(pieces)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the table has each of the pieces, which differ; the new ones are learned first."""
        if self.bytes > self.most:  # half of it stays at most, what was met most often
            n = min(np.count_nonzero(self.again), self.again.size // 2)
            self._keep(np.sort(np.argsort(-self.again, kind="stable")[:n]), self.known, self.table, self.cuts)
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        self.again[at[~new]] += 1
        if new.any():
            at[new] = np.arange(len(self.known), len(self.known) + np.count_nonzero(new))
            unknown = pieces.filter(pa.array(new))
            for k in range(0, len(unknown), LIST_PIECES):
                self._learn(unknown.slice(k, LIST_PIECES).to_pylist())
        return at

    def split(self, texts: pa.Array) -> tuple:
        """Texts cut into coded pieces: each text's own end among them, the pieces, and the texts that stay whole."""
        apart, cut = self._cut(texts)
        lists = pc.split_pattern(apart.filter(pa.array(cut)), " ")
        edges = lists.offsets.to_numpy()
        return edges - edges[0], lists.flatten().dictionary_encode(), [None if c else texts[k].as_py() for k, c in enumerate(cut)]

    def ids(self, parts: list[tuple]):
        """The ids of each text of split parts, whose pieces are looked up together."""
        coded = pa.chunked_array([pieces for _, pieces, _ in parts]).unify_dictionaries()
        at = self._places(coded.chunk(0).dictionary)
        pa.default_memory_pool().release_unused()
        for (edges, _, whole), pieces in zip(parts, coded.chunks):
            ids, ends = _ragged(self.table, self.cuts, at[pieces.indices.to_numpy()])
            ends = ends[edges].tolist()
            found = (ids[a:b] for a, b in zip(ends, ends[1:]))
            for text in whole:
                yield next(found) if text is None else self._whole(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return list(self.ids([self.split(pa.array(texts, pa.large_string()))]))


def _encoded(batches, codec: Encoder):
    """(doc_id, ids) of each row: texts are cut PART_BYTES at a time and looked up GROUP_BYTES at a time."""
    doc_ids, parts, size = [], [], 0
    for batch in filter(len, batches):
        doc_ids += batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        edges = [0, *(np.flatnonzero(np.diff(ends // PART_BYTES)) + 1).tolist(), len(texts)]
        parts += [codec.split(texts.slice(a, b - a)) for a, b in zip(edges, edges[1:])]
        size += int(ends[-1])
        if size >= GROUP_BYTES:
            yield from zip(doc_ids, codec.ids(parts))
            doc_ids, parts, size = [], [], 0
    if parts:
        yield from zip(doc_ids, codec.ids(parts))


# --- files -------------------------------------------------------------------------------------


def write_codes(docs: DataFrame, name: str = TOKENIZER, end_id: int = END_ID, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Encode every text, write the segments to the shared folder, and return them as read back."""
    own = texts(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(8, int(size // PARTITION_BYTES) + 1)
    # Rows of one id, or of none, are in order of their texts and may take several partitions.
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)]
    ordered = own.repartitionByRange(n_parts, *order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("part_start", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("starts", pa.list_(pa.int64())),
            ("n_ids", pa.int64()),
            ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))),
        ]
    )

    def pack(batches):
        path = tokenizer_path(name)
        codec = worker_table(("tokens", path, table_bytes), lambda: Encoder(path, table_bytes))
        end = np.array([end_id], dtype="<u4")
        part, done = TaskContext.get().partitionId(), 0
        doc_ids, lengths, buffers = [], [], []

        def segment():
            ids = np.concatenate(buffers)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            row = {"part": part, "part_start": done, "doc_ids": doc_ids, "starts": starts, "n_ids": ids.size, "levels": encode_levels(ids)}
            return pa.RecordBatch.from_pylist([row], schema=schema), ids.size

        held = 0
        for doc_id, code in _encoded(batches, codec):
            doc_ids.append(doc_id)
            lengths.append(code.size + 1)
            buffers += [code, end]
            held += lengths[-1]
            if held >= SEGMENT_IDS:
                row, n = segment()
                yield row
                done, held, doc_ids, lengths, buffers = done + n, 0, [], [], []
        if doc_ids:
            yield segment()[0]

    return stage(ordered.mapInArrow(pack, SEGMENT_SCHEMA), "token-codes")


def read_ids(segment: dict, k: int) -> np.ndarray:
    """All ids of the segment's k-th document, by random access."""
    start = segment["starts"][k]
    stop = segment["starts"][k + 1] if k + 1 < len(segment["starts"]) else segment["n_ids"]
    return access_range(segment["levels"], start, stop)


def _digests(batches):
    """Every document's ids by random access, some documents at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            segment = batch.slice(row, 1).to_pylist()[0]
            edges = np.array([*segment["starts"], segment["n_ids"]], dtype=np.int64)
            first, crcs = 0, []
            while first < edges.size - 1:
                last = max(first + 1, int(np.searchsorted(edges, edges[first] + READ_IDS, "right")) - 1)
                ids = access_range(segment["levels"], int(edges[first]), int(edges[last])).astype("<u4", copy=False).tobytes()
                own = 4 * (edges[first : last + 1] - edges[first])
                crcs += [zlib.crc32(ids[a:b]) for a, b in zip(own, own[1:])]
                first = last
            columns = [
                pa.array(np.full(len(crcs), segment["part"], dtype=np.int32)),
                pa.array(segment["doc_ids"], pa.int64()),
                pa.array(segment["part_start"] + edges[:-1]),
                pa.array(np.diff(edges)),
                pa.array(crcs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "place", "n_tokens", "ids_crc32"])


def digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written files."""
    found = segments.mapInArrow(_digests, "part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    # One row per range partition, whose running sum is taken run by run.
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("run", F.floor(F.col("part") / RUN_PARTS))
    runs = sums.groupBy("run").agg(F.sum("n").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run", before("run").alias("run_offset"))
    offsets = sums.withColumn("offset", before("run", "part")).join(runs, "run").select("part", (F.col("run_offset") + F.col("offset")).alias("offset"))
    out = found.join(small(offsets, "offsets"), "part")
    return out.select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(write_codes(docs, table_bytes=STAGE_TABLE_BYTES))


@query("op8_token_codes")
def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(write_codes(table(spark, sf_dir, "documents")))
