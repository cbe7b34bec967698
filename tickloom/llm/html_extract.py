"""Main text of pages by suffix arrays over the pages of a host.

A page's markup is read into blocks of text. Blocks of elements that name themselves as menus,
headers, footers, sidebars, notices, adverts, forms or comments never count. All blocks of all pages
of a host, those of articles too, go as tokens into the host's suffix array: the streams of many
pages, one after the other, sorted by their suffixes. Runs of MIN_RUN or more tokens that distinct
pages of the host repeat decide about every block:

- a block outside of an article or main element is the text of a page whose markup names no
  article, and goes where runs on MIN_PAGES pages cover MIN_COVERED of it;
- a block inside of one is the text of its page, and goes where runs on at least MIN_SHARE of the
  host's pages, of SHARE_PAGES pages or more, cover MIN_COVERED of it. Articles share sentences;
  what half of a host's articles repeat is no sentence of theirs.

``boilerplate_tokens`` is what runs on MIN_PAGES pages cover of each page's streams.

A host's pages are dealt by hash to shards of about SHARD_TOKENS tokens, so that no task needs a
whole host. Where a host has several shards, its runs are counted over all its pages first, and
each shard is given the counts of its own: the result doesn't depend on the shards. For it the tasks
that read the pages tell every different run of a shard, inside articles and outside, and on how
many of its pages it is. Runs travel sorted and packed, as prints: so many bits of their hash that a
run of the host has another's print with a probability of 2^-SPARE_BITS, as a word has another's
token. What comes back to a shard is the counts of those of its runs that other shards have too and
MIN_PAGES pages hold. Streams travel as TOKEN_BYTES of a hash per token, and what comes back is the
numbers of the blocks that go; texts are read from the pages themselves. Words are hashed side by
side, READ_BYTES of html at once.
Suffixes are ordered by their first MIN_RUN tokens (prefix doubling), which is all that repeats of
this length need; each doubling is one sort of whole numbers.

Edge cases: a null html is empty and its text too; a null url has the empty host; exact copies of
a row count as one page for the suffix array and are returned each; unclosed elements end with
the element around them; pages of any length are read whole; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import small, stage
from .common import query, table, text_runs

MIN_RUN = 8  # a power of two
MIN_PAGES = 3
MIN_COVERED = 0.6
#: Share of a host's pages that runs inside articles must be on, and pages the host must have for it.
MIN_SHARE, SHARE_PAGES = 0.5, 10
SHARD_TOKENS = 500_000
#: Bits of a run's print beyond those that number the host's runs; two to this power shards' prints meet in one task, in the
#: mean; prints that a task holds before it tells them.
SPARE_BITS, PART_BITS, HELD_PRINTS = 24, 1, 4 << 20
#: Bytes of html per token, in the mean, by which pages are dealt; bytes of a token's hash.
HTML_BYTES, TOKEN_BYTES = 8, 3
#: Bytes of html whose words are hashed at once.
READ_BYTES = 4 << 20

# Fixed names of HTML elements, by what this reader does with them.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "select", "object", "canvas", "audio", "video", "map", "head"}
ARTICLE = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that an opening tag of the same group ends, up to the element that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
CLOSES |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|footer|sidebar|aside|ad|ads|advert|adverts|advertisement|banner|sponsor|sponsored|"
    r"promo|cookie|cookies|consent|notice|newsletter|subscribe|signup|popup|modal|breadcrumb|breadcrumbs|share|social|related|comment|"
    r"comments|disqus|respond|pagination|pager|widget|login|copyright)(?:$|[\s_-])",
    re.I,
)
_CHROME_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Quoted values may hold a >; where quotes don't pair, the first > ends the tag, and so does the page's end.
_TAG = re.compile(r"""<!--|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_chrome(name: str, attributes: str) -> bool:
    if name in CHROME:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if name in ("html", "body"):
        return False
    return bool(
        "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or _HIDDEN.search(found.get("style", ""))
        or found.get("role", "").lower() in _CHROME_ROLE
        or _CHROME_NAME.search(html.unescape(found.get("class", "")))
        or _CHROME_NAME.search(html.unescape(found.get("id", "")))
    )


def read_blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order; zone: article, plain or chrome."""
    out: list[tuple[str, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, in chrome, in article

    def flush():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                _, chrome, article = stack[-1] if stack else ("", False, False)
                out.append(("chrome" if chrome else "article" if article else "plain", text))

    def leave(k: int):
        if any(name in BLOCKS or chrome != (stack[k - 1][1] if k else False) for name, chrome, _ in stack[k:]):
            flush()
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = size if stop < 0 else stop + 3
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = size if stop is None else max(page.find(">", stop.start()) + 1, stop.end())
            pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if stack and stack[-1][0] == "head" and name not in ("meta", "link", "base"):
            leave(len(stack) - 1)  # what can't stand in a head ends it
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in CLOSES:
            ended, holders = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    leave(k)
                    break
                if stack[k][0] in holders:
                    break
        if name in VOID or m[3].endswith("/"):
            continue
        _, chrome, article = stack[-1] if stack else ("", False, False)
        now = chrome or _is_chrome(name, m[3])
        if now != chrome:
            flush()
        stack.append((name, now, article or name in ARTICLE or "articleBody" in m[3]))
    flush()
    return out


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, a key that exact copies of a row share, and a hash of the host."""
    out = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), "^.*?//", "")
    name = F.lower(F.substring_index(F.regexp_extract(rest, "^[^/?#]*", 0), "@", -1))
    return out.withColumns({"key": F.concat_ws(":", F.xxhash64("page_id", "url", "html"), F.hash("html", "url")), "host": F.xxhash64(name)})


OTHER, PLAIN, INSIDE = 0, 1, 2


def kinds(found: list[tuple[str, str]]) -> list[int]:
    """Of each block: inside an article, plain on a page without one (both may be text), or neither."""
    named = any(zone == "article" for zone, _ in found)
    return [INSIDE if zone == "article" else PLAIN if zone == "plain" and not named else OTHER for zone, _ in found]


def in_order(kind: np.ndarray) -> np.ndarray:
    """Places of the blocks in the streams: those of the article first, then all others."""
    return np.concatenate([np.flatnonzero(kind == INSIDE), np.flatnonzero(kind != INSIDE)])


_STREAM = "key string, host long, shard long, pages long, kinds binary, sizes binary, tokens binary"


def _tokens(pages: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The kinds and sizes of each page's blocks, and the hashes of all pages' streams."""
    kind_of, size_of, streams = [], [], []
    for page in pages.to_pylist():
        found = read_blocks(page)
        kind_of.append(np.array(kinds(found), dtype=np.uint8))
        size_of.append(np.array([text.count(" ") + 2 for _, text in found], dtype="<i4"))  # a block's end is a token too
        streams += [found[k][1] for k in in_order(kind_of[-1])]
    return kind_of, size_of, word_hashes(" \n ".join([*streams, ""]).encode())


def _streams(batches):
    """Of each page the kinds and sizes of its blocks, and the tokens of its streams."""
    names = [c.split()[0] for c in _STREAM.split(", ")]
    for batch in batches:
        for at, pages in text_runs(batch, 4, READ_BYTES):
            kind_of, size_of, h = _tokens(pages)
            ends = [0, *(TOKEN_BYTES * np.cumsum([int(size.sum()) for size in size_of])).tolist()]
            flat = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()
            columns = [[x.tobytes() for x in kind_of], [x.tobytes() for x in size_of], [flat[a:b] for a, b in zip(ends, ends[1:])]]
            yield pa.RecordBatch.from_arrays([*batch.slice(at, len(pages)).columns[:4], *[pa.array(c, pa.binary()) for c in columns]], names=names)


#: Words of more bytes are hashed one by one, all others side by side, eight bytes at a time.
WORD_BYTES = 64


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, each of which a space ends."""
    raw = np.frombuffer(text + bytes(8), dtype=np.uint8)
    lanes = np.ndarray(len(text) + 1, dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from each byte on
    ends = np.flatnonzero(raw[: len(text)] == ord(" "))
    starts = np.zeros_like(ends)
    starts[1:] = ends[:-1] + 1
    size = ends - starts
    out = size.astype(np.uint64)
    for at in range(0, min(WORD_BYTES, int(size.max(initial=0))), 8):
        here = np.flatnonzero(size > at)
        spare = np.maximum(0, 8 - (size[here] - at)).astype(np.uint64) * np.uint64(8)
        out[here] = _mixed(out[here] ^ (lanes[starts[here] + at] << spare))
    for k in np.flatnonzero(size > WORD_BYTES):
        out[k] = xxhash.xxh64_intdigest(text[starts[k] : ends[k]])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit hangs on all others (the end of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """Hashes of all runs of ``run`` tokens."""
    n = max(0, tokens.size - run + 1)
    out = np.full(n, np.uint64(run))
    for k in range(run if n else 0):
        out = (out ^ tokens[k : k + n]) * _STEP
        out ^= out >> np.uint64(31)
    return out


def ranks(keys: np.ndarray) -> np.ndarray:
    """Each key's place among the different keys, by one sort, of (key, position) in one number where 64 bits hold both."""
    bits = np.uint64(max(1, keys.size - 1).bit_length())
    if int(keys.max(initial=0)).bit_length() + int(bits) <= 64:
        both = np.sort(keys << bits | np.arange(keys.size, dtype=np.uint64))
        order, sorted_ = both & ((np.uint64(1) << bits) - np.uint64(1)), both >> bits
    else:
        order = np.argsort(keys)
        sorted_ = keys[order]
    new = np.zeros(keys.size, dtype=np.uint64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(keys.size, dtype=np.uint64)
    rank[order.view(np.int64)] = np.cumsum(new)
    return rank


def run_starts(segments: np.ndarray, run: int) -> np.ndarray:
    """Where runs of ``run`` tokens start that don't reach into the next segment."""
    return np.flatnonzero(segments[run - 1 :] == segments[: max(0, segments.size - run + 1)])


def run_counts(tokens: np.ndarray, segments: np.ndarray, pages: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts): where runs of ``run`` tokens start, and how many distinct pages have each.

    Prefix doubling: ranks by the first 1, 2, 4 ... tokens of each suffix, until suffixes of one
    rank share ``run`` tokens. A run doesn't reach into the next segment.
    """
    n = tokens.size
    if n < run:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rank = ranks(tokens.astype(np.uint64, copy=False))
    length = 1
    while length < run:
        ahead = np.zeros(n, dtype=np.uint64)  # nothing ahead comes first
        ahead[:-length] = rank[length:] + np.uint64(1)
        rank = ranks(rank * (rank.max() + np.uint64(2)) + ahead)  # sorted: the suffix array by 2 * length tokens
        length *= 2
    starts = run_starts(segments, run)
    of = rank[starts].view(np.int64)
    bits = int(pages.max()).bit_length()
    held = np.sort(of << bits | pages[starts])  # (rank, page)
    fresh = np.ones(held.size, dtype=bool)
    fresh[1:] = held[1:] != held[:-1]
    return starts, np.bincount(held[fresh] >> bits, minlength=n)[of]


def covered(n: int, starts: np.ndarray, run: int) -> np.ndarray:
    """Which of n tokens lie in a run from one of ``starts``."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + run, n), -1)
    return np.cumsum(edges)[:n] > 0


def repeated(tokens: np.ndarray, pages: np.ndarray, run: int, least: int) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that ``least`` distinct pages hold."""
    starts, counts = run_counts(tokens, pages, pages, run)
    return covered(tokens.size, starts[counts >= least], run)


class _Shard:
    """The streams of a shard's pages side by side, each different page once."""

    def __init__(self, rows: pa.Table):
        keys = rows.column("key").to_pylist()
        first = {key: k for k, key in reversed(list(enumerate(keys)))}
        self.keys = sorted(first)
        column = lambda name, k: rows.column(name)[k].as_py()
        tokens, kind, size, place, page_of = [], [], [], [], []
        for page, key in enumerate(self.keys):
            k = first[key]
            own = np.frombuffer(column("kinds", k), dtype=np.uint8)
            at = in_order(own)
            kind.append(own[at])
            size.append(np.frombuffer(column("sizes", k), dtype="<i4")[at])
            place.append(at)
            page_of.append(np.full(at.size, page))
            tokens.append(np.frombuffer(column("tokens", k), dtype=np.uint8).reshape(-1, TOKEN_BYTES))
        join = lambda parts, kind_: np.concatenate([*parts, np.zeros(0, kind_)]).astype(kind_)
        self.kind, self.size, self.place, self.page_of = join(kind, np.uint8), join(size, np.int64), join(place, np.int64), join(page_of, np.int64)
        wide = np.zeros((sum(map(len, tokens)), 8), dtype=np.uint8)
        if len(wide):
            wide[:, :TOKEN_BYTES] = np.concatenate(tokens)
        self.tokens = wide.view(np.uint64).ravel()
        self.owner = np.repeat(np.arange(self.size.size), self.size)
        self.pages = self.page_of[self.owner] if self.owner.size else np.zeros(0, np.int64)
        self.inside = (self.kind == INSIDE)[self.owner] if self.owner.size else np.zeros(0, bool)
        self.segments = 2 * self.pages + self.inside

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        return run_counts(self.tokens, self.segments, self.pages, MIN_RUN)


def packed(keys: np.ndarray, bits: int) -> bytes:
    """Different numbers of so many bits, ascending: their low bytes, and a one for each among zeros that count the rest."""
    low = next(k for k in range(2, 8) if k == 7 or (1 << bits >> 8 * k) <= 8 * keys.size)
    steps = np.zeros(keys.size + (1 << bits >> 8 * low) + 1, dtype=np.uint8)
    steps[(keys >> np.uint64(8 * low)).astype(np.int64) + np.arange(keys.size)] = 1
    own = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low])
    return np.array([low, keys.size], dtype="<i8").tobytes() + own.tobytes() + np.packbits(steps).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    low, n = np.frombuffer(data, "<i8", 2).tolist()
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :low] = np.frombuffer(data, np.uint8, n * low, 16).reshape(-1, low)
    steps = np.unpackbits(np.frombuffer(data, np.uint8, offset=16 + n * low))
    high = (np.flatnonzero(steps) - np.arange(n)).astype(np.uint64)
    return high << np.uint64(8 * low) | wide.view("<u8").ravel().astype(np.uint64)


def print_bits(shards: int) -> tuple[int, int, int]:
    """Bits of a shard's number, of the number of a print's part, and of the rest of the print; a key is (shard, rest)."""
    of_shard = (shards - 1).bit_length()
    of_part = max(0, of_shard - PART_BITS)
    return of_shard, of_part, min(SHARD_TOKENS.bit_length() + of_shard + SPARE_BITS - of_part, 64 - of_shard)


def prints_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return hashes >> np.uint64(64 - sum(print_bits(shards)[1:]))


def _cut(numbers: np.ndarray):
    """(number, from, to) of the equal ones in an ascending array."""
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if numbers.size else numbers
    return [(int(numbers[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], numbers.size])]


_TOLD = "host long, part long, shards long, keys binary, counts binary"
_TOTALS = "host long, part long, shard long, shards long, prints binary, totals binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema.split(", ")]
    kind = lambda c: pa.binary() if c.endswith("binary") else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, kind(x)) for c, x in zip(columns, schema.split(", "))], names=[x.split()[0] for x in schema.split(", ")])


def _told(host: int, shards: int, prints: np.ndarray, shard: np.ndarray) -> list[tuple]:
    """Rows of a host's prints, one for each page that has it: their keys, and how many pages, told where it is more than one."""
    of_shard, of_part, rest = print_bits(shards)
    part = (prints >> np.uint64(rest)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    keys = (shard.astype(np.uint64) << np.uint64(rest) | prints & np.uint64((1 << rest) - 1))[order]
    rows = []
    for number, a, b in _cut(part[order]):
        own, n = np.unique(keys[a:b], return_counts=True)
        rows.append((host, number, shards, packed(own, of_shard + rest), np.packbits(n > 1).tobytes() + n[n > 1].astype("<u4").tobytes()))
    return rows


def _prints(batches):
    """The runs of the pages of large hosts, by host and part."""
    held: dict[tuple, list] = {}
    n = 0
    for batch in batches:
        for at, pages in text_runs(batch, 4, READ_BYTES):
            kind_of, size_of, words = _tokens(pages)
            inside = [int(size[kind == INSIDE].sum()) for kind, size in zip(kind_of, size_of)]
            segments = np.repeat(np.arange(2 * len(pages)), [k for size, a in zip(size_of, inside) for k in (a, int(size.sum()) - a)])
            starts = run_starts(segments, MIN_RUN)
            h, page = run_hashes(words & np.uint64((1 << 8 * TOKEN_BYTES) - 1), MIN_RUN)[starts], segments[starts] >> 1
            order = np.argsort(h, kind="stable")  # pages ascend beside equal runs
            h, page = h[order], page[order]
            fresh = np.ones(h.size, dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (page[1:] != page[:-1])
            h, page = h[fresh], page[fresh]
            n += h.size
            host, shard, shards = (batch.column(k).slice(at, len(pages)).to_numpy() for k in (1, 2, 3))
            order = np.argsort(host[page], kind="stable")
            for number, a, b in _cut(host[page][order]):
                mine = order[a:b]
                own = int(shards[page[mine[0]]])
                held.setdefault((number, own), []).append((prints_of(h[mine], own), shard[page[mine]].astype(np.uint32)))
            if n >= HELD_PRINTS:
                yield _table([row for key, own in held.items() for row in _told(*key, *map(np.concatenate, zip(*own)))], _TOLD)
                held, n = {}, 0
    if held:
        yield _table([row for key, own in held.items() for row in _told(*key, *map(np.concatenate, zip(*own)))], _TOLD)


def _totals(rows: pa.Table) -> pa.Table:
    """For each shard of a host the prints of one part that another shard has too, and on how many pages of the host they are."""
    host, part, shards = (rows.column(k)[0].as_py() for k in range(3))
    bits = np.uint64(print_bits(shards)[2])
    keys = [unpacked(x) for x in rows.column("keys").to_pylist()]
    counts = [np.ones(x.size, dtype=np.int64) for x in keys]
    for n, told in zip(counts, rows.column("counts").to_pylist()):
        n[np.unpackbits(np.frombuffer(told, np.uint8, (n.size + 7) // 8), count=n.size) > 0] = np.frombuffer(told, "<u4", offset=(n.size + 7) // 8)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    rest = keys & ((np.uint64(1) << bits) - np.uint64(1))
    runs, of = np.unique(rest, return_inverse=True)
    total = np.bincount(of, weights=counts, minlength=runs.size).astype(np.int64)  # sums are exact below 2^53
    keys, first = np.unique(keys, return_index=True)
    of = of[first]
    wanted = (total[of] >= MIN_PAGES) & (np.bincount(of, minlength=runs.size)[of] > 1)
    keys, of = keys[wanted], of[wanted]
    out = [(host, part, shard, shards, packed(runs[of[a:b]], int(bits)), total[of[a:b]].astype("<i8").tobytes()) for shard, a, b in _cut(keys >> bits)]
    return pa.Table.from_batches([_table(out, _TOTALS)])


_FOUND = "key string, gone array<int>, boilerplate_tokens long"


def _judge(rows: pa.Table, runs: pa.Table) -> pa.Table:
    """The blocks of each page that go, by number. ``runs``: the totals of the shard's runs, where the host has other shards."""
    shard = _Shard(rows)
    starts, counts = run_counts(shard.tokens, shard.segments, shard.pages, MIN_RUN)
    n_pages = rows.column("pages")[0].as_py() if rows.num_rows else None
    if runs.num_rows and starts.size:
        shards = runs.column("shards")[0].as_py()
        parts = sorted(zip(*(runs.column(name).to_pylist() for name in ("part", "prints", "totals"))))
        known = np.concatenate([np.uint64(k << print_bits(shards)[2]) | unpacked(x) for k, x, _ in parts])
        total = np.concatenate([np.frombuffer(x, "<i8") for _, _, x in parts])
        mine = prints_of(run_hashes(shard.tokens, MIN_RUN)[starts], shards)
        at = np.minimum(np.searchsorted(known, mine), known.size - 1)
        counts = np.maximum(counts, np.where(known[at] == mine, total[at], 0))
    n_pages = n_pages or len(shard.keys)
    cover = covered(shard.tokens.size, starts[counts >= MIN_PAGES], MIN_RUN)
    share = lambda hit: np.bincount(shard.owner, weights=hit, minlength=shard.size.size) / np.maximum(1, shard.size)
    gone = (shard.kind == PLAIN) & (share(cover) >= MIN_COVERED)
    if n_pages >= SHARE_PAGES:
        often = covered(shard.tokens.size, starts[counts >= max(MIN_PAGES, MIN_SHARE * n_pages)], MIN_RUN)
        gone |= (shard.kind == INSIDE) & (share(often) >= MIN_COVERED)
    lost: list[list[int]] = [[] for _ in shard.keys]
    for block in np.flatnonzero(gone):
        lost[shard.page_of[block]].append(int(shard.place[block]))
    by_page = np.bincount(shard.pages, weights=cover, minlength=len(shard.keys)).astype(np.int64)
    return pa.table({"key": pa.array(shard.keys, pa.string()), "gone": pa.array(lost, pa.list_(pa.int32())), "boilerplate_tokens": pa.array(by_page, pa.int64())})


def _read(batches):
    """The text of each page: its blocks that may be text, less those that go."""
    for batch in batches:
        texts = []
        for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found, lost = read_blocks(page), set(gone or ())
            texts.append("\n".join(text for k, ((_, text), kind) in enumerate(zip(found, kinds(found))) if kind != OTHER and k not in lost))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(4)], names=["page_id", "url", "text", "boilerplate_tokens"])


def judged(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_keyed`` pages, and (key, gone, boilerplate_tokens) of each different one."""
    own = _keyed(pages)
    size = F.sum(F.octet_length("html")) / (HTML_BYTES * SHARD_TOKENS)
    hosts = own.groupBy("host").agg(F.ceil(size).alias("shards"), F.count_distinct("key").alias("pages"), F.count(F.lit(1)).alias("rows"))
    hosts = stage(hosts, "hosts")
    repeats = hosts.where(F.col("rows") > F.col("pages")).limit(1).count() > 0
    rows = own.dropDuplicates(["key"]) if repeats else own
    # Only hosts of several shards need their numbers; at most as many as there are shards.
    large = small(hosts.where("shards > 1").drop("rows"), "large-hosts")
    rows = rows.join(large, "host", "left").withColumn("shard", F.pmod(F.xxhash64("key"), F.coalesce("shards", F.lit(1))).cast("long"))
    streams = rows.select("key", "host", "shard", "pages", "html").mapInArrow(_streams, _STREAM)
    # Pages of large hosts are read twice, as their streams would take more disk than that.
    told = rows.where("shards > 1").select("key", "host", "shard", "shards", "html").mapInArrow(_prints, _TOLD)
    totals = stage(told.groupBy("host", "part").applyInArrow(_totals, _TOTALS), "run-totals")
    return own, stage(streams.groupBy("host", "shard").cogroup(totals.groupBy("host", "shard")).applyInArrow(_judge, _FOUND), "judged")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and boilerplate_tokens of every row."""
    own, found = judged(pages)
    out = own.select("key", "page_id", "url", "html").join(small(found, "judged-pages"), "key", "left")
    return out.select("page_id", "url", "html", "gone", "boilerplate_tokens").mapInArrow(_read, "page_id long, url string, text string, boilerplate_tokens long")


@query("op2_host_suffix_array")
def op2_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "boilerplate_tokens")
