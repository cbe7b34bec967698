"""The methods themselves, on small cases."""

import itertools
import math
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import DOC_SCHEMA
from pyspark.sql import functions as F

from tickloom.llm import chat_format, common, decontaminate, html_extract, maxent_lm, pii, quality_fm, quality_rules, simhash, token_codes


# --- near-duplicates ---------------------------------------------------------------------------


def test_thresholds_sum_and_find_every_close_pair():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 62, 200, dtype=np.int64)
    x[100:] = x[:100] ^ np.array([sum(1 << b for b in rng.choice(63, 3, replace=False)) for _ in range(100)])
    groups = [list(range(k * 16, k * 16 + 16)) for k in range(4)]
    values = simhash.part_values(x, groups)
    masks = simhash._masks(16, 3)
    counts = [np.bincount(values[:, i], minlength=1 << 16) for i in range(4)]
    shares = simhash.allocate(values, [simhash._within(c, 3) for c in counts], masks)
    assert (shares.sum(axis=1) == 4).all() and (shares >= 0).all()
    for a in range(100):
        differ = np.bitwise_count((values[a] ^ values[a + 100]).astype(np.uint64))
        assert (differ < shares[a]).any()  # some probed part meets its threshold


def test_counts_within_a_distance():
    counts = np.zeros(1 << 6, dtype=np.int64)
    counts[[0, 1, 3, 7, 7, 63]] += 1
    within = simhash._within(counts, 3)
    for v in range(64):
        for d in range(4):
            assert within[d][v] == sum(counts[u] for u in range(64) if (u ^ v).bit_count() <= d)


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_links_against_all_pairs(spark, monkeypatch, tile):
    """Many close fingerprints around one value, with tiles far smaller than the group."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "GROUP_ROWS", 500)
    rng = np.random.default_rng(5)
    near = [int(0x5555_5555_5555_5555) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in (1, 2, 3, 4, 6) for _ in range(60)]
    fps = sorted({*near, *map(int, rng.integers(0, 1 << 62, 300)), 0, 7, 0x7F})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in common.components(simhash.links(table)).collect()}
    wanted = brute.classes(fps)
    assert {f: roots.get(f, f) for f in fps} == {f: fps[w] for f, w in zip(fps, wanted)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


# --- token codes -------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 1 << 40])
def test_codes_give_any_id_back(top):
    rng = np.random.default_rng(top)
    ids = np.concatenate([rng.integers(0, top, 1000), [0, top]]).astype(np.uint64)
    levels = token_codes.encode_levels(ids)
    assert len(levels) == max(1, -(-top.bit_length() // 8))
    assert (token_codes.access(levels, np.arange(ids.size)) == ids).all()
    assert (token_codes.decode(levels) == ids).all()
    for at in (0, 63, 64, 500, 1001):
        assert token_codes.access(levels, np.array([at]))[0] == ids[at]
    for start, stop in ((0, 1002), (0, 0), (5, 6), (63, 65), (64, 128), (7, 900), (960, 1002), (1001, 1002), (1002, 1002)):
        assert (token_codes.access_range(levels, start, stop) == ids[start:stop]).all()


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    path = token_codes.tokenizer_path()
    plain, own = Tokenizer.from_file(path), token_codes.Encoder(path)
    texts = ["", " ", "a", " a b", "a  b", "a\n b", "it's 'll x", "é ü x y", "x <|endoftext|> y", "tail ", "\ta b\n", "don't.\nYes 12,3 %%%  !", "a.b,c. d, e", "a ... b", "x., y", "_. z", ".a", "3.14,15.\n,b", "e\u0301. f", "a.'s b,'t", "a\x00. b", "\n.a", "\nA b.\nC", "．。a. b"]
    texts += ["a \nb", "a\n\nb", "a\n\n\nb", "a  \n b", "a\tb", "a \tb", "a\t b", "a\u00a0 b", "a \n", " \n a", "  a", ". a", "a .b"]
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in own.encode(texts)] == wanted
    for t, ids in zip(texts * 2, wanted * 2):
        assert np.frombuffer(own.encode([t])[0], dtype="<u4").tolist() == ids, t
    assert own.encode([]) == []


def test_encoder_with_a_small_table():
    from tokenizers import Tokenizer

    path = token_codes.tokenizer_path()
    plain, own = Tokenizer.from_file(path), token_codes.Encoder(path, table_bytes=3 * token_codes.ENTRY_BYTES)
    for t in ("one two three four five", "six two seven", "one two"):
        assert np.frombuffer(own.encode([t])[0], dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_pieces_met_again_stay_in_a_full_table():
    from tokenizers import Tokenizer

    path = token_codes.tokenizer_path()
    plain, own = Tokenizer.from_file(path), token_codes.Encoder(path, table_bytes=40 * token_codes.ENTRY_BYTES)
    learned, learn = [], own._learn
    own._learn = lambda pieces: learned.extend(pieces) or learn(pieces)
    for k in range(60):
        text = "often " + " ".join(f"w{k}x{j}" for j in range(10)) + " often"
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 60
    assert token_codes.STAGE_TABLE_BYTES < 40 << 20
    assert learned.count("often") == 1
    assert len(learned) == len(set(learned))


_GROWTH = """
import re, sys
from tickloom.llm import common, token_codes

def held():
    return 1024 * sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))

make = lambda: token_codes.Encoder(token_codes.tokenizer_path())
common.worker_table("a", make).encode(["a few words, to begin with"])
start = held()
for k in range(60):
    common.worker_table("a", make).encode([" ".join(f"w{k}x{j}" for j in range(5000))])
full = held()
common.worker_table("b", dict)
print(full - start, start - held())
"""


def test_a_worker_holds_little_and_gives_it_back():
    """300,000 pieces take under 100 bytes each, and a worker that goes on to another operator has less than before them."""
    out = subprocess.run([sys.executable, "-c", _GROWTH], cwd=Path(token_codes.__file__).parents[2], capture_output=True, text=True, check=True).stdout
    grown, freed = map(int, out.split()[-2:])
    assert grown < 300_000 * 100
    assert freed > 0


def test_groups_and_parts_change_nothing(monkeypatch):
    from tokenizers import Tokenizer

    path = token_codes.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = ["", "one two. Three, four", "a  b", "é ü. x", "two one\nfour", "x <|endoftext|> y", "x., y", " tail "] * 9
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    rows = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    batches = [rows.slice(0, 5), rows.slice(5, 0), rows.slice(5, 40), rows.slice(45)]
    for part, group, learn in ((1, 1, 1), (20, 70, 2), (1 << 20, 1 << 20, 200)):
        monkeypatch.setattr(token_codes, "PART_BYTES", part)
        monkeypatch.setattr(token_codes, "GROUP_BYTES", group)
        monkeypatch.setattr(token_codes, "LEARN_PIECES", learn)
        for table_bytes in (0, 300, 1 << 20):
            own = token_codes.Encoder(path, table_bytes)
            for _ in range(2):
                found = list(token_codes._encoded(iter(batches), own))
                assert [(d, x.tolist()) for d, x in found] == list(enumerate(wanted))
            own.between = None
            assert [x.tolist() for x in own.encode(texts)] == wanted


# --- personal data -----------------------------------------------------------------------------


def _segmentations(island, kinds, i=0):
    """All paths as lists of (segment, type)."""
    if i == len(island.tokens):
        yield []
        return
    for rest in _segmentations(island, kinds, i + 1):
        yield rest
    for k, (a, b) in enumerate(zip(island.from_, island.to)):
        if a == i:
            for t in range(kinds):
                for rest in _segmentations(island, kinds, b):
                    yield [(k, t), *rest]


def test_semi_markov_sums_over_all_segmentations():
    rng = np.random.default_rng(2)
    crf = pii.SemiMarkov()
    crf.w = rng.normal(0, 0.3, crf.w.shape)
    island = pii.Island(" a1.2@b ", 1, 7)
    scores = crf.scores(island)
    paths = list(_segmentations(island, len(pii.KINDS)))
    weigh = [math.exp(sum(scores[k, t] for k, t in p)) for p in paths]
    total, posterior = crf.sums(island, scores)
    assert math.isclose(total, math.log(sum(weigh)), rel_tol=1e-9)
    for k, t in itertools.product(range(len(island.span)), range(len(pii.KINDS))):
        assert math.isclose(posterior[k, t], sum(w for p, w in zip(paths, weigh) if (k, t) in p) / sum(weigh), abs_tol=1e-9)
    best = max(paths, key=lambda p: sum(scores[k, t] for k, t in p))
    assert math.isclose(sum(scores[k, t] for k, t in crf.best(island, scores)), sum(scores[k, t] for k, t in best))


def test_semi_markov_learns_the_base_and_leaves_other_numbers_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    crf = pii.fit(docs)
    text = "write to qq.17@mail3.example.com or 10.20.30.40 today, 4111111111111111 too, call +1 (555) 555-0123 now. Version 2.0 of 1999."
    hits = []
    for a, b in pii.islands(text):
        island = pii.Island(text, a, b)
        if island.found:
            hits += [(pii.KINDS[t], *island.span[k]) for k, t in crf.best(island, crf.scores(island))]
    assert set(hits) == set(brute.personal(text))
    assert crf.added(text, pii.base_spans(text)) == []
    for clean in ("Version 2.0 of 1999, page 12.", "host 10.20.30.999", "id 12345678901 and key=a9f8b7c6", "4111-1111-1111-1112", "a@b"):
        assert crf.added(clean, pii.base_spans(clean)) == []
    told = "call (988) 555-2485 now"
    assert crf.added(told, []) == [("phone", 5, 19)]


def _phone_model():
    """A model that knows one shape of phones, and nothing else."""
    crf = pii.SemiMarkov()
    kind = pii.KINDS.index("phone")
    crf.w[kind, pii._crc("bias")] = -20
    crf.w[kind, pii._crc("shape", "(9)_9-9")] = 40
    return crf


def test_every_phone_of_a_long_list_is_added():
    phones = [f"(555) {200 + k}-{4000 + k}" for k in range(300)]
    text = "numbers: " + ", ".join(phones) + " end"
    assert len(pii.islands(text)) == 1
    got = _phone_model().added(text, pii.base_spans(text))
    assert [text[a:b] for _, a, b in got] == phones
    taken = [("phone", text.index(phones[7]), text.index(phones[7]) + 5), ("ip", text.index(phones[7]) + 2, text.index(phones[9]))]
    assert [text[a:b] for _, a, b in _phone_model().added(text, taken)] == phones[:7] + phones[9:]


def test_copies_take_one_place_among_the_examples(spark):
    copies = [(k, "in 1999, write to a@b.cc now") for k in range(300)]
    others = [(1000 + k, f"page {k} for x{k}@y.zz now") for k in range(10)]
    rows = pii.examples(spark.createDataFrame(copies + others, "doc_id long, text string"), 16).collect()
    assert len(rows) == 16 == len({(r.text, *r.kinds, *r.starts, *r.ends) for r in rows})
    assert sum(bool(r.kinds) for r in rows) == 8


def test_base_patterns_on_hostile_texts():
    for t in ["a" * 300_000, "1" * 300_000, "a@" * 50_000, "+1" + "(" * 100_000, "1." * 100_000, "@" * 100_000]:
        pii.base_spans(t)
        pii.islands(t)
    for t in ["a@b.c@d.e", "x@y@z.w", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "0001.2.3.4", "99.1.1.256", "a..b@c.d.", "+1 234 567 89)", "-4111 1111 1111 1111-"]:
        assert pii.base_spans(t) == brute.personal(t), t


# --- pages -------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp;three<br>four<p>Five&#33;<ul><li>x<li>y</ul>
<aside>aside</aside><form><p>form</p></form><div id="comments"><p>first!</p></div><blockquote>six
 seven</blockquote></article><footer>&copy; me</footer></body></html>"""


def page_text(page):
    return "\n".join(t for zone, t in html_extract.read_blocks(page) if zone == "article")


def test_article_blocks():
    assert page_text(PAGE) == "A & B\nOne two three four\nFive!\nx\ny\nsix seven"
    assert page_text("<article><p>a<p>b <i>c") == "a\nb c"
    assert page_text('<article><p title="a>b">x</p><p data-x="unpaired>y</p>') == "x\ny"
    assert page_text("<body><article>a<div class=share>no</div>b</article>") == "a\nb"
    assert page_text("") == ""


def test_suffix_array_marks_what_pages_repeat():
    rng = np.random.default_rng(9)
    boiler = list(range(1000, 1012))
    tokens, pages = [], []
    for page in range(6):
        own = [*rng.integers(0, 900, 30).tolist(), *boiler, *rng.integers(0, 900, 25).tolist()]
        tokens += own
        pages += [page] * len(own)
    got = html_extract.repeated(np.array(tokens, dtype=np.uint64), np.array(pages), 8, 3)
    wanted = set()
    seen = {}
    for k in range(len(tokens) - 7):
        if pages[k] == pages[k + 7]:
            seen.setdefault(tuple(tokens[k : k + 8]), []).append(k)
    for at in seen.values():
        if len({pages[k] for k in at}) >= 3:
            wanted |= {k + j for k in at for j in range(8)}
    assert set(np.flatnonzero(got).tolist()) == wanted and len(wanted) >= 6 * 12


def test_ranks_are_places_among_different_keys():
    rng = np.random.default_rng(4)
    for keys in (rng.integers(0, 50, 400), rng.integers(1 << 57, 1 << 62, 400).repeat(2), np.array([7, 7, 7]), np.array([3])):
        keys = rng.permutation(keys).astype(np.uint64)
        assert (html_extract.ranks(keys) == np.unique(keys, return_inverse=True)[1]).all()


def test_suffix_array_takes_few_sorts():
    """Less CPU than five sorts by two keys of the array's own size; it took ten."""
    tokens = np.random.default_rng(2).integers(0, 1 << 14, 300_000).astype(np.uint64) * np.uint64(1000)
    pages = np.arange(tokens.size) // 500

    def cpu(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert cpu(lambda: html_extract.run_counts(tokens, pages, pages, 8)) < 5 * cpu(lambda: np.lexsort((pages, tokens)))


def test_words_are_hashed_side_by_side(monkeypatch):
    """Every word by all of its bytes, whatever stands beside it; only very long ones are hashed one by one."""
    long = "x" * 70
    words = ["a", "a\0", "é", "\n", "sevenxx", "eightxxx", "eightxxy", "ninexxxxx", "ninexxxxy", "w" * 16, "w" * 64, "w" * 63 + "v", "w" * 65, long, long + "y"]
    words += [f"word{k}" for k in range(5_000)] + ["🙂" * k for k in range(1, 20)]
    alone = [html_extract.word_hashes(f"{w} ".encode())[0] for w in words]
    assert len(set(alone)) == len(words)
    order = np.random.default_rng(5).integers(0, len(words), 20_000)
    got = html_extract.word_hashes("".join(words[k] + " " for k in order).encode())
    assert (got == np.array(alone, dtype=np.uint64)[order]).all()
    assert html_extract.word_hashes(b"").size == 0
    assert len({int(h) & 0xFFFFFF for h in alone}) >= len(words) - 8  # the bytes that travel

    singly = []
    digest = html_extract.xxhash.xxh64_intdigest
    monkeypatch.setattr(html_extract.xxhash, "xxh64_intdigest", lambda w: singly.append(w) or digest(w))
    pages = [f"<body><p>{' '.join(words[4:12])}</p>{'<p>one two</p>' * 50}<article>é {long}</article></body>", "", "<p>one</p>"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), *[pa.array([1, 1, 1])] * 3, pa.array(pages)], names=["key", "host", "shard", "pages", "html"])
    whole = pa.Table.from_batches(html_extract._streams(iter([batch]))).to_pylist()
    assert singly == [long.encode()]
    tokens = [r["tokens"] for r in whole]
    assert [len(t) // html_extract.TOKEN_BYTES for t in tokens] == [3 + 9 + 50 * 3, 0, 2]
    assert tokens[2] == tokens[0][12 * 3 : 13 * 3] + tokens[0][14 * 3 : 15 * 3]  # "one" and a block's end
    monkeypatch.setattr(html_extract, "READ_BYTES", 1)
    assert pa.Table.from_batches(html_extract._streams(iter([batch]))).to_pylist() == whole


def test_pages_without_an_article_lose_what_the_host_repeats(spark):
    rng = np.random.default_rng(1)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 40)) for _ in range(8)]
    shared = "this very long line stands on every page of this one host always"
    rows = [(k, f"https://h.example/{k}", f"<body><div>{shared}</div><p>{t}</p><div>{shared}</div></body>") for k, t in enumerate(own)]
    rows += [(99, "https://other.example/", f"<body><div>{shared}</div><p>alone</p></body>"), (100, None, None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict(enumerate(own)), 99: f"{shared}\nalone", 100: ""}


def test_repeats_are_counted_over_the_whole_host(spark, monkeypatch):
    """A line on 3 of 300 pages is boilerplate (with the block ends around it), whether the host is one shard or many."""
    rng = np.random.default_rng(6)
    shared = "this line stands on three pages of three hundred and nowhere else"
    own = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 30)) for _ in range(300)]
    rows = [(k, f"https://h.example/{k}", f"<body><p>{t}</p>" + f"<p>{shared}</p>" * (k % 100 == 7) + "</body>") for k, t in enumerate(own)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for tokens in (html_extract.SHARD_TOKENS, 500):
        monkeypatch.setattr(html_extract, "SHARD_TOKENS", tokens)
        got = {r.page_id: (r.text, r.boilerplate_tokens) for r in html_extract.extract(pages).collect()}
        assert got == {k: (t, 14 * (k % 100 == 7)) for k, t in enumerate(own)}


def test_rare_runs_inside_articles_are_counted_over_the_whole_host(spark, monkeypatch):
    """Three of 300 pages share a sentence inside articles, and a line that is plain on one of three pages."""
    rng = np.random.default_rng(8)
    sentence = "three articles of this host share one sentence and no other page has it"
    line = "one plain page and two articles of this host have this line in common"
    rows, texts = [], {}
    for k in range(300):
        own = " ".join(f"w{x}" for x in rng.integers(0, 100_000, 30))
        if k == 5:
            rows.append((k, "https://h.example/5", f"<body><p>{own}</p><p>{line}</p></body>"))
            texts[k] = own
        else:
            held = [own] + [sentence] * (k % 100 == 7) + [line] * (k in (90, 210))
            rows.append((k, f"https://h.example/{k}", "<article>" + "".join(f"<p>{t}</p>" for t in held) + "</article>"))
            texts[k] = "\n".join(held)
    wanted = {k: (t, 16 * (k % 100 == 7) + 16 * (k in (5, 90, 210))) for k, t in texts.items()}  # a block's end before it and its own
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for tokens in (html_extract.SHARD_TOKENS, 500):
        monkeypatch.setattr(html_extract, "SHARD_TOKENS", tokens)
        got = {r.page_id: (r.text, r.boilerplate_tokens) for r in html_extract.extract(pages).collect()}
        assert got == wanted


def test_totals_of_runs_come_back_to_the_shards_that_have_them():
    """Prints of nine shards' pages, told by three tasks, against a plain count."""
    rng = np.random.default_rng(3)
    of_shard, of_part, rest = html_extract.print_bits(9)
    every = rng.integers(0, 1 << of_part + rest, 4_000).astype(np.uint64)
    pages = [(int(rng.integers(9)), rng.permutation(every)[: rng.integers(1, 400)]) for _ in range(60)]
    pages += [(0, every[:1]), (0, every[:1]), (0, every[:1]), (8, np.array([0, (1 << of_part + rest) - 1], dtype=np.uint64))]
    rows = []
    for k in range(3):
        prints, shard = np.concatenate([x for _, x in pages[k::3]]), np.concatenate([np.full(len(x), s) for s, x in pages[k::3]])
        rows += html_extract._told(4, 9, prints, shard)
    table = pa.Table.from_batches([html_extract._table(rows, html_extract._TOLD)])
    got = {}
    for part in range(1 << of_part):
        for r in html_extract._totals(table.filter(pa.array([x == part for x in table.column("part").to_pylist()]))).to_pylist():
            prints = html_extract.unpacked(r["prints"]) | np.uint64(part << rest)
            got |= {(r["shard"], x): n for x, n in zip(prints.tolist(), np.frombuffer(r["totals"], "<i8").tolist())}
    total, holders = Counter(x for _, own in pages for x in own.tolist()), {}
    for s, own in pages:
        for x in own.tolist():
            holders.setdefault(x, set()).add(s)
    wanted = {(s, x): n for x, n in total.items() for s in holders[x] if n >= 3 and len(holders[x]) > 1}
    assert got == wanted and len(got) > 1_000
    many = np.unique(rng.integers(0, 1 << 57, 1 << 18).astype(np.uint64))
    assert (html_extract.unpacked(html_extract.packed(many, 57)) == many).all() and len(html_extract.packed(many, 57)) < 5.5 * many.size
    assert html_extract.unpacked(html_extract.packed(many[:0], 57)).size == 0
    assert all(sum(html_extract.print_bits(1 << k)[::2]) <= 64 and sum(html_extract.print_bits(1 << k)[1:]) <= 64 for k in range(1, 24))


def plain_texts(pages):
    """Each page's text by the rules' wording, page by page and run by run."""
    import re

    by_host = {}
    for page_id, url, page in dict.fromkeys(pages):
        rest = re.sub("^.*?//", "", url or "", count=1)
        by_host.setdefault(re.match("[^/?#]*", rest)[0].rpartition("@")[2].lower(), []).append((page_id, url, page))
    texts = {}
    for own in by_host.values():
        blocks = [html_extract.read_blocks(page or "") for _, _, page in own]
        holders, streams = {}, []
        for k, found in enumerate(blocks):
            mine = []
            for inside in (True, False):
                words, owner = [], []
                for b, (zone, text) in enumerate(found):
                    if (zone == "article") == inside:
                        block = [*text.split(" "), "\n"]
                        words += block
                        owner += [b] * len(block)
                mine.append((words, owner))
                for j in range(len(words) - 7):
                    holders.setdefault(tuple(words[j : j + 8]), set()).add(k)
            streams.append(mine)
        for k, found in enumerate(blocks):
            named = any(zone == "article" for zone, _ in found)
            kept = []
            for words, owner in streams[k]:
                for b in dict.fromkeys(owner):
                    zone, text = found[b]
                    if zone == "article":
                        least = max(3, 0.5 * len(own)) if len(own) >= 10 else math.inf
                    elif zone == "plain" and not named:
                        least = 3
                    else:
                        continue
                    hit = set()
                    for j in range(len(words) - 7):
                        if len(holders[tuple(words[j : j + 8])]) >= least:
                            hit |= set(range(j, j + 8))
                    mine = [j for j, o in enumerate(owner) if o == b]
                    if len(hit & set(mine)) < 0.6 * len(mine):
                        kept.append((b, text))
            texts[own[k]] = "\n".join(t for _, t in sorted(kept))
    return texts


def made_pages(n=40):
    """Articles with an unmarked notice in most of them and a sentence that a third of them shares."""
    rng = np.random.default_rng(12)
    notice = "Support this paper and become a member for only two coins a month today"
    sentence = "The minister said on Monday that nothing at all would change before the summer"
    rows = []
    for k in range(n):
        own = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 25)) for _ in range(3)]
        inner = "".join(f"<p>{t}</p>" for t in [own[0], *[notice] * (k % 8 != 0), own[1], *[sentence] * (k % 3 == 0), own[2]])
        rows.append((k, f"https://paper.example/{k}", f"<body><div>Top of the page is the same on all pages here and there</div><article>{inner}</article></body>"))
    rows += [(100 + k, f"http://u@Small.example/{k}?a", f"<article><p>{notice}</p><p>own {k}</p></article>") for k in range(7)]
    rows += [(200 + k, f"small.example/{k}", f"<body><p>{notice}</p><p>words of page {k} that no other page of this host has at all</p></body>") for k in range(2)]
    return [*rows, rows[0], rows[0], (300, None, None), (301, None, "<p>x</p>" * 3)], notice, sentence


@pytest.mark.parametrize("tokens", [500_000, 400])
def test_what_half_of_a_host_repeats_goes_and_a_shared_sentence_stays(spark, monkeypatch, tokens):
    monkeypatch.setattr(html_extract, "SHARD_TOKENS", tokens)
    rows, notice, sentence = made_pages()
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    wanted = plain_texts(rows)
    assert sorted(r.page_id for r in got) == sorted(x[0] for x in rows)
    for r, page in ((r, next(x for x in rows if x[0] == r.page_id)) for r in got):
        assert r.text == wanted[page]
        if r.page_id < 100:
            assert notice not in r.text and (sentence in r.text) == (r.page_id % 3 == 0)
        elif r.page_id < 200:
            assert notice in r.text  # fewer than ten pages of the host


def test_no_article_sentence_of_the_given_pages_goes(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {page[0]: text for page, text in plain_texts(pages).items()}
    assert got == {d: page_text(page) for d, _, page in pages}


def test_long_pages_and_hosts_of_one_page(spark):
    long = "<article>" + "".join(f"<p>word{k} and so on to the end of line {k}</p>" for k in range(60_000)) + "</article>"
    rows = [(1, "https://one.example/", long), (2, "https://two.example/", "<p>alone</p>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: page_text(long), 2: "alone"} and len(got[1]) > 2_000_000


# --- chat --------------------------------------------------------------------------------------


def test_merged_turns_and_escapes_come_back(spark):
    texts = ["", "a", "\\", "\\\\", "<\\/s>", "</s>", "<|user|>", "<|+|>", "|>", "<", ">x", "a<", "[INST] [/INST]", "<<SYS>>", "<|", "x|", "line\n\n"]
    roles = ["system", "user", "user", "assistant", "assistant", "a|", "", "<|"]
    rows = [(c, k, roles[(c + k * k) % len(roles)], texts[(c * 3 + k) % len(texts)]) for c in range(40) for k in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(turns)
    out = out.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.learnt(F.col("formatted"), F.col("mask")).alias("loss"))
    blocks = {r.conv_id: len(r.blocks) for r in chat_format.conversations(turns).collect()}
    for r in out.collect():
        own = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        changes = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:]))
        assert blocks[r.conv_id] == changes == r.formatted.count("</s>")


def chat_seconds(spark, n):
    import time

    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k} says </s> é😀 {k}") for k in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).cache()
    turns.count()
    out = chat_format.format_chat(turns)
    begun = time.time()
    got = out.select(chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.learnt(F.col("formatted"), F.col("mask")).alias("loss")).first()
    took = time.time() - begun
    turns.unpersist()
    assert [(t.role, t.text) for t in got.turns] == [r[2:] for r in rows]
    assert got.loss == "".join(r[3] for r in rows if r[2] == "assistant")
    return took


def test_a_conversation_of_many_turns_takes_linear_time(spark):
    chat_seconds(spark, 1000)
    short, long = chat_seconds(spark, 8000), chat_seconds(spark, 16_000)
    assert long < 3 * short + 2


# --- language model ----------------------------------------------------------------------------


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 300}" for j in range(50))) for k in range(40)], "doc_id long, text string")
    counts = maxent_lm.word_counts(docs)
    words = maxent_lm.lexicon(counts)
    weights = maxent_lm.train(maxent_lm.marked(docs), words)
    n = len(words.mass)
    classes, members = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    context = [np.full(n * n, x, dtype=np.uint64) for x in (3, 5, 7)]
    assert math.isclose(np.exp(maxent_lm.log_prob(weights, context, classes, members)).sum(), 1, rel_tol=1e-5)
    # The shares of a group's words, and of one that was never seen, sum to one too.
    rest = np.ones((n, n))
    for r in counts.collect():
        a, b = words.groups(np.array([r.h], dtype=np.int64).view(np.uint64))
        rest[a[0], b[0]] += r.c + 1
    assert np.allclose(rest, words.mass)


def plain_read(docs):
    """Tokens and their places among the different ones, word by word."""
    tokens = []
    for text in docs:
        tokens += [*text.encode().lower().split(), b""]
    different = {w: k for k, w in enumerate(dict.fromkeys(tokens))}
    return tokens, [different[w] for w in tokens]


def test_language_model_reads_texts_as_word_by_word():
    docs = ["", " ", "One two ONE", "\n a\tb\x0b\x0cC\r", "x\x1cy\x85z\xa0É é", *[f"u{chr(k)}V" for k in range(1, 0x300)]]
    column = pa.array(["left out", *docs]).slice(1)
    words, hashes, own, stops = maxent_lm.read(column)
    tokens, places = plain_read(docs)
    assert [words[k].as_py() for k in own] == tokens and own.tolist() == places
    assert hashes.tolist() == [maxent_lm._hash(w.as_py()) for w in words]
    assert [tokens[k - 1] for k in stops] == [b""] * len(docs) and stops[-1] == len(tokens)
    runs = list(common.text_runs(pa.record_batch([column], names=["text"]), 0, 8))
    assert [x for _, run in runs for x in run.to_pylist()] == docs and len(runs) > 100
    assert [column[first].as_py() for first, _ in runs] == [run[0].as_py() for _, run in runs]


def test_language_model_counts_across_batches(monkeypatch):
    rng = np.random.default_rng(2)
    docs = [" ".join(f"W{k}" for k in rng.integers(0, 400, 30)) for _ in range(200)]
    batches = [pa.record_batch([pa.array(docs[k : k + 10])], names=["text"]) for k in range(0, 200, 10)]
    for most in (50, 300, 10**6):
        monkeypatch.setattr(maxent_lm, "_BATCH_WORDS", most)
        seen = Counter()
        for batch in maxent_lm._count_batches(batches):
            seen.update(dict(zip(*(c.to_pylist() for c in batch.columns))))
        assert seen == Counter(plain_read(docs)[0])
    assert not list(maxent_lm._count_batches([]))


def test_language_model_reads_texts_faster_than_word_by_word():
    docs = [" ".join(f"w{k * j % 5003}" for j in range(500)) for k in range(1, 401)]
    column = pa.array(docs)
    least = {}
    for _ in range(3):
        for name, act in (("own", lambda: maxent_lm.read(column)), ("plain", lambda: plain_read(docs))):
            begun = time.process_time()
            act()
            least[name] = min(least.get(name, math.inf), time.process_time() - begun)
    assert least["own"] < 0.8 * least["plain"]


def test_language_model_sums_gradients_by_row():
    rng = np.random.default_rng(5)
    for rows in (rng.integers(0, 50, 400), np.arange(400)[::-1].copy(), np.zeros(400, np.int64)):
        grad = rng.normal(size=(rows.size, 8)).astype(np.float32)
        for n_rows in (1 << 10, 1 << 20):
            at, total = maxent_lm._row_sums(grad, rows, n_rows)
            assert at.tolist() == sorted(set(rows.tolist()))
            for row, own in zip(at, total):
                assert np.allclose(own, grad[rows == row].sum(axis=0), atol=1e-5)


def test_language_model_sizes_follow_the_counts():
    grown = [maxent_lm.sizes(v, n) for v, n in ((10, 100), (10**4, 10**6), (4 * 10**5, 4 * 10**6), (10**7, 10**9), (10**9, 10**13))]
    assert grown == sorted(grown, key=lambda x: x[0]) and [c for c, _ in grown] == [4, 8, 16, 32, 64]
    assert [r for _, r in grown[:3]] == [1 << 10, 1 << 17, 1 << 16]
    assert all(8 * c * r <= maxent_lm.TABLE_BYTES for c, r in grown)


def plain_score(text, words, weights):
    """log10 of a text's probability, token by token, from the weights as they are."""
    tokens = [*text.encode().lower().split(), b""]
    n, rows = len(words.mass), words.rows
    hashes = [maxent_lm._hash(w) for w in tokens]
    mask = (1 << 64) - 1
    a, b, c, d = (int(x) for x in (maxent_lm._A, maxent_lm._B, maxent_lm._C, maxent_lm._D))
    counts = dict(zip(words.hashes.tolist(), words.counts.tolist()))
    total = 0.0
    for k, h in enumerate(hashes):
        one = hashes[k - 1] if k else c
        two = d if k == 0 else hashes[k - 2] if k > 1 else c
        features = [one * a & mask, (one * b & mask) ^ (two * c & mask), (two * d + a) & mask]
        features = [x ^ (x >> 29) for x in features]
        place = lambda f, salt, low: low + ((((f + salt * b) & mask) * a & mask) >> 32) % (rows - low)
        k_class, k_member = h % n, h // n % n
        x = weights.by_class[0] + sum(weights.by_class[place(f, 0, 1)] for f in features)
        y = weights.by_member[k_class] + sum(weights.by_member[place(f, k_class + 1, n)] for f in features)
        for z, at in ((x, k_class), (y, k_member)):
            z = z.astype(float)
            total += (z[at] - np.log(np.exp(z).sum())) / math.log(10)
        total += math.log10((counts.get(h, 0) + 1) / words.mass[k_class, k_member])
    return total


def test_scores_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    own = maxent_lm.marked(docs)
    counts = maxent_lm.word_counts(own.where("part <> 2"))
    words = maxent_lm.lexicon(counts)
    weights = maxent_lm.train(own.where("part <> 2"), words)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = maxent_lm.score(own, words, weights, counts).collect()
    assert len(got) == 60
    for r in got:
        assert math.isclose(r.score, plain_score(text[r.doc_id], words, weights), rel_tol=1e-4, abs_tol=1e-3)
    docs.unpersist()


def test_language_model_beats_the_base_on_held_out_documents(spark):
    found = maxent_lm.language_model_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = found.where(F.col("part") == 2).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_rare_words_by_join_score_as_frequent_ones(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    all_known = {r.doc_id: r for r in maxent_lm.language_model_scores(docs).collect()}
    monkeypatch.setattr(maxent_lm, "FREQUENT", 512)
    for r in maxent_lm.language_model_scores(docs).collect():
        assert r.n_known == all_known[r.doc_id].n_known
        assert math.isclose(r.base_score, all_known[r.doc_id].base_score, rel_tol=1e-9)


def test_language_model_grows_beyond_the_table_that_tasks_hold(spark, monkeypatch):
    """With a table of 8,192 rows of 65,536 wanted ones the rows of the last two words are dealt to tasks, and contexts are told apart again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(5))  # copies of a row have its score

    def gains():
        rows = maxent_lm.language_model_scores(docs).collect()
        assert len(rows) == 1_005
        by_id = {}
        for r in rows:
            assert math.isclose(r.score, by_id.setdefault((r.doc_id, r.n_tokens, r.base_score), r.score), rel_tol=1e-5)
        gain = lambda own: sum(r.score - r.base_score for r in own) / sum(r.n_tokens for r in own)
        return gain([r for r in rows if r.part != 2]), gain([r for r in rows if r.part == 2])

    monkeypatch.setattr(maxent_lm, "TABLE_BYTES", 1 << 19)
    monkeypatch.setattr(maxent_lm, "PART_TOKENS", 100_000)
    rows = maxent_lm.sizes(60_000, 350_000)[1]
    words = maxent_lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), 350_000, 60_000, np.ones((8, 8)), rows)
    assert words.parts == 4 and words.parts * words.part_rows == maxent_lm.wanted_rows(350_000) == 8 * rows
    dealt = gains()
    monkeypatch.setattr(maxent_lm, "wanted_rows", lambda n_tokens: rows)  # contexts share the table's rows
    shared = gains()
    assert dealt[0] > 1.2 * shared[0] and dealt[1] > shared[1]


def test_dealt_rows_give_probabilities_and_learn():
    """Over all groups of one context they sum to one; the group that training saw there is likelier than before."""
    n, per = 8, 400_000
    words = maxent_lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), per, 60_000, np.ones((n, n)), 1 << 10)
    weights = maxent_lm.Weights.fresh(words)
    context = lambda k, times: maxent_lm._bytes_of(np.full(times, k, dtype=np.uint64), maxent_lm.WORD_BITS // 8).tobytes()
    scored = np.arange(n * n)
    rows = []
    for chunk, (sizes, learn, target) in enumerate([([20], 1, np.full(20, 11)), ([1] * (n * n), 0, scored)]):
        steps = np.diff(np.arange(len(sizes)), prepend=0).astype("<u4").tobytes()
        rows.append((0, chunk, np.arange(len(sizes)).astype("<i8").tobytes(), steps, np.array(sizes, "<u4").tobytes(), bytes([learn]) * len(sizes), context(5, len(target)), context(9, len(target)), target.astype(np.uint8).tobytes(), bytes(len(target))))
    names = [x.split()[0] for x in maxent_lm._SENT.split(", ")]
    found = {}
    for own in (rows, rows[1:]):  # with the training text and without it
        back = maxent_lm.part_scores(pa.table([pa.array(x) for x in zip(*own)], names=names), words, weights)
        sums = maxent_lm._chunk_sums(back.slice(len(own) - 1)).to_pydict()
        assert sums["same"] == scored.tolist() and sums["n"] == [1] * (n * n)
        found[len(own)] = 10 ** np.array(sums["dealt"])
        assert math.isclose(found[len(own)].sum(), 1, rel_tol=1e-5)
    assert found[2][11] > 1.2 * found[1][11] and found[2].argmax() == 11


def test_common_contexts_are_dealt_to_many_tasks():
    rng = np.random.default_rng(7)
    pair = np.concatenate([np.full(50_000, 17), rng.integers(0, 1 << 60, 20_000).repeat(3)]).astype(np.uint64)
    deal = maxent_lm.deals(pair, rng.integers(-(1 << 60), 1 << 60, pair.size), 100)
    assert len(set(deal[:50_000].tolist())) == 100 and np.bincount(deal).max() < 2 * pair.size / 100
    assert (deal[50_000::3] == deal[50_001::3]).all() and (deal[50_000::3] == deal[50_002::3]).all()


# --- factorisation machine ---------------------------------------------------------------------


def test_factorisation_machine_equals_the_pair_sum():
    rng = np.random.default_rng(4)
    m = quality_fm.Machine()
    m.w, m.v, m.bias = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape), 0.3
    at, x = np.array([1, 5, 9, 77]), rng.normal(size=4)
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert math.isclose(m.raw(at, x), m.bias + m.w[at] @ x + pairs, rel_tol=1e-9)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * 50, None, None, 250) for k in range(40)], DOC_SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    known = labels.select("doc_id", F.col("quality").alias("label"))
    assert quality_fm._within(docs, known).count() == 40
    monkeypatch.setattr(quality_fm, "TRAIN_BYTES", 1000)
    order = [r.doc_id for r in known.orderBy(F.xxhash64("doc_id")).collect()]
    assert sorted(r.doc_id for r in quality_fm._within(docs, known).collect()) == sorted(order[:4])
    assert all(0 <= r.score <= 1 for r in quality_fm.score(docs, quality_fm.fit(docs, labels)).collect())


# --- decontamination ---------------------------------------------------------------------------


ITEM = "A train leaves Boston at 9 am and travels 120 km toward Chicago while Maria waits 45 minutes before she drives 60 miles. How far apart are they?"
OTHER = "A train leaves Denver at 7 am and travels 310 km toward Austin while Peter waits 20 minutes before she drives 85 miles. How far apart are they?"
LOOSE = "A train leaves Denver at 7 am and travels 310 km toward Austin while Peter waits 20 minutes"


def test_templates_catch_other_numbers_and_names(spark):
    rows = [
        (1, "Intro text here.\n" + ITEM + "\nMore text."),
        (2, OTHER),
        (3, "A train is a train and nothing else matters at all to anyone who waits here for long."),
        (4, None),
        (None, ITEM),
        (5, LOOSE),
    ]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC_SCHEMA)
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "9 9 9 9 9 9 9 9 9")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert set(got) == {1, 2, None} and {r.item_id for r in got.values()} == {10}
    assert got[1].same_slots and not got[2].same_slots and got[2].consistent == 1


def test_templates_catch_edits_and_slots_of_other_lengths(spark):
    words = ITEM.split()
    rows = [
        (1, " ".join([*words[:14], "quickly", *words[14:]])),
        (2, " ".join(words[:13] + words[14:])),
        (3, ITEM.replace("Maria", "Mary Ann Jones").replace("45", "twenty five").replace("120 km", "85km").replace("9", "twenty-one")),
        (4, " ".join([*words[:14], *["and", "so", "on"] * 5, *words[14:]])),
        (5, " ".join(words[14:] + words[:14])),
        (6, ITEM + "\n" + " ".join(f"w{k}" for k in range(50)) + "\n" + " ".join(words[:13] + words[14:])),
    ]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC_SCHEMA)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame([(10, ITEM)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 6}  # 4: two halves far apart, 5: halves in the other order
    assert got[1].covered == 1 and got[1].same_slots and not got[3].same_slots
    assert [got[k].n_places for k in (1, 2, 3, 6)] == [1, 1, 1, 2]


def test_inconsistent_slots_are_no_copy(spark):
    item = "Add 5 to the first box then take 5 from the second box and put 5 into the third box then say 5 out loud now"
    mixed = "Add 1 to the first box then take 2 from the second box and put 3 into the third box then say 4 out loud now"
    steady = "Add 8 to the first box then take 8 from the second box and put 8 into the third box then say 8 out loud now"
    docs = spark.createDataFrame([(1, mixed, None, None, None), (2, steady, None, None, None)], DOC_SCHEMA)
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [2]


SUMS = "12 + 7 = 19 and 30 + 4 = 34"


def test_items_of_placeholders_are_found_word_by_word(spark):
    rows = [
        (1, f"Before it says something.\n{SUMS}\nand so on"),
        (2, "12 + 8 = 20 and 30 + 4 = 34"),
        (3, "1 2 3 and 4 5 6"),
        (4, SUMS.replace("and", "or")),
        (5, f"{SUMS}. Again: {SUMS}"),
    ]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC_SCHEMA)
    numbers = " ".join(f"{k} Maria {k + 1} km" for k in range(30))  # placeholders alone, longer than a window
    items = spark.createDataFrame([(1, SUMS), (2, "12"), (3, numbers), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(docs, items).collect()}
    assert set(got) == {(1, 1), (5, 1)} and got[1, 1].same_slots and got[5, 1].n_places == 2
    held = [(7, "x " + numbers + " y", None, None, None), (8, numbers.replace("7 Maria", "7 Anna"), None, None, None)]
    found = decontaminate.contamination(spark.createDataFrame(held, DOC_SCHEMA), items).collect()
    assert [(r.doc_id, r.item_id, r.covered) for r in found] == [(7, 3, 1.0)]


def test_a_small_table_of_words_reads_alike():
    text = ITEM + "\n" + OTHER + " 1 2 3 John Smith"
    whole, few = decontaminate.Templates(), decontaminate.Templates(most=8)
    for _ in range(3):
        for part in (text, OTHER, ITEM):
            a, b = whole.read(part), few.read(part)
            assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


ODD_WORDS = """a I A The THE the, "The end." end." wow!" why?" Maria Maria's O'Neil NASA iPhone Éclair éclair ÉCLAIR straße ŒUVRE
    12 +12 -12 $12 12$ 12% 3.5 1,000 5km 5Km 85kg. 7€ £7 +-+ -- - ... ! !a a! -a a- _a_ $a a$ %% % $ € km KM Km, (km) twenty Twenty
    twenty-one Twenty-One. twenty-dog Hundred, \x00 \x01num \x01 x\x00 \x7fa a\x7f :a: A: a. a.b A.b x\u0301 中文 中文. №5 ²""".split()


def test_words_are_told_at_once_as_one_by_one():
    words = ODD_WORDS + [f"{a}{w}{b}" for w in ODD_WORDS for a in ("", "(", '"', "+", "€") for b in ("", ".", '?"', "%", "-", "\u201d")]
    kind, own, ends, token = decontaminate.canonical_all(pa.array(words))
    for k, word in enumerate(words):
        told = decontaminate.canonical(word, False)
        assert kind[k] == decontaminate._KINDS.get(told[0], 0) and bool(ends[k]) == told[2] and bool(token[k]) == (told[0] != "")
        if kind[k] in (0, 4):
            assert int(own[k]) == decontaminate.xxhash.xxh64_intdigest(told[1], 7)


def test_texts_read_together_as_alone():
    rng = np.random.default_rng(8)
    gaps = [" ", "  ", "\n", "\t", "\xa0", "\u2028", "\x1c"]
    texts = ["", " ", "\n", *["".join(w + gaps[rng.integers(len(gaps))] for w in rng.choice(ODD_WORDS, 40)) for _ in range(60)]]
    texts += [ITEM, "John", "Smith 12", "km 7", "- km 7", "5", "( £ 9", OTHER + " ", "twenty", ""]
    for most in (8, 10**6):
        alone, together = decontaminate.Templates(most), decontaminate.Templates(most)
        for _ in range(2):
            hashes, literal, stops, word = together.read_all(pa.array(["left out", *texts]).slice(1))
            first = 0
            for text, stop in zip(texts, stops.tolist()):
                h, lit, one = alone.read(text)
                assert h.tolist() == hashes[first:stop].tolist() and lit.tolist() == literal[first:stop].tolist()
                assert [one(k) for k in range(h.size)] == [word(k) for k in range(first, stop)]
                first = stop
            assert first == hashes.size


def test_windows_stay_in_their_text():
    words = ITEM.split()
    every = np.full(decontaminate.BITMAP_BITS // 8, 255, np.uint8)
    texts = pa.array(["", " ".join(words[:9]), " ".join(words[9:12]), None, " ".join(words[12:])]).fill_null("")
    rows = list(decontaminate._rows([1, 2, 3, 4, 5], [0] * 5, texts, [4, 8], decontaminate.Templates().read_all, [every, None]))
    own = [r for k in range(5) for r in decontaminate._rows([k + 1], [0], texts.slice(k, 1), [4, 8], decontaminate.Templates().read_all, [every, None])]
    assert {str(r) for r in rows} == {str(r) for r in own} and len(rows) == len(own)
    assert {r[0] for r in rows} == {2, 5} and all(r[3] + r[4] <= r[5] for r in rows)


def test_words_are_told_at_once_faster_than_one_by_one():
    words = [x for k in range(20_000) for x in (f"{k:b}".replace("0", "a").replace("1", "b"), f"N{k:b},".replace("0", "a").replace("1", "b"))]
    column = pa.array(words)
    least = {}
    for _ in range(3):
        for name, act in (("own", lambda: decontaminate.canonical_all(column)), ("plain", lambda: [decontaminate.xxhash.xxh64_intdigest(decontaminate.canonical(w, False)[1], 7) for w in words])):
            begun = time.process_time()
            act()
            least[name] = min(least.get(name, math.inf), time.process_time() - begun)
    assert least["own"] < 0.8 * least["plain"]


# --- line rules --------------------------------------------------------------------------------


def test_a_phrase_in_a_long_line_is_no_boilerplate(spark):
    long = "The committee read the privacy policy of the firm for a whole afternoon and found in the end that all of its many pages said nothing at all"
    rows = spark.createDataFrame([(x,) for x in (long, "Read our privacy policy here")], "x string").select(F.explode(quality_rules._lines(F.col("x"))).alias("l"))
    assert [r.fails for r in rows.select(quality_rules.line_fails(F.col("l")).alias("fails")).collect()] == [False, True]


def test_lines_that_fail(spark):
    bad = ["Home | News | Sport | Weather | More", "WOW!!! BUY!!! NOW!!!", "this&&& is*** bad$$$", "All rights reserved.", "go go go go go"]
    good = ["A plain line, with a stop.", "Prices rose 5% | a note", "", "Don't panic!"]
    rows = spark.createDataFrame([(x,) for x in bad + good], "x string").select(F.explode(quality_rules._lines(F.col("x"))).alias("l")).select("l.line", quality_rules.line_fails(F.col("l")).alias("fails")).collect()
    assert {r.line for r in rows if r.fails} == set(bad)
