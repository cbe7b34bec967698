"""Every registered query against a plain Python version, on real and on edge-case tables."""

import json
from collections import Counter, defaultdict

import brute
import pytest
from conftest import EDGE_DOCS, SMALL
from pyspark.sql import functions as F

from tickloom import llm

Q = llm.QUERIES


@pytest.fixture(params=["small", "edge"])
def tables(request, edge_dir):
    return SMALL if request.param == "small" else edge_dir


def documents(spark, at):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]


def same(got, wanted):
    assert Counter(got) == Counter(wanted)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty_dir, name):
    rows = Q[name](spark, empty_dir).collect()
    assert len(rows) == (1 if name.startswith("op4_") else 0)  # op4 adds a conversation


def test_personal_data(spark, tables):
    found = Q["op1_semi_markov_pii"](spark, tables).collect()
    wanted = []
    for d, t, _ in documents(spark, tables):
        spans = brute.personal(t)
        n = Counter(k for k, _, _ in spans)
        wanted.append((d, n["email"], n["ip"], n["card"], n["phone"], brute.sha(brute.joined(spans))))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found], wanted)
    base = defaultdict(set)
    for d, t, _ in documents(spark, tables):
        base[d] |= {f"{k}:{a}:{b}" for k, a, b in brute.personal(t)}
    for r in found:
        assert base[r.doc_id] <= set(r.spans.split(",")) - {""}


def test_line_rules(spark, tables):
    found = Q["op5_line_rules"](spark, tables).collect()
    wanted = [(d, *brute.rule_counts(t).values()) for d, t, _ in documents(spark, tables)]
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found], wanted)
    assert not any(r.kept and r.base_failed for r in found)


def test_base_scores(spark, tables):
    docs = documents(spark, tables)
    found = Q["op6_maxent_lm"](spark, tables).collect()
    wanted = brute.base_scores([x[:2] for x in docs])
    key = lambda d, n, k, total, score: (d, n, k, total, round(score, 6))
    same(
        [(*key(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score), r.held_out) for r in found],
        [(*key(d, *w), brute.crc_of(d) % 7 == 2) for (d, _, _), w in zip(docs, wanted)],
    )
    assert all(r.score < 0 for r in found)


def test_mixing(spark, tables):
    docs = documents(spark, tables)
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(brute.WORD.findall(t or ""))
    target = brute.mix_targets(size)
    found = Q["op7_mix_weights"](spark, tables).collect()
    assert found == Q["op7_mix_weights"](spark, tables).collect()
    wanted = Counter((d, len(brute.WORD.findall(t or "")), size[s], round(target[s], 4)) for d, t, s in docs)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 4)) for r in found) == wanted
    for r in found:
        low = int(r.target / r.source_size) if r.source_size else 0
        assert r.taken in (low * r["size"], (low + 1) * r["size"]) and r.taken <= 2 * r["size"]


def test_token_codes(spark, tables):
    from tokenizers import Tokenizer

    from tickloom.llm.token_codes import tokenizer_path

    docs = sorted(((d, t or "") for d, t, _ in documents(spark, tables)))
    wanted = brute.token_rows(docs, Tokenizer.from_file(tokenizer_path()))
    found = Q["op8_token_codes"](spark, tables).collect()
    same([tuple(r) for r in found], wanted)


def test_near_duplicates(spark, tables):
    docs = sorted(documents(spark, tables), key=lambda x: x[0])
    fps = [brute.fingerprint(t) for _, t, _ in docs]
    roots = brute.classes(fps)
    found = Q["op10_simhash_pigeonhole"](spark, tables).collect()
    same([tuple(r) for r in found], [(d, f"{fp:016x}", docs[root][0]) for (d, _, _), fp, root in zip(docs, fps, roots)])


def test_chat(spark, tables):
    from tickloom.llm.chat_format import TRAP

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)]
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        by_conv[c].append((-1 if turn is None else turn, role or "", text or ""))
    wanted = []
    for c, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        wanted.append((c, len(turns), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), brute.sha(loss)))
    found = Q["op4_chat_format"](spark, tables).collect()
    same([(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found], wanted)


def test_quality_scores_hold_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    found = Q["op3_factorisation_machine"](spark, at).withColumn("id", F.col("doc_id")).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    assert all(r.held_out == (brute.crc_of(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in found)
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_quality_scores_on_edges(spark, edge_dir):
    found = Q["op3_factorisation_machine"](spark, edge_dir).collect()
    assert len(found) == len(EDGE_DOCS) and all(0 <= r.score <= 1 for r in found)


def test_pages_on_edges(spark, edge_dir):
    found = Q["op2_host_suffix_array"](spark, edge_dir).collect()
    assert len(found) == spark.read.parquet(f"{edge_dir}/pages.parquet").count()
    assert all(r.text is not None and r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id is None] == [""]


def test_decontamination_on_edges(spark, edge_dir):
    assert Q["op9_template_decontamination"](spark, edge_dir).count() == 0


def test_decontamination_finds_every_whole_item(spark):
    """Documents that hold an item's words in a row, found by plain search, and no others."""
    items = [(r.item_id, " ".join(r.text.lower().split())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [(d, " ".join((t or "").lower().split())) for d, t, _ in documents(spark, "/root/testdata/sf0.01")]
    wanted = {(d, i) for d, t in docs for i, x in items if x in t}
    at = "/root/testdata/sf0.01"
    found = Q["op9_template_decontamination"](spark, at).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted and wanted
    assert all(r.covered > 0.9 and r.same_slots for r in found)


def test_oracles_name_the_same_columns(spark):
    for name in llm.ORACLES:
        assert Q[name](spark, SMALL).columns == Q[name](spark, SMALL).columns
    json.dumps(llm.ORACLES)
