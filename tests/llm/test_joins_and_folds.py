"""The set join, the filter audit and the prefix trie against plain Python, on real and hard tables."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import DOC_SCHEMA, SMALL
from pyspark.sql import functions as F

from tickloom import llm
from tickloom.llm import chosen_path, common, filter_audit, prefix_trie

Q = llm.QUERIES
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(params=["small", "edge"])
def tables(request, edge_dir):
    return SMALL if request.param == "small" else edge_dir


def rows_of(spark, at, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{at}/{name}.parquet").select(*columns).collect()]


# --- chosen paths ------------------------------------------------------------------------------


def classes(spark, docs):
    table = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOC_SCHEMA)
    return Counter(map(tuple, chosen_path.near_duplicates(table).collect()))


def test_set_join(spark, tables):
    docs = rows_of(spark, tables, "documents", "doc_id", "text")
    wanted = Counter((d, n, c, d is not None and d == c) for (d, _), (n, c) in zip(docs, brute.shingle_classes(docs)))
    found = Q["op11_chosen_path"](spark, tables)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, found.collect())) == wanted


def near_copies(seed, groups, size, length=120):
    """Texts around random ones, some just at the threshold: words of each changed, cut or put in."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(groups):
        first = [word() for _ in range(length)]
        for _ in range(size):
            own = list(first)
            for _ in range(rng.randrange(0, 12)):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out, 5))


def test_set_join_on_many_close_groups(spark):
    docs = near_copies(1, 25, 12) + [(None, "a b c"), (2, "A  b c"), (1, "a b c"), (9000, None), (9001, " "), (9002, "one"), (9003, "One")]
    wanted = Counter((d, n, c) for (d, _), (n, c) in zip(docs, brute.shingle_classes(docs)))
    assert classes(spark, docs) == wanted


def test_set_join_with_small_tasks(spark, monkeypatch):
    """Every path for large nodes, clusters and keys, on data that small limits make large."""
    docs = near_copies(2, 3, 90) + [(20_000 + k, "same text for many rows") for k in range(60)] + [(7, "same text for many rows")] * 40
    wanted = Counter((d, n, c) for (d, _), (n, c) in zip(docs, brute.shingle_classes(docs)))
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    monkeypatch.setattr(chosen_path, "SPLIT", 4)
    monkeypatch.setattr(chosen_path, "GROUP_ROWS", 300)
    monkeypatch.setattr(chosen_path, "TILE_SHINGLES", 2500)
    monkeypatch.setattr(chosen_path, "PIVOTS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert classes(spark, docs) == wanted


def test_clusters_are_searched_exactly():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.choice(10_000, 60, replace=False)
        sets = [np.unique(np.where(rng.random(60) < 0.12 * rng.random(), rng.choice(10_000, 60), base)).astype(np.uint64) for _ in range(14)]
        root = list(range(len(sets)))

        def find(x):
            return x if root[x] == x else find(root[x])

        own = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = np.intersect1d(a, sets[j]).size
                if 100 * both >= 80 * (a.size + sets[j].size - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        wanted = [find(k) for k in own]
        root = own
        for a, b in chosen_path.cluster_links(sets):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert [find(k) for k in range(len(sets))] == wanted


def test_minwise_tokens_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    tokens = chosen_path.minwise([np.sort(a[:360]), np.sort(a[40:])])  # 320 of 400 shared
    assert abs((tokens[0] == tokens[1]).mean() - 0.8) < 0.13
    assert (chosen_path.minwise([np.sort(a)] * 2)[0] == chosen_path.minwise([np.sort(a)])[0]).all()


def test_trees_reach_the_recall():
    for n in (1, 10**5, 10**11):
        levels = chosen_path.last_level(n)
        assert (1 - chosen_path.survival(levels)) ** chosen_path.trees_for(levels) <= 1 - chosen_path.RECALL
        assert n / chosen_path.SPLIT ** (levels - chosen_path.START) <= chosen_path.SMALL
    # The recursion against drawn trees.
    rng, alive = np.random.default_rng(6), 0
    for _ in range(4000):
        n = 1
        for _ in range(3):
            picked = n + rng.binomial(n, 1 / chosen_path.THRESHOLD - 1)
            n = rng.binomial(picked, chosen_path.THRESHOLD)
        alive += n > 0
    assert abs(alive / 4000 - chosen_path.survival(3)) < 0.03


# --- filter audit ------------------------------------------------------------------------------


def audit_rows(frame):
    names = ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert frame.columns == names
    return [tuple(r) for r in frame.collect()]


def test_filter_audit(spark, tables):
    docs = rows_of(spark, tables, "documents", "doc_id", "text", "source")
    labels = rows_of(spark, tables, "labels", "doc_id", "quality", "toxic")
    found = audit_rows(Q["op12_filter_audit"](spark, tables))
    assert len(found) == len(set(found)) and set(found) == brute.filter_rows(docs, labels)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_filter_audit_on_copies(spark, monkeypatch, hot):
    """Copies in several parts, under equal and missing ids, labelled twice; with hot keys too."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["aa", "Bb", "cc#", "dd", "e"]) + str(rng.randrange(400)) for _ in range(n))
    texts = [words(rng.choice([3, 199, 200, 260])) for _ in range(12)] + [None, "", "one one one"]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    found = filter_audit.audit(
        spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    found = audit_rows(found)
    assert len(found) == len(set(found)) and set(found) == brute.filter_rows(docs, labels)


# --- prefix trie -------------------------------------------------------------------------------


def test_prefix_trie(spark, tables):
    turns = rows_of(spark, tables, "conversations", "conv_id", "turn", "role", "text")
    found = [tuple(r) for r in Q["op13_prefix_trie"](spark, tables).collect()]
    assert len(found) == len(set(found)) and set(found) == brute.trie_rows(turns)


@pytest.mark.parametrize("hot, run, bits", [(20_000, 1024, 12), (4, 2, 1)])
def test_prefix_trie_over_blocks(spark, monkeypatch, hot, run, bits):
    """Short, equal, long and turnless conversations, with families whose first one is missing."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "ID_BITS", bits)
    rng = random.Random(8)
    turns = []
    for c in [*range(0, 45), *range(61, 70), 100, 107, -3, -20]:
        n = rng.choice([1, 2, 3, 5, 9, 20])
        if c == 100:
            n = 70
        turns += [(c, t, rng.choice(["user", "assistant"]) if n < 5 else "user", rng.choice(["hi", "hi there", "x y z"]) if t < 3 else "go on please") for t in range(n)]
    turns += [(1, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 0, "user", "hi"), (500, 3, "", ""), (520, 3, None, None)]
    rng.shuffle(turns)
    found = [tuple(r) for r in prefix_trie.trie(spark.createDataFrame(turns, TURNS).repartition(5)).collect()]
    wanted = brute.trie_rows(turns)
    assert len(found) == len(set(found)) and set(found) == wanted
    assert max(x[1] for x in wanted) >= 69


def test_prefix_trie_is_one_rollup_per_pass(spark):
    """Prefixes are aggregated together: no join or loop by depth."""
    rows = spark.createDataFrame([(1, 0, 0, 0, *([None] * prefix_trie.WIDTH))], "conv_id long, block long, pa long, pb long, " + ", ".join(f"{c} binary" for c in prefix_trie._COLUMNS))
    plan = prefix_trie._rollup(rows, "COUNT(*) AS n_convs")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "Join" not in plan


# --- joins by counted keys ---------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_hot_keys(spark, how):
    rows = spark.createDataFrame([(k, 1 if k < 50 else k % 7 + 2, "x") for k in range(90)] + [(200, None, "x"), (201, 99, "x")], "a long, key long, n string")
    by_key = spark.createDataFrame([(1, 50, "one"), (2, 6, "two"), (3, 6, "three"), (50, 0, "none")], "key long, many long, name string")
    wanted = Counter(map(tuple, rows.join(by_key.drop("many"), "key", how).select("a", "key", "n", "name").collect()))
    for hot in (10_000, 10, 0):
        got = common.join_counted(rows, by_key, ["key"], "many", how, hot)
        assert got.columns == ["a", "key", "n", "name"] and Counter(map(tuple, got.collect())) == wanted


def test_edge_tables_have_clashing_columns(spark, edge_dir):
    assert {"key", "u", "v", "host"} <= set(spark.read.parquet(f"{edge_dir}/documents.parquet").columns)
    assert spark.read.parquet(f"{edge_dir}/conversations.parquet").where(F.col("conv_id").isNull()).count() == 1
