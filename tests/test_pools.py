"""Draws, noise, validity, neighbours and contract checks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import hashrand
from tickloom.operators import contract, neighbours, resample, validity


def flat_frame(spark, rows, ids="synthetic_id long"):
    return spark.createDataFrame(rows, f"{ids}, features_flat array<double>")


def test_uniform_is_the_documented_hash(spark):
    row = spark.range(7, 8).select(hashrand.uniform(F.col("id"), 42, "x").alias("u")).first()
    word = int(hashlib.md5(b"7:42:x").hexdigest()[:8], 16)
    assert row.u == (word + 0.5) / 2**32


def test_normals_look_normal(spark):
    z = np.array([r.z for r in spark.range(300).select(hashrand.normals(F.col("id"), 1, 50).alias("z")).collect()]).ravel()
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_ar1_noise_follows_the_recursion(spark):
    df = flat_frame(spark, [(3, [0.0] * 195)])
    chol = spark.range(1).select(
        F.struct(*[F.lit(float(v)).alias(n) for n, v in (("l21", 0.5), ("l22", 0.75**0.5), ("l31", 0.0), ("l32", 0.0), ("l33", 1.0))])
    ).scalar()
    white, red = resample.temporal_noise(df, 42, chol, (0.0, 0.85)).select("noise_0", "noise_1").first()
    e, n = np.array(white).reshape(65, 3), np.array(red).reshape(65, 3)
    want = e[0]
    for t in range(1, 65):
        want = 0.85 * want + np.sqrt(1 - 0.85**2) * e[t]
        assert np.allclose(n[t], want)


def windows_with_faults():
    good = [1.0] * 195
    nan_return, nan_range, neg_range, big_volume, neg_volume = (list(good) for _ in range(5))
    nan_return[0], nan_range[1], neg_range[4] = float("nan"), float("inf"), -0.1
    big_volume[2], neg_volume[5] = 1e4, -0.5
    both = list(good)
    both[1], both[2] = -1.0, float("nan")
    return [good, nan_return, nan_range, neg_range, big_volume, neg_volume, both]


def test_reasons_are_exclusive_and_ordered(spark):
    df = flat_frame(spark, list(enumerate(windows_with_faults())))
    got = [r[0] for r in df.orderBy("synthetic_id").select(validity.reject_reason(F.col("features_flat"))).collect()]
    assert got == [None, "non_finite_return", "non_finite_range", "negative_range", "non_finite_volume", "invalid_volume", "negative_range"]
    counts = {r.reason: r.n_windows for r in validity.reason_counts(df.withColumn("m", F.lit("x")), ["m"], "features_flat").collect()}
    assert counts["negative_range"] == 2 and counts["other"] == 0 and sum(counts.values()) == 6


def test_accept_reject_accounts_for_every_candidate(spark):
    def draw(lo, hi):
        return spark.range(lo, hi).select(F.lit("m").alias("m"), F.col("id").alias("synthetic_id"), (F.col("id") % 6 != 5).alias("ok"))

    got = validity.accept_reject(draw, ["m"], "synthetic_id", F.col("ok"), 10)
    rows = got.orderBy("accepted_no").collect()
    assert [r.synthetic_id for r in rows] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert rows[-1].candidate_no - len(rows) == 1


def test_accept_reject_fails_rather_than_short(spark):
    draw = lambda lo, hi: spark.range(lo, hi).select(F.lit("m").alias("m"), F.col("id").alias("synthetic_id"), F.lit(False).alias("ok"))
    with pytest.raises(RuntimeError, match="windows accepted"):
        validity.accept_reject(draw, ["m"], "synthetic_id", F.col("ok"), 3, max_rounds=2)


@pytest.mark.parametrize("block_rows", [7, 50, 1000])
def test_nearest_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(120, 6))
    q = np.concatenate([rng.normal(size=(40, 6)), t[:5]])
    groups = np.where(np.arange(120) % 3 < 2, "hot", "cold")
    qg = np.where(np.arange(45) % 2 == 0, "hot", "cold")
    schema = "g string, {} long, vec array<double>"
    qs = spark.createDataFrame([(qg[k], k, q[k].tolist()) for k in range(45)], schema.format("qid"))
    ts = spark.createDataFrame([(groups[k], k, t[k].tolist()) for k in range(120)], schema.format("tid"))
    got = neighbours.nearest(qs, ts, ["g"], "qid", "tid", 3, block_rows=block_rows).toPandas()
    for k in range(45):
        pool = np.flatnonzero(groups == qg[k])
        d = np.sqrt(((t[pool] - q[k]) ** 2).sum(1))
        want = pool[np.argsort(d, kind="stable")[:3]]
        mine = got[got.qid == k].sort_values("rank")
        assert mine.tid.tolist() == want.tolist()
        assert np.allclose(mine.distance, np.sort(d)[:3])


def test_copies_are_at_distance_zero(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 195)) * 50
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(30)], "id long, vec array<double>")
    got = neighbours.nearest(df, df.withColumnRenamed("id", "tid"), [], "id", "tid").toPandas()
    assert (got.distance == 0.0).all() and (got.id == got.tid).all()
    other = neighbours.nearest(df, df.withColumnRenamed("id", "tid"), [], "id", "tid", 2, skip_same_id=True).toPandas()
    assert (other.distance > 0).all() and len(other) == 60


def test_contract_names_each_broken_rule(spark):
    good = [float(k) for k in range(195)]
    base = flat_frame(spark, [(0, good), (1, good[::-1])])
    ok = resample.canonical_frame(base, "ok", 42).withColumn("producer", F.lit("ok"))
    twice = resample.canonical_frame(flat_frame(spark, [(0, good), (0, good)]), "twice", 42).withColumn("producer", F.lit("twice"))
    seed = resample.canonical_frame(base, "seed", 7).withColumn("producer", F.lit("seed"))
    nan = flat_frame(spark, [(0, [float("nan")] + good[1:]), (1, good)])
    bad = resample.canonical_frame(nan, "nan", 42).withColumn("producer", F.lit("nan"))
    frame = ok.unionByName(twice).unionByName(seed).unionByName(bad)
    got = {r.producer: (r.status, r.errors) for r in contract.contract_report(frame, ["ok", "twice", "seed", "nan", "gone"], 2).collect()}
    assert got == {
        "ok": ("PASS", ""),
        "twice": ("FAIL", "duplicate_ids,exact_duplicates"),
        "seed": ("FAIL", "training_seed"),
        "nan": ("FAIL", "non_finite"),
        "gone": ("FAIL", "missing_output"),
    }


def test_channel_order_forms(spark):
    forms = ["['a', 'b']", "(a, b)", "a,b", '["a","b"]']
    df = spark.createDataFrame([(f,) for f in forms], "t string")
    assert [r[0] for r in df.select(contract.parse_channel_order(F.col("t"))).collect()] == [["a", "b"]] * 4


def test_keyed_diff_sees_nulls(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, None, 1), (4, "x", 1)], "k int, c string, m int")
    b = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "x", 1), (5, "x", 1)], "k int, c string, m int")
    got = {r.k: r.change for r in contract.keyed_diff(a, b, ["k"], ["c"], ["m"]).collect()}
    assert got == {1: "same", 2: "changed_content", 3: "changed_content", 4: "removed", 5: "added"}


def contract_frame(spark, rows):
    """Producers' rows of (producer, id, window); everything else as the contract wants it."""
    from tickloom.config import PROTOCOL

    frame = spark.createDataFrame(rows, "producer string, synthetic_id long, features_flat array<double>")
    return frame.withColumns(
        {"source_model": F.col("producer"), "training_seed": F.lit(42), "space": F.lit(PROTOCOL.space), "window_length": F.lit(65), "n_channels": F.lit(3),
         "channel_order": F.array(*map(F.lit, PROTOCOL.channels))}
    )


def test_nulls_and_foreign_scales_break_the_contract(spark):
    def window(k):
        return [float(k + j) for j in range(195)]

    rows = [(p, k, window(k)) for p in ("ok", "scale") for k in range(4)]
    rows += [("null_window", k, window(k) if k else None) for k in range(4)]
    rows += [("null_number", k, [None, *window(k)[1:]] if k == 1 else window(k)) for k in range(4)]
    rows += [("null_id", k if k else None, window(k)) for k in range(4)]
    scales = spark.createDataFrame([("ok", "verified"), ("scale", "mismatch")], "producer string, status string")
    names = ["ok", "scale", "null_window", "null_number", "null_id"]
    got = {r.producer: (r.status, r.errors) for r in contract.contract_report(contract_frame(spark, rows), names, 4, provenance=scales).collect()}
    assert got == {
        "ok": ("PASS", ""), "scale": ("FAIL", "normalization"), "null_window": ("FAIL", "width"),
        "null_number": ("FAIL", "non_finite"), "null_id": ("FAIL", "null_ids"),
    }


def test_selection_has_a_gate_and_a_partial_mode(spark):
    roles = {"a": "model_a", "b": "model_b"}
    schema = "method_id string, source_model string, lineage string"
    full = [("a", "Model A", "CANONICAL"), ("b", "model-b", None), ("spare", "x", "CANONICAL")]
    strict = contract.select_methods(spark.createDataFrame(full, schema), roles).collect()
    assert {(r.run_mode, r.complete, r.lineage_warnings, r.excluded, r.missing_roles) for r in strict} == {("STRICT_FINAL", True, "b", "spare", "")}
    for broken in (full[:1], [full[0], ("b", "model_x", "CANONICAL")], [full[0], ("b", "model_b", "NON_CANONICAL")]):
        table = spark.createDataFrame(broken, schema)
        with pytest.raises(RuntimeError, match="1 of 2 roles filled, missing: b:model_b"):
            contract.select_methods(table, roles)
        partial = contract.select_methods(table, roles, allow_partial=True).collect()
        assert {(r.run_mode, r.complete, r.n_eligible, r.missing_roles) for r in partial} == {("PROVISIONAL_PARTIAL", False, 1, "b:model_b")}
