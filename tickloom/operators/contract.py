"""Contract checks for pools, registries, and comparisons of keyed tables.

The checks of every producer run as one grouped job; comparisons take tables of any
size and are one full outer join on the key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PROTOCOL, Protocol
from ..functions.arrays import checksum, finite
from .fidelity import repeated_windows

# The contract columns, and names that must not leak into a pool.
CANONICAL = (
    "synthetic_id", "source_model", "training_seed", "space", "window_length", "n_channels", "channel_order", "features_flat",
)
FORBIDDEN = ("ticker", "window_start_date", "window_end_date", "date", "dates", "session_dates")
# Lineage and role labels.
CANONICAL_LINEAGE, OTHER_LINEAGE, UNKNOWN_LINEAGE = "CANONICAL", "NON_CANONICAL", "NOT_VERIFIABLE"
ENTRY_FIELDS = (
    "method_id", "method_family", "source_model", "source_directory", "path", "sha256", "rows", "logical_shape", "training_seed",
    "space", "window_length", "n_channels", "channel_order", "features_flat_length", "normalization_status", "contract_status",
    "donor_lineage_status",
)


def present_columns(frame: DataFrame, key: str) -> DataFrame:
    """(key, names): the columns in which a producer has any value."""
    names = [c for c in frame.columns if c != key]
    filled = frame.groupBy(key).agg(*[F.count(c).alias(c) for c in names])
    found = F.array_compact(F.array(*[F.when(F.col(c) > 0, c) for c in names]))
    return filled.select(key, found.alias("names"))


def assess_schema(frame: DataFrame, key: str = "producer") -> DataFrame:
    """Missing, forbidden and extra columns per producer."""
    wanted = F.array(*[F.lit(c) for c in CANONICAL])
    banned = F.array(*[F.lit(c) for c in FORBIDDEN])
    joined = lambda c: F.concat_ws(",", F.array_sort(c))
    table = present_columns(frame, key)
    missing, extra = F.array_except(wanted, "names"), F.array_except("names", wanted)
    return table.select(
        key,
        joined(missing).alias("missing"),
        joined(F.array_intersect("names", banned)).alias("forbidden"),
        joined(extra).alias("extra"),
        ((F.size(missing) == 0) & (F.size(extra) == 0)).alias("ok"),
    )


def parse_channel_order(col: Column) -> Column:
    """``['a','b']`` or ``(a, b)`` or ``a,b`` as an array of names."""
    bare = F.regexp_replace(col, r"[\[\]()'\"\s]", "")
    return F.filter(F.split(bare, ","), lambda x: x != "")


def expected_values(proto: Protocol = PROTOCOL) -> dict[str, tuple[Column, object]]:
    order = ",".join(proto.channels)
    return {
        "training_seed": (F.col("training_seed"), proto.seeds[0]),
        "space": (F.col("space"), proto.space),
        "window_length": (F.col("window_length"), proto.length),
        "n_channels": (F.col("n_channels"), len(proto.channels)),
        "channel_order": (F.concat_ws(",", "channel_order"), order),
    }


def metadata_checks(frame: DataFrame, key: str = "producer", proto: Protocol = PROTOCOL) -> DataFrame:
    """One row per (producer, field): single-valued, and the expected value.

    A field is single-valued when its least and greatest values agree, which needs no
    distinct set.
    """
    fields = expected_values(proto)
    spans = frame.groupBy(key).agg(
        *[F.struct(F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(n) for n, (c, _) in fields.items()]
    )
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.col(n)["lo"].alias("lo"), F.col(n)["hi"].alias("hi"), F.lit(str(v)).alias("wanted"))
            for n, (_, v) in fields.items()
        ]
    )
    long = spans.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    return long.select(key, "field", one.alias("is_unique"), (one & (F.col("lo") == F.col("wanted"))).alias("as_expected"))


def contract_report(
    frame: DataFrame, expected: list[str], expected_rows: int, proto: Protocol = PROTOCOL, key: str = "producer", provenance: DataFrame | None = None
) -> DataFrame:
    """PASS or FAIL per producer with the list of broken rules; absent producers fail too.

    A null window has the wrong width, a null number in one is not finite, and null ids break a
    rule of their own. ``provenance`` holds (key, status) of the normalizer, where it is known.
    """
    width = F.coalesce(F.when(F.col("features_flat").isNotNull(), F.size("features_flat")), F.lit(-1))
    bad_value = F.coalesce(F.exists("features_flat", lambda x: ~F.coalesce(finite(x), F.lit(False))), F.lit(False))
    shape = frame.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(width).alias("__lo"),
        F.max(width).alias("__hi"),
        F.sum(bad_value.cast("int")).alias("non_finite_windows"),
        F.sum(F.col("synthetic_id").isNull().cast("int")).alias("null_ids"),
        F.sum(F.col("features_flat").isNull().cast("int")).alias("null_windows"),
    )
    ids = frame.where("synthetic_id IS NOT NULL").groupBy(key, "synthetic_id").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(
        F.sum(F.col("n") - 1).alias("duplicate_ids")
    )
    repeats = repeated_windows(frame.where("features_flat IS NOT NULL"), [key]).groupBy(key).agg(F.count(F.lit(1)).alias("exact_duplicates"))
    meta = metadata_checks(frame, key, proto).groupBy(key).agg(
        *[F.bool_or((F.col("field") == n) & ~F.col("as_expected")).alias(f"__{n}") for n in expected_values(proto)]
    )
    schema = assess_schema(frame, key).select(key, F.col("ok").alias("__schema"))
    names = frame.sparkSession.createDataFrame([(n,) for n in expected], f"{key} string")
    table = names.join(shape, key, "left").join(ids, key, "left").join(repeats, key, "left").join(meta, key, "left").join(schema, key, "left")
    if provenance is None:
        table = table.withColumn("__provenance", F.lit(None).cast("string"))
    else:
        table = table.join(provenance.select(key, F.col("status").alias("__provenance")), key, "left")
    table = table.fillna(0, ["n_rows", "non_finite_windows", "duplicate_ids", "exact_duplicates", "null_ids", "null_windows"])
    seen = F.col("n_rows") > 0
    rules = [
        ("missing_output", ~seen),
        ("schema", seen & ~F.col("__schema")),
        ("rows", seen & (F.col("n_rows") != expected_rows)),
        *[(n, F.col(f"__{n}")) for n in expected_values(proto)],
        ("null_ids", F.col("null_ids") > 0),
        ("duplicate_ids", F.col("duplicate_ids") > 0),
        ("width", seen & ((F.col("__lo") != proto.width) | (F.col("__hi") != proto.width))),
        ("non_finite", F.col("non_finite_windows") > 0),
        ("exact_duplicates", F.col("exact_duplicates") > 0),
        ("normalization", F.col("__provenance").eqNullSafe("mismatch")),
    ]
    errors = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules]))
    return table.withColumn("errors", F.concat_ws(",", errors)).select(
        key, "n_rows", "non_finite_windows", "null_ids", "null_windows", "duplicate_ids", "exact_duplicates",
        F.coalesce("__provenance", F.lit("not_verifiable")).alias("normalization_status"),
        F.when(F.col("errors") == "", "PASS").otherwise("FAIL").alias("status"), "errors",
    )


def fingerprint(frame: DataFrame, key: str = "producer") -> DataFrame:
    """Content hash per producer that does not depend on row order, and that SQL can compute.

    The sha256 of the row count and of the sum of the rows' hashes; a row's hash is 40 bits of
    the md5 of its id and its weighted checksum to six decimals.
    """
    value = F.round(checksum(F.col("features_flat")) * 1e6)
    number = F.coalesce(F.when(finite(value), value.cast("long").cast("string")), F.lit("none"))
    told = F.concat_ws(":", F.coalesce(F.col("synthetic_id").cast("string"), F.lit("none")), number)
    h = F.conv(F.substring(F.md5(told), 1, 10), 16, 10).cast("decimal(28,0)")
    sums = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"))
    return sums.select(key, F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("sha256"))


def build_registry(
    report: DataFrame, hashes: DataFrame, families: Mapping[str, str], lineage: Mapping[str, str], proto: Protocol = PROTOCOL
) -> DataFrame:
    """Entries of the producers that passed, sorted by id, with all of ENTRY_FIELDS."""
    of = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("producer")]
    return (
        report.where(F.col("status") == "PASS")
        .join(hashes, "producer")
        .select(
            F.col("producer").alias("method_id"),
            of(families).alias("method_family"),
            F.col("producer").alias("source_model"),
            F.lit("pools").alias("source_directory"),
            F.concat(F.lit("pools/"), F.col("producer"), F.lit(".parquet")).alias("path"),
            "sha256",
            F.col("n_rows").alias("rows"),
            F.array(F.col("n_rows"), F.lit(proto.length).cast("long"), F.lit(len(proto.channels)).cast("long")).alias("logical_shape"),
            F.lit(proto.seeds[0]).alias("training_seed"),
            F.lit(proto.space).alias("space"),
            F.lit(proto.length).alias("window_length"),
            F.lit(len(proto.channels)).alias("n_channels"),
            F.array(*map(F.lit, proto.channels)).alias("channel_order"),
            F.lit(proto.width).alias("features_flat_length"),
            "normalization_status",
            F.col("status").alias("contract_status"),
            F.coalesce(of(lineage), F.lit(UNKNOWN_LINEAGE)).alias("donor_lineage_status"),
        )
        .orderBy("method_id")
    )


def validate_entries(entries: DataFrame, families: list[str], expected_rows: Column | int, proto: Protocol = PROTOCOL) -> DataFrame:
    """Flags per registry entry: all fields there, and each rule of the contract kept."""
    rows = expected_rows if isinstance(expected_rows, Column) else F.lit(expected_rows)
    complete = F.lit(True)
    for c in ENTRY_FIELDS:
        complete = complete & F.col(c).isNotNull()
    held = lambda cond: F.coalesce(cond, F.lit(False))
    counts = entries.groupBy("method_id").agg(F.count(F.lit(1)).alias("__n"))
    path = F.col("path")
    shape = F.array(rows.cast("long"), F.lit(proto.length).cast("long"), F.lit(len(proto.channels)).cast("long"))
    return entries.join(counts, "method_id").select(
        "method_id",
        complete.alias("complete"),
        held(F.col("contract_status") == "PASS").alias("status_ok"),
        held(F.col("donor_lineage_status").isin(CANONICAL_LINEAGE, OTHER_LINEAGE, UNKNOWN_LINEAGE)).alias("lineage_ok"),
        held(F.col("method_family").isin(families)).alias("family_ok"),
        held(F.col("rows") == rows).alias("rows_ok"),
        held(F.col("logical_shape") == shape).alias("shape_ok"),
        held((F.col("training_seed") == proto.seeds[0]) & (F.col("space") == proto.space)).alias("seed_and_space_ok"),
        held((F.col("window_length") == proto.length) & (F.col("n_channels") == len(proto.channels)) & (F.col("features_flat_length") == proto.width)).alias("sizes_ok"),
        held(F.col("channel_order") == F.array(*map(F.lit, proto.channels))).alias("order_ok"),
        held(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("hash_ok"),
        held(~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")).alias("path_ok"),
        (F.col("__n") == 1).alias("unique_id"),
    )


def keyed_diff(saved: DataFrame, current: DataFrame, keys: list[str], content: list[str], metadata: list[str]) -> DataFrame:
    """One row per key: added, removed, changed content, changed metadata or same.

    Compares null-safely, so a value that turns null counts as a change.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"{prefix}__in"), *[F.col(c).alias(f"{prefix}{c}") for c in (*content, *metadata)])

    both = side(saved, "s_").join(side(current, "c_"), keys, "full_outer")

    def moved(cols: list[str]) -> Column:
        out = F.lit(False)
        for c in cols:
            out = out | ~F.col(f"s_{c}").eqNullSafe(F.col(f"c_{c}"))
        return out

    present = F.col("s___in").isNotNull() & F.col("c___in").isNotNull()
    change = (
        F.when(F.col("s___in").isNull(), "added")
        .when(F.col("c___in").isNull(), "removed")
        .when(moved(content) & moved(metadata), "changed_both")
        .when(moved(content), "changed_content")
        .when(moved(metadata), "changed_metadata")
        .otherwise("same")
    )
    status = F.when(F.col("s___in").isNull(), "UNREGISTERED->PASS").when(F.col("c___in").isNull(), "PASS->MISSING")
    return both.select(*keys, change.alias("change"), status.alias("status_change"), present.alias("in_both"))


def normal_name(col: Column) -> Column:
    """Lower case, runs of other characters to one underscore, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "_"), F.lit("_"))


def role_status(owner: Column, name: Column, roles: Mapping[str, tuple[str, ...]]) -> Column:
    """PASS when the owner's name is one of its aliases, else WRONG_ROLE; owners without
    a role are UNOFFICIAL_OWNER. The alias table is a few constants."""
    status = F.lit("UNOFFICIAL_OWNER")
    for who, aliases in roles.items():
        ok = normal_name(name).isin(*aliases)
        status = F.when(owner == who, F.when(ok, "PASS").otherwise("WRONG_ROLE")).otherwise(status)
    return status


def lineage_status(outputs: DataFrame, provenance: DataFrame, key: str, declared: str, canonical: object) -> DataFrame:
    """Lineage of each output from its provenance record, when there is one."""
    joined = outputs.join(provenance.select(key, declared), key, "left")
    status = (
        F.when(F.col(declared).isNull(), UNKNOWN_LINEAGE)
        .when(F.col(declared) == F.lit(canonical), CANONICAL_LINEAGE)
        .otherwise(OTHER_LINEAGE)
    )
    return joined.withColumn("lineage", status)


def select_methods(certified: DataFrame, roles: Mapping[str, str], allow_partial: bool = False) -> DataFrame:
    """Every required role with the certified method that fills it.

    ``certified`` holds (method_id, source_model, lineage), one row per method. Without
    ``allow_partial`` a role that no method may fill stops the run. Each row also carries the
    outcome of the whole selection: mode, counts, roles left open, certified methods that were
    left out, and warnings for selected methods whose lineage can't be verified.
    """
    wanted = certified.sparkSession.createDataFrame(list(roles.items()), "method_id string, required_role string")
    joined = wanted.join(certified, "method_id", "left")
    structural = F.when(F.col("source_model").isNull(), "MISSING").otherwise("PASS")
    role = F.when(F.col("source_model").isNull(), "MISSING").when(
        normal_name(F.col("source_model")) == F.col("required_role"), "PASS"
    ).otherwise("WRONG_ROLE")
    lineage = F.coalesce("lineage", F.lit(UNKNOWN_LINEAGE))
    rows = joined.select(
        "method_id", "required_role", structural.alias("structural_status"), role.alias("role_status"), lineage.alias("lineage"),
        ((role == "PASS") & (lineage != OTHER_LINEAGE)).alias("eligible"),
    )
    listed = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(c)))
    one = rows.agg(
        F.struct(
            F.sum(F.col("eligible").cast("long")).alias("n_eligible"),
            F.count(F.lit(1)).alias("n_required"),
            listed(F.when(~F.col("eligible"), F.concat_ws(":", "method_id", "required_role"))).alias("missing_roles"),
            listed(F.when(F.col("eligible") & (F.col("lineage") == UNKNOWN_LINEAGE), F.col("method_id"))).alias("lineage_warnings"),
        ).alias("c")
    )
    outcome = one.first()["c"]  # one row
    complete = outcome["n_eligible"] == outcome["n_required"]
    if not complete and not allow_partial:
        raise RuntimeError(f"selection blocked, {outcome['n_eligible']} of {outcome['n_required']} roles filled, missing: {outcome['missing_roles']}")
    chosen = rows.where("eligible").select("method_id")
    left_out = certified.join(chosen, "method_id", "left_anti").agg(listed("method_id").alias("x")).select("x").scalar()
    return rows.select(
        "*",
        F.lit("PROVISIONAL_PARTIAL" if allow_partial else "STRICT_FINAL").alias("run_mode"),
        F.lit(outcome["n_eligible"]).cast("long").alias("n_eligible"),
        F.lit(complete).alias("complete"),
        F.lit(outcome["missing_roles"]).alias("missing_roles"),
        F.lit(outcome["lineage_warnings"]).alias("lineage_warnings"),
        left_out.alias("excluded"),
    )


def invariants(runs: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Which fields have one value over all runs of a group."""
    spans = runs.groupBy(group).agg(
        *[F.struct(F.min(F.col(c).cast("string")).alias("lo"), F.max(F.col(c).cast("string")).alias("hi")).alias(c) for c in fields]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c)["lo"].eqNullSafe(F.col(c)["hi"]).alias("identical")) for c in fields])
    return spans.select(group, F.explode(cells).alias("c")).select(group, "c.*")


HISTORY = ("train_loss", "validation_loss")


def history_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest gap per run and metric over epochs, and whether all are equal."""
    left = a.select("run", "epoch", *[F.col(c).alias(f"a_{c}") for c in HISTORY])
    right = b.select("run", "epoch", *[F.col(c).alias(f"b_{c}") for c in HISTORY])
    both = left.join(right, ["run", "epoch"], "full_outer")
    same = F.lit(True)
    for c in HISTORY:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return both.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"max_gap_{c}") for c in HISTORY],
        F.bool_and(same).alias("identical"),
    )


def history_check(history: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in HISTORY:
        ok = ok & finite(F.col(c))
    return history.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_finite"),
        (F.countDistinct("epoch") == F.count(F.lit(1))).alias("unique_epochs"),
    )


def best_epoch(history: DataFrame, before: int = 10, after: int = 30) -> DataFrame:
    """Epoch of the least validation loss and the range around it to zoom into."""
    best = history.where(finite(F.col("validation_loss"))).groupBy("run").agg(
        F.min(F.struct("validation_loss", "epoch")).alias("b"), F.min("epoch").alias("lo"), F.max("epoch").alias("hi")
    )
    at = F.col("b.epoch")
    return best.select(
        "run", at.alias("best_epoch"), F.col("b.validation_loss").alias("best_loss"),
        F.greatest(at - before, F.col("lo")).alias("zoom_from"), F.least(at + after, F.col("hi")).alias("zoom_to"),
    )


def best_loss_delta(frozen: DataFrame, long: DataFrame) -> DataFrame:
    """Best epoch and loss of each run's frozen and long training, and what the longer one gains."""
    side = lambda df, name: best_epoch(df).select(
        "run", F.col("best_epoch").alias(f"{name}_best_epoch"), F.col("best_loss").alias(f"{name}_best_loss")
    )
    both = side(frozen, "frozen").join(side(long, "long"), "run")
    return both.withColumn("delta_best_loss", F.col("long_best_loss") - F.col("frozen_best_loss"))


def subset_integrity(subset: DataFrame, row_id: str, expected: Column, pool_size: int) -> DataFrame:
    inside = (F.col(row_id) >= 0) & (F.col(row_id) < pool_size)
    counts = subset.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("n_rows"), (F.max("n") == 1).alias("is_unique"), F.bool_and(inside).alias("in_bounds")
    ).withColumn("__want", expected).select("n_rows", (F.col("n_rows") == F.col("__want")).alias("as_expected"), "is_unique", "in_bounds")
