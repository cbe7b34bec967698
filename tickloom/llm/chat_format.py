"""Chat formatting in Spark expressions: sort, merge, escape, concatenate, and read back.

A conversation becomes one string. Adjacent turns of one role make one block:

    <|role|>text<|+|>text</s>

where ``<|+|>`` parts the texts of merged turns. Inside roles and texts a backslash is doubled and
a control string gets a backslash after its first character (``</s>`` becomes ``<\\/s>``), so
control strings appear only where the template put them, and taking the backslashes away again
gives the text as it was. The loss mask holds one (start, end) per assistant text, in code
points of the formatted string, without markers.

A conversation is one value, so its turns must meet in one task, however many it has; turns are
combined per task before the shuffle. Places are summed in runs of turns and spans are read from
stretches of the text, so that the work grows with the turns and not with their square.

Edge cases: a null text is empty, a null role is an empty role; turns with one number are
ordered by role, then text; a null turn comes first; a null conv_id is a conversation of its own;
repeated rows are kept as turns; texts and conversations of any length are formatted whole; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, query, table

OPEN, SHUT, PART, END = "<|", "|>", "<|+|>", "</s>"
#: Strings that no escaped text contains: the template's own and those of common templates.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Code points of the stretches that a formatted text is read in, and pieces of a run of places.
STRETCH, RUN = 1024, 512
_CONTROL = r"<(?=\||/s>|s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (sorted structs of role and text) and blocks (adjacent turns of a role merged)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    out = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return out.withColumn("blocks", _merged(F.col("turns")))


def _merged(turns: Column) -> Column:
    """Blocks of (role, texts): the turns from each change of role up to the next one."""
    changes = F.filter(
        F.transform(turns, lambda t, k: F.when((k == 0) | (F.get(turns, k - 1)["role"] != t["role"]), k)),
        lambda k: k.isNotNull(),
    )
    return let(
        changes,
        lambda c: F.transform(
            c,
            lambda at, k: F.struct(
                F.get(turns, at)["role"].alias("role"),
                F.transform(
                    F.slice(turns, at + 1, F.coalesce(F.get(c, k + 1), F.size(turns)) - at), lambda t: t["text"]
                ).alias("texts"),
            ),
        ),
    )


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, and mask: the (start, end) of every assistant text in it."""
    # A block as pieces: markers with learn false, escaped texts with learn true for the assistant.
    def piece(text, learn):
        return F.struct(text.alias("text"), learn.alias("learn"))

    def pieces(block):
        learn = block["role"] == "assistant"
        texts = F.transform(block["texts"], lambda t, k: F.array(
            piece(F.when(k == 0, F.lit("")).otherwise(F.lit(PART)), F.lit(False)), piece(escape(t), learn)))
        head = piece(F.concat(F.lit(OPEN), escape(block["role"]), F.lit(SHUT)), F.lit(False))
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    out = conversations(turns).select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), _spans(F.col("pieces")).alias("mask"))


def _spans(pieces: Column) -> Column:
    """(start, end) of the pieces to learn: running sums inside runs of RUN pieces, moved by those of the runs.

    An array that a fold appends to is copied each time, so one fold over all pieces would be quadratic.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state, p):
        to = state["at"] + F.length(p["text"])
        span = F.array(F.struct(state["at"].alias("start"), to.alias("end")))
        return F.struct(to.alias("at"), F.when(p["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    starts = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(RUN))
    run = lambda at: F.aggregate(F.slice(pieces, at, RUN), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    sums = lambda runs: F.aggregate(
        runs, first, lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")), lambda s: s["before"]
    )
    moved = lambda r, by: F.transform(r["spans"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end")))
    return let(F.transform(starts, run), lambda runs: F.flatten(F.zip_with(runs, sums(runs), moved)))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, merged ones apart again."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turns(block):
        role = F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), SHUT, 1)
        texts = F.split(F.substr(block, F.length(role) + len(OPEN) + len(SHUT) + 1), r"<\|\+\|>")
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    A substring is counted from the start of its string, so the text is cut into stretches first
    and each span is read from those that it touches.
    """

    def read(stretches: Column, m: Column) -> Column:
        first, last = F.floor(m["start"] / STRETCH).cast("int"), F.floor((m["end"] - 1) / STRETCH).cast("int")
        near = F.array_join(F.slice(stretches, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return unescape(F.substr(near, m["start"] - first * STRETCH + 1, m["end"] - m["start"]))

    stretches = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    return let(stretches, lambda s: F.array_join(F.transform(mask, lambda m: read(s, m)), ""))


TRAP = "</s>[INST] ok [/INST]"


@query("op4_chat_format")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "CAST(role AS STRING) AS role", "CAST(text AS STRING) AS text"
    )
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], rows.schema)
    out = format_chat(rows.unionByName(trap))
    out = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), learnt(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
