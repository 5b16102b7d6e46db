"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation is sorted by turn. Every assistant turn becomes one example: all turns before it are context,
its own text is the only trainable span. A conversation that does not end with an assistant turn (or has none)
gives one closing example with an empty span, so that no turn is lost.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. In texts a ``<``, any backslashes and ``|``
get one more backslash, so no marker can appear in a text, and taking one away restores it. In roles backslash,
newline and ``|`` are written as ``\\\\``, ``\\n`` and ``\\p``.

Defined results: null text or role is empty; turns sort by (turn, role, text), null first, so ties and repeated
rows have one order; rows with a null conversation id form one conversation; an empty table gives no examples;
extra columns are ignored. A conversation is one document: it is held whole by the task that formats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def escape_role(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(c: Column) -> Column:
    plain = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, last, formatted, loss_start, loss_chars): the span counts characters of ``formatted``."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = convs.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("text"),
                (t["role"] == target_role).alias("target"),
            ),
        ).alias("ps"),
    ).withColumn("n", F.size("ps"))
    spots = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("ps", i)["target"] | (i == F.col("n")))
    each = parts.select("conv_id", "ps", "n", F.posexplode(spots).alias("example", "at"))
    return (
        each.withColumn("goal", F.element_at("ps", F.col("at")))
        .withColumn(
            "context",
            F.concat(
                F.array_join(
                    F.transform(
                        F.slice("ps", F.lit(1), F.col("at") - 1), lambda p: F.concat(p["head"], p["text"], F.lit(END))
                    ),
                    "",
                ),
                F.col("goal.head"),
            ),
        )
        .select(
            "conv_id",
            "example",
            (F.col("at") == F.col("n")).alias("last"),
            F.concat("context", "goal.text", F.lit(END)).alias("formatted"),
            F.length("context").cast("long").alias("loss_start"),
            F.when(F.col("goal.target"), F.length("goal.text")).otherwise(0).cast("long").alias("loss_chars"),
        )
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def one(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        length = F.length(x) - F.length(role) - 1 - len(END)
        return F.struct(
            unescape_role(role).alias("role"), unescape(F.substring(x, F.length(role) + 2, length)).alias("text")
        )

    return F.transform(pieces, one)


def read_back(examples_df: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turn_lines = F.array_join(
        F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    each = examples_df.select(
        "conv_id",
        F.struct("example", F.when(F.col("loss_chars") > 0, loss).otherwise("").alias("loss")).alias("part"),
        F.when(
            F.col("last"),
            F.struct(
                F.size(F.split("formatted", r"<\|im_start\|>")).alias("pieces"), F.sha2(turn_lines, 256).alias("digest")
            ),
        ).alias("whole"),
        F.length("formatted").cast("long").alias("chars"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return (
        each.groupBy("conv_id")
        .agg(
            F.max("whole").alias("whole"),
            F.sort_array(F.collect_list("part")).alias("parts"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            (F.col("whole.pieces") - 1).cast("long").alias("n_turns"),
            F.col("whole.digest").alias("turns_sha256"),
            F.length(joined).cast("long").alias("loss_chars"),
            F.sha2(joined, 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
