"""Chat formatting in DataFrame functions only.

Turns of a conversation are collected as structs, sorted by turn, adjacent turns of one role are
merged into one block, and the blocks are joined to one string:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n<|im_start|>...

Inside roles and texts a backslash is doubled and every control string gets a backslash behind
its first character, so no text can end a block and the escape can be undone: a doubled
backslash run has even length, the one that was put in stands alone.

The result also holds ``loss_spans``, start and length in code points of every assistant text as
it stands in the string; everything else is masked out of the loss.

Edge cases: a null text or role is empty, a null turn comes first, equal turns are ordered by
role and text, rows that repeat are all formatted. Rows with a null conv_id form one
conversation. An empty table gives no conversation. Other columns are ignored. The result has
one string per conversation, so a conversation must fit in a row; nothing else is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The template, and the control strings of common templates that are escaped.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROL, doubled)


def unescape(text: Column) -> Column:
    single = reduce(lambda c, s: F.replace(c, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s)), reversed(CONTROL), text)
    return F.replace(single, F.lit("\\\\"), F.lit("\\"))


def _unescape_role(role: Column) -> Column:
    """A single backslash and n is a line end; behind a doubled backslash n is itself."""
    parts = F.split(role, r"\\\\", -1)
    return unescape(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of every conversation."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        # A line end in a role becomes a backslash and n, so the first line end ends the role.
        F.struct(
            F.col("turn"),
            F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n")).alias("role"),
            escape(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("row"),
    )
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    # A row that follows one of its own role is put behind a separator, any other opens a block.
    number = F.sequence(F.lit(0), F.size("rows") - 1)
    pieces = F.transform(
        F.arrays_zip("rows", number.alias("i")),
        lambda x: F.struct(
            x["rows"]["role"].alias("role"),
            x["rows"]["text"].alias("text"),
            F.when(x["i"] == 0, F.concat(F.lit(START), x["rows"]["role"], F.lit("\n")))
            .when(F.get("rows", x["i"] - 1)["role"] == x["rows"]["role"], F.lit(SEPARATOR))
            .otherwise(F.concat(F.lit(f"{END}\n{START}"), x["rows"]["role"], F.lit("\n")))
            .alias("lead"),
        ),
    )
    built = sorted_rows.select("conv_id", pieces.alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.struct((p["role"] == LEARNED_ROLE).alias("learned"), F.length(p["lead"]).alias("lead"), F.length(p["text"]).alias("text")))
    joined = F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), "")
    spans = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["end"] + s["lead"] + s["text"]).alias("end"),
            F.when(
                s["learned"],
                F.concat(acc["spans"], F.array(F.struct((acc["end"] + s["lead"]).alias("start"), s["text"].alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return (
        built.select("conv_id", F.concat(joined, F.lit(f"{END}\n")).alias("formatted"), sizes.alias("sizes"))
        .select("conv_id", "formatted", spans.alias("loss_spans"))
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_text, all from the formatted string."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    parsed = formatted.select("conv_id", "formatted", "loss_spans", F.flatten(F.transform(blocks, turns)).alias("turns"))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return parsed.select("conv_id", "formatted", "turns", F.array_join(masked, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
