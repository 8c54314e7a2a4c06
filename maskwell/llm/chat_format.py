"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected, sorted by turn and merged: adjacent turns of one role
form a block, whose texts are joined by array aggregation. A block is

    <s>[INST]role[/INST]text[NEXT]text...</s>

and a conversation is its blocks in order. Control strings inside roles and texts are escaped by one
backslash behind their first character (`</s>` becomes `<\\/s>`; one that already has n backslashes
there gets n + 1), so no control string of a text survives and unescaping is exact.

The loss mask is an array of code point ranges (start, end) over the formatted text, one for each
assistant text. Offsets are prefix sums in two levels, so a long conversation costs n * sqrt(n)
steps, not n * n.

Defined results for odd input: null text and null role count as empty; equal turn numbers order by
role, then text; null turns come first; rows that repeat are turns of their own; a null conv_id is
one conversation; other columns are ignored. A conversation is one value of the result, so it has
to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, MID, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"
ASSISTANT = "assistant"

# The control strings without their first character, behind any number of backslashes.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|NEXT\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|NEXT\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def prefix_sums(column: str) -> str:
    """SQL for the exclusive prefix sums of an array<int> column, by chunks of about sqrt(n)."""
    step = f"greatest(1, cast(sqrt(size({column})) as int))"
    scan = "aggregate({a}, array({z}), (s, x) -> concat(s, array(element_at(s, -1) + x)))"
    chunks = f"transform(sequence(0, (size({column}) - 1) div {step}), k -> slice({column}, k * {step} + 1, {step}))"
    sums = f"transform({chunks}, c -> aggregate(c, 0, (s, x) -> s + x))"
    starts = scan.format(a=sums, z="0")
    inner = scan.format(a="c", z="0")
    return f"if(size({column}) = 0, array(0), flatten(zip_with({chunks}, slice({starts}, 1, size({sums})), (c, z) -> transform(slice({inner}, 1, size(c)), v -> v + z))))"


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_mask array<struct<start, end>>, n_blocks: one row a conversation."""
    turn = F.struct(turns["turn"].alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(turns["conv_id"].alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # A block begins where the role changes; blocks are slices between the beginnings.
    cut = sorted_turns.withColumn("b", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or get(t, i).role <> get(t, i - 1).role)"))
    blocks = cut.withColumn("blocks", F.expr("transform(b, (s, k) -> named_struct('role', get(t, s).role, 'texts', transform(slice(t, s + 1, coalesce(get(b, k + 1), size(t)) - s), x -> x.text)))"))
    escaped = blocks.withColumn("blocks", F.transform("blocks", lambda x: F.struct(escape(x["role"]).alias("role"), x["role"].alias("raw"), F.transform(x["texts"], escape).alias("texts"))))
    piece = lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MID), F.array_join(x["texts"], NEXT), F.lit(CLOSE))
    sized = escaped.withColumn("formatted", F.array_join(F.transform("blocks", piece), "")).withColumn(
        # Lengths of all stretches in order, each text behind the marks that precede it.
        "runs", F.expr(f"flatten(transform(blocks, x -> concat(flatten(transform(x.texts, (v, i) -> array(if(i = 0, {len(OPEN) + len(MID)} + char_length(x.role), {len(NEXT)}), char_length(v)))), array({len(CLOSE)}))))")
    ).withColumn("loss", F.expr("flatten(transform(blocks, x -> concat(flatten(transform(x.texts, v -> array(false, x.raw = 'assistant'))), array(false))))")).withColumn("starts", F.expr(prefix_sums("runs")))
    mask = "transform(filter(sequence(0, size(runs) - 1), i -> get(loss, i)), i -> named_struct('start', get(starts, i), 'end', get(starts, i) + get(runs, i)))"
    return sized.select("conv_id", "formatted", F.expr(mask).alias("loss_mask"), F.size("blocks").cast("long").alias("n_blocks"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """chats with turns array<struct<role, text>> and loss_text, both read back from formatted."""
    block = F.transform(
        F.filter(F.split("formatted", CLOSE, -1), lambda x: x != ""),
        lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), MID, 1)).alias("role"), F.split(F.substring(x, F.lit(1 + len(OPEN) + len(MID)) + F.char_length(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), MID, 1)), F.lit(1 << 30)), r"\[NEXT\]", -1).alias("texts")),
    )
    turns = F.flatten(F.transform(block, lambda x: F.transform(x["texts"], lambda v: F.struct(x["role"].alias("role"), unescape(v).alias("text")))))
    under = F.array_join(F.transform("loss_mask", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"]))), "")
    return chats.withColumn("turns", turns).withColumn("loss_text", under)


def chat_digests(turns: DataFrame) -> DataFrame:
    """The contract's row for each conversation, read back from the formatted text and the mask."""
    parsed = parse_chats(format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
