"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose the windows: a turn begins a new one where the tokens from the window's first turn on would pass the
budget, less what the repeated system turn takes and history may take. So windows are as full as whole turns let them be. A window
repeats the system turn and the last turns before it, within limits; repeated text is masked, so each
assistant text is a target once. Text in the template is escaped so that no control string can come from a turn:

    ### role: text</turn>

In a text `\\` becomes `\\\\`, `<` becomes `\\l`, `#` becomes `\\h`; in a role also `:` becomes `\\c`. No `<` or `#` remains.

Prefix sums are two-level sums over ranges of turns, and windows are chosen within parts of PART turns (a part begins a window), so a
conversation with very many turns is worked on by many tasks, and no array outgrows a part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.operators.running import running_totals

#: Tokens of a window, of repeated history, and most repeated turns; tokens that a turn's marks take.
BUDGET, HISTORY, HISTORY_TURNS, MARKS = 2048, 256, 2, 4
#: Turns to a range of the prefix sums, and to a part in which windows are chosen.
RANGE, PART = 4096, 512
END = "</turn>\n"
TARGET = "assistant"


def swap(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(c: Column) -> Column:
    return swap(swap(swap(c, "\\", "\\\\"), "<", "\\l"), "#", "\\h")


def unescape(c: Column) -> Column:
    """Pairs are undone from the left; what stands for a backslash in between can't come from an escaped text."""
    c = swap(swap(swap(c, "\\\\", "<0>"), "\\h", "#"), "\\l", "<1>")
    return swap(swap(c, "<0>", "\\"), "<1>", "<")


def escape_role(c: Column) -> Column:
    return swap(escape(c), ":", "\\c")


def unescape_role(c: Column) -> Column:
    c = swap(swap(swap(swap(c, "\\\\", "<0>"), "\\h", "#"), "\\c", ":"), "\\l", "<1>")
    return swap(swap(c, "<0>", "\\"), "<1>", "<")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")) + MARKS


def placed(turns: DataFrame) -> DataFrame:
    """Turns with their number in the conversation, the tokens before them, and their part."""
    rows = turns.withColumn("tokens", token_count(F.col("text")).cast("bigint"))
    rows = running_totals(rows, ["conv_id"], "turn", {"nr": F.lit(1), "before": F.col("tokens")}, ["role", "text"], RANGE)
    return rows.withColumn("part", F.floor(F.col("nr") / PART))


IS_SYSTEM = "nr = 0 and role = 'system'"


def chosen(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """(id, at_part, spans): the windows of each part as (start, end_nr, end_at): first and last turn, and tokens up to its end."""
    system = rows.where(IS_SYSTEM).select(F.col("conv_id").alias("_of"), F.col("tokens").alias("_system"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("nr", "before", "tokens"))).alias("turns"))
    parts = parts.join(system, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    later = F.greatest(F.lit(1), budget - history - F.coalesce("_system", F.lit(0))).cast("bigint")
    span = "struct<start:bigint,end_nr:bigint,end_at:bigint>"
    none = F.struct(F.lit(0).cast("bigint").alias("begun"), F.lit(0).cast("bigint").alias("room"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc, x):
        end = x["before"] + x["tokens"]
        fresh = (F.size(acc["spans"]) == 0) | (end - acc["begun"] > acc["room"])
        mine = lambda start: F.array(F.struct(start.alias("start"), x["nr"].alias("end_nr"), end.alias("end_at")).cast(span))
        open_ = F.element_at(acc["spans"], -1)["start"]
        grown = F.concat(F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1), mine(open_))
        return F.when(fresh, F.struct(x["before"].alias("begun"), F.when(x["nr"] == 0, F.lit(budget)).otherwise(later).cast("bigint").alias("room"), F.concat(acc["spans"], mine(x["nr"])).alias("spans"))).otherwise(F.struct(acc["begun"].alias("begun"), acc["room"].alias("room"), grown.alias("spans")))

    return parts.select(F.col("conv_id").alias("id"), F.col("part").alias("at_part"), F.aggregate("turns", none, step)["spans"].alias("spans"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row a window: (conv_id, window, turns, context_turns, tokens, over_budget, formatted, loss).

    conversations: (conv_id, turn, role, text), a row a turn; other columns are not read. Turns are ordered by (turn, role,
    text), nulls first; repeated rows are turns of their own; null roles and texts count as empty; rows with a null conv_id are a
    conversation of their own. `window` is the number of its first own turn. `context_turns` leading turns are repeated ones. `loss` is an
    array of (start, length) in characters of `formatted`: the escaped assistant texts that are not repeated. A turn is never cut: a
    window is over budget, and says so, only if one turn with the system turn and history is.
    """
    clean = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = placed(clean)
    spans = chosen(rows, budget, history)
    rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("at_part")))
    # A part's spans are in order, and each turn is in one.
    rows = rows.withColumn("span", F.element_at(F.filter("spans", lambda x: x["start"] <= F.col("nr")), -1)).drop("id", "at_part", "spans")
    rows = rows.withColumn("window", F.col("span.start"))
    # Turns that the next window repeats; that there is no next one shows in the end, for it has no turns of its own.
    close = (F.col("span.end_nr") - F.col("nr") < history_turns) & (F.col("span.end_at") - F.col("before") <= history)
    text = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "), escape(F.col("text")), F.lit(END))
    said = F.when(F.col("role") == TARGET, F.length(escape(F.col("text")))).otherwise(0)
    entry = lambda window, repeated: F.struct(window.alias("window"), F.lit(repeated).alias("repeated"), F.col("nr"), F.col("tokens"), said.alias("said"), text.alias("text"))
    is_system = F.expr(IS_SYSTEM)
    both = F.array(entry(F.col("window"), False), entry(F.col("span.end_nr") + 1, True))
    mine = F.array(entry(F.col("window"), False))
    each = rows.select("conv_id", F.explode(F.when(close & ~is_system, both).otherwise(mine)).alias("e"))
    grouped = each.groupBy("conv_id", "e.window").agg(F.array_sort(F.collect_list(F.struct("e.nr", "e.repeated", "e.tokens", "e.said", "e.text"))).alias("t"))
    grouped = grouped.where(F.exists("t", lambda x: ~x["repeated"]))
    first = rows.where(is_system).select(F.col("conv_id").alias("sys_id"), F.struct("nr", F.lit(True).alias("repeated"), "tokens", F.lit(0).alias("said"), text.alias("text")).alias("sys"))
    joined = grouped.join(first, F.col("conv_id").eqNullSafe(F.col("sys_id")), "left")
    lead = F.when(F.col("sys").isNotNull() & (F.element_at("t", 1)["nr"] > 0), F.array("sys"))
    out = joined.select("conv_id", "window", F.when(lead.isNotNull(), F.concat(lead, "t")).otherwise(F.col("t")).alias("t"))
    # The place where each turn ends: sums of lengths, over the bounded number of turns of a window.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, x):
        at = acc["at"] + F.length(x["text"])
        start = at - len(END) - x["said"]
        found = F.when((x["said"] > 0) & ~x["repeated"], F.array(F.struct(start.alias("start"), x["said"].alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct(at.alias("at"), F.concat(acc["spans"], found).alias("spans"))

    tokens = F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, x: acc + x["tokens"])
    return out.select(
        "conv_id",
        "window",
        F.size("t").alias("turns"),
        F.size(F.filter("t", lambda x: x["repeated"])).alias("context_turns"),
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
        F.array_join(F.transform("t", lambda x: x["text"]), "").alias("formatted"),
        F.aggregate("t", zero, step)["spans"].alias("loss"),
    )


def parsed(formatted: Column) -> Column:
    """Turns (role, text) read back from a window."""
    parts = F.split(formatted, "</turn>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(whole, lambda p: F.struct(unescape_role(F.substring_index(p, ": ", 1).substr(F.lit(5), F.length(p))).alias("role"), unescape(p.substr(F.length(F.substring_index(p, ": ", 1)) + 3, F.length(p))).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """Read back from the windows, one row a conversation; a digest is of a whole conversation, which so must fit in a row (2 GiB)."""
    fresh = F.slice(parsed(F.col("formatted")), F.col("context_turns") + 1, F.col("turns"))
    told = windows(conversations).select("conv_id", "window", fresh.alias("fresh"), masked_text(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").alias("chars"))
    flat = F.array_join(F.transform("fresh", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    per = told.select("conv_id", F.struct("window", flat.alias("turns"), "loss").alias("w"), F.size("fresh").alias("n"), "chars")
    ordered = F.array_sort("ws")
    one = per.groupBy("conv_id").agg(F.sum("n").cast("bigint").alias("n_turns"), F.collect_list("w").alias("ws"), F.sum("chars").cast("bigint").alias("formatted_chars"))
    turns = F.array_join(F.transform(ordered, lambda x: x["turns"]), "")
    loss = F.array_join(F.transform(ordered, lambda x: x["loss"]), "")
    return one.select("conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


#: Fixed value: the conversation that the query adds.
PROBE = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = [spark.range(1).select(F.lit(-7).cast(T.LongType()).alias("conv_id"), F.lit(i).cast(T.LongType()).alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for i, role in enumerate(("user", "assistant"))]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows[0]).unionByName(rows[1])
