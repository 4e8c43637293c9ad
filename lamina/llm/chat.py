r"""Chat formatting with budgeted windows, in DataFrame operations only.

Turns of a conversation (rows by turn; ties by role, then text) are laid into windows of at most `budget`
tokens. The prefix sums of the turns' tokens choose the spans: a window takes new turns from where the last
one ended for as long as prefix[end] - prefix[begin] fits what the budget leaves after the system turn (the
first turn, if its role is `system`; every window begins with it) and after the repeated history (up to
`history` turns before the span, at most `history_share` of the budget, nearest first). A turn that alone exceeds the budget gets a
window of its own and is kept whole (`over_budget`). Windows are aligned to turns; no text is cut.

A turn is written as `<|turn|>role\ntext<|end|>`, a repeated one (system turn or history) as `<|seen|>...`.
Control strings inside roles and texts (CONTROL) are broken by `\-` after their first character; a
backslash of the text is doubled before, so `unescape` gives back every text exactly.

loss_spans are code point ranges of `formatted` that hold the text of *new* assistant turns: repeated ones
are masked, so over all windows each assistant text is a target exactly once.

A turn's tokens are its words plus `per_turn`. A null text or role is empty. A null conv_id is a
conversation of its own. Repeated rows are turns of their own. Extra columns are ignored, empty tables give
empty results. A conversation is only ever gathered as its turns' token counts; texts meet by window. Folds carry
ints and put them away in blocks, so a conversation of very many turns takes time nearly linear in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, require

# What may begin or end a turn, here or in well-known templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
TURN, SEEN, END = "<|turn|>", "<|seen|>", "<|end|>"
BUDGET = 512
HISTORY = 2
HISTORY_SHARE = 0.25
PER_TURN = 4
#: Steps of a fold after which its results are put away.
BLOCK = 256

# a control string's first character, with the rest of it ahead
_BREAK = r"<(?=\||s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)|\|(?=>)|\[(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, r"$0\\-")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|-)", "$1")


def _numbered(turns: DataFrame, per_turn: int) -> DataFrame:
    require(turns, "conv_id", "turn", "role", "text")
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return plain.select("conv_id", (F.row_number().over(order) - 1).alias("i"), "role", "text", (n_words(F.col("text")) + per_turn).cast("int").alias("tokens"))


def _folded(begin: Column, end: Column, start: Column, state: Callable, made: Callable) -> Column:
    """Fold over the numbers from begin to before end: all the ints that the arrays made(state, j) hold.
    A fold copies what it carries at each step: so it carries ints alone, and those of a block are put away with it."""
    none = F.array().cast("array<int>")
    starts = F.when(end > begin, F.sequence(begin, end - 1, F.lit(BLOCK))).otherwise(none)

    def block(a: Column, first: Column) -> Column:
        def step(e: Column, j: Column) -> Column:
            return F.struct(state(e["state"], j).alias("state"), F.concat(e["ints"], made(e["state"], j)).alias("ints"))

        def put_away(e: Column) -> Column:
            return F.struct(e["state"].alias("state"), F.concat(a["done"], e["ints"]).alias("done"))

        return F.aggregate(F.sequence(first, F.least(first + BLOCK, end) - 1), F.struct(a["state"].alias("state"), none.alias("ints")), step, put_away)

    return F.aggregate(starts, F.struct(start.alias("state"), none.alias("done")), block)["done"]


def spans(numbered: DataFrame, budget: int, history: int, share: float) -> DataFrame:
    """conv_id, window, first (of the repeated history), begin, end, has_system, over_budget."""
    # before: tokens of the turns before each
    order = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = numbered.select("conv_id", "i", "tokens", (F.col("role") == "system").alias("system"), F.sum("tokens").over(order).alias("upto"))
    per = sums.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "upto", "tokens", "system"))).alias("t"))
    per = per.select(
        "conv_id", F.col("t")[0]["system"].alias("has_system"), F.size("t").alias("n"),
        (F.lit(budget) - F.when(F.col("t")[0]["system"], F.col("t")[0]["tokens"]).otherwise(0)).alias("room"),
        F.concat(F.array(F.lit(0).cast("long")), F.col("t.upto")).alias("prefix"),
    ).withColumn("begin", F.col("has_system").cast("int"))

    def at(j: Column) -> Column:
        return F.element_at("prefix", (j + 1).cast("int"))

    def history_of(j: Column) -> Column:
        """The first turn of the history of a span that begins at turn j."""
        ways = [F.when((j - h >= F.col("begin")) & (at(F.greatest(j - h, F.lit(0))) + F.lit(int(budget * share)) >= at(j)), j - h) for h in range(history, 0, -1)]
        return F.coalesce(*ways, j)

    def first_of(j: Column) -> Column:
        """The first turn of a window whose span begins at j: history goes if the turn doesn't fit beside it."""
        back = history_of(j)
        return F.when(at(j + 1) - at(back) <= F.col("room"), back).otherwise(j)

    def fits(a: Column, j: Column) -> Column:
        return (j == a["begin"]) | (at(j + 1) - at(a["first"]) <= F.col("room"))

    def joined(a: Column, j: Column) -> Column:
        """Turn j joins the open span, or begins the next one."""
        return F.when(fits(a, j), a).otherwise(F.struct(first_of(j).alias("first"), j.alias("begin")))

    none = F.array().cast("array<int>")
    start = F.struct(F.col("begin").alias("first"), F.col("begin").alias("begin"))
    later = _folded(F.col("begin"), F.col("n"), start, joined, lambda a, j: F.when(fits(a, j), none).otherwise(F.array(j)))
    per = per.withColumn("begins", F.concat(F.array("begin"), later))

    def window(begin: Column, k: Column) -> Column:
        first = F.when(k == 0, begin).otherwise(first_of(begin))
        end = F.coalesce(F.get("begins", k + 1), "n")
        return F.struct(first.alias("first"), begin.alias("begin"), end.alias("end"), (at(end) - at(first) > F.col("room")).alias("over_budget"))

    # prefix must not go along with every window
    per = per.select("conv_id", "has_system", F.transform("begins", window).alias("done"))
    # outer: no window array is empty, and Catalyst infers no filter that would make the arrays a second time
    return per.select("conv_id", "has_system", F.posexplode_outer("done").alias("window", "w")).select("conv_id", "window", "w.first", "w.begin", "w.end", "has_system", "w.over_budget")


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, history_share: float = HISTORY_SHARE, per_turn: int = PER_TURN) -> DataFrame:
    """conv_id, window, formatted, loss_spans (array of begin, end), n_new (turns that are not repeated),
    tokens, over_budget."""
    if budget < 1 or history < 0 or not 0 <= history_share <= 1:
        raise ValueError("budget must be positive, history not negative, history_share from 0 to 1")
    numbered = _numbered(turns, per_turn)
    chosen = spans(numbered, budget, history, history_share)
    shown = chosen.select("*", F.explode(F.concat(F.when(F.col("has_system"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(F.col("end") > F.col("first"), F.sequence("first", F.col("end") - 1)).otherwise(F.array().cast("array<int>")))).alias("i"))
    shown = shown.withColumnRenamed("conv_id", "c_").withColumnRenamed("i", "i_")
    rows = shown.join(numbered, F.col("c_").eqNullSafe(F.col("conv_id")) & (F.col("i_") == F.col("i")))
    new = ((F.col("i") >= F.col("begin")) & (F.col("i") < F.col("end"))) | ((F.col("window") == 0) & (F.col("i") == 0))
    rows = rows.withColumn("new", new).withColumn("head", F.concat(F.when(F.col("new"), F.lit(TURN)).otherwise(F.lit(SEEN)), escape(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    item = F.struct("i", "head", "body", (F.col("new") & (F.col("role") == "assistant")).alias("target"), "new", "tokens")
    per = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(item)).alias("t"), F.first("over_budget").alias("over_budget"))

    def begin(at: Column, x: Column) -> Column:
        return (at + F.length(x["head"])).cast("int")

    def behind(at: Column, x: Column) -> Column:
        return (begin(at, x) + F.length(x["body"])).cast("int")

    def of(j: Column) -> Column:
        return F.element_at("t", j + 1)

    edges = _folded(
        F.lit(0), F.size("t"), F.lit(0), lambda at, j: behind(at, of(j)) + len(END),
        lambda at, j: F.when(of(j)["target"], F.array(begin(at, of(j)), behind(at, of(j)))).otherwise(F.array().cast("array<int>")),
    )
    per = per.withColumn("edges", edges)
    numbers = F.when(F.size("edges") > 0, F.sequence(F.lit(0), F.size("edges") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    loss_spans = F.transform(numbers, lambda k: F.struct(F.get("edges", k).alias("begin"), F.get("edges", k + 1).alias("end")))
    return per.select(
        "conv_id", "window", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), loss_spans.alias("loss_spans"),
        F.aggregate("t", F.lit(0), lambda a, x: a + x["new"].cast("int")).alias("n_new"), F.aggregate("t", F.lit(0), lambda a, x: a + x["tokens"]).alias("tokens"), "over_budget",
    )


def parsed(formatted: Column) -> Column:
    """The turns that are not repeated, read back: array of (role, text)."""
    turns = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|turn\|>(.*?)<\|end\|>"), F.lit(1))
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(t, "\n", 1)).alias("role"), unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text")))


def targets(formatted: Column, loss_spans: Column) -> Column:
    """Text under the loss mask, read back."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["begin"] + 1, s["end"] - s["begin"]))), "")


def digest(made: DataFrame) -> DataFrame:
    """One row a conversation, from the windows as written."""
    turns = F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.select("conv_id", "window", F.size(turns).cast("long").alias("n"), F.array_join(turns, "").alias("said"), targets(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("chars"))
    per = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return per.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
