"""Conversations as training texts: windows of whole turns under a token budget, with a loss mask.

A turn is its role's opening mark, its text and the closing mark. Control
strings inside texts and roles get a backslash after their first character (one
more if backslashes stand there already), so no text holds a mark, and taking
one backslash away gives every text back.

Running sums of the turns' tokens choose the windows. A window starts with the
conversation's system turn, then repeats the last turns before it (at most
``history`` tokens and ``history_turns`` turns, whole turns only), then takes new
turns while all of it stays within ``budget``. The loss mask covers the texts
of new assistant turns, so each is a target once; repeated ones are masked.
No turn is cut: one that doesn't fit beside the system turn stands in a
window of its own without history, longer than the budget.

A conversation is laid out in blocks of ``BLOCK`` budgets of tokens, each of
which starts a window of its own (with the history before it), so a row holds
a bounded stretch however long the conversation is; positions and running sums
come from ``running.ordered``, which splits a long conversation over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import ordered

BUDGET, HISTORY, HISTORY_TURNS = 2048, 512, 4
BLOCK = 64
#: A mark's share of a turn's tokens.
MARK_TOKENS = 4
#: About as many tokens as a word-piece vocabulary takes: six letters or digits, or one sign.
PIECES = r"[\p{L}\p{N}]{1,6}|[^\p{L}\p{N}\s]"

#: The marks of the roles that have their own, and of others (role between the first two).
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[TEXT]", "[/TURN]")

_AFTER = {
    c: "|".join(m[1:].replace("[", r"\[").replace("]", r"\]") for pair in (*MARKS.values(), OTHER) for m in pair if m[0] == c)
    for c in "<["
}
_ESCAPE = "|".join(rf"(?<=[{c}])(?=\\*(?:{_AFTER[c]}))".replace("[[]", r"\[") for c in "<[")
_UNESCAPE = "|".join(rf"(?<=[{c}])\\(?=\\*(?:{_AFTER[c]}))".replace("[[]", r"\[") for c in "<[")
_TURN = "(?s)" + "|".join([
    *(rf"\Q{a}\E.*?\Q{b}\E" for a, b in MARKS.values()), rf"\Q{OTHER[0]}\E.*?\Q{OTHER[1]}\E.*?\Q{OTHER[2]}\E"])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECES)).cast("bigint")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    for r, (a, _) in MARKS.items():
        out = F.when(role == r, F.lit(a)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for r, (_, b) in MARKS.items():
        out = F.when(role == r, F.lit(b)).otherwise(out)
    return out


def _stretches(turns: DataFrame, history: int, grid: int) -> DataFrame:
    """(conv_id, block, system, turns): the turns of each block in order, after those before it that it may repeat."""
    before = F.col("upto") - F.col("tokens")
    turns = turns.withColumn("before", before).withColumn("block", F.expr(f"before div {grid}"))
    turns = turns.withColumn("is_system", (F.col("pos") == 0) & (F.col("role") == "system"))
    next_too = F.expr(f"(before + {history}) div {grid} > block and not is_system")
    spread = turns.withColumn("own", F.col("block")).withColumn(
        "block", F.explode(F.when(next_too, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    # The system turn goes to each later block of its conversation.
    later = turns.where("block > 0").select("conv_id", "block").distinct()
    system = turns.where("is_system").drop("block").join(later.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    rows = spread.unionByName(system.withColumn("own", F.lit(-1).cast("bigint")))
    turn = F.struct("pos", (F.col("own") == F.col("block")).alias("fresh"), "role", "text", "tokens", "before", "is_system")
    grouped = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max(F.col("own") == F.col("block")).alias("any"))
    # A block that only a long turn reaches over has no turn of its own.
    return grouped.where("any").drop("any").selectExpr(
        "conv_id", "block", "if(turns[0].is_system, turns[0], null) as system",
        "filter(turns, t -> t.fresh or not t.is_system) as turns")


def _plan(stretches: DataFrame, budget: int, history: int, history_turns: int) -> DataFrame:
    """One row a window: where its repeated turns (``h``), its new ones (``s``) and those behind it (``e``) start."""
    low = "if(turns[0].is_system, 1, 0)"
    # The system turn's tokens, but where it is among the window's new turns.
    beside = "if(system is null or (i = 0 and turns[0].is_system), 0L, system.tokens)"
    reach = (f"array_min(filter(sequence(least(i, greatest({low}, i - {history_turns})), i), j -> j = i or ("
             f"turns[i].fresh and turns[i].before - turns[j].before <= {history} and "
             f"turns[i].before + turns[i].tokens - turns[j].before + {beside} <= {budget})))")
    step = (f"if(not turns[i].fresh or (size(acc.starts) > 0 and turns[i].before + turns[i].tokens - acc.base <= {budget}), acc, "
            f"transform(array({reach}), h -> named_struct('starts', concat(acc.starts, array(named_struct('h', h, 's', i))), "
            f"'base', turns[h].before - {beside}))[0])")
    empty = "named_struct('starts', cast(array() as array<struct<h:int,s:int>>), 'base', 0L)"
    starts = f"aggregate(sequence(0, size(turns) - 1), {empty}, (acc, i) -> {step}).starts"
    return stretches.withColumn("starts", F.expr(starts)).select("conv_id", "block", "system", "turns", "starts", F.posexplode("starts")).selectExpr(
        "conv_id", "block", "pos as nth", "system is not null and not (col.s = 0 and turns[0].is_system) as with_system",
        "system", "col.h as h", "col.s as s", "turns", "if(pos + 1 < size(starts), starts[pos + 1].s, size(turns)) as e")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """The windows of all conversations: ``conv_id, block, nth, n_turns, n_repeated, n_tokens, text, loss``.

    Turns stand in the order of ``turn`` (null first; ties by role, then text). A
    null role or text is an empty one, rows without an id are one conversation,
    repeated rows are turns as often as they stand there, and other columns are
    left out. (block, nth) orders a conversation's windows; the first
    ``n_repeated`` of a window's ``n_turns`` are the system turn and history;
    ``loss`` holds (start, length) in code points of ``text`` of each target.
    """
    rows = conversations.select("conv_id", F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text")) + MARK_TOKENS)
    turns = ordered(rows, "conv_id", [F.col("_turn"), F.col("role"), F.col("text")], {"upto": ("sum", F.col("tokens"))}, "chat").drop("_turn")
    windows = _plan(_stretches(turns, history, BLOCK * budget), budget, history, history_turns)
    shown = F.concat(F.when(F.col("with_system"), F.array("system")).otherwise(F.expr("slice(turns, 1, 0)")),
                     F.expr("slice(turns, h + 1, e - h)"))
    pieces = F.transform("shown", lambda t: F.struct(
        _opening(t["role"]).alias("open"), escape(t["text"]).alias("body"), _closing(t["role"]).alias("close"), t["role"].alias("role"), t["tokens"].alias("tokens")))
    windows = windows.withColumn("shown", shown).withColumn("n_repeated", F.expr("s - h + if(with_system, 1, 0)")).select(
        "conv_id", "block", "nth", "n_repeated", pieces.alias("pieces"))
    spans = ("aggregate(sequence(0, size(pieces) - 1), named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>)), "
             "(acc, i) -> named_struct("
             "'at', acc.at + char_length(pieces[i].open) + char_length(pieces[i].body) + char_length(pieces[i].close), "
             "'spans', if(i >= n_repeated and pieces[i].role = 'assistant', concat(acc.spans, array(named_struct("
             "'start', acc.at + char_length(pieces[i].open), 'length', cast(char_length(pieces[i].body) as bigint)))), acc.spans))).spans")
    return windows.select(
        "conv_id", "block", "nth", F.size("pieces").alias("n_turns"), "n_repeated",
        F.expr("aggregate(pieces, 0L, (a, p) -> a + p.tokens)").alias("n_tokens"),
        F.expr("array_join(transform(pieces, p -> concat(p.open, p.body, p.close)), '')").alias("text"), F.expr(spans).alias("loss"))


def read_turns(text: Column) -> Column:
    """The (role, text) of a window's turns, from its text alone."""
    def one(piece: Column) -> Column:
        other = F.struct(unescape(F.regexp_extract(piece, rf"(?s)^\Q{OTHER[0]}\E(.*?)\Q{OTHER[1]}\E", 1)).alias("role"),
                         unescape(F.regexp_extract(piece, rf"(?s)\Q{OTHER[1]}\E(.*)\Q{OTHER[2]}\E$", 1)).alias("text"))
        for role, (a, b) in MARKS.items():
            inner = F.substring(piece, F.lit(len(a) + 1), F.char_length(piece) - len(a) - len(b))
            other = F.when(F.startswith(piece, F.lit(a)), F.struct(F.lit(role).alias("role"), unescape(inner).alias("text"))).otherwise(other)
        return other

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), one)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, as they were."""
    return F.transform(loss, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def read_back(windows: DataFrame) -> DataFrame:
    """Each conversation from its windows: ``conv_id, n_turns, turns, loss_text, formatted_chars``.

    ``turns`` holds role, newline, text, newline of every turn, ``loss_text`` all
    text under the mask. A conversation is one string here, so one row holds it.
    """
    new = F.expr("slice(all_turns, n_repeated + 1, size(all_turns))")
    parts = windows.withColumn("all_turns", read_turns(F.col("text"))).select(
        "conv_id", "block", "nth", new.alias("new"), F.char_length("text").cast("bigint").alias("chars"),
        F.array_join(read_loss(F.col("text"), F.col("loss")), "").alias("lost"))
    parts = parts.withColumn("said", F.expr("array_join(transform(new, t -> concat(t.role, '\\n', t.text, '\\n')), '')"))
    part = F.sort_array(F.collect_list(F.struct("block", "nth", "said", "lost")))
    return parts.groupBy("conv_id").agg(
        F.sum(F.size("new")).cast("bigint").alias("n_turns"), F.sum("chars").alias("formatted_chars"), part.alias("parts")).selectExpr(
        "conv_id", "n_turns", "array_join(transform(parts, p -> p.said), '') as turns",
        "array_join(transform(parts, p -> p.lost), '') as loss_text", "formatted_chars")
