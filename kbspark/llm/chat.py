"""Chat formatting in budgeted, turn-aligned windows (built-in functions only).

A turn is written <|im_start|>role<|im_sep|>text<|im_end|>. Inside roles and texts each "<|" becomes "<||", so no text can hold a mark, and
"<||" -> "<|" takes it back. Prefix sums of turn tokens deal turns out to stretches of bounded length, in which windows fill up
in order; each later window repeats the leading system turn and up to `history_turns` turns before it, both outside the loss mask, so
that each assistant text is a target once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import materialize

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens that a turn's marks count as.
MARKS = 4


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def token_estimate(text: Column) -> Column:
    """A token for each four bytes begun, and the marks."""
    return (F.floor((F.octet_length(text) + 3) / 4) + MARKS).cast("long")


def turns_of(conversations: DataFrame, stretch: int, history_budget: int, count_tokens: Callable[[Column], Column]) -> DataFrame:
    """c (key that is never null), conv_id, stretch, ord (place in the conversation, from 0), kind, tokens, role, text.

    Rows are sorted once over the whole table, by ranges, so that neither a long conversation nor a turn number that many rows share is one
    task's work; their prefix sums come from those within a range and those of the ranges before. A turn belongs (`own`) to the stretch of
    tokens that it starts in, goes along (`carry`) to the next one where it may be its history, and a leading system turn (`system`) goes to
    all stretches of its conversation."""
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # equal rows are split as well: the last key tells them apart, and it doesn't matter how
    t = t.orderBy(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.rand(1))
    t = materialize(t.withColumn("row", F.monotonically_increasing_id()).drop("turn"), "turns")
    t = t.withColumns({"c": F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "part": F.shiftright("row", 33), "tokens": count_tokens(F.col("text"))})

    sums = t.groupBy("c", "part").agg(F.count("*").alias("rows"), F.sum("tokens").alias("part_tokens"), F.min(F.struct("row", "role", "tokens")).alias("first"))
    whole = Window.partitionBy("c")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"n": F.sum("rows").over(whole), "all_tokens": F.sum("part_tokens").over(whole), "first": F.min("first").over(whole)})
    sums = sums.withColumns({"rows": F.coalesce(F.sum("rows").over(before), F.lit(0)), "part_tokens": F.coalesce(F.sum("part_tokens").over(before), F.lit(0))})

    so_far = Window.partitionBy("c", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"ord": F.count("*").over(so_far) - 1, "start": F.sum("tokens").over(so_far) - F.col("tokens")}).join(sums, ["c", "part"])
    t = t.withColumns({"ord": F.col("ord") + F.col("rows"), "start": F.col("start") + F.col("part_tokens")})
    is_system = (F.col("ord") == 0) & (F.col("n") > 1) & (F.col("first.role") == "system")
    own, next_one = F.floor(F.col("start") / stretch), F.floor((F.col("start") + history_budget) / stretch)
    goes = F.when(is_system, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all_tokens") - 1) / stretch)), lambda z: F.struct(z.alias("stretch"), F.lit("system").alias("kind"))))
    goes = goes.when(next_one > own, F.array(F.struct(own.alias("stretch"), F.lit("own").alias("kind")), F.struct(next_one.alias("stretch"), F.lit("carry").alias("kind"))))
    goes = goes.otherwise(F.array(F.struct(own.alias("stretch"), F.lit("own").alias("kind"))))
    return t.select("c", "conv_id", "ord", "tokens", "role", "text", F.inline(goes))


def format_chats(conversations: DataFrame, budget: int = 1024, history_budget: int = 256, history_turns: int = 2, stretch: int = 16, count_tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, first_turn (place of the window's first new turn after a leading system turn),
    n_repeated (leading turns that repeat another window's), text, loss (array of (start, end) in code points of text), n_tokens, over_budget.

    Turns go by number, nulls first, ties by role and text; a repeated row is a turn of its own. Null roles and texts are empty, a null
    conv_id is a conversation, an empty table has no windows. Windows fill up in order within each stretch of `stretch` budgets, whose turns
    are bounded in number as a turn counts one token at least; a stretch begins with a new window. Turns are never cut: a turn longer than
    the room is alone in its window, which is marked over_budget. `count_tokens` is the measure of a text (positive); history takes up to
    `history_turns` turns of `history_budget` tokens together, fewer where the new turn needs the room."""
    t = turns_of(conversations, stretch * budget, history_budget, count_tokens)
    g = t.groupBy("c", "stretch").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("ord", "kind", "tokens", "role", "text"))).alias("p"))
    g = g.withColumns({"lead": F.filter("p", lambda x: x.kind == "system"), "p": F.filter("p", lambda x: x.kind != "system")})
    g = g.withColumn("lead_tokens", F.coalesce(F.get("lead", F.lit(0)).tokens, F.lit(0)))

    def sizes(x: Column, i: Column) -> Column:
        """What the fold needs of a turn: its place from 1, whether it is new, tokens, and the history that a window starting here takes."""
        room = F.least(F.lit(history_budget), F.lit(budget) - F.col("lead_tokens") - x.tokens)
        turns, tokens, total = F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long")
        for j in range(1, history_turns + 1):
            total = total + F.when(i >= j, F.get("p", i - j).tokens)
            fits = F.coalesce(total <= room, F.lit(False))
            turns, tokens = turns + fits.cast("int"), F.when(fits, total).otherwise(tokens)
        return F.struct((i + 1).alias("i"), (x.kind == "own").alias("own"), x.tokens.alias("tokens"), turns.alias("back"), tokens.alias("back_tokens"))

    def fill(acc: Column, x: Column) -> Column:
        """Sum of the open window, and the windows (place of the first new turn, turns of history)."""
        opens = x.own & (acc.used.isNull() | (acc.used + x.tokens > budget))
        used = F.when(opens, F.col("lead_tokens") + x.back_tokens + x.tokens).otherwise(acc.used + x.tokens)
        return F.struct(used.alias("used"), F.when(opens, F.concat(acc.windows, F.array(F.struct(x.i.alias("i"), x.back.alias("back"))))).otherwise(acc.windows).alias("windows"))

    nothing = F.struct(F.lit(None).cast("long").alias("used"), F.array().cast("array<struct<i:int,back:int>>").alias("windows"))
    g = g.withColumn("sizes", F.transform("p", sizes)).withColumn("w", F.aggregate("sizes", nothing, fill, lambda acc: acc.windows))

    def window(x: Column, k: Column) -> Column:
        end = F.coalesce(F.get("w", k + 1).i, F.size("p") + 1)
        return F.struct(x.i.alias("i"), x.back.alias("back"), F.slice("p", x.i - x.back, end - x.i + x.back).alias("turns"))

    w = g.select("conv_id", "lead", F.inline(F.transform("w", window)))
    w = w.withColumn("first_turn", F.get("turns", F.col("back")).ord).withColumn("n_repeated", F.col("back") + F.when(F.col("first_turn") > 1, F.size("lead")).otherwise(0))

    def piece(x: Column, i: Column) -> Column:
        role, text = escape(x.role), escape(x.text)
        return F.struct(F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END)).alias("piece"), (F.length(role) + len(START) + len(SEP)).alias("at"), F.length(text).alias("n"), ((x.role == "assistant") & (i >= F.col("n_repeated"))).alias("target"), x.tokens.alias("tokens"))

    w = w.select("conv_id", "first_turn", "n_repeated", F.transform(F.concat("lead", "turns"), piece).alias("p"))

    def add(acc: Column, x: Column) -> Column:
        s = acc.pos + x.at
        out = F.when(x.target, F.concat(acc.out, F.array(F.struct(s.alias("start"), (s + x.n).alias("end"))))).otherwise(acc.out)
        return F.struct((acc.pos + F.length(x.piece)).alias("pos"), out.alias("out"))

    loss = F.aggregate("p", F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), add, lambda acc: acc.out)
    n_tokens = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x.tokens)
    w = w.select("conv_id", "first_turn", "n_repeated", F.array_join(F.transform("p", lambda x: x.piece), "").alias("text"), loss.alias("loss"), n_tokens.alias("n_tokens"))
    return w.withColumn("over_budget", F.col("n_tokens") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, first_turn, turns (array of (role, text): the turns that are new in the window), targets (array of texts under the mask)."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.lit(2**31 - 1) - F.col("n_repeated") - 2)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, SEP, 1)
        text = F.substring(x, F.length(role) + len(SEP) + 1, F.length(x) - F.length(role) - len(SEP) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), x.start + 1, x.end - x.start)))
    return windows.select("conv_id", "first_turn", F.transform(pieces, turn).alias("turns"), targets.alias("targets"), F.length("text").alias("n_chars"))


def digest(windows: DataFrame) -> DataFrame:
    r = read_back(windows)
    r = r.select("conv_id", "n_chars", F.struct("first_turn", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").alias("t"), F.array_join("targets", "").alias("l")).alias("w"))
    g = r.groupBy("conv_id").agg(F.sum(F.col("n_chars").cast("long")).alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    whole, loss = F.array_join(F.transform("w", lambda x: x.t), ""), F.array_join(F.transform("w", lambda x: x.l), "")
    n = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x.n)
    return g.select("conv_id", n.alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


ORACLE = """
with recursive c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, dense_rank() over (order by conv_id) c, row_number() over w - 1 o, (strlen(x) + 3) // 4 + 4 k,
             length(replace(r, '<|', '<||')) + length(replace(x, '<|', '<||')) + 32 l,
             count(*) over (partition by conv_id) > 1 and first_value(r) over w = 'system' s, (strlen(first_value(x) over w) + 3) // 4 + 4 fk
      from c window w as (partition by conv_id order by turn nulls first, r, x)),
h as (select *, case when s then fk else 0 end sk, (sum(k) over w - k) // 16384 z,
             case when o - 1 >= s::int then lag(k) over w end k1, case when o - 2 >= s::int then lag(k) over w + lag(k, 2) over w end k2
      from o window w as (partition by c order by o)),
q as (select *, coalesce(case when k2 <= least(256, 1024 - sk - k) then 2 when k1 <= least(256, 1024 - sk - k) then 1 end, 0) nb,
             row_number() over (partition by c, z order by o) i from h where not (s and o = 0)),
f as (select c, z, i, o, s, nb, true opens, sk + case nb when 2 then k2 when 1 then k1 else 0 end + k used from q where i = 1
      union all select q.c, q.z, q.i, q.o, q.s, q.nb, f.used + q.k > 1024,
             case when f.used + q.k > 1024 then sk + case q.nb when 2 then k2 when 1 then k1 else 0 end + k else f.used + k end
      from f join q on q.c = f.c and q.z = f.z and q.i = f.i + 1),
e as (select c, l from h union all select h.c, h.l from f join h on h.c = f.c and f.opens and h.o between f.o - f.nb and f.o - 1
      union all select h.c, h.l from f join h on h.c = f.c and f.opens and f.s and f.o > 1 and h.o = 0),
y as (select c, sum(l)::bigint l from e group by 1),
d as (select c, any_value(conv_id) conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by o)) turns_sha256,
             coalesce(string_agg(case when r = 'assistant' then x end, '' order by o), '') t from h group by 1)
select conv_id, n_turns, turns_sha256, length(t)::bigint loss_chars, sha256(t) loss_sha256, l formatted_chars from d join y using (c)
"""
