"""Chat formatting in budgeted windows. DataFrame functions only.

Prefix sums of turn tokens cut a conversation into windows at turn borders. A window shows the system turn
again, then as much of the end of the window before it as the history budget allows, then its own turns; all
of it within the budget. Repeated turns are marked and lie outside the loss mask, so each assistant text is a
target once.

Template: ``<turn:ROLE>\\nTEXT\\n</turn>\\n``; a repeated turn opens with ``<again:ROLE>``. Inside roles and
texts ``&`` and ``<`` become ``&amp;`` and ``&lt;`` (in roles ``>`` and a line feed too), so no text can hold
a mark, and undoing it gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.llm.common import sha256_text

END = "\n</turn>\n"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, ("&", "&amp;"), ("<", "&lt;"))


def unescape(c: Column) -> Column:
    return _swap(c, ("&lt;", "<"), ("&amp;", "&"))


def escape_role(c: Column) -> Column:
    return _swap(escape(c), (">", "&gt;"), ("\n", "&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(_swap(c, ("&#10;", "\n"), ("&gt;", ">")))


def token_estimate(text: Column) -> Column:
    """An estimate: four code points a token, and four tokens of marks a turn. Any Column function of the text can stand for it."""
    return F.lit(4) + F.ceil(F.length(text) / 4)


def format_windows(conversations: DataFrame, *, budget: int = 512, history: int = 128, tokens=token_estimate) -> DataFrame:
    """(conv_id, window, formatted, loss: array of [start, end) in code points, n_new, n_tokens) for each window.

    The budget holds the system turn, the history and the window's own turns. What the first two may take is
    set aside; own turns are dealt by halves of the rest: those whose prefix sums begin in one half share a
    window, and a turn over half is a window of its own. So a window goes over the budget only where one own
    turn, with the system turn, does; turns are never cut.

    Input: (conv_id, turn, role, text), other columns are ignored. Null roles and texts are empty; turns
    with one number (or none) are ordered by role and text. A null conv_id is one conversation. An empty table
    gives an empty table. The turns of one conversation are sorted in one task.
    """
    conv = ["conv_id"]
    in_order = Window.partitionBy(*conv).orderBy("turn", "role", "text")
    by_ord = Window.partitionBy(*conv).orderBy("ord")
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("ord", F.row_number().over(in_order)).withColumn("n", tokens(F.col("text")).cast("long"))
    system = (F.col("ord") == 1) & (F.col("role") == "system")
    t = t.withColumn("before", F.sum("n").over(by_ord) - F.col("n"))
    t = t.withColumn("head", F.coalesce(F.sum(F.when(system, F.col("n"))).over(Window.partitionBy(*conv)), F.lit(0)))
    t = t.withColumn("half", F.greatest(F.floor((F.lit(budget - history) - F.col("head")) / 2), F.lit(1)))
    t = t.withColumn("big", F.col("n") > F.col("half")).withColumn("bin", F.floor(F.col("before") / F.col("half")))
    new = F.col("big") | F.coalesce(F.lag("big").over(by_ord) | (F.lag("bin").over(by_ord) != F.col("bin")), F.lit(True))
    t = t.withColumn("span", F.sum(new.cast("long")).over(by_ord) - 1)
    t = t.withColumn("own", F.sum("n").over(Window.partitionBy("conv_id", "span")))
    following = Window.partitionBy(*conv).orderBy("span").rangeBetween(1, 1)
    t = t.withColumn("next_start", F.min("before").over(following)).withColumn("next_own", F.min("own").over(following))
    left = F.least(F.lit(history), F.lit(budget) - F.col("head") - F.col("next_own"))
    again = (F.col("next_start") - F.col("before") <= left) & ~system
    shown = F.array(F.struct(F.col("span").alias("window"), F.lit(2).alias("part")))
    shown = F.when(again, F.concat(shown, F.array(F.struct((F.col("span") + 1).alias("window"), F.lit(1).alias("part"))))).otherwise(shown)
    rows = t.select("conv_id", "ord", "role", "text", "n", F.inline(shown))
    spans = t.where("span > 0").select("conv_id", F.col("span").alias("window")).distinct()
    heads = t.where(system).select("conv_id", "ord", "role", "text", "n")
    heads = heads.join(spans, heads["conv_id"].eqNullSafe(spans["conv_id"])).select(heads["conv_id"], "ord", "role", "text", "n", "window", F.lit(0).alias("part"))
    rows = rows.unionByName(heads)

    mark = F.when(F.col("part") == 2, "<turn:").otherwise("<again:")
    rows = rows.withColumn("head", F.concat(mark, escape_role(F.col("role")), F.lit(">\n"))).withColumn("body", escape(F.col("text")))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    in_window = Window.partitionBy("conv_id", "window").orderBy("part", "ord")
    start = F.coalesce(F.sum(size).over(in_window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    target = (F.col("part") == 2) & (F.col("role") == "assistant")
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("body"))
    piece = F.struct("part", "ord", F.concat("head", "body", F.lit(END)).alias("shown"), F.when(target, F.struct("start", "end")).alias("loss"))
    out = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count(F.when(F.col("part") == 2, 1)).alias("n_new"), F.sum("n").alias("n_tokens"))
    return out.select(
        "conv_id",
        "window",
        F.array_join(F.col("p.shown"), "").alias("formatted"),
        F.filter(F.col("p.loss"), lambda x: x.isNotNull()).alias("loss"),
        "n_new",
        "n_tokens",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What formatted windows hold: (conv_id, window, turns: array of (again, role, text), loss_text, chars)."""
    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">\n", 1)
        return F.struct(
            F.startswith(head, F.lit("<again:")).alias("again"),
            unescape_role(F.substring(head, F.instr(head, ":") + 1, F.length(head))).alias("role"),
            unescape(F.substring(piece, F.length(head) + 3, F.length(piece))).alias("text"),
        )

    pieces = F.split("formatted", END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select(
        "conv_id", "window", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("chars")
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    read = read_windows(format_windows(talks.unionByName(extra)))
    new = F.filter("turns", lambda t: ~t["again"])
    flat = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", F.struct("window", flat.alias("flat"), "loss_text").alias("w"), F.size(new).alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.col("w.loss_text"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        sha256_text(F.array_join(F.col("w.flat"), "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha256_text(loss).alias("loss_sha256"),
        "formatted_chars",
    )


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord,
    4 + ceil(length(text) / 4)::BIGINT AS n FROM c
), b AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY ord) - n AS before,
    coalesce(sum(n) FILTER (ord = 1 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS head FROM o
), h AS (SELECT *, greatest(floor((512 - 128 - head) / 2)::BIGINT, 1) AS half FROM b
), g AS (SELECT *, n > half AS big, floor(before / half)::BIGINT AS bin FROM h
), w AS (
  SELECT *, big OR coalesce(lag(big) OVER v OR lag(bin) OVER v <> bin, true) AS fresh FROM g WINDOW v AS (PARTITION BY conv_id ORDER BY ord)
), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY ord) - 1 AS span FROM w
), x AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, span) AS own FROM s
), e AS (
  SELECT *, min(own) OVER y AS next_own, min(before) OVER y AS next_start FROM x
  WINDOW y AS (PARTITION BY conv_id ORDER BY span RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)
), r AS (
  SELECT conv_id, role, text, 5 AS mark FROM e
  UNION ALL SELECT conv_id, role, text, 6 FROM e
    WHERE next_start - before <= least(128, 512 - head - next_own) AND NOT (ord = 1 AND role = 'system')
  UNION ALL SELECT e.conv_id, role, text, 6 FROM e JOIN (SELECT DISTINCT conv_id, span FROM e WHERE span > 0) x
    ON e.conv_id IS NOT DISTINCT FROM x.conv_id WHERE ord = 1 AND role = 'system'
), f AS (
  SELECT conv_id, sum(mark + 1 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&#10;'))
    + 2 + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 9)::BIGINT AS formatted_chars FROM r GROUP BY conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '') AS loss FROM o GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
