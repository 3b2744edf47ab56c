"""Chat formatting whose output reads back as the turns it was made of; DataFrame operations only.

Grammar: ``conversation := turn*``, ``turn := "### " role ": " body "</turn>\\n"``. A backslash stands for
the character after it, whatever that is; a role ends at the first ": " outside such pairs, a body at the first
"</turn>\\n", and neither holds "###" or "</turn>". The parser reads from left to right once: it first doubles each pair's
backslash to its other side (``\\x`` becomes ``\\x\\``), after which no control string can be found across or inside a
pair, and what it finds is the grammar's. Each conversation is rendered as it is, the result parsed and compared with the
source; where it differs (a text holds a control string or a backslash) it is rendered again with the
conflicting content escaped, and compared again, until identical. Escaping puts a backslash before each
backslash and inside each control string, so that none is left whole; that level is always identical.

Turns are ordered by turn, then role, then text (nulls first). Null texts and roles are empty, repeated
rows are turns of their own, and a null conversation id is a conversation like another. A conversation
is one output string, so its turns meet in one task; conversations don't. Other columns aren't read, whatever their names.
An empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import table

# Fixed values of the template.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
#: Turns whose places are summed up together.
BLOCK = 256


def escaped(s: Column) -> Column:
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit(CLOSE), F.lit("<\\/turn>"))
    return F.regexp_replace(s, "#(?=##)", r"#\\")


def role_escaped(s: Column) -> Column:
    return F.regexp_replace(escaped(s), ":(?= )", r":\\")


def unescaped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def closed(s: Column) -> Column:
    """Each escaped character with a backslash on either side, read from left to right."""
    return F.regexp_replace(s, r"(?s)\\(.)", r"\\$1\\")


def opened(s: Column) -> Column:
    """closed() text without its backslashes."""
    return F.regexp_replace(s, r"(?s)\\(.)\\", "$1")


def width(s: Column) -> Column:
    """Characters that closed() text had before."""
    return F.length(s) - F.regexp_count(s, F.lit(r"(?s)\\.\\"))


def rendered(turns: Column, escape: bool) -> Column:
    """The text of an array of (role, text)."""
    role, body = (role_escaped, escaped) if escape else ((lambda s: s), (lambda s: s))
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t["role"]), F.lit(SEP), body(t["text"]), F.lit(CLOSE + "\n"))))


def parsed(text: Column) -> Column:
    """The array of (role, text, head, body: characters up to the body, and of it) that a rendered text stands for; null if it breaks the grammar."""
    parts = F.split(closed(text), CLOSE + "\n", -1)
    heads = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        at = F.instr(rest, SEP)
        role, body = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + len(SEP), F.length(rest))
        good = p.startswith(OPEN) & (at > 0) & ~F.contains(rest, F.lit("###")) & ~F.contains(rest, F.lit(CLOSE))
        return F.when(good, F.struct(opened(role).alias("role"), opened(body).alias("text"), (width(role) + len(OPEN) + len(SEP)).alias("head"), width(body).alias("body")))

    turns = F.transform(heads, turn)
    return F.when(F.forall(turns, lambda t: t.isNotNull()) & (F.element_at(parts, -1) == ""), turns)


def pairs(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def running(sizes: Column, first: Column) -> Column:
    """Where each of the sizes begins, from first on."""
    zero = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, lambda a, n: F.struct((a["at"] + n).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def begins(sizes: Column) -> Column:
    """As running() from 0, over blocks of BLOCK, so that the cost is near linear however many sizes there are."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: (a + n).cast("int")))
    return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), lambda b, at: running(b, at)))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, formatted, level (0: as it was, 1: escaped), turns read back, loss_spans.

    loss_spans: (start, end) in code points of formatted, of each assistant turn's body.
    """
    rows = rows.select(
        rows[conv].alias(conv),
        F.struct(rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text")).alias("__t"),
    )
    chats = rows.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list("__t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("__source"))
    done = chats.withColumn("__plain", rendered(F.col("__source"), False)).withColumn("__read", parsed(F.col("__plain")))
    done = done.withColumn("level", F.when(F.equal_null(pairs(F.col("__read")), F.col("__source")), 0).otherwise(1))
    done = done.withColumn("formatted", F.when(F.col("level") == 0, F.col("__plain")).otherwise(rendered(F.col("__source"), True)))
    done = done.withColumn("__read", F.when(F.col("level") == 0, F.col("__read")).otherwise(parsed(F.col("formatted"))))
    same = (F.col("level") == 0) | F.equal_null(pairs(F.col("__read")), F.col("__source"))
    done = done.withColumn("__read", F.when(same, F.col("__read")).otherwise(F.raise_error(F.lit("a conversation did not read back as it was"))))
    starts = begins(F.transform("__read", lambda t: (t["head"] + t["body"] + len(CLOSE) + 1).cast("int")))
    spans = F.zip_with(starts, F.col("__read"), lambda s, t: F.struct((s + t["head"]).alias("start"), (s + t["head"] + t["body"]).alias("end"), t["role"].alias("role")))
    spans = F.transform(F.filter(spans, lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return done.select(conv, "formatted", "level", pairs(F.col("__read")).alias("turns"), spans.alias("loss_spans"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, span by span, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))))


def query(spark, sf_dir):
    """op8: every conversation, and one (id -7) of nothing but control strings, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    done = format_chats(rows.unionByName(more))
    loss = under_mask(F.col("formatted"), F.col("loss_spans"))
    return done.select("conv_id", F.col("turns"), F.col("formatted"), F.coalesce(loss, F.lit("")).alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), each as (
  select *,
    contains(role || text, '\') or contains(role || text, '###') or contains(role || text, '</turn>') or contains(role, ': ') as hard,
    list_sum(list_transform(regexp_extract_all(role || chr(10) || text, '#{3,}'), lambda x: length(x) - 2)) as hashes,
    length(role || text) - length(replace(role || text, '\', '')) as slashes,
    (length(role || chr(10) || text) - length(replace(role || chr(10) || text, '</turn>', ''))) / 7 as closes,
    (length(role) - length(replace(role, ': ', ''))) / 2 as colons
  from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(length(role) + length(text) + 14) + case when bool_or(hard) then sum(coalesce(hashes, 0) + slashes + closes + colons) else 0 end)::bigint as formatted_chars
from each group by conv_id
"""
