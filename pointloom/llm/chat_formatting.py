"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, only its text under the loss
mask. A turn is ``<s>[INST]role[/INST]text</s>``; a control string inside a role or text is broken by a backslash,
and a backslash is doubled, so the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
TARGET = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = TARGET) -> DataFrame:
    """conv_id, example (from 1), n_turns in it, formatted, loss_start (code points, from 0), loss_length.

    Turns go by (turn, role, text), so equal and repeated turn numbers have a fixed order, null numbers first; each
    repeated row is a turn. A null role or text is empty. A conversation that doesn't end in a target turn has one
    more example, with nothing under the mask, so that every turn is in the output. A conversation is one unit of
    work: its examples hold its turns over and over, as this method does. One shuffle, by conversation.
    """
    c = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    shaped = F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END)).alias("head"), escape(t["text"]).alias("body")))
    size = F.size("t")
    targets = F.filter(F.sequence(F.lit(1), size), lambda i: (F.element_at("t", i)["role"] == target) | (i == size))
    each = turns.select("conv_id", shaped.alias("t")).select("conv_id", "t", F.posexplode(targets).alias("k", "i"))
    last = F.element_at("t", F.col("i"))
    context = F.array_join(F.transform(F.slice("t", 1, F.col("i") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    each = each.select("conv_id", (F.col("k") + 1).alias("example"), F.col("i").alias("n_turns"), context.alias("context"), last.alias("last"))
    return each.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("context", "last.head", "last.body", F.lit(CLOSE)).alias("formatted"),
        (F.length("context") + F.length("last.head")).cast("long").alias("loss_start"),
        F.when(F.col("last.role") == target, F.length("last.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and masked text of each conversation, from the formatted text alone: conv_id, turns, loss, formatted_chars."""
    turn = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"
    masked = unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", masked.alias("loss")))).alias("parts"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    roles, texts = (F.regexp_extract_all("whole", F.lit(turn), F.lit(k)) for k in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    return by.select("conv_id", turns.alias("turns"), F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"), "formatted_chars")


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    extra = spark.sql("""select -7L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text
                         union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'""")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_examples(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, row_number() over w as rn, count(*) over (partition by conv_id) as n,
         20 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'))
            + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) as len
  from c window w as (partition by conv_id order by turn, role, text)
), s as (
  select *, sum(len) over (partition by conv_id order by rn) as upto from e
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(upto) filter (role = 'assistant' or rn = n)::bigint as formatted_chars
from s group by conv_id
"""
