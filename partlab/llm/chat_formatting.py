"""Preference formatting of conversations.

The longest common prefix of turns (equal role and text) of the chosen and the rejected
conversation is rendered once, as the prompt. What follows is rendered as two completions,
each with the character spans that a loss counts: what the assistant says, with its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn:bigint,role:string,text:string>"
SPANS = "array<struct<start:int,end:int>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("none")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>"))


def render(turns: Column) -> Column:
    """Text of an array of turns; no turns give the empty text. A null role is rendered as
    ``none``, a null text as empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) in characters of :func:`render`'s text, one for each assistant turn."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        more = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(SPANS))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], more).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(turns, first, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(F.size(same))


def collect_turns(turns: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: (key, turns), ordered by turn, then role, then text (nulls first),
    so ties and repeated rows have one order. A conversation's row is what has to be rendered
    as one text anyway. A row whose key is null belongs to no other: it is a conversation of its
    own."""
    said = F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    whole = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    return whole.unionAll(turns.where(F.col(key).isNull()).select(F.col(key).alias(key), F.array(said).alias("turns")))


def format_arrays(pairs: DataFrame, key: str, chosen: str, rejected: str) -> DataFrame:
    """From (key, chosen turns, rejected turns) to (key, n_prompt_turns, prompt, chosen,
    rejected, chosen_spans, rejected_spans). A null side counts as no turns."""
    none = F.array().cast(f"array<{TURN}>")
    p = pairs.select(F.col(key), F.coalesce(F.col(chosen), none).alias("__a"), F.coalesce(F.col(rejected), none).alias("__b"))
    p = p.withColumn("__n", common_turns(F.col("__a"), F.col("__b")))
    rest = lambda c: F.slice(F.col(c), F.col("__n") + 1, F.greatest(F.size(c), F.lit(1)))
    return p.select(
        key,
        F.col("__n").cast("long").alias("n_prompt_turns"),
        render(F.slice("__a", F.lit(1), F.col("__n"))).alias("prompt"),
        render(rest("__a")).alias("chosen"),
        render(rest("__b")).alias("rejected"),
        trained_spans(rest("__a")).alias("chosen_spans"),
        trained_spans(rest("__b")).alias("rejected_spans"),
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Pairs from two tables of turns (key, turn, role, text). A key on one side only is paired
    with a conversation of no turns, and so is each row without a key. Extra columns are left
    out."""
    a, b = collect_turns(chosen, key), collect_turns(rejected, key)
    c, r = a.withColumnRenamed("turns", "__c"), b.select(F.col(key).alias("__k"), F.col("turns").alias("__r"))
    joined = c.where(F.col(key).isNotNull()).join(r.where("__k IS NOT NULL"), F.col(key) == F.col("__k"), "full").select(F.coalesce(F.col(key), F.col("__k")).alias(key), "__c", "__r")
    lone = c.where(F.col(key).isNull()).select(key, "__c", F.lit(None).cast(f"array<{TURN}>").alias("__r"))
    lone = lone.unionAll(r.where("__k IS NULL").select("__k", F.lit(None).cast(f"array<{TURN}>"), "__r"))
    return format_arrays(joined.unionAll(lone), key, "__c", "__r")


def regurgitated(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected): chosen is the conversation, rejected says in its last assistant
    turn what the assistant turn before it says (nothing, if there is none). Without an
    assistant turn both are equal."""
    c = collect_turns(conversations, key)
    own = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == "assistant")
    c = c.withColumn("__own", own).withColumn("__last", F.when(F.size("__own") > 0, F.element_at("__own", -1)["i"]).otherwise(-1))
    before = F.when(F.size("__own") > 1, F.coalesce(F.try_element_at("__own", F.lit(-2))["text"], F.lit(""))).otherwise("")
    c = c.withColumn("__before", before)
    said = lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("__last"), F.col("__before")).otherwise(t["text"]).alias("text"))
    return c.select(key, F.col("turns").alias("chosen"), F.transform("turns", said).alias("rejected"))


def preference_digest(conversations: DataFrame) -> DataFrame:
    """The formatted pairs of :func:`regurgitated`, spans written as ``start:end,...``."""
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    out = format_arrays(regurgitated(conversations), "conv_id", "chosen", "rejected")
    return out.withColumns({c: flat(c) for c in ("chosen_spans", "rejected_spans")})


def _duck_spans(turns: str) -> str:
    head = "len('<|' || coalesce(t.role, 'none') || '|>' || chr(10))"
    body = "len(coalesce(t.text, '') || '<|end|>')"
    start = f"list_sum(list_transform({turns}[1:i - 1], lambda t: {head} + {body} + 1))"
    return f"""array_to_string(list_filter(list_transform(range(1, len({turns}) + 1), lambda i: CASE WHEN {turns}[i].role = 'assistant' THEN
        (coalesce({start}, 0) + {head.replace('t.', f'{turns}[i].')})::BIGINT || ':' || (coalesce({start}, 0) + {head.replace('t.', f'{turns}[i].')} + {body.replace('t.', f'{turns}[i].')})::BIGINT END), lambda s: s IS NOT NULL), ',')"""


def oracle() -> str:
    """DuckDB SQL for :func:`preference_digest`."""
    text = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: '<|' || coalesce(t.role, 'none') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '')"
    return f"""
    WITH c AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
          UNION ALL SELECT conv_id, [{{'turn': turn, 'role': role, 'text': text}}] FROM conversations WHERE conv_id IS NULL),
    o AS (SELECT conv_id, ts, list_filter(range(1, len(ts) + 1), lambda i: ts[i].role = 'assistant') AS own FROM c),
    p AS (SELECT conv_id, ts AS a, list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN len(own) > 0 AND i = own[-1]
            THEN {{'turn': ts[i].turn, 'role': ts[i].role, 'text': CASE WHEN len(own) > 1 THEN coalesce(ts[own[-2]].text, '') ELSE '' END}} ELSE ts[i] END) AS b FROM o),
    n AS (SELECT *, len(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(list_transform(range(1, i + 1), lambda j: a[j].role IS NOT DISTINCT FROM b[j].role AND a[j].text IS NOT DISTINCT FROM b[j].text), false))) AS k FROM p),
    r AS (SELECT conv_id, k, a[1:k] AS pr, a[k + 1:len(a)] AS ca, b[k + 1:len(b)] AS cb FROM n)
    SELECT conv_id, k::BIGINT AS n_prompt_turns, {text('pr')} AS prompt, {text('ca')} AS chosen, {text('cb')} AS rejected,
           coalesce({_duck_spans('ca')}, '') AS chosen_spans, coalesce({_duck_spans('cb')}, '') AS rejected_spans FROM r
    """
