"""Conversations: token accounting, trimming, shrinking, daily facts, stream folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import agent_tokens

KEEP, LAST, WINDOW, RATIO = 50, 6, 32768, 0.9
TOO_LONG = "tokens limit|token limit|too many tokens|prompt too long|prompt is too long|maximum context|context window|context length|context_length"
DELTA = "choices array<struct<delta:struct<content:string,reasoning_content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"


def message_tokens(text: Column, tool: Column | None = None) -> Column:
    """4 a message, its text, and its tool call."""
    n = F.lit(4) + agent_tokens(F.coalesce(text, F.lit("")))
    return n if tool is None else n + agent_tokens(F.coalesce(tool, F.lit("")))


def called(calls: str = "tool_calls") -> Column:
    """Names and arguments of a message's tool calls as one text."""
    return F.array_join(F.transform(F.coalesce(F.col(calls), F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.coalesce(c["arguments"], F.lit("")))), "")


def totals(messages: DataFrame, system: int = 0, limit: int = WINDOW) -> DataFrame:
    """(conv_id, tokens, shrink); tool calls count where the messages have them."""
    tool = called() if "tool_calls" in messages.columns else None
    t = messages.groupBy("conv_id").agg((F.sum(message_tokens(F.col("text"), tool)) + system).cast("long").alias("tokens"))
    return t.withColumn("shrink", F.col("tokens") > int(limit * RATIO))


def trim(messages: DataFrame, keep: int = KEEP) -> DataFrame:
    """The last ``keep`` messages, without leading tool results."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("_b", F.row_number().over(back)).where(F.col("_b") <= keep)
    first = F.min(F.when(F.col("role") != "tool", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return rows.withColumn("_f", first).where(F.col("turn") >= F.col("_f")).drop("_b", "_f")


def shrink(messages: DataFrame, keep: int = LAST) -> DataFrame:
    """Conversations of more than keep + 2 messages become a summary row and their last messages.

    The kept part never begins with a tool result: it is moved back to the
    message before.  Columns (conv_id, turn, role, text); the summary has turn -1.
    """
    per = Window.partitionBy("conv_id")
    rows = messages.withColumns({"_n": F.count("*").over(per), "_b": F.row_number().over(per.orderBy(F.desc("turn")))})
    start = F.max(F.when((F.col("_b") >= keep) & (F.col("role") != "tool"), F.col("turn"))).over(per)
    rows = rows.withColumn("_old", (F.col("_n") > keep + 2) & (F.col("turn") < F.coalesce(start, F.lit(0))))
    kept = rows.where(~F.col("_old")).select("conv_id", "turn", "role", "text")
    said = rows.where("_old").groupBy("conv_id").agg(summary("role", "text", "turn", "tool_calls" if "tool_calls" in messages.columns else None).alias("text"))
    return kept.unionByName(said.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "text"))


def summary(role: str, text: str, order: str, calls: str | None = None) -> Column:
    """What the user said, 200 characters each, and the names of the tools that were called."""
    said = F.array_agg(F.when(F.col(role) == "user", F.struct(order, F.substring(text, 1, 200).alias("t"))))
    users = F.array_join(F.transform(F.array_sort(said), lambda x: x["t"]), " | ")
    if calls is None:
        return users
    names = F.array_sort(F.array_agg(F.when(F.col(role) == "assistant", F.struct(order, F.filter(F.transform(calls, lambda c: c["name"]), lambda n: n != "").alias("t")))))
    tools = F.array_join(F.flatten(F.filter(F.transform(names, lambda x: x["t"]), lambda t: t.isNotNull())), ", ")
    return F.concat_ws("; ", F.when(users != "", F.concat(F.lit("用户请求: "), users)), F.when(tools != "", F.concat(F.lit("调用过的工具: "), tools)))


def transcript(messages: DataFrame, most: int = 2000) -> DataFrame:
    """Numbered lines by conversation, long ones cut with a notice."""
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("...[truncated]"))).otherwise(F.col("text"))
    line = F.concat(F.lit("["), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("string"), F.lit("] "), F.col("role"), F.lit(": "), cut)
    rows = messages.select("conv_id", "turn", line.alias("line"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("transcript"))


def recent(messages: DataFrame, most: int = LAST, least: int = 20) -> DataFrame:
    """The last user and assistant messages of conversations whose last question and answer aren't short."""
    w = Window.partitionBy("conv_id")
    rows = messages.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    rows = rows.withColumn("_b", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("_b") <= most)
    last = lambda r: F.max_by(F.when(F.col("role") == r, F.length("text")), F.when(F.col("role") == r, F.col("turn"))).over(w)
    rows = rows.withColumns({"_u": last("user"), "_a": last("assistant")})
    return rows.where((F.col("_u") >= least) & (F.col("_a") >= least)).select("conv_id", "turn", "role", "text")


def daily_facts(facts: DataFrame, ts: str = "ts", fact: str = "fact") -> DataFrame:
    """(day, facts) distinct facts of a day in order of arrival."""
    first = facts.groupBy(F.to_date(ts).alias("day"), fact).agg(F.min(ts).alias("at"))
    return first.groupBy("day").agg(F.transform(F.array_sort(F.array_agg(F.struct("at", fact))), lambda x: x[fact]).alias("facts"))


def fold_stream(lines: DataFrame) -> DataFrame:
    """(stream_id, content, reasoning, total_tokens) from server-sent lines (stream_id, seq, line).

    Lines after the end mark and broken JSON are skipped; the last usage wins.
    """
    body = F.regexp_extract("line", r"^data:\s*(.*)$", 1)
    end = F.min(F.when(F.trim(body) == "[DONE]", F.col("seq"))).over(Window.partitionBy("stream_id"))
    rows = lines.withColumns({"b": body, "e": end}).where("b <> '' and (e is null or seq < e)").withColumn("j", F.from_json("b", DELTA))
    text = lambda name: F.coalesce(F.get(F.col("j.choices"), F.lit(0))["delta"][name], F.lit(""))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("seq", c.alias("t")))), lambda x: x["t"]), "")
    used = F.col("j.usage.total_tokens")
    return rows.groupBy("stream_id").agg(
        joined(text("content")).alias("content"), joined(text("reasoning_content")).alias("reasoning"),
        F.max_by(F.when(used.isNotNull(), used), F.when(used.isNotNull(), F.col("seq"))).alias("total_tokens"),
    )


def fold_tool_calls(lines: DataFrame) -> DataFrame:
    """(stream_id, index, id, name, arguments): fragments of each call put together in order."""
    body = F.regexp_extract("line", r"^data:\s*(.*)$", 1)
    rows = lines.select("stream_id", "seq", F.from_json(body, DELTA).alias("j")).select("stream_id", "seq", F.explode(F.get(F.col("j.choices"), F.lit(0))["delta"]["tool_calls"]).alias("c"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("seq", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy("stream_id", F.col("c.index").alias("index")).agg(joined(F.col("c.id")).alias("id"), joined(F.col("c.function.name")).alias("name"), joined(F.col("c.function.arguments")).alias("arguments"))


def speed(chunks: DataFrame) -> DataFrame:
    """(turn_id, tokens, seconds, per_second) from timed pieces of a reply."""
    got = chunks.groupBy("turn_id").agg(F.sum(agent_tokens(F.col("text"))).alias("tokens"), (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("seconds"))
    return got.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")).otherwise(0.0))


def is_too_long(message: Column) -> Column:
    """H11."""
    return F.lower(message).rlike(TOO_LONG)


def command_label(command: Column, labels: dict[str, str]) -> Column:
    """What a command is for, by its first word."""
    table = F.create_map(*[F.lit(x) for kv in sorted(labels.items()) for x in kv])
    first = F.regexp_extract(F.trim(command), r"^(\S+)", 1)
    return F.coalesce(table[first], F.concat(F.lit("run "), first))
