"""Tool logs and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tool_histogram(log: DataFrame) -> DataFrame:
    """A-05: calls by tool, most frequent first, ties by the first seen; ? for no tool.

    ``log``: seq, tool, prompt_id."""
    tool = F.when(F.coalesce("tool", F.lit("")) == "", "?").otherwise(F.col("tool"))
    return log.groupBy(tool.alias("tool")).agg(F.count("*").alias("calls"), F.min("seq").alias("first_seq")).orderBy(F.desc("calls"), "first_seq")


def calls_per_prompt(log: DataFrame) -> DataFrame:
    """A-06, A-07: calls, distinct prompts, and their ratio to one decimal, null without prompts."""
    prompts = F.count_distinct(F.when(F.col("prompt_id") != "", F.col("prompt_id")))
    return log.agg(F.count("*").alias("calls"), prompts.alias("prompts")).withColumn("per_prompt", F.round(F.try_divide(F.col("calls"), F.col("prompts")), 1))


def spoken(turns: DataFrame) -> DataFrame:
    """F-13, T-01: turns of the user or the assistant with text, trimmed."""
    return turns.where(F.col("role").isin("user", "assistant")).withColumn("text", F.trim("text")).where("text <> ''")


def rendered(turns: DataFrame, user: str = "User", assistant: str = "Assistant", least: int = 2) -> DataFrame:
    """T-03: (conv_id, turns, markdown) of conversations with ``least`` turns or more."""
    t = spoken(turns)
    label = F.when(F.col("role") == "user", user).otherwise(assistant)
    section = F.concat(F.lit("## "), label, F.lit("\n\n"), F.col("text"), F.lit("\n"))
    grouped = t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", section.alias("s")))).alias("parts"))
    head = F.concat(F.lit("# Session "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    return grouped.where(F.col("turns") >= least).select("conv_id", "turns", F.concat(head, F.array_join(F.transform("parts", lambda p: p["s"]), "\n")).alias("markdown"))


def extracted_text(content: str = "content") -> Column:
    """S-17: trimmed text of JSON content: a string, or the text blocks of a list."""
    c = F.col(content)
    blocks = F.from_json(c, "array<struct<type: string, text: string>>")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.trim(b["text"])), lambda t: t != "")
    plain = F.trim(F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"), c))
    return F.when(F.ltrim(c).startswith("["), F.array_join(texts, "\n\n")).otherwise(plain)


def transcript_turns(lines: DataFrame) -> DataFrame:
    """R-12, T-01: (seq, role, text) of JSON lines (seq, value); garbled ones are skipped."""
    schema = "type string, isMeta boolean, isSidechain boolean, message struct<role: string, content: string>"
    m = lines.withColumn("m", F.from_json("value", schema)).where("m.message IS NOT NULL AND NOT coalesce(m.isMeta, false) AND NOT coalesce(m.isSidechain, false)")
    turns = m.where(F.col("m.type").isin("user", "assistant")).select("seq", F.col("m.message.role").alias("role"), F.col("m.message.content").alias("content"))
    return turns.withColumn("text", extracted_text("content")).drop("content").where("text <> ''")


def export_turns(exports: DataFrame) -> DataFrame:
    """R-13, T-02: (doc, seq, role, text) of exported documents (doc, value)."""
    schema = "messages array<struct<info: struct<role: string>, parts: array<struct<type: string, text: string>>>>"
    parsed = exports.withColumn("d", F.from_json("value", schema))
    checked = parsed.withColumn("d", F.when(F.col("d").isNull(), F.raise_error(F.lit("an export must be a JSON object")).cast(schema_of(schema))).otherwise(F.col("d")))
    each = checked.select("doc", F.posexplode("d.messages").alias("seq", "m")).where(F.col("m.info.role").isin("user", "assistant"))
    texts = F.filter(F.transform(F.filter("m.parts", lambda p: p["type"] == "text"), lambda p: F.trim(p["text"])), lambda t: t != "")
    return each.select("doc", "seq", F.col("m.info.role").alias("role"), F.array_join(texts, "\n\n").alias("text")).where("text <> ''")


def schema_of(fields: str) -> str:
    return f"struct<{fields.replace('messages ', 'messages: ', 1)}>"


def captures(new: DataFrame, existing: DataFrame) -> DataFrame:
    """K-11: (short_id, file_name): the first existing file of a short id, else the new name."""
    first = existing.groupBy("short_id").agg(F.min("file_name").alias("old"))
    return new.join(first, "short_id", "left").select("short_id", F.coalesce("old", "file_name").alias("file_name"))


def debounced(events: DataFrame, gap_seconds: int) -> DataFrame:
    """W-02 in batch: (rel, started, last_event, events): runs of a key's events that are no
    more than the gap apart; the run settles a gap after its last event."""
    gap = gap_seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # Within slots of a key's time first, so that a busy key is many tasks, then between slots.
    slot = F.floor(micros("ts") / max(gap * 1000, 1))

    def runs(rows: DataFrame, keys: tuple[str, ...], n) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("started", "last_event")
        apart = micros("started") - F.lag(micros("last_event")).over(w) > gap
        told = rows.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return told.groupBy(*keys, "run").agg(F.min("started").alias("started"), F.max("last_event").alias("last_event"), n.alias("events")).drop("run")

    parts = events.select("rel", F.col("ts").alias("started"), F.col("ts").alias("last_event"), slot.alias("slot"))
    parts = runs(parts, ("rel", "slot"), F.count("*"))
    return runs(parts, ("rel",), F.sum("events")).select("rel", "started", "last_event", "events")
