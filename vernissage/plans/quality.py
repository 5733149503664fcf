"""Constraints as jobs: (table, rule, key) for every row that breaks one; empty is good."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage import vocab

# (table, column) -> allowed values; null is allowed.
ENUMS = {
    ("calls", "purpose"): vocab.PURPOSES,
    ("seeds", "page_type"): vocab.PAGE_TYPES,
    ("seeds", "confidence"): vocab.CONFIDENCES,
    ("seeds", "language"): vocab.LANGUAGES,
    ("seeds", "status"): vocab.SEED_STATUSES,
    ("pages", "status"): vocab.PAGE_STATUSES,
    ("pages", "kind"): vocab.PAGE_KINDS,
    ("pages", "extract_status"): vocab.EXTRACT_STATUSES,
    ("exhibitions", "confidence"): vocab.CONFIDENCES,
    ("events", "confidence"): vocab.CONFIDENCES,
    ("events", "kind"): vocab.EVENT_KINDS,
    ("places", "kind"): vocab.PLACE_KINDS,
    ("messages", "role"): vocab.ROLES,
    ("feedback", "rating"): vocab.RATINGS,
    ("facts", "topic"): vocab.PROFILE_TOPICS,
}
SUBSETS = {("exhibitions", "media"): vocab.MEDIA, ("events", "media"): vocab.MEDIA}
ROWS = {
    ("pages", "links need text"): "links IS NULL OR raw_text IS NOT NULL",
    ("pages", "marks all or none"): (
        "(extract_status IS NULL) = (extracted_hash IS NULL) AND (extract_status IS NULL) = (extract_version IS NULL) "
        "AND (extract_status IS NULL) = (extract_model IS NULL) AND (extract_status IS NULL) = (extracted_at IS NULL)"),
    ("seeds", "dated items not negative"): "dated_items >= 0",
    ("messages", "iterations on replies only"): "iteration_count IS NULL OR role = 'assistant'",
}
# Null is a value like any other in these keys where it says so in the model: grouping treats it so.
KEYS = {
    "venues": ("source_venue_id",), "snapshots": ("source_event_id",), "occurrences": ("source_occurrence_id",),
    "pages": ("url",), "seeds": ("venue_id", "url"), "exhibitions": ("venue_id", "title_key"),
    "events": ("venue_id", "title_key", "start_date"), "places": ("kind", "code"),
    "users": ("client", "external_id"), "messages": ("conversation_id", "position"), "feedback": ("message_id",),
}
FOREIGN = {
    ("snapshots", "venue_id"): "venues", ("occurrences", "event_id"): "snapshots", ("pages", "venue_id"): "venues",
    ("seeds", "venue_id"): "venues", ("exhibitions", "venue_id"): "venues", ("events", "venue_id"): "venues",
    ("events", "exhibition_id"): "exhibitions", ("conversations", "user_id"): "users",
    ("messages", "conversation_id"): "conversations", ("facts", "user_id"): "users",
    ("feedback", "message_id"): "messages",
}


def row_rules(table: str, columns: Sequence[str]) -> dict[str, Column]:
    """Rule name -> whether a row of `table` keeps it, for the columns it has."""
    rules = {}
    for (name, column), values in ENUMS.items():
        if name == table and column in columns:
            rules[f"{column} is known"] = F.col(column).isNull() | F.col(column).isin(*values)
    for (name, column), values in SUBSETS.items():
        if name == table and column in columns:
            rules[f"{column} are known"] = F.size(F.array_except(column, F.array(*map(F.lit, values)))) == 0
    for (name, rule), text in ROWS.items():
        if name == table:
            rules[rule] = F.expr(text)
    return rules


def broken_rows(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """All row rules of a table in one pass over it."""
    rules = row_rules(table, df.columns)
    if not rules:
        return df.select(F.lit(table).alias("table"), F.lit("").alias("rule"), F.col(key).cast("string").alias("key")).limit(0)
    broken = F.array_compact(F.array(*(
        F.when(~F.coalesce(kept, F.lit(False)), F.lit(rule)) for rule, kept in rules.items())))
    return df.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def _key_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))


def repeated_keys(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or KEYS[table])
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit(table).alias("table"), F.lit("unique " + ", ".join(columns)).alias("rule"),
        _key_text(columns).alias("key"))


def open_conversations(conversations: DataFrame) -> DataFrame:
    """Users with more than one conversation that has not ended."""
    return conversations.filter("ended_at IS NULL").groupBy("user_id").agg(F.count("*").alias("n")).filter(
        "n > 1").select(F.lit("conversations").alias("table"), F.lit("one open per user").alias("rule"),
                        F.col("user_id").cast("string").alias("key"))


def orphans(df: DataFrame, table: str, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose `column` names no row of its parent. Distinct values go to the join."""
    named = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return named.join(parent.select(F.col("id").alias(column)), column, "left_anti").select(
        F.lit(table).alias("table"), F.lit(f"{column} exists").alias("rule"), F.col(column).cast("string").alias("key"))


def violations(tables: Mapping[str, DataFrame], repeats: Collection[str] = ()) -> DataFrame:
    """Every broken rule of the tables given. Foreign keys are checked where both ends are given. Tables
    in `repeats` are as they were collected, before a merge by key: a key may come in them twice."""
    found = []
    for name, df in tables.items():
        key = "id" if "id" in df.columns else df.columns[0]
        found.append(broken_rows(df, name, key))
        if name in KEYS and name not in repeats and set(KEYS[name]) <= set(df.columns):
            found.append(repeated_keys(df, name))
        if name == "conversations":
            found.append(open_conversations(df))
    for (name, column), parent in FOREIGN.items():
        if name in tables and parent in tables and column in tables[name].columns:
            found.append(orphans(tables[name], name, column, tables[parent]))
    everything = found[0]
    for df in found[1:]:
        everything = everything.unionByName(df)
    return everything


def leaked(df: DataFrame, marker: str) -> DataFrame:
    """Rows of a query's result in which any text, at any depth, holds a planted marker."""
    return df.filter(F.contains(F.to_json(F.struct(*df.columns)), F.lit(marker)))
