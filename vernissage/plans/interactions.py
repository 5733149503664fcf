"""The interaction log: conversations, feedback, remembered facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.dates import to_local
from vernissage.operators.keyed import append_absent, delete_keys, last_per_key
from vernissage.operators.ordered import running
from vernissage.session import cut_lineage

CHUNK = 200


# --- conversations -------------------------------------------------------------------------------


def _hour_marks(messages: DataFrame) -> DataFrame:
    """(user_id, day, slot, first_ts, last_ts, n): messages summed up per user and local hour."""
    local = to_local(F.col("ts"))
    return messages.select(
        "user_id", "ts", F.to_date(local).alias("day"), F.hour(local).alias("slot")
    ).groupBy("user_id", "day", "slot").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def _session_slots(messages: DataFrame) -> DataFrame:
    """Hour marks with `session`, numbered from 0 within each user and local day.

    A conversation never outlives its local day, and a gap over six hours never falls inside one
    hour, so the hours of a day are all that is needed to cut it: at most 25 rows per user and day,
    however many messages they hold."""
    marks = _hour_marks(messages)
    line = Window.partitionBy("user_id", "day").orderBy("first_ts")
    # UTC on both sides, so a clock change does not count as a gap.
    idle = F.col("first_ts") - F.lag("last_ts").over(line) > F.expr(f"INTERVAL {vocab.IDLE_HOURS} HOURS")
    opened = marks.withColumn("_new", F.coalesce(idle, F.lit(False)).cast("int"))
    return opened.withColumn("session", F.sum("_new").over(
        line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def sessionize(messages: DataFrame) -> DataFrame:
    """(user_id, day, session, started_at, last_turn_at, turns) from messages (user_id, ts): a new
    conversation after a gap of more than six hours, or on another local day than it opened on."""
    return _session_slots(messages).groupBy("user_id", "day", "session").agg(
        F.min("first_ts").alias("started_at"), F.max("last_ts").alias("last_turn_at"),
        F.sum("n").alias("turns"))


def with_session(messages: DataFrame) -> DataFrame:
    """Messages with the day and number of their conversation."""
    slots = _session_slots(messages).select("user_id", "day", "slot", F.col("session").cast("long"))
    local = to_local(F.col("ts"))
    return messages.withColumn("day", F.to_date(local)).withColumn("slot", F.hour(local)).join(
        slots, ["user_id", "day", "slot"]).drop("slot")


def conversation_ends(sessions: DataFrame) -> DataFrame:
    """Sessions with `ended_at`: when the user's next conversation opened, null for the open one.
    The sequence is one row per conversation, not per message."""
    line = Window.partitionBy("user_id").orderBy("started_at")
    return sessions.withColumn("ended_at", F.lead("started_at").over(line))


def replay(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conversation_id, chunk, messages): each conversation's messages in order, as arrays of at
    most `chunk` of them; concatenated by chunk they are the whole conversation."""
    entry = F.struct("position", "role", "content")
    return (
        messages.withColumn("chunk", F.floor(F.col("position") / chunk))
        .groupBy("conversation_id", "chunk")
        .agg(F.array_sort(F.collect_list(entry)).alias("messages"))
    )


def number_turns(messages: DataFrame) -> DataFrame:
    """Messages (conversation_id, ord, turn_id, role, iterations, ...) with `position` from 0 in the
    conversation, and `iteration_count` on the last assistant message of each turn only."""
    placed = running(messages, ["conversation_id"], "ord", {"_upto": ("sum", F.lit(1))})
    last = messages.filter("role = 'assistant'").groupBy("conversation_id", "turn_id").agg(
        F.max("ord").alias("_last"))
    count = F.when(F.col("ord") == F.col("_last"), F.col("iterations"))
    return (
        placed.join(last, ["conversation_id", "turn_id"], "left")
        .withColumn("position", (F.col("_upto") - 1).cast("long"))
        .withColumn("iteration_count", count)
        .drop("_upto", "_last", "iterations")
    )


# --- feedback ------------------------------------------------------------------------------------


def latest_feedback(ratings: DataFrame, messages: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feedback, refused). Ratings hold ord, user_id, message_id or conversation_id (its last reply
    is meant), rating. One verdict per reply, the newest winning; a rating of anything that is no
    reply of that user is refused."""
    replies = messages.filter("iteration_count IS NOT NULL").select(
        F.col("id").alias("_reply"), F.col("conversation_id").alias("_conversation"), "position")
    owned = replies.join(conversations.select(
        F.col("id").alias("_conversation"), F.col("user_id").alias("_owner")), "_conversation")
    last = replies.groupBy(F.col("_conversation").alias("conversation_id")).agg(
        F.max_by("_reply", "position").alias("_last_reply"))
    named = ratings.join(last, "conversation_id", "left").withColumn(
        "message_id", F.when(F.col("message_id").isNull(), F.col("_last_reply")).otherwise(F.col("message_id"))
    ).drop("_last_reply")
    checked = named.join(
        owned.select(F.col("_reply").alias("message_id"), "_owner"), "message_id", "left")
    fine = F.col("_owner").eqNullSafe(F.col("user_id"))
    kept = checked.filter(fine).select("message_id", "rating", "ord")
    refused = checked.filter(~fine).select("ord", F.lit("not a reply of this user").alias("reason"))
    return last_per_key(kept, ["message_id"], ["ord"]).select("message_id", "rating", "ord"), refused


# --- remembered facts ----------------------------------------------------------------------------


def apply_remember(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, refused) of a remember log (user_id, seq, topic, fact, replaces).

    `replaces` must name a fact of the user that was live just then, or the whole event is refused
    (reason `unknown`, or `already replaced` by `successor`). Of the events that name one fact,
    only the first after it can win, so an event stands iff it and every event up its chain is such
    a first. Chains are followed by doubling: each round halves what is left of the longest."""
    firsts = (
        log.filter("replaces IS NOT NULL AND replaces < seq")
        .groupBy("user_id", F.col("replaces").alias("parent")).agg(F.min("seq").alias("first"))
    )
    known = log.select("user_id", F.col("seq").alias("parent"))
    linked = (
        log.select("user_id", "seq", F.col("replaces").alias("parent"))
        .join(firsts, ["user_id", "parent"], "left")
        .join(known.withColumn("_exists", F.lit(True)), ["user_id", "parent"], "left")
    )
    root = F.col("parent").isNull()
    first = F.col("_exists").isNotNull() & (F.col("first") == F.col("seq"))
    # `up` is the next event to ask, null when nothing is left to ask.
    chain = cut_lineage(linked.select(
        "user_id", "seq", F.when(root | ~first, None).otherwise(F.col("parent")).alias("up"),
        (root | F.coalesce(first, F.lit(False))).alias("stands")))
    while chain.filter("up IS NOT NULL").limit(1).count():
        above = chain.select("user_id", F.col("seq").alias("up"), F.col("up").alias("_next"),
                             F.col("stands").alias("_stands"))
        chain = cut_lineage(chain.join(above, ["user_id", "up"], "left").select(
            "user_id", "seq",
            F.when(F.col("stands") & F.coalesce("_stands", F.lit(True)), F.col("_next")).alias("up"),
            (F.col("stands") & F.coalesce("_stands", F.lit(True))).alias("stands")))
    judged = log.join(chain.select("user_id", "seq", "stands"), ["user_id", "seq"])
    kept = judged.filter("stands")
    replaced_by = kept.filter("replaces IS NOT NULL").select(
        "user_id", F.col("replaces").alias("seq"), F.col("seq").alias("superseded_by"))
    facts = kept.join(replaced_by, ["user_id", "seq"], "left").select(
        "user_id", "seq", "topic", "fact", "superseded_by")
    # A refused event met a fact that was never written, or one replaced before it.
    target = facts.select("user_id", F.col("seq").alias("replaces"), "superseded_by", F.lit(True).alias("_written"))
    before = F.coalesce(F.col("_written") & (F.col("superseded_by") < F.col("seq")), F.lit(False))
    refused = judged.filter("NOT stands").join(target, ["user_id", "replaces"], "left").select(
        "user_id", "seq", F.when(before, "already replaced").otherwise("unknown").alias("reason"),
        F.when(before, F.col("superseded_by")).alias("successor"))
    return facts, refused


def remember_more(facts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, refused) after a later batch of remember events: `apply_remember` over the whole log,
    told only the facts it left. Written facts stand; those replaced before stay so."""
    dead = facts.filter("superseded_by IS NOT NULL").select("user_id", F.col("seq").alias("replaces"), "superseded_by")
    late = events.join(dead, ["user_id", "replaces"]).select(
        "user_id", "seq", F.lit("already replaced").alias("reason"), F.col("superseded_by").alias("successor"))
    open_events = events.join(late.select("user_id", "seq"), ["user_id", "seq"], "left_anti")
    live = facts.filter("superseded_by IS NULL")
    roots = live.select("user_id", "seq", "topic", "fact", F.lit(None).cast("long").alias("replaces"))
    now, refused = apply_remember(roots.unionByName(open_events.select(*roots.columns)))
    return now.unionByName(facts.filter("superseded_by IS NOT NULL")), refused.unionByName(late)


def live_profile(facts: DataFrame) -> DataFrame:
    """Facts nothing has replaced, with `rank`: the topic's place in the fixed order."""
    rank = F.array_position(F.array(*map(F.lit, vocab.PROFILE_TOPICS)), F.col("topic")).cast("long")
    return facts.filter("superseded_by IS NULL").select("user_id", rank.alias("rank"), "seq", "topic", "fact")


def forget(tables: Mapping[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """facts, conversations, messages and feedback without everything of `users` (user_id)."""
    gone = tables["conversations"].join(users.select("user_id"), "user_id", "left_semi").select(
        F.col("id").alias("conversation_id"))
    messages = delete_keys(tables["messages"], gone, ["conversation_id"])
    lost = tables["messages"].join(gone, "conversation_id", "left_semi").select(F.col("id").alias("message_id"))
    return {
        "facts": delete_keys(tables["facts"], users, ["user_id"]),
        "conversations": delete_keys(tables["conversations"], users, ["user_id"]),
        "messages": messages,
        "feedback": delete_keys(tables["feedback"], lost, ["message_id"]),
    }


def add_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Insert-if-absent by (client, external_id)."""
    return append_absent(users, seen.select("client", "external_id"), ["client", "external_id"])
