"""The interaction log: sessions, replay, feedback, remembered facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.catalog.registry import query
from vernissage.plans import interactions

_LOCAL_DAY = "cast(ts at time zone 'UTC' at time zone 'Europe/Madrid' as date)"
_SESSIONS = f"""
  m as (select event_id, user_id, ts, {_LOCAL_DAY} as day from events),
  g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as cut
        from m window w as (partition by user_id, day order by ts)),
  s as (select *, cast(sum(cut) over (partition by user_id, day order by ts rows between unbounded preceding and current row) as bigint) as session from g)"""


@query("sessionize", f"""with {_SESSIONS}
    select user_id, day, session, min(ts) as started_at, max(ts) as last_turn_at, count(*) as turns from s group by 1, 2, 3""")
def sessionize(t):
    return interactions.sessionize(t["events"]).withColumn("session", F.col("session").cast("long"))


@query("sessionize_messages", f"with {_SESSIONS} select event_id, user_id, day, session from s")
def sessionize_messages(t):
    return interactions.with_session(t["events"].select("event_id", "user_id", "ts")).drop("ts")


@query("conversation_ends", f"""with {_SESSIONS},
    c as (select user_id, day, session, min(ts) as started_at, max(ts) as last_turn_at, count(*) as turns from s group by 1, 2, 3)
    select *, lead(started_at) over (partition by user_id order by started_at) as ended_at from c""")
def conversation_ends(t):
    return interactions.conversation_ends(interactions.sessionize(t["events"])).withColumn("session", F.col("session").cast("long"))


@query("replay", """
    select conv_id as conversation_id, turn // 3 as chunk, string_agg(turn || ':' || role || ':' || md5(text), ',' order by turn) as messages
    from conversations group by 1, 2""")
def replay(t):
    messages = t["conversations"].select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    listed = interactions.replay(messages, chunk=3)
    shown = F.transform("messages", lambda m: F.concat(m["position"].cast("string"), F.lit(":"), m["role"], F.lit(":"), F.md5(m["content"])))
    return listed.withColumn("messages", F.array_join(shown, ","))


@query("number_turns", """
    with m as (select conv_id as conversation_id, turn * 10 + conv_id as ord, turn // 2 as turn_id, role, conv_id % 5 as iterations from conversations)
    select m.conversation_id, m.ord, m.turn_id, role, row_number() over (partition by m.conversation_id order by m.ord) - 1 as position,
      case when m.ord = l.last then iterations end as iteration_count
    from m left join (select conversation_id, turn_id, max(ord) as last from m where role = 'assistant' group by 1, 2) l
      on l.conversation_id = m.conversation_id and l.turn_id = m.turn_id""")
def number_turns(t):
    m = t.sql("select conv_id as conversation_id, turn * 10 + conv_id as ord, turn div 2 as turn_id, role, conv_id % 5 as iterations from conversations")
    return interactions.number_turns(m)


_STORED = """
  msgs as (select conv_id * 1000 + turn as id, conv_id as conversation_id, turn as position, case when role = 'assistant' then 1 end as iteration_count from conversations),
  convs as (select conv_id as id, conv_id % 7 as user_id from conversations group by 1, 2),
  rates as (
    select conv_id * 1000 + turn as ord, conv_id % 7 + (turn % 5) // 4 as user_id, conv_id * 1000 + turn as message_id, cast(null as bigint) as conversation_id,
      case when turn % 2 = 1 then 'good' else 'bad' end as rating from conversations
    union all
    select 10000000 + conv_id * 1000 + turn, conv_id % 7, null, conv_id, 'bad' from conversations where turn % 3 = 0),
  named as (
    select r.ord, r.user_id, coalesce(r.message_id, l.id) as message_id, rating
    from rates r left join (select conversation_id, arg_max(id, position) as id from msgs where iteration_count is not null group by 1) l
      on l.conversation_id = r.conversation_id),
  judged as (
    select n.*, c.user_id as owner from named n left join msgs m on m.id = n.message_id and m.iteration_count is not null
    left join convs c on c.id = m.conversation_id)"""


def _log(t):
    c = t["conversations"]
    conv, turn = F.col("conv_id"), F.col("turn")
    number = conv * 1000 + turn
    none = F.lit(None).cast("long")
    messages = c.select(number.alias("id"), conv.alias("conversation_id"), turn.alias("position"),
                        F.when(F.col("role") == "assistant", 1).alias("iteration_count"))
    conversations = c.select(conv.alias("id"), (conv % 7).alias("user_id")).distinct()
    ratings = c.select(
        number.alias("ord"), (conv % 7 + F.when(turn % 5 == 4, 1).otherwise(0)).alias("user_id"), number.alias("message_id"),
        none.alias("conversation_id"), F.when(turn % 2 == 1, "good").otherwise("bad").alias("rating"),
    ).unionByName(c.filter("turn % 3 = 0").select(
        (number + 10_000_000).alias("ord"), (conv % 7).alias("user_id"), none.alias("message_id"),
        conv.alias("conversation_id"), F.lit("bad").alias("rating")))
    return ratings, messages, conversations


@query("latest_feedback", f"""with {_STORED}
    select message_id, arg_max(rating, ord) as rating, max(ord) as ord from judged where owner = user_id group by 1""")
def latest_feedback(t):
    return interactions.latest_feedback(*_log(t))[0]


@query("feedback_refused", f"""with {_STORED}
    select ord, 'not a reply of this user' as reason from judged where owner is distinct from user_id""")
def feedback_refused(t):
    return interactions.latest_feedback(*_log(t))[1]


# A remember log: every event of a user is a fact; most correct one of the last few.
_REMEMBER = """
  log as (
    select user_id, event_id as seq, case event_id % 8 when 0 then 'media' when 1 then 'themes' when 2 then 'area' when 3 then 'budget'
        when 4 then 'language' when 5 then 'access' else 'other' end as topic, event_type || ' ' || event_id as fact,
      case when event_id % 3 <> 0 then lag(event_id, cast(1 + event_id % 4 as int)) over (partition by user_id order by event_id)
        when event_id % 30 = 0 then event_id + 5 when event_id % 31 = 0 then 0 end as replaces
    from events)"""
_LAGS = "case event_id % 4 " + " ".join(
    f"when {i} then lag(event_id, {i + 1}) over (partition by user_id order by event_id)" for i in range(4)) + " end"
_SPARK_LOG = _REMEMBER.replace("lag(event_id, cast(1 + event_id % 4 as int)) over (partition by user_id order by event_id)", _LAGS)

# Stands iff the first to correct a fact that itself stands: the chain is walked down from the roots.
_CHAIN = f"""
  {_REMEMBER},
  firsts as (select user_id, replaces, min(seq) as seq from log where replaces < seq group by 1, 2),
  standing as (
    select user_id, seq from log where replaces is null
    union all
    select f.user_id, f.seq from standing s join firsts f on f.user_id = s.user_id and f.replaces = s.seq),
  facts as (
    select l.user_id, l.seq, l.topic, l.fact, n.seq as superseded_by from log l semi join standing s on s.user_id = l.user_id and s.seq = l.seq
    left join (select l2.* from log l2 semi join standing s2 on s2.user_id = l2.user_id and s2.seq = l2.seq) n on n.user_id = l.user_id and n.replaces = l.seq)"""


def remember_log(t):
    return t.sql(f"with {_SPARK_LOG} select * from log")


@query("apply_remember", f"with recursive {_CHAIN} select * from facts")
def apply_remember(t):
    return interactions.apply_remember(remember_log(t))[0]


@query("remember_refused", f"""with recursive {_CHAIN}
    select l.user_id, l.seq, case when f.superseded_by < l.seq then 'already replaced' else 'unknown' end as reason,
      case when f.superseded_by < l.seq then f.superseded_by end as successor
    from log l anti join standing s on s.user_id = l.user_id and s.seq = l.seq
    left join facts f on f.user_id = l.user_id and f.seq = l.replaces""")
def remember_refused(t):
    return interactions.apply_remember(remember_log(t))[1]


@query("live_profile", f"""with recursive {_CHAIN}
    select user_id, cast(list_position(['media', 'themes', 'area', 'budget', 'language', 'access', 'other'], topic) as bigint) as rank, seq, topic, fact
    from facts where superseded_by is null""")
def live_profile(t):
    return interactions.live_profile(interactions.apply_remember(remember_log(t))[0])


_FORGOTTEN = "select conv_id % 7 as user_id from conversations where conv_id % 7 in (2, 5) group by 1"


@query("forget", """
    select 'conversations' as kind, id from (select distinct conv_id as id, conv_id % 7 as user_id from conversations) where user_id not in (2, 5)
    union all select 'messages', conv_id * 1000 + turn from conversations where conv_id % 7 not in (2, 5)
    union all select 'feedback', conv_id * 1000 + turn from conversations where conv_id % 7 not in (2, 5) and turn % 2 = 1
    union all select 'facts', event_id from events where user_id % 7 not in (2, 5)""")
def forget(t):
    _, messages, conversations = _log(t)
    kept = interactions.forget({
        "facts": t["events"].select((F.col("user_id") % 7).alias("user_id"), F.col("event_id").alias("id")),
        "conversations": conversations, "messages": messages,
        "feedback": messages.filter("position % 2 = 1").select(F.col("id").alias("message_id"), "id"),
    }, t.sql(_FORGOTTEN))
    rows = [df.select(F.lit(name).alias("kind"), "id") for name, df in kept.items()]
    everything = rows[0]
    for df in rows[1:]:
        everything = everything.unionByName(df)
    return everything
