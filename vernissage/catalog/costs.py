"""Model calls: prices, sums, cache use, percentiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.catalog.registry import query
from vernissage.operators.ordered import percentiles, running
from vernissage.plans import costs, dialogue

_CLASSES = ("input", "output", "cache_write_5m", "cache_write_1h", "cache_read")
_MODELS = [*vocab.PRICES, "unheard-of"]
_MODEL = "case user_id % {} {} end".format(len(_MODELS), " ".join(f"when {i} then '{m}'" for i, m in enumerate(_MODELS)))
_TOKENS = {
    "input": "input_tokens", "output": "output_tokens", "cache_write_5m": "cache_creation_input_tokens",
    "cache_write_1h": "id % 3", "cache_read": "cache_read_input_tokens",
}
_USED = {c: f"case when id % 4 = 0 or '{c}' = 'input' then {t} else 0 end" for c, t in _TOKENS.items()}
_CALLS = "select id, {} as model, {} from v_calls".format(_MODEL, ", ".join(f"cast({e} as bigint) as {c}_tokens" for c, e in _USED.items()))
_PRICES = "values " + ", ".join(
    "(" + ", ".join([f"'{m}'"] + [f"cast({'null' if p is None else p} as decimal(14,6))" for p in prices]) + ")"
    for m, prices in vocab.PRICES.items())
_PRICED = f"""
  c as ({_CALLS}), p(model, {", ".join("p_" + c for c in _CLASSES)}) as ({_PRICES}),
  j as (
    select c.*, case when p.model is null then 'unknown model'
        when {" or ".join(f"({c}_tokens > 0 and p_{c} is null)" for c in _CLASSES)} then 'tokens without a price' end as reason,
      {" + ".join(f"coalesce(cast({c}_tokens as decimal(18,0)) * p_{c}, 0)" for c in _CLASSES)} as total
    from c left join p on p.model = c.model),
  n as (select *, cast(total as decimal(30,6)) as micro, floor(total) as whole from j)"""
# Micro-dollars to a millionth: the whole part, rounded half to even by hand.
_EVEN = """cast((cast(whole as hugeint) + case when micro - whole > 0.5 then 1 when micro - whole = 0.5 and cast(whole as hugeint) % 2 = 1 then 1 else 0 end)
  as decimal(18,0)) / cast(1000000 as double)"""


def _calls(t):
    return t.sql(_CALLS)


@query("call_cost", f"""with {_PRICED}
    select id, model, cast(round({_EVEN}, 6) as decimal(18,6)) as cost_usd from n where reason is null""")
def call_cost(t):
    return costs.call_cost(_calls(t), costs.price_table(t.spark))[0].select("id", "model", "cost_usd")


@query("call_cost_refused", f"with {_PRICED} select id, model, reason from n where reason is not null")
def call_cost_refused(t):
    return costs.call_cost(_calls(t), costs.price_table(t.spark))[1]


_SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in costs.SUMMED)


@query("call_costs", f"""
    select purpose, model, count(*) as calls, count(error_type) as errors, {_SUMS}, cast(sum(cost_usd) as double) as cost_usd,
      min(created_at) as first_call, max(created_at) as last_call
    from v_calls where cast(created_at at time zone 'UTC' at time zone 'Europe/Madrid' as date) >= date '2024-01-03' group by 1, 2""")
def call_costs(t):
    return costs.call_costs(t["v_calls"], since=date(2024, 1, 3)).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("call_costs_purpose", f"""
    select purpose, model, count(*) as calls, count(error_type) as errors, {_SUMS}, cast(sum(cost_usd) as double) as cost_usd,
      min(created_at) as first_call, max(created_at) as last_call from v_calls where purpose = 'error' group by 1, 2""")
def call_costs_purpose(t):
    return costs.call_costs(t["v_calls"], purpose="error").withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("trace_spend", f"""
    with a as (select user_id * 1000 + event_id % 60 as trace_id from events group by 1)
    select a.trace_id, count(c.id) as calls, cast(coalesce(sum(cost_usd), 0) as double) as cost_usd,
      {", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in costs.SUMMED)}
    from a left join v_calls c on c.trace_id = a.trace_id and c.purpose = 'click' group by 1""")
def trace_spend(t):
    traces = t["events"].select((F.col("user_id") * 1000 + F.col("event_id") % 60).alias("trace_id"))
    return costs.trace_spend(t["v_calls"], traces, purpose="click").withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("exchange_cost", """
    select trace_id, count(*) as calls, cast(sum(cost_usd) as double) as cost_usd, cast(sum(latency_ms) as bigint) as latency_ms
    from v_calls group by 1""")
def exchange_cost(t):
    return dialogue.exchange_cost(t["v_calls"]).withColumn("cost_usd", F.col("cost_usd").cast("double"))


_RUNS = "select user_id as run_id, id as ord, input_tokens, cache_read_input_tokens, cache_creation_input_tokens from v_calls"


@query("cache_share", f"""
    with r as (select *, input_tokens + cache_read_input_tokens + cache_creation_input_tokens as prompt from ({_RUNS})),
    w as (select *, max(prompt) over (partition by run_id order by ord rows between unbounded preceding and 1 preceding) as before from r)
    select count(*) as calls, cast(coalesce(sum(cache_read_input_tokens), 0) as bigint) as read, cast(coalesce(sum(prompt), 0) as bigint) as sent
    from w where before >= 4096""")
def cache_share(t):
    return costs.cache_share(t.sql(_RUNS))


@query("latency_percentiles", """
    with r as (select purpose, latency_ms, row_number() over (partition by purpose order by latency_ms) as n, count(*) over (partition by purpose) as total from v_calls)
    select purpose, share, min(latency_ms) as latency_ms from r, (values (cast(0.5 as double)), (0.95), (1.0)) s(share)
    where n >= ceil(share * total) group by 1, 2""")
def latency_percentiles(t):
    return percentiles(t["v_calls"], ["purpose"], "latency_ms", [0.5, 0.95, 1.0])


@query("running_spend", """
    select user_id, id, cast(sum(input_tokens) over w as bigint) as sent, max(latency_ms) over w as slowest,
      last_value(error_type ignore nulls) over w as last_error
    from v_calls window w as (partition by user_id order by id rows between unbounded preceding and current row)""")
def running_spend(t):
    found = running(t["v_calls"].select("user_id", "id", "input_tokens", "latency_ms", "error_type"), ["user_id"], "id", {
        "sent": ("sum", F.col("input_tokens")), "slowest": ("max", F.col("latency_ms")),
        "last_error": ("last", F.col("error_type"))}, block=1000)
    return found.select("user_id", "id", "sent", "slowest", "last_error")


_SEARCHES = "select conv_id as run, turn, (conv_id * 7 + turn) % 60 > 40 as truncated from conversations"


@query("truncated_share", f"""
    select run, count(*) as searches, count(*) filter (truncated) as truncated from ({_SEARCHES}) group by 1""")
def truncated_share(t):
    return dialogue.truncated_share(t.sql(_SEARCHES), "run")
