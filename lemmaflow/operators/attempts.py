"""Which of a key's recorded responses a generation with retries takes, and what it costs.

A generation asks with its prompt; an answer that is not valid, or a prompt too long, makes it ask again: once with a compact
prompt, which costs no attempt, then for repairs, until the attempts are used up. Responses are rows in the order in which
they came, so the retries are a fold over a key's first few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Attempts of a generation (fixed value). The compact prompt adds one call that is none.
ATTEMPTS = 3
STATE = "struct<attempts:int,calls:int,compacted:boolean,prompt:string,prompts:array<string>,chosen:bigint,failure:string>"


def ladder(responses: DataFrame, keys: list[str], attempts: int = ATTEMPTS, compact_on_failure: bool = True) -> DataFrame:
    """keys, chosen (order of the response taken, null if none), attempts, calls, prompts (what each call asked with: original,
    compact, repair), failure (null if one is taken; error, exhausted, or open if more responses are wanted).

    responses: keys, order (long), outcome (valid, invalid, too_long for a prompt that does not fit, error), compact (boolean: is
    there a compact prompt?). compact_on_failure: an invalid first answer asks with the compact prompt too, not only a prompt too long. An
    unknown or null outcome counts as invalid, a null compact as none; rows without order are no responses; of rows with one order the one
    with the smallest outcome counts. Keys may be null. No key's rows are gathered beyond the attempts + 1 that can be used: Spark
    limits groups before it shuffles them.
    """
    r = responses.filter("order is not null").select(*keys, "order", F.coalesce("outcome", F.lit("invalid")).alias("outcome"), F.coalesce("compact", F.lit(False)).alias("compact"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("order"))
    r = r.groupBy(*keys, "order").agg(F.min("outcome").alias("outcome"), F.bool_or("compact").alias("compact")).withColumn("at", rank).filter(f"at <= {attempts + 1}")
    own = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order", "outcome", "compact"))).alias("rs"))
    start = f"cast(named_struct('attempts', 0, 'calls', 0, 'compacted', false, 'prompt', 'original', 'prompts', array(), 'chosen', null, 'failure', 'open') as {STATE})"
    to = lambda attempts, compacted, prompt, chosen, failure: f"cast(named_struct('attempts', {attempts}, 'calls', s.calls + 1, 'compacted', {compacted}, 'prompt', {prompt}, 'prompts', array_append(s.prompts, s.prompt), 'chosen', {chosen}, 'failure', {failure}) as {STATE})"
    on_failure = "s.attempts = 0" if compact_on_failure else "false"
    step = f"""case
      when s.failure is null or s.failure <> 'open' then s
      when r.outcome = 'valid' then {to('s.attempts + 1', 's.compacted', 's.prompt', 'r.order', 'null')}
      when r.compact and not s.compacted and (r.outcome = 'too_long' or r.outcome <> 'error' and {on_failure}) then {to('s.attempts', 'true', "'compact'", 'null', "'open'")}
      when r.outcome in ('too_long', 'error') then {to('s.attempts + 1', 's.compacted', 's.prompt', 'null', "'error'")}
      when s.attempts + 1 >= {attempts} then {to('s.attempts + 1', 's.compacted', 's.prompt', 'null', "'exhausted'")}
      else {to('s.attempts + 1', 's.compacted', "'repair'", 'null', "'open'")} end"""
    d = own.withColumn("s", F.expr(f"aggregate(rs, {start}, (s, r) -> {step})"))
    return d.select(*keys, "s.chosen", "s.attempts", "s.calls", "s.prompts", "s.failure")
