"""Tables the checked queries run on: the given parquet files and views derived from all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One statement for both engines. The rule words, amounts, links and odd labels that the given prose lacks
# are derived from every row of `events`.
MESSAGES_SQL = """
select event_id as msg_id, event_type as source, ts,
 case when event_id % 12 < 6 then 'spam' when event_id % 12 = 11 then 'OTHER' else 'Ham' end as type,
 case event_id % 12
  when 0 then concat('URGENT: transfer $', cast(floor(value*10) as bigint), ' to a secure account now')
  when 1 then concat('Click http://win', user_id, '.example/claim to verify your bank details')
  when 2 then concat('Payment of $', cast(floor(value) as bigint), ' failed, call 5550', 1000000 + user_id, ' immediately')
  when 3 then 'Limited time offer expires today, confirm quickly'
  when 4 then concat('Please validate money order ', user_id, ' via help', user_id, '@mail.example.com')
  when 5 then concat('The café banké note is here!! ', user_id)
  when 6 then concat('Quick lunch on day ', user_id, ', bring the bank notes')
  when 7 then 'ok'
  when 8 then concat('Report ', event_id, ' is in your account, please confirm')
  when 9 then concat(user_id, ' 1234567 99 88 77 66')
  when 10 then null
  else 'unlabelled text for the archive' end as text
from events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES_SQL.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


# Raw model answers, derived from every event but the error events: those have none.
_HEAD = "concat('{\"risk_score\": 0.', lpad(cast(event_id % 100 as string), 2, '0'), "
_BODY = "'\"indicators\": [\"asks for money\", \"odd link\"], \"recommendations\": [\"do not answer\"], \"confidence\": \"High\"}'"
VERDICTS_SQL = f"""
select event_id as msg_id,
 case event_id % 9
  when 0 then {_HEAD}', ', {_BODY})
  when 1 then concat('```json', chr(10), {_HEAD}', ', {_BODY}), chr(10), '```', chr(10))
  when 2 then concat('```', chr(10), '{{"risk_score": "0.4", ', {_BODY}, '```')
  when 3 then 'I think this is a scam.'
  when 4 then null
  when 5 then concat('{{', {_BODY})
  when 6 then concat('{{"risk_score": "high", ', {_BODY})
  when 7 then '{{"risk_score": 0.71, "indicators": ["", "  padded ", null, "plain"], "recommendations": [], "confidence": "Medium"}}'
  else concat('{{"risk_score": 0.55, "indicators": ["costs ', chr(92), '$5"], "recommendations": ["wait"]}}') end as raw
from events where event_type <> 'error'
"""


def raw_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VERDICTS_SQL.replace("{", "{{").replace("}", "}}").replace("from events", "from {events}"),
                     events=table(spark, sf_dir, "events"))
