"""Caption tables derived from the events table, so that queries grow with it.

Each statement runs on Spark and DuckDB alike; {events} stands for the events table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import spread

CAPTIONS = """
SELECT video_id, CAST(n AS INT) AS event_idx, CAST(n * 8000 AS DOUBLE) AS start_ms,
       CAST(n * 8000 + 8000 + (event_id % 3) * 1500 AS DOUBLE) AS end_ms, event_id, n % 24 AS phase, event_id % 4 AS variant,
       CASE WHEN n % 24 = 8 AND event_id % 4 = 0 THEN concat('This video is sponsored by ', brand, '.')
            WHEN n % 24 = 8 AND event_id % 4 = 1 THEN concat('Before we continue, here is a quick word from ', brand, '.')
            WHEN n % 24 = 8 AND event_id % 4 = 3 THEN concat('I want to thank ', brand, ' for supporting this channel.')
            WHEN n % 24 = 9 THEN concat('Head over to ', lower(brand), '.com/alex and start your free trial today.')
            WHEN n % 24 = 10 THEN concat('Use promo code ', upper(brand), ' for 20 percent off your first order.')
            WHEN n % 24 = 11 THEN concat(brand, ' helps you manage every project in one platform.')
            WHEN n % 24 = 12 AND event_id % 4 IN (0, 1) THEN concat('Thanks to ', brand, ' for supporting the show. Now let''s get back to the story.')
            WHEN n % 24 = 17 AND event_id % 4 = 0 THEN 'This part was not sponsored by anyone.'
            WHEN n % 24 = 17 AND event_id % 4 = 1 THEN 'Merch alert. Check out my merch in the channel store.'
            WHEN n % 24 = 20 AND event_id % 4 = 2 THEN 'You should check out the link in the description.'
            WHEN event_id % 6 = 0 THEN 'The researchers recorded each result and checked it twice.'
            WHEN event_id % 6 = 1 THEN 'First, remove the old panel and label every cable.'
            WHEN event_id % 6 = 2 THEN 'The next stage of the experiment changes the pressure.'
            WHEN event_id % 6 = 3 THEN 'Officers begin piecing the story together.'
            WHEN event_id % 6 = 4 THEN 'Nobody expected the engine to restart so quickly.'
            ELSE 'We compared the control group with the remaining cases.' END AS text
FROM (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
             CASE user_id % 5 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Zenly' WHEN 2 THEN 'Orbit' WHEN 3 THEN 'Kudos' ELSE 'Nimbus' END AS brand
      FROM {events}) numbered
"""

#: Captions that word-order and fuzzy rules tell apart: names of sponsors, plain talk of sponsors, and misspelt cues.
TALK = f"""
SELECT video_id, event_idx,
       CASE event_id % 23 WHEN 0 THEN concat('For this show the usual sponsor of the week is ', brand, '.')
            WHEN 1 THEN concat(brand, ' is today a sponsor of this video.')
            WHEN 2 THEN concat('The sponsor for todays podcast goes by ', brand, '.')
            WHEN 3 THEN 'This episode is about how a sponsor picks a name.'
            WHEN 4 THEN concat('In this episode ', brand, ' is once more sponsoring us.')
            WHEN 5 THEN concat('Our sponsor ', brand, ' can help you plan the week.')
            WHEN 6 THEN 'Our sponsor program can help pupils.'
            WHEN 7 THEN concat('We love our sponsors like ', brand, ' and others.')
            WHEN 8 THEN 'The sponsor is a school that offers rooms.'
            WHEN 9 THEN 'We   thank our SPONSORS.'
            WHEN 10 THEN concat('This vidio is sponsored by ', brand, '.')
            WHEN 11 THEN 'Thank yuo for sponsoring this video.'
            WHEN 12 THEN 'With that out of teh way, we go on.'
            WHEN 13 THEN 'And now bak to the vidio.'
            WHEN 14 THEN 'So lets get back to it, shall we?'
            WHEN 15 THEN concat('The sponsors such as ', brand, ' came by.')
            WHEN 16 THEN 'The response of the sensor was slow.'
            WHEN 17 THEN concat('Supprt for this show comes from ', brand, ', a sponsor, not a sponser.')
            WHEN 18 THEN 'A sponsor, and one of many, once saw a long and rather dull video about this.'
            WHEN 19 THEN concat('The sponsors including ', brand, ' left early.')
            WHEN 20 THEN ''
            WHEN 21 THEN concat('Thnks to our sponsor ', brand)
            ELSE 'He stepped back to the door.' END AS text
FROM (SELECT *, CASE video_id % 5 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Zenly' WHEN 2 THEN 'Orbit' WHEN 3 THEN 'Kudos' ELSE 'Nimbus' END AS brand FROM ({CAPTIONS}) c) b
"""

#: Captions of which some end well before the next one starts.
PAUSED = f"SELECT video_id, event_idx, start_ms, end_ms - CASE WHEN event_id % 6 = 0 THEN 2500 ELSE 0 END AS end_ms, text FROM ({CAPTIONS}) c"

TRUTH = f"""
SELECT video_id, event_idx, start_ms, start_ms + 40000 AS end_ms, 'paid-sponsor' AS category
FROM (SELECT *, lead(event_idx, 4) OVER (PARTITION BY video_id ORDER BY event_idx) AS closing FROM ({CAPTIONS}) c) d
WHERE phase = 8 AND variant <> 2 AND closing IS NOT NULL
UNION ALL
SELECT video_id, event_idx, start_ms, start_ms + 8000 AS end_ms, 'self-promotion' AS category FROM ({CAPTIONS}) c WHERE phase = 17 AND variant = 1
"""

#: Segments that a local detector might have found: truth shifted by up to 8 seconds.
LOCAL = f"""
SELECT video_id, event_idx, start_ms + (event_idx % 5 - 2) * 4000 AS start_ms, end_ms + (event_idx % 7 - 3) * 3000 AS end_ms, category,
       CASE (video_id + event_idx) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
       CASE event_idx % 2 WHEN 0 THEN 'explicit-boundary' ELSE 'low-evidence-timeout' END AS reason
FROM ({TRUTH}) t WHERE end_ms + (event_idx % 7 - 3) * 3000 > start_ms + (event_idx % 5 - 2) * 4000
"""

#: Community segments in seconds, every third video; odd videos have each in two pieces half a second apart.
COMMUNITY = f"""
SELECT video_id, CAST(start_ms / 1000 + (video_id % 7) * 0.25 AS DOUBLE) AS start_s,
       CAST(CASE WHEN video_id % 2 = 1 THEN start_ms / 1000 + 20 ELSE end_ms / 1000 END + (video_id % 7) * 0.25 AS DOUBLE) AS end_s,
       CASE WHEN event_idx % 5 = 0 THEN 'intro' ELSE 'sponsor' END AS category, CASE WHEN event_idx % 2 = 0 THEN 'skip' END AS action_type
FROM ({TRUTH}) t WHERE video_id % 3 = 0
UNION ALL
SELECT video_id, CAST(start_ms / 1000 + 20.5 + (video_id % 7) * 0.25 AS DOUBLE) AS start_s, CAST(end_ms / 1000 + (video_id % 7) * 0.25 AS DOUBLE) AS end_s,
       CASE WHEN event_idx % 5 = 0 THEN 'intro' ELSE 'sponsor' END AS category, CASE WHEN event_idx % 2 = 0 THEN 'skip' END AS action_type
FROM ({TRUTH}) t WHERE video_id % 3 = 0 AND video_id % 2 = 1 AND end_ms - start_ms > 20500
"""

#: Ranges that a language model might have answered with.
ANSWERS = f"""
SELECT video_id, event_idx, start_ms + (event_idx % 3) * 4000 AS start_ms, end_ms + (event_idx % 4) * 6000 AS end_ms, category,
       CASE event_idx % 2 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence, concat('evidence ', CAST(event_idx % 3 AS STRING)) AS reason
FROM ({TRUTH}) t WHERE (video_id + event_idx) % 4 <> 0
"""

POSITIONS = """
SELECT user_id AS video_id, event_id, CAST((event_id * 37) % 720 AS DOUBLE) AS pos_s FROM {events}
"""

SKIPS = """
SELECT user_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'RECORD' ELSE 'REVERT' END AS action, value AS duration_s
FROM {events} WHERE event_type IN ('purchase', 'error')
"""

MESSAGES = """
SELECT tab_id, event_id AS seq, n,
       CASE WHEN n % 4 = 0 THEN 'VIDEO_CHANGED' WHEN n % 4 = 1 AND event_id % 7 = 0 THEN 'CHANNEL_BLOCKED' WHEN event_type = 'error' THEN 'TRANSCRIPT_STATUS' ELSE 'PROCESS_TRANSCRIPT' END AS action,
       CASE WHEN n % 4 <> 0 AND event_id % 3 = 0 THEN CAST(floor(n / 4) AS BIGINT) - 1 ELSE CAST(floor(n / 4) AS BIGINT) END AS video_id,
       event_id % 2 AS body
FROM (SELECT user_id AS tab_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM {events}) m
"""

TRACKS = """
SELECT video_id, CAST(n AS INT) AS pos, CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'de' ELSE 'fr' END AS language_code,
       CASE WHEN event_id % 3 = 0 THEN 'asr' END AS kind, concat('https://captions.example/', CAST(event_id AS STRING)) AS base_url
FROM (SELECT floor(event_id / 3) AS video_id, event_id, event_id % 3 AS n FROM {events}) t
"""


def sample(spark: SparkSession, sf_dir: str, statement: str, *keys: str) -> DataFrame:
    """The statement's rows; keys: by which the events are spread first, if the statement's windows go by them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(statement, events=spread(events, *keys) if keys else events)


def in_duckdb(statement: str) -> str:
    return statement.replace("{events}", "events")
