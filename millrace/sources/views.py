"""Domain views over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row per (sample_index, traj), eight trajectories a sample, with every answer style of the extraction cascade.
ROLLOUTS = """
WITH b AS (SELECT event_id, event_id % 8 AS traj, CAST(floor(event_id / 8.0) AS BIGINT) AS g,
    CASE WHEN CAST(floor(event_id / 8.0) AS BIGINT) % 10 = 0 THEN CAST(floor(event_id / 8.0) AS BIGINT) * 8 ELSE event_id END AS e FROM events),
t AS (SELECT *, CASE g % 5 WHEN 0 THEN 'mcq' WHEN 1 THEN 'yesno' WHEN 2 THEN 'numeric' WHEN 3 THEN 'counting' ELSE 'open' END AS answer_type,
    (e * 31 + g * 17) % 10 AS r1, (e * 37 + g * 11) % 10 AS r2, (e * 13 + 1) % 6 AS f1, (e * 19 + 2) % 6 AS f2, (e * 29) % 5 AS fb FROM b),
v AS (SELECT *, CASE answer_type WHEN 'mcq' THEN substr('ABCD', CAST(g % 4 AS INT) + 1, 1) WHEN 'yesno' THEN CASE WHEN g % 2 = 0 THEN 'Yes' ELSE 'No' END
      WHEN 'open' THEN CASE g % 4 WHEN 0 THEN 'red sports car' WHEN 1 THEN 'a cat' WHEN 2 THEN 'left side' ELSE 'fire truck' END ELSE CAST(2 + g % 9 AS VARCHAR(20)) END AS tv,
    CASE answer_type WHEN 'mcq' THEN substr('ABCD', CAST((g + 1 + e % 3) % 4 AS INT) + 1, 1) WHEN 'yesno' THEN CASE WHEN g % 2 = 0 THEN 'No' ELSE 'Yes' END
      WHEN 'open' THEN CASE g % 4 WHEN 0 THEN 'blue sports car' WHEN 1 THEN 'a dog' WHEN 2 THEN 'right side' ELSE 'fire truk' END ELSE CAST(3 + g % 9 + e % 4 AS VARCHAR(20)) END AS wv FROM t),
w AS (SELECT *, CASE WHEN r1 < 5 THEN tv ELSE wv END AS x1, CASE WHEN r2 < 6 THEN tv ELSE wv END AS x2,
    CASE WHEN answer_type = 'mcq' THEN '(' ELSE '' END AS lp, CASE WHEN answer_type = 'mcq' THEN ')' ELSE '' END AS rp FROM v)
SELECT g AS sample_index, traj, concat('task', CAST(g % 9 AS VARCHAR(20))) AS dataset_name, answer_type, concat(lp, tv, rp) AS ground_truth,
  CASE f1 WHEN 0 THEN concat('<think>r</think><answer>', lp, x1, rp, '</answer>') WHEN 1 THEN concat('<answer>', lp, x1, rp, '</answer>') WHEN 2 THEN concat(lp, x1, rp)
    WHEN 3 THEN concat('The answer is ', x1) WHEN 4 THEN concat('<think>r</think><answer>', lp, x1, rp, ' descriptor</answer>') ELSE '' END AS a1,
  CASE fb WHEN 0 THEN concat('<think>r</think> ', chr(92), 'boxed{CORRECT}') WHEN 1 THEN concat('<think>r</think> ', chr(92), 'boxed{Incorrect}')
    WHEN 2 THEN 'INCORRECT. Revise.' WHEN 3 THEN concat(chr(92), 'boxed{(A)}') ELSE '' END AS f1,
  CASE f2 WHEN 0 THEN concat('<think>r</think><answer>', lp, x2, rp, '</answer>') WHEN 1 THEN concat('<answer>', lp, x2, rp, '</answer>') WHEN 2 THEN concat(lp, x2, rp)
    WHEN 3 THEN concat('The answer is ', x2) WHEN 4 THEN concat('<think>r</think><answer>', lp, x2, rp, ' descriptor</answer>') ELSE '' END AS a2
FROM w
"""

#: First question, first and last answer of each conversation.
MESSAGES = """
SELECT conv_id, coalesce(min_by(text, turn) FILTER (WHERE role='user'),'') AS question, coalesce(min_by(text, turn) FILTER (WHERE role='assistant'),'') AS answer1,
 coalesce(max_by(text, turn) FILTER (WHERE role='assistant'),'') AS ground_truth FROM conversations GROUP BY conv_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROLLOUTS.replace("FROM events", f"FROM parquet.`{sf_dir}/events.parquet`"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES.replace("FROM conversations", f"FROM parquet.`{sf_dir}/conversations.parquet`"))
