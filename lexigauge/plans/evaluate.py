"""From the files of a study to its evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.operators import evaluation as ev
from lexigauge.operators.ranking import human_ranking
from lexigauge.operators.tables import durable
from lexigauge.sources import study


def joined_study(spark: SparkSession, results_path: str, answers_path: str) -> DataFrame:
    """People's and every model's rank of each candidate that people ranked."""
    machine = study.result_rows(study.read_results(spark, results_path)).select(
        "model", "lp_id", "sp_id", F.col("rank").cast("bigint").alias("machine"), "similarity"
    )
    answers = study.read_worker_answers(spark, answers_path)
    human = human_ranking(answers, ["lp_id"], accepted=study.accepted())
    return ev.join_rankings(
        human.select("lp_id", "sp_id", F.col("rank").alias("human")), durable(machine, "machine"), ["lp_id", "sp_id"]
    )


def evaluate_study(spark: SparkSession, results_path: str, answers_path: str) -> DataFrame:
    joined = durable(joined_study(spark, results_path, answers_path), "joined")
    return ev.evaluate(joined, ["model", "lp_id"])
