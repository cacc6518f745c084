"""Questionnaires: lead texts, each with candidates, nested in files or wide in survey sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "lp_id string, answer string, possible_answers array<struct<id:string,text:string>>"
SHEET_LEAD = "leadParagraph"
SHEET_CANDIDATES = tuple(f"similarParagraph_{i}" for i in range(1, 7))


def read_questionnaire(spark: SparkSession, path: str) -> DataFrame:
    """One row per question; a malformed file is an error."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True, mode="FAILFAST")


def candidate_rows(questionnaire: DataFrame) -> DataFrame:
    """``(lp_id, sp_id, lead_text, cand_text)``; questions without candidates vanish."""
    return questionnaire.select(
        "lp_id", F.col("answer").alias("lead_text"), F.explode("possible_answers").alias("c")
    ).select("lp_id", F.col("c.id").alias("sp_id"), "lead_text", F.col("c.text").alias("cand_text"))


def texts_and_pairs(questionnaire: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each text once, with an id, and the pairs to compare: a lead and its own candidates."""
    asked = questionnaire.filter(F.size("possible_answers") > 0)
    lead_id = F.concat_ws("␟", F.lit("lead"), "lp_id")
    cand_id = F.concat_ws("␟", F.lit("cand"), "lp_id", "sp_id")
    leads = asked.select(lead_id.alias("text_id"), F.col("answer").alias("text"))
    rows = candidate_rows(asked)
    cands = rows.select(cand_id.alias("text_id"), F.col("cand_text").alias("text"))
    pairs = rows.select("lp_id", "sp_id", lead_id.alias("a"), cand_id.alias("b"))
    return leads.unionByName(cands), pairs


def most_candidates(questionnaire: DataFrame) -> int:
    row = questionnaire.agg(F.max(F.size("possible_answers"))).first()
    return int(row[0] or 0)


def sheet_to_questionnaire(
    sheet: DataFrame,
    lp: str = "LP",
    lead: str = SHEET_LEAD,
    candidates: tuple[str, ...] = SHEET_CANDIDATES,
) -> DataFrame:
    """Wide survey sheet to nested form; the columns become SP1, SP2 ... in their order."""
    structs = [
        F.struct(F.lit(f"SP{i}").alias("id"), F.col(c).cast("string").alias("text"))
        for i, c in enumerate(candidates, 1)
    ]
    return sheet.select(
        F.col(lp).cast("string").alias("lp_id"),
        F.col(lead).cast("string").alias("answer"),
        F.array(*structs).alias("possible_answers"),
    )


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    columns = ["LP", SHEET_LEAD, *SHEET_CANDIDATES]
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_questionnaire(questionnaire: DataFrame, path: str) -> None:
    questionnaire.select("lp_id", "answer", "possible_answers").write.mode("overwrite").json(path)


def write_sheet_tasks(sheet: DataFrame, path: str, lp: str = "LP") -> None:
    """One folder per lead text, each holding its row."""
    sheet.repartition(lp).write.mode("overwrite").partitionBy(lp).csv(path, header=True, escape='"')
