"""Question sets as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.schemas import QUESTIONS
from pagelore.sources.landing import numbered_lines

REQUIRED = ("question", "source", "answer_page_url")


def check_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, lineno, line`` -> (questions, rejects). Blank lines are skipped; a
    reject names its line and the keys it lacks, or that it is not JSON."""
    filled = lines.where(F.trim("line") != "")
    row = F.from_json("line", QUESTIONS)
    broken = F.try_parse_json("line").isNull()
    missing = F.concat_ws(", ", *[
        F.when(F.coalesce(F.col(f"row.{k}"), F.lit("")) == "", k) for k in REQUIRED])
    checked = filled.withColumn("row", row).withColumn(
        "problem", F.when(broken, "not JSON").when(missing != "", F.concat(F.lit("missing "), missing)))
    good = checked.where(F.col("problem").isNull()).select("lineno", "row.*")
    return good, checked.where(F.col("problem").isNotNull()).select("file", "lineno", "problem")


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return check_lines(numbered_lines(spark, path))


def require_questions(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """Stop on the first bad line, or on an empty set."""
    first = rejects.orderBy("file", "lineno").first()
    if first:
        raise ValueError(f"{first['file']}:{first['lineno']} {first['problem']}")
    if good.isEmpty():
        raise ValueError("the question set is empty")
    return good


def write_questions(questions: DataFrame, path: str) -> None:
    """JSON lines, NULL fields written out and other alphabets kept as they are."""
    questions.select(*QUESTIONS.fieldNames()).write.mode("overwrite").option(
        "ignoreNullFields", "false").json(path)
