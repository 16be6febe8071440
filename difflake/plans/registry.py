"""All queries of the library by name, with the SQL that each is checked against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff_checks
from . import contexts, diffs, more, repairs, runs  # noqa: F401  (these register their queries beside those of diffs)
from .tables import table

QUERIES = {**diffs.QUERIES}
ORACLE_SQL = {**diffs.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions -> lines -> checks -> verdicts -> pass rate by repository."""
    verdicts = diff_checks.validate_patches(table(spark, sf_dir, "predictions"))
    repo = F.split_part("instance_id", F.lit("__"), F.lit(1)).alias("repo")
    return verdicts.groupBy(repo).agg(F.count("*").alias("n"), F.count_if("is_valid").alias("valid"), F.avg("score").alias("mean_score"))
