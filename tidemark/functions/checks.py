"""Conditions that fail the job."""

from pyspark.sql import Column, functions as F


def must(condition: Column, message: Column | str) -> Column:
    """True where the condition holds; otherwise (null included) the job fails. For use in a filter, which is never dropped."""
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
