"""Calendar helpers shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    """First day of the month: a 4-byte grouping key, labelled only after grouping."""
    return F.trunc(day, "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_index(day: Column) -> Column:
    """Months since year 0, ignoring the day of the month."""
    return F.year(day) * 12 + F.month(day)


def churn_status(is_churned: Column) -> Column:
    return F.when(is_churned == 1, "Churned").otherwise("Active")
