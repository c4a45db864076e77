"""Generated state-by-year program panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Program eras (inclusive years), their typical programs, and which programs are credit programs.
FIRST_ERA, SECOND_ERA = (2011, 2017), (2022, 2024)
FIRST_PROGRAMS = ["Loan Guarantee", "Loan Participation", "Capital Access Program"]
SECOND_PROGRAMS = ["Loan Guarantee", "Loan Participation", "Capital Access Program", "Venture Capital"]
CREDIT_PROGRAMS = ["Loan Guarantee", "Collateral Support", "Loan Participation", "Capital Access Program"]


def program_panel(states: DataFrame, first_year: int | Column = 2009, last_year: int | Column = 2024, shift: int | Column = 0,
                  state: str = "state_fips") -> DataFrame:
    """Program activity of every state and year; ``shift`` moves the eras for panels of other years."""
    def bound(y):
        return F.lit(y) if isinstance(y, int) else y

    years = F.explode(F.sequence(bound(first_year).cast("int"), bound(last_year).cast("int")))
    grid = states.select(state).distinct().select(state, years.alias("year"))
    y = F.col("year") - bound(shift)
    first, second = y.between(*FIRST_ERA), y.between(*SECOND_ERA)
    credit = [len([p for p in ps if p in CREDIT_PROGRAMS]) for ps in (FIRST_PROGRAMS, SECOND_PROGRAMS)]
    return grid.select(
        state, "year", (first | second).cast("int").alias("active"), second.cast("int").alias("second_era_active"),
        F.when(first, len(FIRST_PROGRAMS)).when(second, len(SECOND_PROGRAMS)).otherwise(0).alias("program_count"),
        F.when(first, credit[0]).when(second, credit[1]).otherwise(0).alias("n_credit_programs"),
        F.when(first, "first").when(second, "second").otherwise("none").alias("era_label"),
    )
