"""Rule filters over candidates of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal each value that is given; None means no filter on that column."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def period_conflict(asked: Column, named: Column, published: Column) -> Column:
    """DIFFERENT_PERIOD if the passage names years and none is asked for, unless it was published in one of them; or if it
    names none and was published more than a year after the last one asked for."""
    year = F.year(published)
    has, names = F.coalesce(F.size(asked) > 0, F.lit(False)), F.coalesce(F.size(named) > 0, F.lit(False))
    disjoint = names & ~F.coalesce(F.arrays_overlap(asked, named), F.lit(False)) & ~F.coalesce(F.array_contains(asked, year), F.lit(False))
    late = ~names & F.coalesce(year > F.array_max(asked) + 1, F.lit(False))
    return F.when(has & (disjoint | late), "DIFFERENT_PERIOD")


def entity_conflict(asked: Column, named: Column) -> Column:
    """DIFFERENT_ENTITY if both name entities of a kind (streets, districts) and share none."""
    both = (F.coalesce(F.size(asked), F.lit(0)) > 0) & (F.coalesce(F.size(named), F.lit(0)) > 0)
    return F.when(both & ~F.coalesce(F.arrays_overlap(asked, named), F.lit(False)), "DIFFERENT_ENTITY")


def acronym_conflict(asked: Column, named: Column) -> Column:
    """DIFFERENT_ENTITY if the passage has a sibling of an asked acronym, one with the same first two letters, and not that one."""
    lost = F.filter(asked, lambda a: ~F.array_contains(named, a))
    sibling = F.exists(lost, lambda a: F.exists(named, lambda b: (F.substring(a, 1, 2) == F.substring(b, 1, 2)) & ~F.array_contains(asked, b)))
    return F.when(F.coalesce(sibling, F.lit(False)), "DIFFERENT_ENTITY")


def rule_conflict(q: str, c: str) -> Column:
    """The first conflict of a joined row: q and c are structs with years, streets, districts, acronyms, c also published."""
    field = lambda s, f: F.col(f"{s}.{f}")
    return F.coalesce(
        period_conflict(field(q, "years"), field(c, "years"), field(c, "published")),
        entity_conflict(field(q, "streets"), field(c, "streets")),
        entity_conflict(field(q, "districts"), field(c, "districts")),
        acronym_conflict(field(q, "acronyms"), field(c, "acronyms")),
    )


def apply_rules(candidates: DataFrame, conflict: Column, asked: str, category: str, penalty: float = 0.85, generic: tuple[str, ...] = ("general", "other")) -> tuple[DataFrame, DataFrame]:
    """Candidates without a conflict, scores of another category than asked for lowered unless either is generic; and the
    dropped ones with their reason."""
    rows = candidates.withColumn("reason", conflict)
    plain = F.coalesce(F.col(asked).isin(*generic) | F.col(category).isin(*generic) | F.col(asked).isNull() | F.col(category).isNull(), F.lit(True))
    kept = rows.where("reason is null").drop("reason")
    return kept.withColumn("score", F.when(~plain & (F.col(asked) != F.col(category)), F.col("score") * penalty).otherwise(F.col("score"))), rows.where("reason is not null")


def apply_recency(candidates: DataFrame, question: str, published: str, today: Column, days: int = 365, applies: Column | None = None) -> DataFrame:
    """Of each question's candidates those 0 to `days` days old; if there are none all, dated ones marked outdated."""
    age = F.date_diff(today, F.col(published))
    recent = F.coalesce(age.between(0, days), F.lit(False))
    on = F.lit(True) if applies is None else applies
    rows = candidates.withColumn("_recent", recent).withColumn("_any", F.max("_recent").over(W.partitionBy(question)))
    kept = rows.where(~on | ~F.col("_any") | F.col("_recent"))
    return kept.withColumn("outdated", on & ~F.col("_any") & F.col(published).isNotNull()).drop("_recent", "_any")
