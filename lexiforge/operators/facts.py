"""Facts of passages: dates, academic years, event intervals, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed month names, in order.
MONTHS_RO = ("ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie")
FACT = ["passage_id", "type", "qualifier", "source_text", "unit", "int_value", "date_value", "start_date", "end_date", "start_year", "end_year"]


def _facts(df: DataFrame, **cols: Column) -> DataFrame:
    kinds = {"int_value": "bigint", "date_value": "date", "start_date": "date", "end_date": "date", "start_year": "int", "end_year": "int"}
    return df.select("passage_id", *[cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FACT[1:]])


def _month(name: Column, months: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.lower(name) == m, F.lit(i)) for i, m in enumerate(months, 1)])


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All matches of a pattern as structs of the whole match (g0) and its groups (g1 ...)."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(n + 1)])


def date_facts(passages: DataFrame, text: str = "search_text", months: tuple[str, ...] = MONTHS_RO) -> tuple[DataFrame, DataFrame]:
    """Facts and rows (passage_id, warning): `d1/ d2 și d3 month year` as three dates, `d month year` outside of those,
    d.m.yyyy, and academic years 20xx-20xx. What is no date gives INVALID_DATE_IGNORED."""
    names, t = "|".join(months), F.col(text)
    three = rf"(?iU)([0-9]{{1,2}})/ ?([0-9]{{1,2}}) (?:și|si|and) ([0-9]{{1,2}}) ({names}) ((?:19|20)[0-9]{{2}})"
    one = rf"(?iU)(?<![0-9])([0-9]{{1,2}}) ({names}) ((?:19|20)[0-9]{{2}})"
    dotted = r"(?<![0-9.])([0-9]{1,2})\.([0-9]{1,2})\.((?:19|20)[0-9]{2})(?![0-9])"
    rest = F.regexp_replace(t, three, "|")
    a = passages.select("passage_id", F.explode(_groups(t, three, 5)).alias("m")).select("passage_id", "m.g0", F.explode(F.array("m.g1", "m.g2", "m.g3")).alias("d"), _month(F.col("m.g4"), months).alias("mo"), F.col("m.g5").alias("y"))
    b = passages.select("passage_id", F.explode(_groups(rest, one, 3)).alias("m")).select("passage_id", "m.g0", F.col("m.g1").alias("d"), _month(F.col("m.g2"), months).alias("mo"), F.col("m.g3").alias("y"))
    c = passages.select("passage_id", F.explode(_groups(t, dotted, 3)).alias("m")).select("passage_id", "m.g0", F.col("m.g1").alias("d"), F.col("m.g2").cast("int").alias("mo"), F.col("m.g3").alias("y"))
    dates = a.unionByName(b).unionByName(c).withColumn("v", _date(F.col("y"), F.col("mo"), F.col("d")))
    years = passages.select("passage_id", F.explode(_groups(t, r"(?<![0-9])(20[0-9]{2})\s?[–-]\s?(20[0-9]{2})(?![0-9])", 2)).alias("m"))
    years = years.select("passage_id", "m.g0", F.col("m.g1").cast("int").alias("a"), F.col("m.g2").cast("int").alias("b")).where("b = a + 1")
    facts = _facts(dates.where("v is not null"), type=F.lit("date"), qualifier=F.lit("exact"), source_text=F.col("g0"), date_value=F.col("v")).unionByName(
        _facts(years, type=F.lit("academic_year"), qualifier=F.lit("exact"), source_text=F.col("g0"), start_year=F.col("a"), end_year=F.col("b"))
    )
    return facts, dates.where("v is null").select("passage_id", F.lit("INVALID_DATE_IGNORED").alias("warning")).distinct()


def event_intervals(passages: DataFrame, period: str = "period_raw", text: str = "search_text") -> tuple[DataFrame, DataFrame]:
    """Facts and warnings of event periods: fragments between slashes, `d-d.m[.y]`, `d.m[.y]` or `d.m-d.m[.y]`.

    A fragment without a year takes the only one in the passage, else EVENT_YEAR_MISSING or EVENT_YEAR_AMBIGUOUS. A fragment
    that is none of the forms or no date ends the period with a warning; those before it stay.
    """
    years = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", F.col(text), F.col(period)), F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)))
    rows = passages.where(F.col(period).isNotNull()).select("passage_id", years.alias("years"), F.posexplode(F.split(period, "/")).alias("pos", "f")).withColumn("f", F.trim("f"))
    forms = [
        (r"^([0-9]{1,2})\s*[-–]\s*([0-9]{1,2})\.([0-9]{1,2})(?:\.([0-9]{4}))?$", (1, 3, 2, 3, 4)),
        (r"^([0-9]{1,2})\.([0-9]{1,2})(?:\.([0-9]{4}))?$", (1, 2, 1, 2, 3)),
        (r"^([0-9]{1,2})\.([0-9]{1,2})\s*[-–]\s*([0-9]{1,2})\.([0-9]{1,2})(?:\.([0-9]{4}))?$", (1, 2, 3, 4, 5)),
    ]
    part = lambda i: F.coalesce(*[F.when(F.col("f").rlike(p), F.regexp_extract("f", p, g[i])) for p, g in forms])
    own = part(4)
    year = F.when(F.length(own) > 0, own).when(F.size("years") == 1, F.element_at("years", 1))
    rows = rows.select("passage_id", "pos", "f", "years", year.alias("y"), *[part(i).alias(n) for i, n in enumerate(("d1", "m1", "d2", "m2"))])
    rows = rows.withColumn("a", _date(F.col("y"), F.col("m1"), F.col("d1"))).withColumn("b", _date(F.col("y"), F.col("m2"), F.col("d2")))
    code = (
        F.when(F.col("d1").isNull(), "EVENT_PERIOD_UNSUPPORTED")
        .when(F.col("y").isNull() & (F.size("years") == 0), "EVENT_YEAR_MISSING")
        .when(F.col("y").isNull(), "EVENT_YEAR_AMBIGUOUS")
        .when(F.col("a").isNull() | F.col("b").isNull() | (F.col("b") < F.col("a")), "EVENT_DATE_INVALID")
    )
    rows = rows.withColumn("warning", code)
    stop = F.min(F.when(F.col("warning").isNotNull(), F.col("pos"))).over(W.partitionBy("passage_id"))
    rows = rows.withColumn("_stop", stop)
    good = rows.where("_stop is null or pos < _stop")
    facts = _facts(good, type=F.lit("event_interval"), qualifier=F.lit("exact"), source_text=F.col("f"), start_date=F.col("a"), end_date=F.col("b"))
    return facts, rows.where("pos = _stop").select("passage_id", "warning")


def numeric_facts(passages: DataFrame, text: str = "search_text", units: str = r"zile|echipe(?: de verificare)?|instituții", type_: str = "type") -> DataFrame:
    """Counts: a number that opens a line with its label, `n unit` in running text (not in lists), `peste n mii` as a lower bound."""
    t = F.col(text)
    lines = passages.select("passage_id", F.explode(F.split(t, "\n")).alias("l")).select("passage_id", F.col("l"), F.regexp_extract("l", r"^\s*(?:[-•*]\s*)?([0-9]+)\s+\p{L}", 1).alias("n"), F.regexp_extract("l", r"^\s*(?:[-•*]\s*)?[0-9]+\s+(.+)$", 1).alias("u")).where("n <> ''")
    inline = passages.where(F.col(type_) != "list").select("passage_id", F.explode(_groups(t, rf"(?iU)(?<=\S )(?<![0-9])([0-9]+) ({units})(?!\w)", 2)).alias("m")).select("passage_id", "m.*")
    over = passages.select("passage_id", F.explode(_groups(t, r"(?iU)\bpeste ([0-9]+) mii\b(?: de ((?:\w+ ?){1,2}))?", 2)).alias("m")).select("passage_id", "m.*")
    a = _facts(lines, type=F.lit("count"), qualifier=F.lit("exact"), source_text=F.col("l"), unit=F.trim("u"), int_value=F.try_to_number("n", F.lit("999999999999999")))
    b = _facts(inline, type=F.lit("count"), qualifier=F.lit("exact"), source_text=F.col("g0"), unit=F.col("g2"), int_value=F.try_to_number("g1", F.lit("999999999999999")))
    c = _facts(over, type=F.lit("count"), qualifier=F.lit("lower_bound"), source_text=F.trim("g0"), unit=F.trim("g2"), int_value=F.try_to_number("g1", F.lit("999999999999999")) * 1000)
    return a.unionByName(b).unionByName(c)


def enrich(passages: DataFrame, type_: str = "type") -> tuple[DataFrame, DataFrame]:
    """All facts with ids, and all warnings; events have intervals instead of dates."""
    from lexiforge.functions.text import stable_id

    dates, w1 = date_facts(passages.where(F.col(type_) != "municipal_event"))
    events, w2 = event_intervals(passages.where(F.col(type_) == "municipal_event"))
    facts = dates.unionByName(events).unionByName(numeric_facts(passages))
    ids = stable_id("fact", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FACT])
    return facts.withColumn("fact_id", ids), w1.unionByName(w2).distinct()
