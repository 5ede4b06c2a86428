"""A record as a model's context has it, and as a page shows it: its description cut, and what its sections say in short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html, text


def firsts(sections: Column, field: str, n: int, left_out: str | None = None) -> Column:
    """The first n distinct values of a field over the sections, in their order; null, empty and `left_out` don't count."""
    values = F.transform(sections, lambda s: s[field])
    return F.slice(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "") & (F.lit(left_out is None) | (v != F.lit(left_out or ""))))), 1, n)


def latest(sections: Column, field: str, order: str) -> Column:
    """The field's value in the section of greatest `order` that has one (not null, not empty); of several the first."""
    has = F.filter(sections, lambda s: s[field].isNotNull() & (s[field].cast("string") != ""))
    return F.aggregate(has, F.get(has, F.lit(0)), lambda best, s: F.when(F.coalesce(s[order], F.lit("")) > F.coalesce(best[order], F.lit("")), s).otherwise(best), lambda best: best[field])


def context(code: Column, title: Column, description: Column, sections: Column, rated: list[str], counts: dict[str, str], terms: str = "term", meets: str = "meets", people: str = "instr", order: str = "order") -> Column:
    """A struct: code, title, the first 400 characters of the description, at most 5 terms, 3 meeting patterns (TBA isn't one) and 3 people, the latest value of each of the `rated` fields, and of the `counts` (name of each by field) as a struct, null if it is empty."""
    numbers = [latest(sections, field, order).alias(name) for field, name in counts.items()]
    any_ = F.coalesce(*(n.cast("string") for n in numbers)).isNotNull()
    own = [F.when(any_, F.struct(*numbers)).alias("enrollment")] if numbers else []
    return F.struct(
        code.alias("code"), title.alias("title"), F.substring(F.coalesce(description, F.lit("")), 1, 400).alias("description"),
        firsts(sections, terms, 5).alias("semesters"), firsts(sections, meets, 3, "TBA").alias("meets"), firsts(sections, people, 3).alias("instructors"),
        *(latest(sections, f, order).alias(f) for f in rated), *own,
    )


def card(description: Column, sections: Column, terms: str = "term", meets: str = "meets", people: str = "instr") -> Column:
    """A struct of what a card shows: at most 250 characters of markup, and 4 terms, 3 patterns (`TBA` if there is none) and 3 people as texts."""
    patterns = F.array_join(firsts(sections, meets, 3, "TBA"), " / ")
    return F.struct(
        html.shortened(F.coalesce(description, F.lit("")), 250).alias("description"), F.array_join(firsts(sections, terms, 4), ", ").alias("semesters"),
        F.when(patterns == "", "TBA").otherwise(patterns).alias("meets"), F.array_join(firsts(sections, people, 3), ", ").alias("instructors"),
    )


def query_vector(text: Column, filters: Column, vector: Column, dimensions: int) -> Column:
    """A query's vector; zeros for one that says nothing but has filters (an array)."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank & (F.size(filters) > 0), F.array_repeat(F.lit(0.0), dimensions)).otherwise(vector.cast("array<double>"))


# What a section's fields are without a value of their own.
DEFAULTS = {"instr": "", "meets": "TBA", "meetingTimes": "[]", "start_date": "", "end_date": "", "permreq": "N", "schd": ""}


def section(fields: dict[str, Column], optional: dict[str, Column] | None = None) -> Column:
    """A section as the index has it: `crn` and `srcdb` with season, year and semester of the latter, the fields of DEFAULTS (null, empty or not among `fields`: the default), the days of its pattern, and optional fields as they are, null where there is nothing."""
    code = F.coalesce(fields["srcdb"], F.lit(""))
    name = F.when(code == "", F.lit("")).otherwise(text.term_name(code))
    filled = {n: F.coalesce(F.nullif(fields.get(n, F.lit(None)).cast("string"), F.lit("")), F.lit(d)) for n, d in DEFAULTS.items()}
    return F.struct(
        fields["crn"].alias("crn"), code.alias("srcdb"), F.substring_index(name, " ", 1).alias("season"), F.substring(code, 1, 4).try_cast("int").alias("year"), name.alias("semester"),
        *(c.alias(n) for n, c in filled.items()), text.week_days(filled["meets"]).alias("days"), *(c.alias(n) for n, c in (optional or {}).items()),
    )
