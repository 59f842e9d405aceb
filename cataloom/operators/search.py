"""Predicates of searches: facets, ranges, text, document filters, paging."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions import scalars


def all_of(predicates: Iterable[Column | None]) -> Column:
    """AND over the predicates that are given; an empty search matches everything."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def any_in(values: Column, wanted: list) -> Column | None:
    """At least one of the array's values is wanted."""
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else None


def none_in(values: Column, unwanted: list) -> Column | None:
    found = any_in(values, unwanted)
    return None if found is None else ~found


@dataclass
class CatalogueSearch:
    """A search over nested catalogue rows; empty fields do not restrict. AND across fields, OR inside a field."""

    text: str = ""
    exact_name: str = ""
    include: dict[str, list] = field(default_factory=dict)
    exclude: dict[str, list] = field(default_factory=dict)
    at_least: dict[str, int] = field(default_factory=dict)
    min_year: int | None = None
    max_year: int | None = None
    include_duplicates: bool = False

    def predicate(self, name: str = "name", texts: list[str] | None = None, year: str = "release_year", duplicate_of: str | None = "duplicate_of") -> Column:
        """``include`` and ``exclude`` are by array column; ``at_least`` bounds array sizes; years are inclusive and a
        null year never matches a bound."""
        parts: list[Column | None] = [
            all_terms(self.text, [F.col(c) for c in texts or [name]]) if self.text else None,
            F.lower(F.col(name)) == self.exact_name.lower() if self.exact_name else None,
            F.col(year) >= self.min_year if self.min_year is not None else None,
            F.col(year) <= self.max_year if self.max_year is not None else None,
            F.col(duplicate_of).isNull() if duplicate_of and not self.include_duplicates else None,
        ]
        parts += [any_in(F.col(c), v) for c, v in self.include.items()] + [none_in(F.col(c), v) for c, v in self.exclude.items()]
        parts += [F.size(c) >= n for c, n in self.at_least.items()]
        return all_of(parts)


def _query_terms(text: str) -> list[str]:
    import re
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(c))
    return list(dict.fromkeys(re.findall("[a-z0-9]+", folded.lower())))


def all_terms(text: str, columns: list[Column]) -> Column:
    """Every folded term of ``text`` is a term of one of the columns."""
    found = scalars.terms(F.concat_ws(" ", *columns))
    return all_of([F.array_contains(found, t) for t in _query_terms(text)])


def fuzzy_terms(text: str, columns: list[Column]) -> Column:
    """As ``all_terms``, with edits allowed by length: none up to 2 characters, one up to 5, two beyond."""
    found = scalars.terms(F.concat_ws(" ", *columns))

    def near(term: str) -> Column:
        edits = 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
        return F.exists(found, lambda w: F.levenshtein(w, F.lit(term), edits) >= 0)

    return all_of([near(t) for t in _query_terms(text)])


def active_years_within(min_year: Column, max_year: Column, start: int, end: int) -> Column:
    """An artist's years lie inside the asked ones."""
    return (min_year >= start) & (max_year <= end)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page by a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows by key, with ``next_cursor`` on each: the last key if more rows follow, else null."""
    rows = rows if after is None else rows.where(F.col(key) > F.lit(after))
    some = rows.orderBy(key).limit(limit + 1)
    ends = some.agg(F.sort_array(F.collect_list(key)).alias("keys")).select(F.when(F.size("keys") > limit, F.get("keys", F.lit(limit - 1))).alias("next_cursor"), F.slice("keys", 1, limit).alias("kept"))
    return some.crossJoin(F.broadcast(ends)).where(F.array_contains("kept", F.col(key))).drop("kept")


#: A condition on a path of a JSON document: (path, operator, value).
Condition = tuple[str, str, object]
COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == F.lit(v), "!=": lambda c, v: c != F.lit(v), ">": lambda c, v: c > F.lit(v), "<": lambda c, v: c < F.lit(v),
    ">=": lambda c, v: c >= F.lit(v), "<=": lambda c, v: c <= F.lit(v), "LIKE": lambda c, v: c.like(v), "NOT LIKE": lambda c, v: ~c.like(v),
    "IN": lambda c, v: c.isin(list(v)), "NOT IN": lambda c, v: ~c.isin(list(v)),
}


def document_condition(json: Column, condition: Condition) -> Column:
    """One condition on a variant column. CONTAINS asks whether the array at the path has the value."""
    path, operator, value = condition
    at = "$" if path == "" else f"$.{path}"
    if operator == "CONTAINS":
        kind = "string" if isinstance(value, str) else "bigint" if isinstance(value, int) else "double"
        return F.coalesce(F.array_contains(F.try_variant_get(json, at, f"array<{kind}>"), F.lit(value)), F.lit(False))
    sample = value[0] if isinstance(value, (list, tuple)) else value
    kind = "string" if isinstance(sample, str) else "boolean" if isinstance(sample, bool) else "bigint" if isinstance(sample, int) else "double"
    return COMPARE[operator](F.try_variant_get(json, at, kind), value)


class DocumentFilter:
    """Conditions in order, joined by AND unless said otherwise; AND binds tighter than OR, groups count as one."""

    def __init__(self) -> None:
        self.alternatives: list[list[Condition | DocumentFilter]] = [[]]

    def where(self, path: str, operator: str, value: object) -> DocumentFilter:
        self.alternatives[-1].append((path, operator, value))
        return self

    def group(self, other: DocumentFilter) -> DocumentFilter:
        self.alternatives[-1].append(other)
        return self

    def otherwise(self) -> DocumentFilter:
        self.alternatives.append([])
        return self

    def predicate(self, json: Column) -> Column:
        parts = [all_of([p.predicate(json) if isinstance(p, DocumentFilter) else document_condition(json, p) for p in some]) for some in self.alternatives if some]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def live(expires_at: Column, now: Column) -> Column:
    """Not expired."""
    return expires_at.isNull() | (expires_at > now)
