"""Cells of hand-written sheets: flags, numbers, types and modes; headers by synonym; requirement sheets and summaries of judgements."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import text as T

#: What a cell says for yes and for no.
YES = ["si", "sì", "s", "yes", "y", "true", "1", "x", "vero"]
NO = ["no", "n", "false", "0", "falso"]
MODES = ["variabile", "proporzionale", "on_off"]
#: Beginnings of the headers of code and name columns.
CODE_HEADERS = ["codifica", "codice", "code", "sku", "articolo", "cod", "id"]
NAME_HEADERS = ["denominazione", "descrizione", "nome", "prodotto", "description", "name", "product"]


def flag(cell: Column, default: bool) -> Column:
    """Boolean of a cell; `default` for null, blank and unknown ones."""
    s = F.lower(F.trim(cell))
    return F.when(s.isin(YES), True).when(s.isin(NO), False).otherwise(default)


def number(cell: Column) -> Column:
    """Double of a cell with a point or comma; null where it is no number."""
    return F.replace(F.trim(cell), F.lit(","), F.lit(".")).try_cast("double")


def business_type(cell: Column) -> Column:
    s = F.lower(T.accents_off(F.trim(cell)))
    return F.when(s.startswith("conformit"), "conformita").when(s.startswith("tabellar"), "tabellare").when(s.startswith("discrezional"), "discrezionale")


def mode(cell: Column, criterion: Column, default: str = "variabile") -> Column:
    """The mode a cell names, else what the criterion's text says, else `default`."""
    raw = F.replace(F.replace(F.lower(F.trim(cell)), F.lit("/"), F.lit("_")), F.lit(" "), F.lit("_"))
    s = F.lower(T.accents_off(criterion))
    derived = F.when(s.rlike(r"on[\s/_\-]?off"), "on_off").when(F.contains(s, F.lit("proporzional")), "proporzionale").when(F.contains(s, F.lit("discrezional")), "variabile")
    return F.coalesce(F.when(raw.isin(MODES), raw), derived, F.lit(default))


def column_of(header: list[str], starts: Iterable[str]) -> int | None:
    """The first column whose normalised header begins with one of the words."""
    words = tuple(starts)
    plain = [re.sub(r"[^a-z0-9]+", " ", (h or "").lower()).strip() for h in header]
    return next((i for i, h in enumerate(plain) if h.startswith(words)), None)


def products(header: list[str], rows: list[list[str | None]]) -> list[tuple[str | None, str]]:
    """(code, name) of a product sheet by its headers; the first column and the joined rest where none is known. Empty rows go."""
    code, name = column_of(header, CODE_HEADERS), column_of(header, NAME_HEADERS)
    out = []
    for raw in rows:
        cells = [(c or "").strip() for c in raw]
        if not any(cells):
            continue
        at = lambda i: cells[i] if i is not None and i < len(cells) else ""
        if code is None and name is None:
            out.append((cells[0] or None, " ".join(cells[1:]).strip()))
        else:
            out.append((at(code) or None, at(name)))
    return out


def summary(tabular: DataFrame, discretionary: DataFrame, by: str) -> DataFrame:
    """One row a group: counts and rate of tabular judgements, points of scored criteria and of those left to a person.

    tabular: `by`, judgment (unknown ones count as not verifiable); discretionary: `by`, score, max_points, human, attributed.
    """
    known = ["compliant", "non_compliant", "partial"]
    j = F.when(F.col("judgment").isin(known), F.col("judgment")).otherwise("not_verifiable")
    seen = F.count("*") - F.count_if(j == "not_verifiable")
    a = tabular.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(j == k).alias(k) for k in [*known, "not_verifiable"]), F.round(F.coalesce(F.try_divide(F.count_if(j == "compliant"), seen), F.lit(0.0)), 4).alias("rate"))
    scored = ~F.col("human") & F.col("score").isNotNull()
    points = lambda c, when: F.round(F.sum(F.when(when, F.col(c)).otherwise(0.0)), 2)
    b = discretionary.groupBy(by).agg(
        F.count("*").alias("criteria"), F.count_if(scored).alias("scored"), points("score", scored).alias("points"), points("max_points", scored).alias("most"),
        F.count_if("human").alias("to_review"), points("max_points", F.col("human")).alias("review_points"), F.count_if(~F.col("attributed")).alias("unattributed"),
    )
    return a.join(b, by, "full")
