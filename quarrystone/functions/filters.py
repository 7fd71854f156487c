"""Parameters of lists as users give them, brought to what the queries accept. Nothing here touches rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCALES = ("en", "ko", "ja")
PRODUCT_TYPES = ("chequing", "savings", "gic", "credit-card", "mortgage", "personal-loan", "line-of-credit")
RUN_STATES = ("started", "completed", "failed", "retried")
MOST_ROWS = 100


def codes(values: Iterable[str] | None, allowed: Iterable[str] | None = None) -> list[str]:
    """Codes trimmed, in lower case, each once in the order given; those that aren't allowed are dropped."""
    clean = dict.fromkeys(" ".join(str(v).lower().split()) for v in values or [])
    return [c for c in clean if c and (allowed is None or c in allowed)]


def country(value: str | None, default: str = "CA") -> str:
    code = (value or default).strip().upper()
    return code if len(code) == 2 and code.isascii() and code.isalpha() else default


def one_of(value: str | None, allowed: Iterable[str], default: str | None) -> str | None:
    code = (value or "").strip().lower()
    return code if code in allowed else default


@dataclass(frozen=True)
class ListFilters:
    """What a list of products or runs is asked for, with everything invalid replaced or dropped."""

    locale: str
    country_code: str
    product_types: tuple[str, ...]
    states: tuple[str, ...]
    sort_by: str
    descending: bool
    page: int
    page_size: int


def normalised(*, locale: str | None = None, country_code: str | None = None, product_types: Iterable[str] | None = None, states: Iterable[str] | None = None, sort_by: str | None = None, sort_order: str | None = None, sorts: Iterable[str] = ("default",), page: int = 1, page_size: int = 20) -> ListFilters:
    """Invalid values take their defaults: English, Canada, all states, the first of ``sorts``; unknown types are dropped."""
    sorts = list(sorts)
    return ListFilters(
        locale=one_of(locale, LOCALES, "en"), country_code=country(country_code), product_types=tuple(codes(product_types, PRODUCT_TYPES)), states=tuple(codes(states, RUN_STATES)) or RUN_STATES,
        sort_by=one_of(sort_by, sorts, sorts[0]), descending=(sort_order or "").strip().lower() != "asc", page=max(1, page), page_size=min(MOST_ROWS, max(1, page_size)),
    )


def ordering(asked: ListFilters, columns: dict[str, str], tie: str) -> list[Column]:
    """The order of a list by a column of the whitelist, nulls last, ties by ``tie``."""
    own = F.col(columns[asked.sort_by])
    return [own.desc_nulls_last() if asked.descending else own.asc_nulls_last(), F.asc(tie)]
