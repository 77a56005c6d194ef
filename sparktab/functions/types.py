"""Logical types, column-name rules and roles; all of it works on names, types and a few collected aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Name rules whose matches must agree with published profiles.
EDA_ID_NAME = re.compile(r"(^id$|^id[_-]|[_-]id$|uuid|guid|identifier|(?:^|[_-])key$)", re.I)
PREFLIGHT_ID_NAME = re.compile(r"(^id$|^id[_\-\s]|[_\-\s]id$|uuid|guid|identifier|(?:^|[_\-\s])(?:row|record|sample|observation)[_\-\s]?id(?:$|[_\-\s]))", re.I)
DATE_NAME = re.compile(r"(date|time|timestamp|datetime|created|updated|occurred)", re.I)
PIPELINE_NAME = re.compile(r"(^|[_\-\s])(fold|split|partition)([_\-\s]|$)|(^|[_\-\s])duplicate[_\-\s]?group([_\-\s]|$)|^_?ml[_\-\s]", re.I)
FOLD_NAME = re.compile(r"(^|[_\-\s])(fold|split|partition)([_\-\s]|$)", re.I)
GROUP_NAME = re.compile(r"(^|[_\-\s])duplicate[_\-\s]?group([_\-\s]|$)|(^|[_\-\s])(?:group|entity|subject|patient|customer)[_\-\s]?id([_\-\s]|$)", re.I)
LEAKAGE_TOKENS = frozenset({"target", "label", "outcome", "result", "final", "actual"})

BOOLEAN, DATETIME, NUMERIC, CATEGORY, NESTED = "boolean", "datetime", "numeric", "categorical/text", "nested"


def logical_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(kind, (T.NumericType,)):
        return NUMERIC
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return NESTED
    return CATEGORY


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def counts_as_number(logical: str) -> bool:
    """Booleans are numbers to the identifier rule, as in the profiles that ours must agree with."""
    return logical in (NUMERIC, BOOLEAN)


def is_identifier(name: str, logical: str, non_null: int, distinct: int, rule: re.Pattern = EDA_ID_NAME) -> bool:
    """By name, or by nearly unique values of 20 rows or more that aren't numbers."""
    if non_null == 0:
        return False
    return bool(rule.search(name)) or (non_null >= 20 and distinct / non_null >= 0.98 and not counts_as_number(logical))


def is_pipeline_metadata(name: str) -> bool:
    return bool(PIPELINE_NAME.search(name))


def leakage_signal(name: str, target: str) -> bool:
    """Whether a feature's name shares a word of three letters or more with the target or with outcome words."""
    split = lambda x: {w for w in re.split(r"[^a-z0-9]+", x.lower()) if len(w) >= 3}
    return bool(split(name) & (split(target) | LEAKAGE_TOKENS))


@dataclass(frozen=True)
class ColumnFacts:
    """What a role is decided from."""

    name: str
    logical: str
    rows: int
    missing: int
    distinct: int
    parsed_dates: int = 0
    numeric: dict = field(default_factory=dict)

    @property
    def non_null(self) -> int:
        return self.rows - self.missing

    @property
    def missing_rate(self) -> float:
        return self.missing / self.rows if self.rows else 0.0


# Role names that published profiles use.
ROLES = (
    "target", "time", "group", "possible pipeline metadata", "possible identifier", "date/time-like", "constant",
    "numeric measure", "category/text",
)


def role(facts: ColumnFacts, target: str | None = None, time: str | None = None, group: str | None = None) -> str:
    """The first role, in the order of ROLES, that fits."""
    looks_dated = facts.logical == DATETIME or (bool(DATE_NAME.search(facts.name)) and facts.logical == CATEGORY and facts.parsed_dates >= max(1, int(facts.non_null * 0.8)))
    fits = (
        facts.name == target,
        facts.name == time,
        facts.name == group,
        is_pipeline_metadata(facts.name),
        is_identifier(facts.name, facts.logical, facts.non_null, facts.distinct),
        bool(DATE_NAME.search(facts.name)) and looks_dated,
        facts.distinct <= 1,
        facts.logical == NUMERIC,
        True,
    )
    return ROLES[fits.index(True)]


def infer_task(logical: str, non_null: int, distinct: int) -> str:
    few = distinct <= max(20, int(max(non_null, 1) ** 0.5))
    return "classification" if logical in (BOOLEAN, CATEGORY, NESTED) or few else "regression"
