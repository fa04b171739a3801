"""Data-quality checks over the role tables.

Row counts, missing values and date rules share one scan per table; each
uniqueness check is one aggregation; all relations to one parent share one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.sources.catalog import DATE_RULES, KEYS, ORDERS, RELATIONS, DateRule, Relation
from orderloom.sources.shop import Shop


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _name(column: str) -> str:
    """The column name quoted as an identifier."""
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    """The value quoted as a text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_missing(column: str) -> str:
    """SQL: NULL, or blank once read as text."""
    return f"coalesce(trim(cast({_name(column)} as string)), '') = ''"


def breaks_rule(rule: DateRule) -> str:
    """SQL: both times are readable and the later one lies before the earlier one."""
    return f"try_cast({rule.later} as timestamp_ntz) < try_cast({rule.earlier} as timestamp_ntz)"


def _count_if(condition: str, name: str) -> Column:
    return F.expr(f"count_if({condition}) as {_name(name)}")


def profile(name: str, table: DataFrame) -> DataFrame:
    """One row: ``rows``, ``missing:`` per column and, for orders, ``date:`` per rule."""
    measures = [F.expr("count(1) as rows")]
    measures += [_count_if(is_missing(c), f"missing:{c}") for c in table.columns]
    if name == ORDERS:
        measures += [_count_if(breaks_rule(r), f"date:{r.label}") for r in DATE_RULES]
    return table.agg(*measures)


def _stacked(measured: DataFrame, columns: Sequence[str], names: str, others: Sequence[str] = ()) -> DataFrame:
    """Rows ``names`` (label, value) from the named columns of a one-row table."""
    pairs = ", ".join(f"{_text(c)}, {_name(c)}" for c in columns)
    return measured.selectExpr(*others, f"stack({len(columns)}, {pairs}) as ({names})")


def row_counts(shop: Shop) -> DataFrame:
    """``(dataset, rows)``."""
    return _union(
        [t.agg(F.expr("count(1) as rows")).selectExpr(f"'{name}' as dataset", "rows") for name, t in shop.tables().items()]
    )


def missing_values(shop: Shop) -> DataFrame:
    """``(dataset, column, missing, percent)`` of the columns with missing values."""

    def of(name: str, table: DataFrame) -> DataFrame:
        measured = table.agg(F.expr("count(1) as rows"), *[_count_if(is_missing(c), c) for c in table.columns])
        counted = _stacked(measured, table.columns, "column, missing", ["rows"])
        return counted.where("missing > 0").selectExpr(
            f"'{name}' as dataset", "column", "missing", "missing / rows * 100 as percent"
        )

    return _union([of(name, t) for name, t in shop.tables().items()])


def extra_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``duplicates``: rows beyond the first of each key; NULL keys form one group."""
    groups = table.groupBy(*keys).agg(F.expr("count(1) as rows"))
    return groups.agg(F.expr("coalesce(sum(rows - 1), 0) as duplicates"))


def duplicate_keys(shop: Shop, keys: dict[str, tuple[str, ...]] = KEYS) -> DataFrame:
    """``(dataset, key, duplicates)``."""
    return _union(
        [
            extra_rows(shop.table(name), columns).selectExpr(
                f"'{name}' as dataset", f"'{' + '.join(columns)}' as key", "duplicates"
            )
            for name, columns in keys.items()
        ]
    )


def orphans(shop: Shop, relations: Sequence[Relation] = RELATIONS) -> DataFrame:
    """``(relation, child, parent, key, orphans)``: child rows whose key has no parent row.

    Parent and child keys are counted side by side in one aggregation per
    parent, so the parent is read once for all its children and a key with very
    many rows is combined before the shuffle. NULL child keys are no orphans.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for relation in relations:
        groups.setdefault((relation.parent, relation.key), []).append(relation.child)
    return _union([_orphans_of(shop, parent, key, children) for (parent, key), children in groups.items()])


def _orphans_of(shop: Shop, parent: str, key: str, children: list[str]) -> DataFrame:
    def keys_of(table: str) -> DataFrame:
        return shop.table(table).where(f"{key} is not null").selectExpr(f"{key} as key", f"'{table}' as source")

    by_key = (
        _union([keys_of(table) for table in (parent, *children)])
        .groupBy("key")
        .agg(F.expr(f"max(source = '{parent}') as known"), *[_count_if(f"source = '{c}'", c) for c in children])
    )
    measured = by_key.agg(*[F.expr(f"coalesce(sum(if(known, 0, `{c}`)), 0) as `{c}`") for c in children])
    return _stacked(measured, children, "child, orphans").selectExpr(
        f"concat(child, ' without {parent}') as relation",
        "child",
        f"'{parent}' as parent",
        f"'{key}' as key",
        "orphans",
    )


def date_order(orders: DataFrame, rules: Sequence[DateRule] = DATE_RULES) -> DataFrame:
    """``(rule, later, earlier, violations)``, all rules in one scan."""
    measured = orders.agg(*[_count_if(breaks_rule(r), r.label) for r in rules])
    rows = ", ".join(f"'{r.label}', '{r.later}', '{r.earlier}', `{r.label}`" for r in rules)
    return measured.selectExpr(f"stack({len(rules)}, {rows}) as (rule, later, earlier, violations)")


def findings(shop: Shop) -> DataFrame:
    """``(section, dataset, name, value)``: all counts of a report, one scan per table for its rows, gaps and dates.

    Sections are ``rows``, ``missing`` (columns that miss something), ``dates`` (rules
    of orders), ``duplicates`` (keys) and ``orphans`` (relations).
    """

    def of(name: str, table: DataFrame) -> DataFrame:
        measured = profile(name, table)
        values = _stacked(measured, measured.columns, "measure, value").where("value > 0 or measure not like 'missing:%'")
        section = "case when measure like 'missing:%' then 'missing' when measure like 'date:%' then 'dates' else 'rows' end as section"
        label = "if(measure = 'rows', '', substring(measure, locate(':', measure) + 1)) as name"
        return values.selectExpr(section, f"'{name}' as dataset", label, "value")

    scanned = [of(name, table) for name, table in shop.tables().items()]
    repeats = duplicate_keys(shop).selectExpr("'duplicates' as section", "dataset", "key as name", "duplicates as value")
    lost = orphans(shop).selectExpr("'orphans' as section", "child as dataset", "relation as name", "orphans as value")
    return _union([*scanned, repeats, lost])
