"""Exact, order-independent sums of money held in ``double`` columns.

A plain ``sum`` of doubles depends on the order in which partitions arrive, and
a ``sum`` of decimals takes more than three times as long.
Amounts are therefore counted in units of 1/10,000, split into a high part in
multiples of 2^20 units and a low part below that. The high part is added as a
double, which is exact for whole numbers up to 2^53 (totals up to 9e17), and the
low part as a ``bigint``; both add exactly in any order.

What an amount has beyond its units (nothing, with up to four decimals) is counted
in units of 2^-30 of those, in two further whole numbers, off by less than 5e-14 per
row. Of amounts from 4e14 on, multiples of 2^40 are counted in a double of their
own, exact up to totals of 9e27, and the rest as above. NaN and infinities go there
too, so they reach the total the way a double sum would carry them.

Every part is a few bits short of its type, and carries into the next one where
totals are added up: no group of fewer than 2^43 rows overflows.

A money total named ``x`` travels between aggregations as ``x_hi``, ``x_lo``,
``x_re``, ``x_fi`` and ``x_to``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_ONE = 10_000
EXACT_BELOW = "4e14D"
LARGEST = "1.7976931348623157e308D"
LIMB_BITS = 20
LIMB = 1 << LIMB_BITS
# What one high unit is worth.
HIGH_VALUE = f"{LIMB / UNITS_PER_ONE}D"
# Amounts from EXACT_BELOW on: what one top unit is worth.
TOP_VALUE = f"{float(1 << 40)}D"
# Fine units per one, for what amounts have beyond whole units, and how they are split.
FINER = f"{UNITS_PER_ONE * (1 << 30)}D"
FINE_BITS = 15
FINE = 1 << FINE_BITS
# Below this many high units the whole total is an exact double.
FAST_HIGH = f"{1 << 32}D"
EXACT_HIGH = f"{1 << 53}D"


def total_columns(name: str) -> list[str]:
    """Names of the columns that carry the total ``name``."""
    return [f"{name}_{part}" for part in ("hi", "lo", "re", "fi", "to")]


def _top(amount: str) -> str:
    # NaN compares greater than every number, so it goes here too.
    return f"if(abs({amount}) < {EXACT_BELOW}, 0D, rint({amount} / {TOP_VALUE}))"


def _body(amount: str) -> str:
    """What the top part leaves: below 4e14 and exact, as the top is a power of two."""
    beyond = f"if(abs({amount}) <= {LARGEST}, {amount} - rint({amount} / {TOP_VALUE}) * {TOP_VALUE}, 0D)"
    return f"if(abs({amount}) < {EXACT_BELOW}, {amount}, {beyond})"


def _units(amount: str) -> str:
    return f"cast(rint({_body(amount)} * {UNITS_PER_ONE}) as bigint)"


def _finer(amount: str) -> str:
    return f"cast(rint(({_body(amount)} - cast({_units(amount)} as double) / {UNITS_PER_ONE}D) * {FINER}) as bigint)"


def sum_amounts(name: str, *amounts: str, times: str | None = None) -> list[Column]:
    """Aggregates adding up one or two SQL expressions of every row; NULL counts as 0.

    ``times`` counts each row that many times.
    """
    if len(amounts) > 2:
        raise ValueError("more than two amounts may not fit one bigint")
    doubles = [f"cast({a} as double)" for a in amounts]
    units, finer, top = (" + ".join(part(a) for a in doubles) for part in (_units, _finer, _top))
    high = f"cast(shiftright({units}, {LIMB_BITS}) as double)"
    fine = (f"shiftright({finer}, {FINE_BITS})", f"({finer}) & {FINE - 1}L")
    return _sums(name, (high, f"({units}) & {LIMB - 1}L", *fine, top), times)


def sum_totals(name: str, times: str | None = None) -> list[Column]:
    """Aggregates adding up the totals ``name`` of every row; NULL totals count as 0."""
    high, low, rest, fine, top = total_columns(name)
    rest = f"({rest} + shiftright({fine}, {FINE_BITS}))"
    low = f"({low} + shiftright({rest}, {30 - FINE_BITS}))"
    carried = f"{high} + cast(shiftright({low}, {LIMB_BITS}) as double)"
    parts = (carried, f"{low} & {LIMB - 1}L", f"{rest} & {(1 << (30 - FINE_BITS)) - 1}L", f"{fine} & {FINE - 1}L", top)
    return _sums(name, parts, times)


def _sums(name: str, parts: tuple[str, ...], times: str | None) -> list[Column]:
    counted = "" if times is None else f" * {times}"
    return [F.expr(f"sum(({part}){counted}) as {column}") for part, column in zip(parts, total_columns(name))]


def _added(position: int, names: tuple[str, ...]) -> str:
    zero = ("0D", "0L", "0L", "0L", "0D")[position]
    return "(" + " + ".join(f"coalesce({total_columns(n)[position]}, {zero})" for n in names) + ")"


def _settled(names: tuple[str, ...]) -> tuple[str, str, str, str]:
    """SQL for high, low, fine and top of a sum of totals, carried so that equal sums have equal parts."""
    high, low, rest, fine, top = (_added(i, names) for i in range(5))
    rest = f"({rest} + shiftright({fine}, {FINE_BITS}))"
    low = f"({low} + shiftright({rest}, {30 - FINE_BITS}))"
    return high, low, f"(({rest} & {(1 << (30 - FINE_BITS)) - 1}L) * {FINE}L + ({fine} & {FINE - 1}L))", top


def is_exact(*names: str) -> str:
    """SQL: the totals hold whole units only, so that :func:`total_decimal` may be taken."""
    high = _added(0, names)
    return f"(abs({high}) < {EXACT_HIGH} and {_added(4, names)} = 0)"


def total_decimal(*names: str, times: str | None = None) -> str:
    """SQL for the exact sum of the totals ``names`` as a decimal."""
    high, low, fine, _ = _settled(names)
    high, low = (f"cast(cast({part} as bigint) as decimal(20,0))" for part in (high, low))
    units = f"cast({high} * {LIMB} + {low} as decimal(26,0))"
    if times is not None:
        units = f"{units} * cast({times} as decimal(12,0))"
    counted = "" if times is None else f" * {times}"
    finer = f"cast({fine}{counted} / {FINER} as decimal(20,12))"
    return f"(cast({units} * 0.0001BD as decimal(38,12)) + {finer})"


def total(*names: str, times: str | None = None) -> str:
    """SQL for the sum of the totals ``names`` as a double; 0.0 when there was nothing to add.

    Nearly all totals are whole units below 2^53, whose quotient is the nearest
    double without a detour over decimals.
    """
    high, low, fine, top = _settled(names)
    counted = "" if times is None else f" * {times}"
    small = f"abs({high}{counted}) < {FAST_HIGH} and abs({low}{counted}) < {1 << 52}L"
    fast = f"(cast({high} as bigint) * {LIMB}L + {low}){counted} / {UNITS_PER_ONE}D"
    exact = f"cast({total_decimal(*names, times=times)} as double)"
    finer = f"{fine}{counted} / {FINER}"
    inexact = f"(({high} * {HIGH_VALUE} + {low} / {UNITS_PER_ONE}D){counted} + {finer})"
    fast = f"if({fine} = 0, {fast}, {fast} + {finer})"
    below = f"(case when {small} then {fast} when abs({high}) < {EXACT_HIGH} then {exact} else {inexact} end)"
    return f"if({top} = 0, {below}, {below} + {top}{counted} * {TOP_VALUE})"
