"""The two aggregates computed at request time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.money import is_exact, sum_amounts, sum_totals, total, total_decimal
from orderloom.operators.facts import exprs

COUNTS = ("count(1) as payments", "count(payment_value) as amounts")


def orders_by_status(orders: DataFrame) -> DataFrame:
    """``(status, order_count)``, most frequent first."""
    counted = orders.groupBy("order_status").agg(*exprs("count(1) as order_count"))
    return counted.selectExpr("order_status as status", "order_count").orderBy(F.desc("order_count"), "status")


def payments_by_type(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """``(payment_type, payment_count, total_amount, average_amount)``, largest total first.

    Amounts are rounded half to even on two decimals; the order is by the
    unrounded total. Payments of unknown orders do not count.

    Payments are combined per order and type before the join, which then meets
    one row per order and type however many payments an order has.
    """
    combined = payments.groupBy("order_id", "payment_type").agg(
        *exprs(*COUNTS), *sum_amounts("amount", "payment_value")
    )
    return _by_type(combined.join(orders.select("order_id").distinct(), "order_id", "left_semi"))


def unwound_payments_by_type(payments: DataFrame) -> DataFrame:
    """The same over the payments unwound from order documents."""
    return _by_type(
        payments.groupBy("payment_type").agg(*exprs(*COUNTS), *sum_amounts("amount", "payment_value"))
    )


def _by_type(combined: DataFrame) -> DataFrame:
    totals = combined.groupBy("payment_type").agg(
        *exprs("sum(payments) as payment_count", "sum(amounts) as amounts"), *sum_totals("amount")
    )
    return (
        totals.withColumn("amount", F.expr(total("amount")))
        .orderBy(F.desc("amount"), "payment_type")
        .selectExpr(
            "payment_type",
            "payment_count",
            f"if({is_exact('amount')}, cast(bround({total_decimal('amount')}, 2) as double), amount) as total_amount",
            "bround(try_divide(amount, amounts), 2) as average_amount",
        )
    )
