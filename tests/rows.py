"""Builders of small cost tables."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from spendshift.periods import Period
from spendshift.schemas import COST

BASELINE = Period(date(2026, 7, 6), date(2026, 7, 12))
CURRENT = Period(date(2026, 7, 13), date(2026, 7, 19))
DEFAULTS = {
    "provider": "aws",
    "billing_account_id": "111122223333",
    "service_name": "Amazon Elastic Compute Cloud",
    "service_category": "Other",
    "charge_category": "usage",
    "charge_description": "",
    "region_id": "us-east-1",
    "resource_id": "i-1",
    "resource_name": None,
    "sku_id": "BoxUsage",
    "usage_quantity": 1,
    "usage_unit": "Hrs",
    "billed_cost": 1,
    "currency": "USD",
    "tags": {},
    "commitment_discount_id": None,
    "source_record_id": "r",
}


def days(period: Period):
    return [period.start + timedelta(days=n) for n in range(period.days)]


def cost(day, amount, quantity=1, **fields):
    row = {**DEFAULTS, "usage_date": day, "billed_cost": amount, "effective_cost": amount, "usage_quantity": quantity}
    row.update(fields)
    return row


def cost_table(spark, rows):
    numbers = ("usage_quantity", "billed_cost", "effective_cost")
    data = []
    for seq, row in enumerate(rows):
        full = {"seq": seq, **row}
        data.append(tuple(Decimal(str(full[n])) if n in numbers else full[n] for n in COST.names))
    return spark.createDataFrame(data, COST)
