"""Amount reconciliation, field exclusivity, accounting validation.

Works on the columns made by ``rules.raw_rule_fields``: money as DECIMAL(28,2),
tax flattened to ``tax_amount``, ``tax_type``, ``tax_inferred``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyscan import fixed_values as fv
from tallyscan.functions.sqltext import MONEY, strip

_ZERO = f"cast(0 as {MONEY})"
_DISCOUNT = f"coalesce(discount, {_ZERO})"
_TAX = f"coalesce(tax_amount, {_ZERO})"


def _swap(columns: list[str], changed: dict[str, str]) -> list[str]:
    return [f"{changed[c]} as {c}" if c in changed else f"`{c}`" for c in columns]


def reconcile_amounts(fields: DataFrame) -> DataFrame:
    """subtotal - discount + tax must meet the total within a cent.

    Discounts are stored as negatives and still subtracted here, so a correct
    invoice with a discount comes out as inconsistent; ``validate_accounting`` adds
    the discount and accepts it. Both are kept as they are. When the amounts do not
    meet, a missing tax is inferred, else a missing discount, else the row is marked.
    """
    out = [c for c in fields.columns if c not in ("reconciliation_status", "reconciliation_error")]
    measured = fields.selectExpr("*", f"subtotal - {_DISCOUNT} + {_TAX} as _expected")
    tax_gap = f"(total - subtotal + {_DISCOUNT})"
    discount_gap = f"(subtotal + {_TAX} - total)"
    branch = f"""case
        when subtotal is null or total is null then 'skipped'
        when abs(_expected - total) <= {fv.RECONCILE_TOLERANCE} then 'ok'
        when tax_amount is null and {tax_gap} >= 0 then 'tax'
        when discount is null and {discount_gap} > 0 then 'discount'
        else 'inconsistent' end as _branch"""
    changed = {
        "tax_amount": f"case when _branch = 'tax' then cast({tax_gap} as {MONEY}) else tax_amount end",
        "tax_type": "case when _branch = 'tax' then 'sales_tax' else tax_type end",
        "tax_inferred": "case when _branch = 'tax' then true else tax_inferred end",
        "discount": f"case when _branch = 'discount' then cast(-{discount_gap} as {MONEY}) else discount end",
    }
    error = "concat('Expected total: ', _expected, ', Found: ', total, ', Difference: ', abs(_expected - total))"
    return measured.selectExpr("*", branch).selectExpr(
        *_swap(out, changed),
        "case when _branch = 'inconsistent' then 'inconsistent' end as reconciliation_status",
        f"case when _branch = 'inconsistent' then {error} end as reconciliation_error",
    )


def field_exclusivity(fields: DataFrame) -> DataFrame:
    """Drops a discount above the subtotal and a negative tax."""
    changed = {"discount": "case when abs(discount) > subtotal then null else discount end"}
    for c in ("tax_amount", "tax_type", "tax_inferred"):
        changed[c] = f"case when tax_amount < 0 then null else {c} end"
    return fields.selectExpr(*_swap(fields.columns, changed))


def validate_accounting(fields: DataFrame) -> DataFrame:
    """Adds ``validation_error`` (the first failed check) and ``is_valid``."""
    measured = fields.selectExpr("*", f"coalesce(subtotal, {_ZERO}) + {_TAX} + {_DISCOUNT} as _expected")
    text = "coalesce(cast({0} as string), '0')".format
    # a sum of nothing is written 0, any other with its two places
    expected = "case when coalesce(subtotal, tax_amount, discount) is null then '0' else cast(_expected as string) end"
    words = ", ".join(f"'{w}'" for w in fv.HEADER_WORDS)
    number = strip("invoice_number")
    error = f"""case
        when coalesce({number}, '') = '' then '{fv.MISSING_NUMBER}'
        when total is null then '{fv.MISSING_TOTAL}'
        when invoice_date is null then '{fv.MISSING_DATE}'
        when upper({number}) in ({words})
          then concat("Invoice number '", invoice_number, "' is a table header, not a valid invoice number")
        when abs(_expected - total) > {fv.VALIDATE_TOLERANCE}
          then concat('Math validation failed: total (', total, ') ≠ subtotal (', {text("subtotal")},
            ') + tax (', {text("tax_amount")}, ') + discount (', {text("discount")}, '). Expected: ', {expected},
            ', Difference: ', abs(_expected - total))
        end as validation_error"""
    checked = measured.selectExpr(*[f"`{c}`" for c in fields.columns], error)
    return checked.selectExpr("*", "validation_error is null as is_valid")
