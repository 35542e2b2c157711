"""Pricing parameters (exchange rate, margin, VAT) and their defaulting rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

# Fixed value: VAT multiplier used when none (or a non-positive one) is given.
DEFAULT_VAT = 1.12

# What each invoice rate falls back to when it is missing, unreadable or not positive.
INVOICE_FALLBACKS = {"forex": Decimal(1), "margin": Decimal(1), "vat": Decimal(str(DEFAULT_VAT))}

_PLAIN_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")


def _usable_rate(value) -> Decimal | None:
    """The exact value of a positive number given in any form, else ``None``."""
    text = "" if value is None else str(value).strip()
    if not _PLAIN_NUMBER.fullmatch(text):
        return None
    rate = Decimal(text)
    return rate if rate > 0 else None


@dataclass(frozen=True)
class PricingParams:
    """Request-level pricing: ``price * forex / margin * vat``.

    Forex multiplies pricing only (never billing), margin divides, VAT multiplies.
    """

    forex: float | None = 1.0
    margin: float | None = 1.0
    vat: float | None = None

    def for_grid(self) -> "PricingParams":
        """Grid / summary rules: a missing or zero VAT means the default, a zero margin means 1."""
        forex = 1.0 if self.forex is None else float(self.forex)
        margin = float(self.margin) if self.margin else 1.0
        vat = float(self.vat) if self.vat else DEFAULT_VAT
        return PricingParams(forex, margin, vat)

    def for_invoice(self) -> tuple[Decimal, Decimal, Decimal]:
        """Forex, margin and VAT of an invoice as exact decimals."""
        return tuple(_usable_rate(getattr(self, name)) or fallback for name, fallback in INVOICE_FALLBACKS.items())
