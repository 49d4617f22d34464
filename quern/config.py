"""The constants of the price-panel analyses, in one place."""

from __future__ import annotations

import datetime as dt

FIRST_DAY = dt.date(2024, 2, 28)
FULL_CATALOGUE_FROM = dt.date(2024, 6, 11)
HEADLINE_FROM = dt.date(2025, 1, 1)
FREEZE_WINDOWS = [("freeze 2024-25", dt.date(2024, 11, 1), dt.date(2025, 2, 5)), ("freeze 2025-26", dt.date(2025, 11, 1), dt.date(2026, 2, 5))]
PRICE_EPSILON = 0.005
SPELL_GAP_DAYS = 3
HORIZONS = (1, 2, 3, 7, 14)
LOOKBACK_DAYS = 14
RECENCY_DAYS, HISTORY_DAYS, RECENT_DAYS, STALE_AFTER_DAYS = 200, 42, 7, 14
CO_OBSERVED_DAYS = 90
CLAIM_TOLERANCE = 1.02
TIE_BAND = (0.99, 1.01)
LEAST_PAIR_DAY, LEAST_CATEGORY, LEAST_GTIN = 30, 200, 30
ADJUDICATION_DAYS, ADJUDICATION_TOLERANCE = 7, 0.15
MAGNITUDE_BANDS = {"x100": (95.0, 105.0), "x10": (9.5, 10.5), "/10": (0.095, 0.105), "/100": (0.0095, 0.0105)}
GRAMS = {"g": 1.0, "kg": 1000.0, "lb": 453.592, "lbs": 453.592, "oz": 28.3495}
MILLILITRES = {"ml": 1.0, "l": 1000.0, "fl oz": 29.5735, "floz": 29.5735}
EXTRACT_FLOORS = {"products": 2300, "comparable_pct": 40.0, "vintage_days": 21}
