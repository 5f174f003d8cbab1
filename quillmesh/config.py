"""Weights, thresholds and domains as data."""

from __future__ import annotations

# Names, weights and severities that results depend on.
METRICS = ("optimism", "fear", "uncertainty", "attention", "disagreement", "risk_intensity")
BASELINE = {
    "optimism": {"p_positive": 1.0, "b_bull": 0.0, "g_growth": 0.0},
    "fear": {"p_negative": 1.0, "b_bear": 0.0, "s_shock": 0.0},
    "uncertainty": {"p_neutral": 0.6, "entropy_norm": 0.4, "k_unc": 0.0},
    "attention": {"volume_ecdf": 1.0, "growth_ecdf": 0.0},
    "risk_intensity": {"weighted_mean": 0.7, "p90": 0.3},
}
ENHANCED = {
    "optimism": {"p_positive": 0.7, "b_bull": 0.2, "g_growth": 0.1},
    "fear": {"p_negative": 0.7, "b_bear": 0.2, "s_shock": 0.1},
    "uncertainty": {"p_neutral": 0.4, "entropy_norm": 0.3, "k_unc": 0.3},
    "attention": {"volume_ecdf": 0.7, "growth_ecdf": 0.3},
    "risk_intensity": {"weighted_mean": 0.7, "p90": 0.3},
}
RISK_SEVERITY = {
    "liquidity risk": 5, "credit risk": 5, "macro risk": 4, "regulatory risk": 4, "geopolitical risk": 4,
    "interest rate risk": 3, "earnings risk": 3, "commodity risk": 3, "demand risk": 3, "valuation risk": 2,
}
SIMILAR_TITLE, PREFIX_TOKENS = 0.9, 5
DECAY_HOURS = 72.0
WINDOW_HOURS, SPAN_HOURS, POLARITY = 48, 72, 0.3
HIT_SCALE = 3.0
COVERAGE_BOOST, DRIVER_CAP = 1.15, 115.0
DUPLICATE, REPRINT, UNIQUE = 0.3, 0.7, 1.0
ATTENTION_DAYS, HISTORY_DAYS, LOOKBACK = 7, 30, 7
#: Groups of the supplied tables, with one that never occurs.
GROUPS = ("absent", "click", "error", "purchase", "signup", "view")
