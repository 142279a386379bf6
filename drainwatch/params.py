"""Thresholds of the rules and of the state, with their shipped defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

# The native coin's mint, the launchpads' own curve venues, the stage order.
WRAPPED_SOL = "So11111111111111111111111111111111111111112"
CURVE_DEXES = ("pumpfun", "meteora_dbc", "raydium_launchpad")
STAGE_RANK = {"created": 0, "curve": 1, "graduated": 2}
TRACKED_TYPES = ("token_create", "pool_create", "graduation", "liquidity", "meme", "swap")
FIREHOSE_TYPES = ("swap", "transfer")

# How raw text names a token, its time and its type.
MINT_KEYS = r'"(?:mint|base_mint|quote_mint)":"(\w+)"'
BLOCK_TIME = r'"block_time":(\d+)'
FRAME_TYPE = r'"type":\s*"(\w+)"'
STARTS_TRACKING = r'"type":"(?:token_create|meme|graduation)"'

# Measured precision of each rule and its typical warning time in seconds.
CONFIDENCE = {"red": (422, 431, 485), "amber": (359, 435, 129)}
RULE_NAME = {"red": "creator-adds-liquidity", "amber": "repeat-rugger"}

MINUTE = 60
HOUR = 3600


@dataclass(frozen=True)
class Params:
    min_peak_usd: Decimal = Decimal("1000")
    max_floor_usd: Decimal = Decimal("5")
    fingerprint_min: Decimal = Decimal("84.9")
    fingerprint_max: Decimal = Decimal("85.1")
    burst_window_s: int = 24 * HOUR
    burst_max_launches: int = 10
    resolve_s: int = 60 * MINUTE
    reload_days: int = 7
    reading_bucket_s: int = 60
    idle_curve_s: int = 60 * MINUTE
    idle_graduated_s: int = 1440 * MINUTE
    retention_default_s: int = 24 * HOUR
    retention_serial_s: int = 168 * HOUR
    late_after_s: int = 60
    max_future_skew_s: int = 60
    pending_ttl_s: int = 600
    prior_rugs_shown: int = 5
    suspect_repoll_s: int = 10 * MINUTE
    known_refresh_s: int = 360 * MINUTE
    min_refresh_s: int = 60
    min_token_age_s: int = 10
    max_wait_s: int = 30 * MINUTE
    stale_after_s: int = 30

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULTS = Params()
