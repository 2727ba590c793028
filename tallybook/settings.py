"""Parameters of the ledger: everything a deployment may want to change."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Settings:
    bot_name: str = "tipbot"
    coin: str = "dog"
    fiat: str = "usd"
    minimum: Decimal = Decimal("4")
    verify_above: Decimal = Decimal("1000")
    expire_hours: int = 48
    confirmations: int = 6
    new_user_days: int = 7
    gold_fiat: int = 4
    gold_step: int = 100
    gold_floor: int = 10000
    history_page: int = 50
    pending_batch: int = 50
    unprocessed_batch: int = 10000
    blocked_subreddit: str = "promos"
    keyword_seed: int = 42
    # Services whose bot account must exist and which hold escrow.
    service_bots: tuple[tuple[str, str], ...] = (
        ("reddit", "tipbot"),
        ("twitch", "tipbot"),
        ("twitter", "tipbot"),
    )
    banned: tuple[str, ...] = ()
    coin_symbol: str = "Ð"
    fiat_symbol: str = "$"
    coin_label: str = "DOGE"
    explorer_address: str = "https://explorer.example/address/"
    stats_page: str = "stats"
    tips_page: str = "tips"


DEFAULT = Settings()
