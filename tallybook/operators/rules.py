"""The ordered command rules.

A rule is written as a sequence of tokens; the regular expression and its group
numbers follow from the tokens.  Order matters: the first rule found anywhere in
a text decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..settings import DEFAULT, Settings

# Patterns of the command language.
USER = r"@[\w-]{3,20}"
AMOUNT = r"[0-9]{1,9}(?:\.[0-9]{0,8})?"
KEYWORDS = (
    "all", "flip", "megaflip", "gigaflip", "roll", "megaroll", "gigaroll",
    "random250", "random500", "random1000", "blazeit", "lsd", "dogecar", "joshwise",
    "wutang", "netcodepool", "cake",
)
COIN_UNITS = {"dog": ("doge", "dogecoin", "dogecoins", "doges", "Ð", "dog", "xdg")}
COIN_ADDRESS = {"dog": "[9AaD][1-9a-zA-Z]{20,40}"}
# In matching order: by unit name.
FIAT_UNITS = {
    "cny": ("¥", "cny"),
    "eur": ("€", "eur"),
    "gbp": ("£", "gbp"),
    "jpy": ("¥", "jpy"),
    "rub": ("r", "rur"),
    "usd": (r"\$", "usd"),
}

# The rules in order.  ``_`` is white space; a name in capitals is
# captured; verify is optional.  Public rules also apply to comments.
RULES = """
givetip  a         public  tip _ AMOUNT _ COIN verify
givetip  aa        public  tip _ KEYWORD _ COIN verify
givetip  b         public  tip _ ADDRESS _ AMOUNT _ COIN verify
givetip  bb        public  tip _ ADDRESS _ KEYWORD verify
givetip  bbb       public  tip _ ADDRESS _ COIN AMOUNT verify
givetip  bbbb      public  tip _ ADDRESS _ COIN KEYWORD verify
givetip  bbbbbbbb  public  tip _ ADDRESS _ AMOUNT verify
givetip  c         public  tip _ USER _ AMOUNT _ COIN verify
givetip  cc        public  tip _ USER _ KEYWORD _ COIN verify
givetip  ccc       public  tip _ USER _ COIN AMOUNT verify
givetip  cccc      public  tip _ USER _ COIN KEYWORD verify
givetip  ccccc     public  tip _ USER _ KEYWORD verify
givetip  g         public  tip _ COIN AMOUNT verify
givetip  gg        public  tip _ COIN KEYWORD verify
givetip  ggggg     public  tip _ KEYWORD verify
gold     -         public  tip _ gold
info     -         private info
register -         private register
accept   -         private accept
decline  -         private decline
withdraw a         private withdraw _ ADDRESS _ AMOUNT _ COIN
withdraw aa        private withdraw _ ADDRESS _ KEYWORD _ COIN
withdraw aaa       private withdraw _ ADDRESS _ COIN AMOUNT
withdraw aaaa      private withdraw _ ADDRESS _ COIN KEYWORD
withdraw b         private withdraw _ ADDRESS _ FIAT AMOUNT _ COIN
withdraw bb        private withdraw _ ADDRESS _ FIAT KEYWORD _ COIN
history  -         private history
redeem   a         private redeem _ COIN
rates    -         private rates
"""
# Rules that name a coin without a unit in the text.
IMPLIED_COIN = {("givetip", "bbbbbbbb")}


@dataclass(frozen=True)
class Rule:
    action: str
    name: str
    public: bool
    pattern: str
    groups: tuple[tuple[str, int], ...]  # captured field -> group number
    coin: str | None
    fiat: str | None

    def group(self, field: str) -> int:
        return dict(self.groups).get(field, 0)


def _alternatives(words: tuple[str, ...]) -> str:
    return "|".join(words)


def expand_rules(
    actions: str = RULES,
    coins: dict[str, tuple[str, ...]] = COIN_UNITS,
    fiat: dict[str, tuple[str, ...]] = FIAT_UNITS,
    settings: Settings = DEFAULT,
) -> list[Rule]:
    """The rule table: one rule per coin and, where a fiat amount occurs, per fiat."""
    bot = re.escape(settings.bot_name)
    out = []
    for line in actions.strip().splitlines():
        action, name, scope, *tokens = line.split()
        for coin in coins if "COIN" in tokens or (action, name) in IMPLIED_COIN else (None,):
            for unit in fiat if "FIAT" in tokens else (None,):
                words = {
                    "_": r"\s+",
                    "tip": rf"\+(?:/u/{bot}|{bot})",
                    "verify": r"(?:\s+)?(verify)?",
                    "info": r"\+(?:info|balance)",
                    "USER": f"({USER})",
                    "AMOUNT": f"({AMOUNT})",
                    "KEYWORD": f"({_alternatives(KEYWORDS)})",
                    "ADDRESS": f"({COIN_ADDRESS[coin or next(iter(coins))]})",
                    "COIN": f"(?:{_alternatives(coins[coin])})" if coin else "",
                    "FIAT": f"(?:{_alternatives(fiat[unit])})" if unit else "",
                    "gold": r"gold(?:\s+)?(?:verify)?",
                }
                pattern = "".join(words.get(t, rf"\+{t}") for t in tokens)
                captured = [t for t in tokens if t in ("USER", "AMOUNT", "KEYWORD", "ADDRESS", "verify")]
                groups = tuple((t.lower(), i) for i, t in enumerate(captured, start=1))
                label = "" if name == "-" else name
                out.append(Rule(action, label, scope == "public", pattern, groups, coin, unit))
    return out
