"""Commands: reading envelopes, triage, extraction from text, staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import keyword_amount, msg_kind, parse_amount, trunc8
from ..plans.once import once
from ..schemas import COMMAND_DDL, CONFIG_COLUMNS, ENVELOPE_DDL, HANDLED_COMMANDS
from ..settings import DEFAULT, Settings
from .rules import Rule, expand_rules

# Keyword amounts as (keyword, lowest, highest, divisor).
KEYWORD_AMOUNTS = (
    ("flip", 4, 4, 1),
    ("megaflip", 4, 80, 1),
    ("gigaflip", 4, 800, 1),
    ("roll", 4, 4, 1),
    ("megaroll", 4, 240, 1),
    ("gigaroll", 4, 2400, 1),
    ("random250", 0, 250000, 1000),
    ("random500", 0, 500000, 1000),
    ("random1000", 0, 1000000, 1000),
    ("blazeit", 420, 420, 1),
    ("lsd", 1967, 1967, 1),
    ("dogecar", 98, 98, 1),
    ("joshwise", 98, 98, 1),
    ("wutang", 36, 36, 1),
    ("netcodepool", 1337, 1337, 1),
    ("cake", 365, 365, 1),
)

ALL = "all"


def keyword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KEYWORD_AMOUNTS), "keyword string, lo long, hi long, divisor long")


# --- queue envelopes ---------------------------------------------------------


def read_commands(raw: DataFrame, column: str = "message") -> DataFrame:
    """Parse queue envelopes; ``reject_reason`` is null for usable commands.

    Keeps the raw text, so rejected rows can be written aside as they came.
    """
    opened = once(raw, "_env", F.from_json(F.col(column), ENVELOPE_DDL))
    opened = once(opened, "_cmd", F.from_json(F.col("_env.body"), COMMAND_DDL))
    blank = lambda c: F.coalesce(F.col(f"_cmd.{c}") == "", F.lit(True))
    needs_target = F.col("_cmd.type").isin("givetip", "withdraw")
    reason = (
        F.when(F.col("_env.body").isNull(), "no_body")
        .when(F.col("_cmd").isNull(), "bad_body")
        .when(blank("service"), "no_service")
        .when(blank("type"), "no_type")
        .when(blank("u_from"), "no_sender")
        .when(needs_target & (blank("u_to") == blank("addr_to")), "target_not_unique")
    )
    parsed = opened.select(
        *[F.col(c) for c in raw.columns],
        F.col("_env.id").alias("queue_id"),
        F.col("_env.reservation_id").alias("reservation_id"),
        "_cmd.*",
        reason.alias("reject_reason"),
    )
    return parsed.withColumns(
        {
            "take_all": F.coalesce(F.lower("coin_val") == ALL, F.lit(False)),
            "amount": parse_amount(F.col("coin_val")),
            "fiat_amount": parse_amount(F.col("fiatval")),
        }
    )


def accepted(commands: DataFrame) -> DataFrame:
    return commands.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(commands: DataFrame) -> DataFrame:
    return commands.where(F.col("reject_reason").isNotNull())


def route_commands(df: DataFrame, column: str = "type") -> DataFrame:
    """Handler of each command; a withdrawal is a tip to an address.

    Other types stay unsupported and belong to a reject output.
    """
    kind = F.col(column)
    route = F.when(kind == "withdraw", "givetip").when(kind.isin(*HANDLED_COMMANDS), kind)
    return df.withColumn("route", F.coalesce(route, F.lit("unsupported")))


def project_service_config(df: DataFrame) -> DataFrame:
    """config1..10 by service; the link may come as permalink or msg_link."""
    reddit, twitch, twitter, disqus = (
        F.col("service") == s for s in ("reddit", "twitch", "twitter", "disqus")
    )
    named = {
        "config1": F.when(reddit, F.col("msgid"))
        .when(twitch, F.col("channel"))
        .when(twitter, F.col("tweet_id"))
        .when(disqus, F.col("post_id")),
        "config2": F.when(reddit, F.col("fullname")).when(disqus, F.col("thread_id")),
        "config3": F.when(reddit, F.col("subreddit")),
        "config4": F.when(reddit, F.coalesce("msg_link", "permalink")),
        "config5": F.when(reddit, F.col("verify")),
    }
    empty = F.lit(None).cast("string")
    return df.withColumns({c: named.get(c, empty) for c in CONFIG_COLUMNS})


# --- inbox -------------------------------------------------------------------


def triage_inbox(messages: DataFrame, banned: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``drop_reason`` in order: no author, the bot itself, a banned author; null to keep."""
    names = banned.select(F.lower("name").alias("_banned")).distinct()
    joined = messages.join(names, F.lower("author") == F.col("_banned"), "left")
    reason = (
        F.when(F.coalesce(F.col("author") == "", F.lit(True)), "no_author")
        .when(F.lower("author") == settings.bot_name.lower(), "self")
        .when(F.col("_banned").isNotNull(), "banned")
    )
    return joined.withColumn("drop_reason", reason).drop("_banned")


def unread_inbox(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Messages not recorded as seen, oldest first."""
    fresh = messages.dropDuplicates(["fullname"]).join(seen.select("fullname"), "fullname", "left_anti")
    return fresh.orderBy("created_utc", "fullname")


def next_pending_batch(pending: DataFrame, n: int) -> DataFrame:
    """The oldest ``n`` seconds with pending rows, one row each (lowest msg_id)."""
    rows = F.min_by(F.struct(*pending.columns), F.col("msg_id")).alias("_row")
    first = pending.where(F.col("state") == "pending").groupBy(F.col("created_utc").alias("_at")).agg(rows)
    return first.orderBy("_at").limit(n).select("_row.*")


def triage_pending(pending: DataFrame, messages: DataFrame, matches: DataFrame) -> DataFrame:
    """New state of staged rows and whether they go out to the backend.

    ``messages`` is what can still be fetched; ``matches`` holds the fullnames
    whose text still yields an action.
    """
    live = messages.select(
        F.col("fullname").alias("_full"), F.col("author").alias("_author"), F.lit(True).alias("_live")
    )
    matched = matches.select(F.col("fullname").alias("_match")).distinct()
    joined = pending.join(live, F.col("fullname") == F.col("_full"), "left").join(
        matched, F.col("fullname") == F.col("_match"), "left"
    )
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    is_message = msg_kind(F.col("fullname")) == "message"
    skip = F.when(is_message, empty("from_user") | empty("msg_body")).otherwise(
        F.col("_live").isNull() | empty("_author")
    )
    found = F.col("_match").isNotNull() & (is_message | ~empty("msg_link"))
    return joined.select(
        *[F.col(c) for c in pending.columns if c != "state"],
        F.when(skip | found, "completed").otherwise("failed").alias("state"),
        (~skip & found).alias("emit"),
    )


# --- extraction --------------------------------------------------------------

_FIELDS = ("action", "rule", "to_user", "address", "amount", "keyword", "verify", "coin", "fiat")
_CAPTURED = {"to_user": "user", "address": "address", "amount": "amount", "keyword": "keyword", "verify": "verify"}
# No captured field can hold this character.
_SEP = "\u0001"


def _packed(rule: Rule, text: Column) -> Column:
    """All fields of a match in one string, by one replacement of the whole text."""
    constant = {"action": rule.action, "rule": rule.name, "coin": rule.coin, "fiat": rule.fiat}
    parts = []
    for field in _FIELDS:
        number = rule.group(_CAPTURED.get(field, ""))
        parts.append(f"${number}" if number else constant.get(field) or "")
    return F.regexp_replace(text, f"(?is)^.*?{rule.pattern}.*$", _SEP.join(parts))


def _chain(rules: list[Rule], text: Column) -> Column:
    chain = None
    for rule in rules:
        test, found = text.rlike("(?is)" + rule.pattern), _packed(rule, text)
        chain = F.when(test, found) if chain is None else chain.when(test, found)
    return chain


def match_command(text: Column, rules: list[Rule], settings: Settings = DEFAULT) -> Column:
    """Packed fields of the first matching rule, or null.

    Families of rules share a cheap test, so most texts try a few patterns only.
    """
    families: list[tuple[str, list[Rule]]] = []
    for rule in rules:
        if not families or families[-1][0] != rule.action:
            families.append((rule.action, []))
        families[-1][1].append(rule)
    lead = {
        "givetip": rf"(?i)\+(?:/u/)?{settings.bot_name}\s",
        "withdraw": r"(?i)\+withdraw\s",
    }
    parts = []
    for action, members in families:
        chain = _chain(members, text)
        parts.append(F.when(text.rlike(lead[action]), chain) if action in lead else chain)
    return F.when(text.contains("+"), F.coalesce(*parts))


def extract_commands(
    df: DataFrame, public_only: bool, text: str = "body", settings: Settings = DEFAULT
) -> DataFrame:
    """First matching rule per text and its fields; ``action`` is null without a match."""
    rules = [r for r in expand_rules(settings=settings) if r.public or not public_only]
    return _unpack(df, match_command(F.col(text), rules, settings))


def _unpack(df: DataFrame, packed: Column) -> DataFrame:
    fields = once(df, "_m", F.split(packed, _SEP))
    read = {f: F.nullif(F.get("_m", F.lit(i)), F.lit("")) for i, f in enumerate(_FIELDS)}
    matched = F.col("_m").isNotNull()
    read["rule"] = F.get("_m", F.lit(_FIELDS.index("rule")))
    read["to_user"] = F.substr(read["to_user"], F.lit(2))
    read["keyword"] = F.lower(read["keyword"])
    read["verify"] = F.when(matched, read["verify"].isNotNull())
    return fields.select(*[F.col(c) for c in df.columns], *[v.alias(f) for f, v in read.items()])


def price_keywords(cmds: DataFrame, keywords: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Replace a keyword by its amount; ``take_all`` marks the whole balance.

    ``keywords`` is configuration (a handful of rows), hence the broadcast.
    """
    table = keywords.select(F.col("keyword").alias("_kw"), "lo", "hi", "divisor")
    joined = cmds.join(table, F.lower("keyword") == F.col("_kw"), "left")
    drawn = keyword_amount(F.col("lo"), F.col("hi"), F.col("divisor"), F.col("fullname"), settings.keyword_seed)
    value = F.when(F.col("keyword").isNull(), parse_amount(F.col("amount"))).otherwise(drawn)
    return joined.select(
        *[F.col(c) for c in cmds.columns if c != "amount"],
        value.cast("decimal(20,8)").alias("amount"),
        F.coalesce(F.lower("keyword") == ALL, F.lit(False)).alias("take_all"),
    )


def read_inbox_commands(messages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Extraction for a mixed inbox: comments match public rules only."""
    all_rules = expand_rules(settings=settings)
    public = [r for r in all_rules if r.public]
    is_message = msg_kind(F.col("fullname")) == "message"
    body = F.col("body")
    # The public rules are the head of the rule list, so one pass serves both.
    tail = [r for r in all_rules if not r.public]
    head = match_command(body, public, settings)
    match = F.coalesce(head, F.when(is_message, match_command(body, tail, settings)))
    work = messages.withColumn("kind", F.when(is_message, "message").otherwise("comment"))
    return _unpack(work, match)


def build_action(
    cmds: DataFrame, settings: Settings = DEFAULT, convert_fiat: Column | None = None
) -> DataFrame:
    """Typed action or a ``reason`` why there is none.

    Input: priced commands with ``kind`` and, for comments, ``parent_author``.
    A fiat amount carries no coins and ends below the minimum later on, unless
    ``convert_fiat`` gives the rate to convert it with.
    """
    message = F.col("kind") == "message"
    recipient = F.when(
        ~message,
        F.coalesce("to_user", F.when(F.col("address").isNull(), F.col("parent_author"))),
    )
    reason = (
        F.when(F.col("action").isNull(), "no_match")
        .when(message & (F.col("action") == "givetip") & F.col("address").isNull(), "needs_address")
        .when(~message & F.col("address").isNull() & recipient.isNull(), "no_recipient")
        .when(~message & (F.lower("author") == F.lower(recipient)), "self_tip")
        .when(~message & (F.col("subreddit") == settings.blocked_subreddit), "blocked_subreddit")
    )
    has_fiat = F.col("fiat").isNotNull()
    coins = F.when(~has_fiat, F.col("amount"))
    if convert_fiat is not None:
        rate = F.when(convert_fiat > 0, convert_fiat).cast("decimal(20,8)")
        coins = coins.otherwise(trunc8((F.col("amount") / rate).cast("decimal(38,18)")))
    return cmds.select(
        *[F.col(c) for c in cmds.columns if c not in ("to_user", "address", "amount", "verify", "coin", "author")],
        F.lower("author").alias("from_user"),
        F.lower(recipient).alias("to_user"),
        F.col("address").alias("to_addr"),
        coins.cast("decimal(20,8)").alias("coin_val"),
        F.when(has_fiat, F.col("amount")).cast("decimal(20,10)").alias("fiat_val"),
        F.when(message, F.lit(settings.coin)).otherwise(F.col("coin")).alias("coin"),
        (~message & F.coalesce("verify", F.lit(False))).alias("verify"),
        reason.alias("reason"),
    )


def stage_actions(built: DataFrame, *extra: str) -> DataFrame:
    """Staging rows, one per usable action, and ``extra`` columns of them; the body is kept for messages only."""
    good = built.where(F.col("reason").isNull())
    amount = lambda c, t: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast(t)
    link = F.col("permalink") if "permalink" in good.columns else F.lit(None).cast("string")
    return good.select(
        F.col("action").alias("type"),
        F.lit("pending").alias("state"),
        "created_utc",
        "from_user",
        "to_user",
        "to_addr",
        F.when(~F.col("take_all"), amount("coin_val", "decimal(20,8)")).alias("coin_val"),
        amount("fiat_val", "decimal(20,10)").alias("fiat_val"),
        "take_all",
        F.lit(None).cast("string").alias("txid"),
        "coin",
        "fiat",
        F.when(F.col("kind") == "comment", F.col("subreddit")).alias("subreddit"),
        "verify",
        F.substring_index("fullname", "_", -1).alias("msg_id"),
        "fullname",
        link.alias("msg_link"),
        F.when(F.col("kind") == "message", F.col("body")).alias("msg_body"),
        *extra,
    )
