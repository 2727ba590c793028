"""Markdown reports as ordered lines.

A page is the set of its lines in the order (section, k1, k2); it is never
gathered into one value, since a page may hold any share of the ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import coin_cell, fiat_cell, fmt_cell
from ..schemas import HISTORY_TYPES
from ..settings import DEFAULT, Settings
from .history import tips_list
from .stats import global_stats, user_stats

LINE_ORDER = ("page", "section", "k1", "k2")


def _line(page: Column, section: int, k1: Column, k2: Column, line: Column) -> list[Column]:
    return [
        page.alias("page"),
        F.lit(section).alias("section"),
        k1.cast("bigint").alias("k1"),
        k2.cast("bigint").alias("k2"),
        line.alias("line"),
    ]


_FIRST = -(2**62)


def heading(pages: DataFrame, section: int, lines: Sequence[Column]) -> DataFrame:
    """Lines that precede the rows of a section, for each page of ``pages``."""
    numbered = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), text.alias("text")) for i, text in enumerate(lines)])
    )
    return pages.select("page", numbered.alias("_h")).select(
        *_line(F.col("page"), section, F.lit(_FIRST), F.col("_h.i"), F.col("_h.text"))
    )


def markdown_table(
    rows: DataFrame,
    page: Column,
    cells: dict[str, Column],
    section: int,
    order: tuple[Column, Column],
    title: Column | None = None,
) -> DataFrame:
    """Title, header, rule and one line per row, for every page among the rows."""
    k1, k2 = order
    body = rows.select(*_line(page, section, k1, k2, F.concat_ws("|", *cells.values())))
    head = [F.lit("|".join(cells)), F.lit("|".join([":---"] * len(cells)))]
    if title is not None:
        head = [title, F.lit("")] + head
    return heading(body.select("page").distinct(), section, head).unionByName(body)


def history_cells(viewer: Column, columns: Sequence[str], compact: bool, settings: Settings = DEFAULT) -> dict[str, Column]:
    """One formatted cell per history column; config3 is shown as subreddit."""
    return {
        ("subreddit" if c == "config3" else c): fmt_cell(c, F.col(c), viewer, compact, settings) for c in columns
    }


HISTORY_COLUMNS = (
    "type", "state", "from_user", "to_user", "ts", "to_addr", "coin_val", "coin", "fiat_val", "fiat", "config3",
)


# Fixed order of the sections of a user page.
_TOTALS = {
    1: ("tipped", "fiat", "#### Total tipped (fiat)"),
    2: ("tipped", "coin", "#### Total tipped (coins)"),
    3: ("received", "fiat", "#### Total received (fiat)"),
    4: ("received", "coin", "#### Total received (coins)"),
}
_HISTORY_SECTION = 5


def user_pages(username: DataFrame, action: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Lines of one page per name of a service: totals by unit and the whole history.

    People of one name on two services are two people and have a page each.

    Every page has all headings, so they come from the names alone and the
    totals and the history are each computed once.
    """
    page = F.concat(F.lit(settings.stats_page + "_"), F.col("service_id").cast("string"), F.lit("_"), F.col("name"))
    names = username.select("user_id", "service_id", F.lower("username").alias("name")).distinct()
    pages = names.select("service_id", "name").distinct()

    heads = [(0, 0, F.concat(F.lit("### Tipping summary for "), F.col("name"))), (0, 1, F.lit(""))]
    tables = {s: (title, (kind, "total")) for s, (_, kind, title) in _TOTALS.items()}
    tables[_HISTORY_SECTION] = (
        "#### History", tuple("subreddit" if c == "config3" else c for c in HISTORY_COLUMNS)
    )
    for section, (title, columns) in tables.items():
        texts = (title, "", "|".join(columns), "|".join([":---"] * len(columns)))
        heads += [(section, i, F.lit(text)) for i, text in enumerate(texts)]
    lines = F.array(
        *[F.struct(F.lit(s).alias("section"), F.lit(i).alias("i"), text.alias("text")) for s, i, text in heads]
    )
    headings = pages.select(page.alias("page"), F.explode(lines).alias("_h")).select(
        "page",
        F.col("_h.section").alias("section"),
        F.lit(_FIRST).cast("bigint").alias("k1"),
        F.col("_h.i").cast("bigint").alias("k2"),
        F.col("_h.text").alias("line"),
    )

    section = None
    for number, (direction, kind, _) in _TOTALS.items():
        here = (F.col("direction") == direction) & (F.col("kind") == kind)
        section = F.when(here, number) if section is None else section.when(here, number)
    shown = F.when(F.col("kind") == "fiat", fiat_cell(F.col("total"), settings)).otherwise(
        coin_cell(F.col("total"), settings)
    )
    totals = user_stats(username, action).join(names, "user_id").select(
        page.alias("page"),
        section.alias("section"),
        F.lit(0).cast("bigint").alias("k1"),
        # The first seven bytes of a unit, as a number, sort like the unit.
        F.conv(F.rpad(F.hex(F.substring("unit", 1, 7)), 14, "0"), 16, 10).cast("bigint").alias("k2"),
        F.concat(F.lit("**"), F.col("unit"), F.lit("**|"), shown).alias("line"),
    )

    kept = action.where(F.col("type").isin(*HISTORY_TYPES))
    sender, receiver = F.lower("from_user"), F.lower("to_user")
    both = F.array_distinct(F.array_compact(F.array(sender, receiver)))
    mine = kept.select("*", F.explode(both).alias("name")).join(pages, ["service_id", "name"], "left_semi")
    cells = history_cells(F.col("name"), HISTORY_COLUMNS, compact=False, settings=settings)
    newest = (-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("action_id"))
    history = mine.select(*_line(page, _HISTORY_SECTION, *newest, F.concat_ws("|", *cells.values())))
    return headings.unionByName(totals).unionByName(history)


def global_page(action: DataFrame, top: int = 10, settings: Settings = DEFAULT) -> DataFrame:
    """Lines of the page with global figures, one table per metric."""
    stats = global_stats(action, top)
    page = F.lit(settings.stats_page)
    # The metrics are few and fixed, so they share one section, ordered by name.
    cells = F.concat_ws(
        "|", "metric", F.coalesce("label", F.lit("-")), F.coalesce(F.col("amount").cast("string"), F.lit("-")), F.col("n").cast("string")
    )
    # Types, states, coins and top lists: a few dozen rows whatever the ledger.
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("metric", "position", "label"))
    body = stats.select(*_line(page, 1, rank, F.lit(0), cells))
    head = heading(
        stats.select(page.alias("page")).distinct(),
        1,
        [F.lit("### Global figures"), F.lit(""), F.lit("metric|label|amount|n"), F.lit(":---|:---|:---|:---")],
    )
    return head.unionByName(body)


def tips_page(action: DataFrame, limit: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Lines of the page with all completed tips, or the newest ``limit``."""
    tips = tips_list(action, limit)
    viewer = F.lit("")
    columns = ("row_no", "ts", "from_user", "to_user", "to_addr", "coin_val", "fiat_val")
    cells = {c: fmt_cell(c, F.col(c), viewer, compact=True, settings=settings) for c in columns}
    return markdown_table(
        tips, F.lit(settings.tips_page), cells, 1, (F.col("row_no"), F.lit(0)), F.lit("### All completed tips")
    )
