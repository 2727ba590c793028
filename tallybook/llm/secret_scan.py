"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

All work is done by SQL expressions on the row that holds the text: no shuffle, no
Python. Positions of matches follow from the lengths of the texts between them.

Entropy: a candidate is a run of at least 20 characters of ``[A-Za-z0-9+/=_-]``.
Its character class (hex digits, letters, or mixed) selects an alphabet and a
threshold. A window of 20 characters slides over it. The count of each symbol is one
character of a string of counts; a step changes the counts of the entering and the
leaving symbol and the sum of n*log2(n), from which the entropy follows. The
candidate's span runs from the first to the last window at or above the threshold.
Allow-listed strings (identifiers, paths of plain words, placeholders) and spans
inside a match of a fixed pattern are suppressed.

Null text counts as empty: no spans, the digest of an empty string. Rows are
independent of each other, so repeated rows give repeated results; a null doc_id stays
null. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.once import once
from .common import columns

WINDOW = 20
# The patterns searched for, in the order in which spans of equal start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_letters", "entropy_mixed")
# class: pattern of the whole string, alphabet, least entropy in bits of a window
CLASSES = {
    "entropy_hex": (r"^[0-9A-Fa-f]+$", "0123456789abcdef", 3.0),
    "entropy_letters": (r"^[A-Za-z]+$", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 4.1),
    "entropy_mixed": ("", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-", 3.7),
}
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^[/_=+-]*(?:[A-Za-z]+[/_=+-]+)+[A-Za-z]*$",
    r"(?i:example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh)",
)
# Words of which every match of ASSIGN has one in some case; a cheap test before the pattern.
SIGNS = ("passw", "secret", "token", "api")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(pattern: str, group_length: bool = False, run: str = "", gate: str = "true") -> str:
    """SQL for the matches in ``body``: array of (start, size, value size, text).

    ``run`` is the character class of a pattern that matches maximal runs: looking
    behind, a search skips the places inside a run that is too short.
    """
    p = quoted(f"(?<!{run}){pattern}" if run else pattern)
    size = f"length(regexp_extract(h, {p}, 1))" if group_length else "length(h)"
    return f"""
    CASE WHEN {gate} AND body RLIKE {p} THEN aggregate(
      arrays_zip(transform(split(body, {p}), g -> length(g)), regexp_extract_all(body, {p}, 0)),
      named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,size:int,value:int,hit:string>>)),
      (s, z) -> CASE WHEN z.`1` IS NULL THEN s ELSE named_struct(
        'at', s.at + z.`0` + length(z.`1`),
        'out', concat(s.out, transform(array(z.`1`), h -> named_struct(
          'start', s.at + z.`0`, 'size', length(h), 'value', {size}, 'hit', h)))) END,
      s -> s.out) ELSE cast(array() AS array<struct<start:int,size:int,value:int,hit:string>>) END"""


def spans(found: str, kind: str, least: int) -> str:
    return f"""transform(filter({found}, m -> m.value >= {least}),
      m -> named_struct('start', m.start, 'kind', {KINDS.index(kind)}, 'end', m.start + m.size))"""


def windows(kind: str) -> str:
    """SQL for the hot part of candidate ``m``: struct (first, last), null where no window is hot."""
    _, alphabet, bits = CLASSES[kind]
    most = WINDOW * (log2(WINDOW) - bits)  # the entropy is at least ``bits`` where sum n*log2(n) is at most this
    terms = "array(" + ", ".join(f"{n * log2(n) if n else 0.0!r}D" for n in range(WINDOW + 2)) + ")"
    text = "lower(m.hit)" if kind == "entropy_hex" else "m.hit"
    count = "(ascii(substr(s.counts, k, 1)) - 48)"
    return f"""transform(array(transform(split({text}, ''), c -> locate(c, '{alphabet}'))), codes -> aggregate(
      sequence(1, 2 * m.size),
      named_struct('counts', repeat('0', {len(alphabet)}), 'terms', 0.0D, 'first', cast(null AS int), 'last', cast(null AS int)),
      (s, e) -> CASE
        WHEN e % 2 = 1 THEN transform(array(get(codes, cast((e - 1) / 2 AS int))), k -> named_struct(
          'counts', overlay(s.counts PLACING chr({count} + 49) FROM k FOR 1),
          'terms', s.terms + get({terms}, {count} + 1) - get({terms}, {count}), 'first', s.first, 'last', s.last))[0]
        WHEN e / 2 < {WINDOW} THEN s
        ELSE transform(array(CASE WHEN e / 2 = {WINDOW} THEN named_struct('counts', s.counts, 'terms', s.terms) ELSE
          transform(array(get(codes, cast(e / 2 AS int) - {WINDOW + 1})), k -> named_struct(
            'counts', overlay(s.counts PLACING chr({count} + 47) FROM k FOR 1),
            'terms', s.terms + get({terms}, {count} - 1) - get({terms}, {count})))[0] END), t -> named_struct(
          'counts', t.counts, 'terms', t.terms,
          'first', CASE WHEN t.terms <= {most!r}D THEN coalesce(s.first, cast(e / 2 AS int) - {WINDOW}) ELSE s.first END,
          'last', CASE WHEN t.terms <= {most!r}D THEN cast(e / 2 AS int) ELSE s.last END))[0] END))[0]"""


def entropy_spans() -> str:
    allowed = " OR ".join(f"m.hit RLIKE {quoted(p)}" for p in ALLOWED)
    kinds, cases = list(CLASSES), ""
    for kind in kinds:
        cases += f"WHEN m.hit RLIKE {quoted(CLASSES[kind][0])} THEN transform(array({windows(kind)}), w -> named_struct('kind', {KINDS.index(kind)}, 'first', w.first, 'last', w.last))[0] "
    return f"""filter(
      transform(transform(filter(candidates, m -> NOT ({allowed})), m -> named_struct('start', m.start, 'w', CASE {cases} END)),
        x -> named_struct('start', x.start + x.w.first, 'kind', x.w.kind, 'end', x.start + x.w.last)),
      x -> x.start IS NOT NULL AND NOT exists(base, b -> b.start <= x.start AND b.end >= x.end))"""


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body`` (text, empty for null), ``base`` and ``found``: arrays of (start, kind, end).

    ``base`` has the matches of the fixed patterns; ``found`` has those and the
    entropy spans. Both are in order of start, then kind; ends are exclusive and
    positions count code points. Kinds are indexes into ``KINDS``.
    """
    rows = columns(docs, ("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    signs = "(" + " OR ".join(f"contains(lower(body), '{word}')" for word in SIGNS) + ")"
    rows = once(
        rows,
        "base",
        F.expr(
            f"array_sort(cast(concat({spans(located(ASSIGN, True, gate=signs), 'assign', 12)}, {spans(located(ACCESS), 'access', 18)}, "
            f"{spans(located(HEX, run='[0-9a-f]'), 'hex', 16)}) AS {SPAN}))"
        ),
    )
    rows = once(rows, "candidates", F.expr(located(CANDIDATE, run='[A-Za-z0-9+/=_-]')))
    return once(rows, "found", F.expr(f"array_sort(cast(concat(base, {entropy_spans()}) AS {SPAN}))")).drop("candidates")


def listed(name: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({name}, s -> concat(get({names}, s.kind), ':', s.start, ':', s.end)), ',')"


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of matches per pattern, the digest of their places, and all spans as text."""
    found = scan_secrets(docs)
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS bigint)").alias(f"n_{KINDS[i]}") for i in range(3)]
    return found.select(
        "doc_id", *count, F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"), F.expr(listed("found")).alias("spans")
    )


def redact_secrets(docs: DataFrame, mark: str = "*") -> DataFrame:
    """``docs`` with every character of a span replaced by ``mark``; columns and row count stay.

    Overlapping spans are masked once. A null text stays null.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc_id"), "text", F.col("text").isNull().alias("blank"))
    found = scan_secrets(rows.select(F.struct("doc_id", "blank").alias("doc_id"), "text"))
    masked = f"""CASE WHEN size(found) = 0 THEN body ELSE aggregate(found, named_struct('at', 0, 'out', ''),
      (s, x) -> CASE WHEN x.end <= s.at THEN s ELSE named_struct('at', x.end, 'out', concat(
        s.out, substr(body, s.at + 1, greatest(0, x.start - s.at)),
        repeat({quoted(mark)}, x.end - greatest(x.start, s.at)))) END,
      s -> concat(s.out, substr(body, s.at + 1))) END"""
    out = found.select("doc_id.doc_id.*", F.when(~F.col("doc_id.blank"), F.expr(masked)).alias("text"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """The report in DuckDB SQL; window entropies are computed anew for every window."""

    def either(text: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in text)

    assign = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + ASSIGN[ASSIGN.index(")") :]

    def sql(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def found(pattern: str, kind: str, least: int, value: str) -> str:
        p = sql(pattern)
        return f"""select doc_id, {KINDS.index(kind)} as kind, pos as start, pos + length(hit) as stop, hit from (
          select doc_id, hits[i] as hit, vals[i] as val,
            list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as pos
          from (select *, unnest(range(1, len(hits) + 1)) as i from (
            select doc_id, regexp_extract_all(body, {p}) as hits, string_split_regex(body, {p}) as gaps,
              regexp_extract_all(body, {p}, {value}) as vals from d where regexp_matches(body, {p})))) where length(val) >= {least}"""

    allowed = " or ".join(f"regexp_matches(hit, {sql(p)})" for p in ALLOWED)
    kinds = " ".join(f"when {f'regexp_matches(hit, {sql(p)})' if p else 'true'} then {KINDS.index(k)}" for k, (p, _, _) in CLASSES.items())
    bits = " ".join(f"when {KINDS.index(k)} then {b}" for k, (_, _, b) in CLASSES.items())
    names = "[" + ", ".join(map(sql, KINDS)) + "]"
    entropy = f"""list_sum(list_transform(list_distinct(string_split(w, '')),
      lambda c: -((length(w) - length(replace(w, c, ''))) / {WINDOW}.0) * log2((length(w) - length(replace(w, c, ''))) / {WINDOW}.0)))"""
    text = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop)"
    return f"""
    with d as (select doc_id, coalesce(text, '') as body from documents),
    base as (select doc_id, kind, start, stop from ({found(assign, "assign", 12, "1")}
      union all {found(ACCESS, "access", 18, "0")} union all {found(HEX, "hex", 16, "0")})),
    candidates as (select *, case {kinds} end as class from (
      select doc_id, start, hit from ({found(CANDIDATE, "entropy_mixed", WINDOW, "0")})) where not ({allowed})),
    slid as (select *, substr(case when class = 3 then lower(hit) else hit end, i, {WINDOW}) as w from (
      select *, unnest(range(1, length(hit) - {WINDOW - 2})) as i from candidates)),
    hot as (select doc_id, start, class, min(i) as first, max(i) as last from slid
      where {entropy} >= case class {bits} end group by all),
    more as (select doc_id, class as kind, start + first - 1 as start, start + last + {WINDOW - 1} as stop from hot),
    added as (select * from more where not exists (
      select 1 from base where base.doc_id = more.doc_id and base.start <= more.start and base.stop >= more.stop))
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(base_text, '')) as base_sha256, coalesce(all_text, '') as spans
    from d left join (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
        count(*) filter (kind = 2) as n_hex, {text} as base_text from base group by doc_id) b using (doc_id)
      left join (select doc_id, {text} as all_text from (from base union all from added) group by doc_id) a using (doc_id)
    """
