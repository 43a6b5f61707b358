"""SQL fragments for DuckDB that repeat the Column expressions of `functions`."""

from __future__ import annotations

from ..functions import text as T


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SP = T.SPACE
LF = "chr(10)"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {quote(f'^{SP}+')}, ''), {quote(f'{SP}+$')}, '')"


def split(x: str) -> str:
    return f"string_split({x}, {LF})"


def joined(x: str) -> str:
    return f"array_to_string({x}, {LF})"


def _nest(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    return x


def markdown(x: str) -> str:
    rows = f"list_filter({split(x)}, lambda l: NOT regexp_matches(l, {quote(T.SEPARATOR)}) AND NOT regexp_matches(l, {quote(T.RULE)}))"
    cells = strip(sub("l", rf"{SP}*\|{SP}*", " "))
    return joined(f"list_transform({rows}, lambda l: CASE WHEN contains(l, '|') THEN {cells} ELSE l END)")


def uncertainty(x: str) -> str:
    inner = SP[1:-1]
    return sub(sub(sub(x, T.UNCERTAIN), rf"\[([^\[\]{inner}]+)\]", r"\1"), rf"⟨([^⟨⟩{inner}]+)⟩", r"\1")


STEPS = {
    "nfc": lambda x: f"nfc_normalize({x})",
    "line_strip": lambda x: joined(f"list_transform({split(sub(x, chr(92) + 'r' + chr(92) + 'n?', chr(10)))}, lambda l: {strip('l')})"),
    "markdown": markdown,
    "dehyphenate": lambda x: sub(x, rf"([^{SP[1:-1]}]){T.HYPHENS}\n", r"\1"),
    "uncertainty_marks": uncertainty,
    "newline_to_space": lambda x: f"replace({x}, {LF}, ' ')",
    "ligatures": lambda x: _nest(x, T.LIGATURES),
    "long_s": lambda x: f"translate({x}, 'ſʃ', 'ss')",
    "sharp_s": lambda x: _nest(x, (("ß", "ss"), ("ẞ", "SS"))),
    "combining_e": lambda x: _nest(x, T.SMALL_E),
    "lowercase": lambda x: f"lower({x})",
    "uv": lambda x: f"translate({x}, 'vV', 'uU')",
    "ij": lambda x: f"translate({x}, 'jJ', 'iI')",
    "whitespace": lambda x: f"trim({sub(x, f'{SP}+', ' ')})",
}


def normalize(x: str, tier: str) -> str:
    x = f"coalesce({x}, '')"
    for name in T.TIERS[tier]:
        x = STEPS[name](x)
    return x


def split_lines(x: str) -> str:
    each = f"list_transform({split(sub(f'''coalesce({x}, '')''', chr(92) + 'r' + chr(92) + 'n?', chr(10)))}, lambda l: {strip('l')})"
    return f"list_filter({each}, lambda l: l <> '')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {quote(f'{SP}+')}), lambda t: t <> '')"


def strip_token(x: str) -> str:
    return f"trim({x}, {quote(T.TOKEN_EDGES)})"


def known(a: str, b: str) -> str:
    """The distinct characters of a pair; a column of its own, so that it is made once a row."""
    return f"list_distinct(string_split({a} || {b}, ''))"


def char_edits(a: str, b: str, k: str) -> str:
    """DuckDB's levenshtein counts bytes: the pair's distinct characters, k, become single bytes first."""
    as_bytes = lambda s: f"translate({s}, array_to_string({k}, ''), array_to_string(list_transform(generate_series(1, len({k})), lambda i: chr(CAST(i AS INTEGER))), ''))"
    return f"(CASE WHEN {a} = {b} THEN 0 WHEN {a} = '' THEN length({b}) WHEN {b} = '' THEN length({a}) ELSE levenshtein({as_bytes(a)}, {as_bytes(b)}) END)"


def word_edits(a: str, b: str) -> str:
    """The same for arrays of words, of at most 126 distinct ones."""
    known = f"list_distinct(list_concat({a}, {b}))"
    as_bytes = lambda s: f"array_to_string(list_transform({s}, lambda c: chr(CAST(list_position({known}, c) AS INTEGER))), '')"
    return f"(CASE WHEN len({a}) = 0 THEN len({b}) WHEN len({b}) = 0 THEN len({a}) ELSE levenshtein({as_bytes(a)}, {as_bytes(b)}) END)"


def clean(x: str) -> str:
    """A scalar subquery over one text: the stages of `text.clean`, one a level."""
    full = f"list_transform(l, lambda s: {strip('s')} <> '')"
    note = f"list_filter(generate_series(2, len(l)), lambda i: regexp_matches({strip('l[i]')}, {quote('(?i)' + T.TRAILER)}) AND {strip('l[i - 1]')} = '')"
    tidy = sub("s", r"^\s{0,3}#{1,6}\s+")
    tidy = sub(tidy, r"\*\*(.+?)\*\*|__(.+?)__", r"\1\2")
    tidy = f"regexp_replace({sub(tidy, '(?i)' + T.TAGS)}, {quote(f'{SP}+$')}, '')"
    lines = f"list_filter({split(sub(f'''coalesce({x}, '')''', chr(92) + 'r' + chr(92) + 'n?', chr(10)))}, lambda s: NOT regexp_matches({strip('s')}, {quote(T.FENCE)}))"
    q = f"SELECT {lines} AS l"
    q = f"SELECT l[coalesce(list_position({full}, true), len(l) + 1):] AS l FROM ({q})"
    q = f"SELECT CASE WHEN len(l) > 1 AND regexp_matches({strip('l[1]')}, {quote('(?i)' + T.PREAMBLE)}) THEN l[2:] ELSE l END AS l FROM ({q})"
    q = f"SELECT l[:len(l) + 1 - coalesce(list_position(list_reverse({full}), true), len(l) + 1)] AS l FROM ({q})"
    q = f"SELECT CASE WHEN len(l) > 2 AND len({note}) > 0 THEN l[:list_max({note}) - 2] ELSE l END AS l FROM ({q})"
    return f"(SELECT {sub(strip(joined(f'list_transform(l, lambda s: {tidy})')), f'{chr(92)}n{{3,}}', chr(10) * 2)} FROM ({q}))"


def block_text(x: str) -> str:
    marked = sub(sub(sub(x, "</t[dh]>", " | "), "</tr>", "\n"), "<[^>]+>")
    return joined(split_lines(f"(CASE WHEN contains({x}, '<') AND contains({x}, '>') THEN {marked} ELSE {x} END)"))


def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / nullif({den}, 0))"


def f1(kept: str, ref: str, hyp: str) -> str:
    r, p = f"coalesce({ratio(kept, ref)}, 0)", f"coalesce({ratio(kept, hyp)}, 0)"
    return f"(CASE WHEN {ref} = 0 AND {hyp} = 0 THEN NULL WHEN {r} + {p} = 0 THEN 0.0 ELSE 2 * {r} * {p} / ({r} + {p}) END)"


def log_facet(x: str, floor: float, ceiling: float) -> str:
    return f"(CASE WHEN {x} > 0 AND NOT isnan(CAST({x} AS DOUBLE)) THEN greatest(0.0, least(1.0, (log10({ceiling}) - log10({x})) / (log10({ceiling}) - log10({floor})))) END)"
