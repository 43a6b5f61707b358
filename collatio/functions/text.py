"""Text normalisation as Column expressions. All stay inside the JVM.

White space is what Unicode text splitting takes for it, and is named point by point, since regular-expression engines differ.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column], Column]

# They must be as they are for right results.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HYPHENS = "[-¬⸗=]"
UNCERTAIN = r"\[\?\]|\[\.\.\.\]|\[…\]|\(\?\)"
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ſt"), ("ﬆ", "st"))
SMALL_E = (("aͤ", "ä"), ("oͤ", "ö"), ("uͤ", "ü"), ("Aͤ", "Ä"), ("Oͤ", "Ö"), ("Uͤ", "Ü"))
TOKEN_EDGES = ".,;:!?\"'()[]{}<>«»„“”‚‘’-–—/\\|*+=_~^`§$%&#@"
PERIOD_GLYPHS = "ſʆÿŸæœꝛꝑꝓꝗꝙꝰꝝﬅﬆ"
PERIOD_MARKS = "ͤ̅̄"
FENCE = r"^```[a-zA-Z0-9_-]*\s*$"
PREAMBLE = r"^(here('s| is)|the (following|transcription)|transcription|transkription|sure|okay|ok)\b.*[:：]\s*$"
TRAILER = r"^(note|hinweis|i (have|was)|the (text|page|image)|this (page|text|image)|\*+note)\b.*"
TAGS = r"</?(u|b|i|em|strong|s|del|sub|sup|br|p|span|div)\s*/?>"

LINE_END = "\r\n?"
CELL_EDGE = rf"{SPACE}*\|{SPACE}*"
HYPHENATED = rf"{HYPHENS}\n(?<=[^{SPACE[1:-1]}]{HYPHENS}\n)"  # looks back from a line end, not from every place
BRACKETED = rf"\[([^\[\]{SPACE[1:-1]}]+)\]"
ANGLED = rf"⟨([^⟨⟩{SPACE[1:-1]}]+)⟩"
LONG_S, SHARP_S, V_AS_U, J_AS_I = ("ſʃ", "ss"), (("ß", "ss"), ("ẞ", "SS")), ("vV", "uU"), ("jJ", "iI")
SEPARATOR = rf"^{SPACE}*\|?{SPACE}*:?-{{2,}}:?{SPACE}*(\|{SPACE}*:?-{{2,}}:?{SPACE}*)*\|?{SPACE}*$"
RULE = rf"^{SPACE}*([-*_]{SPACE}*){{3,}}$"
#: The same white space as characters: the JVM's engine tests a class member by member, at each character of a text.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Letters beyond ASCII whose decomposition holds one of the marks; derived, not listed.
MARKED = "".join(c for c in map(chr, range(0x80, 0x3000)) if any(m in unicodedata.normalize("NFD", c) for m in PERIOD_MARKS))
PERIOD_CLASS = f"[{PERIOD_GLYPHS}{PERIOD_MARKS}{MARKED}]"


def python(pattern: str) -> re.Pattern:
    """One of these patterns for Python's engine, which writes code points and the end of a text another way."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern).replace(r"\z", r"\Z"))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.trim(c, F.lit(WHITE))


def each_line(c: Column, f: Step) -> Column:
    return F.array_join(F.transform(F.split(c, "\n", -1), f), "\n")


def nfc(c: Column) -> Column:
    """Unicode NFC, by the library that Spark has for its collations, so texts don't leave the JVM; ASCII is left alone.

    Spark can't tell that a call by name always gives the same, and so never makes it again in a copy of the expression.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(F.length(c) == F.octet_length(c), c).when(c.isNotNull(), composed)


def line_strip(c: Column) -> Column:
    """LF line ends, and no white space around a line."""
    return each_line(_replace_all(c, (("\r\n", "\n"), ("\r", "\n"))), strip)


def markdown(c: Column) -> Column:
    """Without table separator rows and rules; the pipes of a line become spaces."""
    lines = F.filter(F.split(c, "\n", -1), lambda x: ~(x.rlike(SEPARATOR) | x.rlike(RULE)))
    return F.array_join(F.transform(lines, lambda x: F.when(F.contains(x, F.lit("|")), strip(F.regexp_replace(x, CELL_EDGE, " "))).otherwise(x)), "\n")


def dehyphenate(c: Column) -> Column:
    """Words broken at a line end are joined."""
    return F.regexp_replace(c, HYPHENATED, "")


def uncertainty_marks(c: Column) -> Column:
    """Marks of doubt go; a word in brackets loses them."""
    c = F.regexp_replace(c, rf"(?=[\[(])(?:{UNCERTAIN})", "")
    return F.regexp_replace(F.regexp_replace(c, BRACKETED, "$1"), ANGLED, "$1")


def newline_to_space(c: Column) -> Column:
    return _replace_all(c, (("\n", " "),))


def _replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ligatures(c: Column) -> Column:
    return _replace_all(c, LIGATURES)


def long_s(c: Column) -> Column:
    return _replace_all(c, tuple(zip(*LONG_S, strict=True)))


def sharp_s(c: Column) -> Column:
    return _replace_all(c, SHARP_S)


def combining_e(c: Column) -> Column:
    """A vowel with a small e above it is an umlaut."""
    return _replace_all(c, SMALL_E)


def lowercase(c: Column) -> Column:
    return F.lower(c)


def uv(c: Column) -> Column:
    return _replace_all(c, tuple(zip(*V_AS_U, strict=True)))


def ij(c: Column) -> Column:
    return _replace_all(c, tuple(zip(*J_AS_I, strict=True)))


def _blank(c: Column) -> Column:
    """Each white-space character a blank."""
    return _replace_all(c, tuple((x, " ") for x in WHITE if x != " "))


def whitespace(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(_blank(c), "  +", " "))


#: In the order they are applied, whatever the tier.
STEPS: dict[str, Step] = {f.__name__: f for f in (nfc, line_strip, markdown, dehyphenate, uncertainty_marks, newline_to_space, ligatures, long_s, sharp_s, combining_e, lowercase, uv, ij, whitespace)}
_L0 = {"nfc", "line_strip", "markdown", "newline_to_space", "whitespace"}
_L1 = _L0 | {"dehyphenate", "uncertainty_marks", "ligatures", "long_s", "sharp_s", "combining_e"}
TIERS: dict[str, list[str]] = {t: [s for s in STEPS if s in own] for t, own in (("L0", _L0), ("L1", _L1), ("L2", set(STEPS)))}


def normalize(c: Column, tier: str) -> Column:
    """The text at a tier, each holding the one before. Null is empty."""
    if tier not in TIERS:
        raise ValueError(f"no tier {tier!r}: {', '.join(TIERS)}")
    c = F.coalesce(c, F.lit(""))
    for name in TIERS[tier]:
        c = STEPS[name](c)
    return c


def split_lines(c: Column) -> Column:
    """The stripped lines that aren't empty."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), LINE_END, "\n"), "\n", -1), strip)
    return F.filter(lines, lambda x: x != "")


def tokens(c: Column) -> Column:
    """White-space-delimited tokens; none for an empty text."""
    return F.filter(F.split(_blank(F.coalesce(c, F.lit(""))), " ", -1), lambda x: x != "")


def strip_token(c: Column) -> Column:
    """A token without the punctuation around it."""
    return F.trim(c, F.lit(TOKEN_EDGES))


def key(c: Column) -> Column:
    """What a token is looked up by."""
    return F.lower(strip_token(c))


def numeral_tokens(c: Column) -> Column:
    """Stripped tokens with a decimal digit."""
    return F.transform(F.filter(tokens(c), lambda x: x.rlike(r"\p{Nd}")), strip_token)


def punctuation(c: Column) -> Column:
    """How many characters are punctuation or symbols."""
    return F.regexp_count(c, F.lit(r"[\p{P}\p{S}]")).cast("long")


def capitals(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Lu}")).cast("long")


def period_glyphs(c: Column) -> Column:
    """How many letter forms and marks of the period a text holds."""
    return F.regexp_count(c, F.lit(PERIOD_CLASS)).cast("long")


def _at(a: Column, test: Step) -> Column:
    """The places of an array's members that pass."""
    return F.filter(F.transform(a, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def clean(df: DataFrame, source: str, out: str) -> DataFrame:
    """df with `out`: a system's output, the column `source`, without its presentation.

    Code fences, blank lines at both ends, one line of preamble (if another line is left) and a closing note after a blank
    line go; then heading marks, emphasis and simple tags within lines, and blank lines in excess. A stage is a
    projection of its own, on the array of lines; the planner runs them as one.
    """
    lines, marks = f"{out}__lines", f"{out}__marks"
    c, m = F.col(lines), F.col(marks)

    def full(x: Column) -> Column:
        return x.rlike(f"[^{SPACE[1:-1]}]")

    split = F.split(F.regexp_replace(F.coalesce(F.col(source), F.lit("")), LINE_END, "\n"), "\n", -1)
    df = df.withColumn(lines, F.filter(split, lambda x: ~strip(x).rlike(FENCE)))
    df = df.withColumn(marks, _at(c, full))
    df = df.withColumn(lines, F.when(F.size(m) == 0, F.slice(c, 1, 0)).otherwise(F.slice(c, F.array_min(m) + 1, F.size(c))))
    opened = (F.size(c) > 1) & F.coalesce(strip(F.get(c, F.lit(0))).rlike(f"(?i){PREAMBLE}"), F.lit(False))
    df = df.withColumn(lines, F.when(opened, F.slice(c, 2, F.size(c))).otherwise(c))
    df = df.withColumn(marks, _at(c, full))
    df = df.withColumn(lines, F.slice(c, 1, F.coalesce(F.array_max(m) + 1, F.lit(0))))
    df = df.withColumn(marks, F.filter(_at(c, lambda x: strip(x).rlike(f"(?i){TRAILER}")), lambda i: i > 0))
    df = df.withColumn(marks, F.filter(m, lambda i: ~full(F.get(c, i - 1))))
    df = df.withColumn(lines, F.when((F.size(c) > 2) & (F.size(m) > 0), F.slice(c, 1, F.array_max(m) - 1)).otherwise(c))

    def tidy(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s{0,3}#{1,6}\s+", "")
        x = F.regexp_replace(x, r"\*\*(.+?)\*\*|__(.+?)__", "$1$2")
        return F.regexp_replace(F.regexp_replace(x, f"(?i){TAGS}", ""), rf"{SPACE}+\z", "")

    df = df.withColumn(lines, F.transform(c, tidy))
    return df.withColumn(out, F.regexp_replace(strip(F.array_join(c, "\n")), "\n{3,}", "\n\n")).drop(lines, marks)


def unwrap(c: Column, tag: str = "output") -> Column:
    """The text inside a wrapping tag; the tag's other marks go too."""
    inner = F.regexp_extract(c, rf"(?s)^\s*<{tag}>\s*(.*?)\s*(</{tag}>\s*)?\z", 1)
    c = F.when(c.rlike(rf"(?s)^\s*<{tag}>"), inner).otherwise(c)
    return strip(F.regexp_replace(c, rf"(?i)</?{tag}\b[^>]*>", ""))


def block_text(c: Column) -> Column:
    """Markup reduced to its cells' text: cells end with a pipe, rows with a line end, other tags go; stripped lines that aren't empty."""
    c = F.coalesce(c, F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "</t[dh]>", " | "), "</tr>", "\n"), "<[^>]+>", "")
    return F.array_join(split_lines(F.when(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), marked).otherwise(c)), "\n")


def fill(template: str, **fields: Column) -> Column:
    """A prompt: {name} replaced by its field, then doubled braces by single ones."""
    c = F.lit(template)
    for name, value in fields.items():
        c = F.replace(c, F.lit("{" + name + "}"), value)
    return F.replace(F.replace(c, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
