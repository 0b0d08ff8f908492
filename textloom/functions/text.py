"""Text rules as Column expressions (all JVM-side except where noted)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.vectorized import nfc_text, top_char_share

# The characters Unicode-aware whitespace handling must know.
# Java's (?U)\s lacks U+001C..U+001F, so the class is spelled out.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_SPACE_CLASS = (
    r"\t\x0b-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Same meaning, cheaper to test: two range checks turn most letters away, and a
# single plain space is not matched because replacing it would change nothing.
_SPACE = rf"[\t-\x20\x85-\x{{3000}}&&[{SPACE_CLASS}]]"
_LINE_SPACE = rf"[\t-\x20\x85-\x{{3000}}&&[{LINE_SPACE_CLASS}]]"
SPACE_RUN = rf"{_SPACE}{{2,}}|[\t-\x1f\x85-\x{{3000}}&&[{SPACE_CLASS}]]"

# Patterns whose meaning must match exactly.
HTML_TAG = r"<[^>]+>"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
VARIANT_MARKUP = r"(?s)-\{(.*?)\}-"
PREFERRED_VARIANTS = ("zh-tw", "zh-hant", "zh-hk")

# Text that may change under NFC: combining marks, Hangul jamo, code points with
# singleton or excluded decompositions, and anything unknown to this JVM.
NFC_SUSPECTS = (
    r"[\p{M}\p{Cn}\x{340}-\x{387}\x{900}-\x{11ff}\x{1f00}-\x{2001}\x{2126}-\x{212b}"
    r"\x{2329}\x{232a}\x{2adc}\x{f900}-\x{fb4f}\x{11000}-\x{11fff}\x{1d100}-\x{1d1ff}\x{2f800}-\x{2fa1f}]"
)

MIN_CHARS = 20
MAX_SYMBOL_RATIO = 0.3
MAX_REPEAT_RATIO = 0.3


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    """Every whitespace run becomes one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(text, SPACE_RUN, " "), F.lit(" "))


def to_nfc(text: Column) -> Column:
    """NFC; only rows that can change leave the JVM (the others pass NULL)."""
    suspect = text.rlike(r"[^\x00-\x{2ff}]") & text.rlike(NFC_SUSPECTS)
    changed = nfc_text(F.when(suspect, text))
    return F.coalesce(changed, text)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, " ")


def _variant_choice(inner: Column) -> Column:
    """One ``flag:text;flag:text`` body resolved to a single variant."""
    parts = F.filter(F.split(inner, ";", -1), lambda p: F.instr(p, ":") > 0)
    entries = F.transform(
        parts,
        lambda p: F.struct(
            strip_space(F.substring_index(p, ":", 1)).alias("flag"),
            strip_space(p.substr(F.instr(p, ":") + 1, F.length(p))).alias("value"),
        ),
    )
    order = F.concat(
        F.array(*[F.lit(v) for v in PREFERRED_VARIANTS]),
        F.array_distinct(F.transform(entries, lambda e: e["flag"])),
    )
    # A repeated flag keeps its first position but takes its last value.
    values = F.transform(
        order,
        lambda flag: F.try_element_at(F.filter(entries, lambda e: e["flag"] == flag), F.lit(-1))["value"],
    )
    picked = F.try_element_at(F.filter(values, lambda v: F.length(v) > 0), F.lit(1))
    return F.when(F.instr(inner, ":") == 0, inner).otherwise(F.coalesce(picked, F.lit("")))


def resolve_variants(text: Column) -> Column:
    """Replace every language-variant markup span by one variant."""
    outside = F.split(text, r"(?s)-\{.*?\}-", -1)
    inside = F.transform(F.regexp_extract_all(text, F.lit(VARIANT_MARKUP), F.lit(1)), _variant_choice)
    woven = F.zip_with(outside, inside, lambda o, i: F.concat(o, F.coalesce(i, F.lit(""))))
    return F.when(F.instr(text, "-{") > 0, F.array_join(woven, "")).otherwise(text)


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "")


def tidy_space(text: Column) -> Column:
    """LF newlines, single spaces, at most one blank line, no line-end space."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    # The look-behind lets only the first space of a run start a match.
    t = F.regexp_replace(t, rf"{_LINE_SPACE}(?<!{_LINE_SPACE}{_LINE_SPACE}){_LINE_SPACE}*+(?=\n)", "")
    return strip_space(t)


def normalize(text: Column, html: bool = True) -> Column:
    t = to_nfc(text)
    if html:
        t = strip_html(t)
    return tidy_space(strip_controls(resolve_variants(t)))


def symbol_ratio(text: Column) -> Column:
    """Share of characters that are neither letter, number, space nor CJK; empty text is 1.0."""
    content = rf"[\p{{L}}\p{{N}}{SPACE_CLASS}\x{{4e00}}-\x{{9fff}}]+"
    symbols = F.length(F.regexp_replace(text, content, ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(symbols / F.length(text))


def repeat_ratio(text: Column) -> Column:
    """Share of the most frequent non-space character; nothing but space is 1.0."""
    return top_char_share(text)


def quality_reason(
    text: Column,
    min_chars: int = MIN_CHARS,
    max_symbol_ratio: float = MAX_SYMBOL_RATIO,
    max_repeat_ratio: float = MAX_REPEAT_RATIO,
) -> Column:
    """First failing rule, or ``ok``.

    Only texts that pass the two cheap rules are handed to the vectorized
    repetition count; the others pass NULL, which is never looked at.
    """
    short = F.length(text) < min_chars
    noisy = symbol_ratio(text) > max_symbol_ratio
    repetitive = repeat_ratio(F.when(~short, text)) > max_repeat_ratio
    return (
        F.when(short, F.lit("too_short"))
        .when(noisy, F.lit("too_many_symbols"))
        .when(repetitive, F.lit("too_repetitive"))
        .otherwise(F.lit("ok"))
    )


def quality_verdict(text: Column, **limits) -> Column:
    reason = quality_reason(text, **limits)
    return F.struct((reason == "ok").alias("keep"), reason.alias("reason"))


def content_hash(text: Column) -> Column:
    """SHA-1 of the whitespace-collapsed text."""
    return F.sha1(collapse_space(text))


def characters(text: Column) -> Column:
    """Array of code points as one-character strings; empty text gives no element."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def ngrams(text: Column, k: int) -> Column:
    """Overlapping k-character pieces by a look-ahead, linear in the text length."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-character shingles of the collapsed text; short text is one shingle."""
    s = collapse_space(text)
    return (
        F.when(F.length(s) == 0, F.array().cast("array<string>"))
        .when(F.length(s) <= k, F.array(s))
        .otherwise(F.array_distinct(ngrams(s, k)))
    )


def untrimmed_shingles(text: Column, k: int = 5) -> Column:
    """Shingle rule of the pair join: spaces collapsed, ends kept, never empty."""
    s = F.regexp_replace(text, SPACE_RUN, " ")
    return F.when(F.length(s) < k, F.array(s)).otherwise(F.array_distinct(ngrams(s, k)))
