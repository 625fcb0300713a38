"""Normal forms of text, as Catalyst expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFUSIONS, EDGE_PUNCTUATION

#: Typographic characters and what they stand for.
QUOTES = "‘’‚‛′“”„″‐‑‒–—―−   "
PLAIN = "'''''\"\"\"\"-------   "
#: Phrases that mean alcohol by volume, longest first.
ABV_PHRASES = (
    r"alcohol\s+by\s+volume", r"alc(?:ohol)?\.?\s*/\s*vol(?:ume)?\.?", r"alc(?:ohol)?\.?\s+by\s+vol(?:ume)?\.?", r"alc\.?\s*vol\.?", r"\babv\b", r"\bby\s+vol(?:ume)?\.?", r"\balc\.?(?=\s|$)",
)


#: Texts of ASCII letters, digits and % with single blanks between, and no phrase for alcohol by volume: they are their own normal form but for case.
PLAIN_TEXT = r"\A(?=[A-Za-z0-9%][A-Za-z0-9% ]*+\z)(?!.*(?:  | \z))(?!.*(?i:alc|abv|vol))"


#: What becomes a blank in lower-case ASCII and other letters; a mark behind a digit stays, if a digit follows too or it is a point or a comma.
MARKS = "".join(c for c in map(chr, range(128)) if not (c in "% " or c.isdigit() or c.islower() or c.isupper()))
MARK = r"[\x00-\x7F&&[^\w\s%]]"
GAPS = rf"[\t-\r_]|{MARK}(?:(?<!\d.)|(?<![.,])(?!\d))"


@functools.cache
def compatibility_table(drop_accents: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their single replacements, characters with longer replacements), from the Unicode tables of the basic plane.

    Compatibility forms are composed, typographic quotes, dashes and blanks become plain, and accents go if asked; all in one table, since a
    pass of translate() looks at every character. Characters that become nothing come last in the first text, without a
    replacement, so translate() drops them. Hangul is left alone: its syllables would come apart.
    """
    plain = str.maketrans(QUOTES, PLAIN)
    single, dropped, longer = [], [], []
    for code in range(0x80, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        to = unicodedata.normalize("NFKC", c).translate(plain)
        if drop_accents:
            to = "".join(x for x in unicodedata.normalize("NFKD", to) if not unicodedata.combining(x))
        if to == c:
            continue
        if not to:
            dropped.append(c)
        elif len(to) == 1:
            single.append((c, to))
        elif code in range(0x2100, 0x2190) or code in range(0xFB00, 0xFB07) or c in "…‥¼½¾":
            longer.append((c, to))
    return "".join(a for a, _ in single) + "".join(dropped), "".join(b for _, b in single), tuple(longer)


def _unified(text, drop_accents: bool) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    given, to, longer = compatibility_table(drop_accents)
    out = text
    for c, replacement in longer:
        out = F.replace(out, F.lit(c), F.lit(replacement))
    out = F.when(F.translate(text, "".join(c for c, _ in longer), "") != text, out).otherwise(text)
    return F.when(_is_ascii(text), text).otherwise(F.translate(out, given, to))


def unify_unicode(text) -> Column:
    """Compatibility characters composed, typographic quotes, dashes and blanks plain; null counts as empty. (SF1)"""
    return _unified(text, False)


def fold_accents(text) -> Column:
    """The same without diacritics. (SF2)"""
    return _unified(text, True)


def collapse_blanks(text: Column) -> Column:
    """(SF3)"""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_strict(text) -> Column:
    """Case and punctuation kept; marks of registration dropped before they turn into letters. (SF4)"""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(text.rlike(PLAIN_TEXT), text).otherwise(_strict(text))


def _strict(text: Column) -> Column:
    return collapse_blanks(unify_unicode(F.regexp_replace(text, r"(?U)\s*[®™©℠]", "")))


def unify_abv(text: Column) -> Column:
    """All of the phrases hold one of three short words; other texts are left alone. (SF5)"""
    return F.when(text.rlike("(?i)alc|abv|vol"), F.regexp_replace(text, "(?iU)" + "|".join(ABV_PHRASES), " abv ")).otherwise(text)


def normalize_loose(text) -> Column:
    """Lower case, phrases for alcohol by volume as one, no accents, punctuation only inside numbers. (SF6)"""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(text.rlike(PLAIN_TEXT), F.lower(text)).otherwise(_loose(text))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _once(value: Column, f) -> Column:
    """f(value), with value found once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _loose(text: Column) -> Column:
    """Most texts are ASCII and letters once their accents are folded. These need no Unicode classes, and seldom a pattern, which costs far more than translate()."""
    return _once(F.lower(fold_accents(text)), lambda x: F.when(_is_ascii(x) | ~x.rlike(r"[^\x00-\x7F\p{L}]"), _simple_bare(x)).otherwise(_bare(x)))


def _bare(folded: Column) -> Column:
    bare = F.regexp_replace(F.replace(unify_abv(folded), F.lit("_"), F.lit(" ")), r"(?U)(?<!\d)[^\w\s%](?!\d)|(?<=\d)[^\w\s%.,](?!\d)|(?<!\d)[^\w\s%](?=\d)", " ")
    return collapse_blanks(bare)


def _simple_bare(folded: Column) -> Column:
    """The same of lower-case ASCII and other letters."""
    alcohol = folded.contains("alc") | folded.contains("abv") | folded.contains("vol")
    unified = F.when(alcohol, unify_abv(folded)).otherwise(folded)
    bare = _once(unified, lambda x: F.when(x.rlike("[0-9]" + MARK), F.regexp_replace(x, GAPS, " ")).otherwise(F.translate(x, MARKS, " " * len(MARKS))))
    two, one = F.lit("  "), F.lit(" ")
    bare = _once(F.replace(F.replace(bare, two, one), two, one), lambda x: F.when(x.contains("  "), F.regexp_replace(x, "  +", " ")).otherwise(x))
    return F.trim(bare)


def loose_equal(a, b) -> Column:
    """(SF7)"""
    return normalize_loose(a) == normalize_loose(b)


def strip_edges(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE_PUNCTUATION))


def despaced(text: Column) -> Column:
    """(SF13)"""
    return F.replace(text, F.lit(" "), F.lit(""))


def letter_spaced(text: Column) -> Column:
    """At least four words, three in five of them single characters. (SF13)"""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return (F.size(words) >= 4) & (F.size(F.filter(words, lambda w: F.length(w) == 1)) >= 0.6 * F.size(words))


def shape_fold(text) -> Column:
    """The loose form without blanks, with letters that reading confuses as one. (SF11)"""
    return fold_shapes(despaced(normalize_loose(text)))


def fold_shapes(out: Column) -> Column:
    """Letters that reading confuses as one; blanks stay. (SF12)"""
    for a, b in CONFUSIONS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_word(token: Column) -> Column:
    """Two letters or more. (SF14)"""
    return F.length(F.regexp_replace(token, r"[^\p{L}]", "")) >= 2


def country_key(name) -> Column:
    """(SF16)"""
    key = F.regexp_replace(normalize_loose(name), r"\bst(e?)\b", "saint$1")
    return F.regexp_replace(key, "^the ", "")


def digits_only(text: Column) -> Column:
    """(SF19)"""
    return F.regexp_replace(text, r"\D", "")


def slug(text: Column) -> Column:
    """(SF20)"""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def header_key(text: Column) -> Column:
    """A header without case, blanks, - and /, and without a byte-order mark. (SF21)"""
    return F.regexp_replace(F.lower(F.translate(text, "﻿", "")), r"[\s_/-]+", "")


def quoted(text: Column) -> Column:
    """(SF26)"""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("'")), F.lit('"'))


def decimal(text: Column) -> Column:
    """A decimal comma counts as a point. (SF27)"""
    return F.replace(text, F.lit(","), F.lit(".")).cast("double")


def general_number(value: Column) -> Column:
    """A number in its shortest form of at most six digits, as in 45 or 13.5. (SF24)"""
    rounded = F.round(value, 4).cast("decimal(20,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(rounded, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def words(text: Column) -> Column:
    """(AR2)"""
    return F.filter(F.split(text, " "), lambda w: w != "")
