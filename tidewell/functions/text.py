"""Scalar text functions as column expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters with marks of the Latin blocks, and the letters a to z that they are written with."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(c, base) for c, base in pairs if base != c and "a" <= base <= "z" and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


MARKED, UNMARKED = _plain_letters()


def transliterated(text: Column) -> Column:
    """Lower case, letters with marks as plain ones, and `ß`, `æ`, `œ` as two letters."""
    text = F.translate(F.lower(text), MARKED, UNMARKED)
    for letter, two in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        text = F.replace(text, F.lit(letter), F.lit(two))
    return text


def tokens(text: Column) -> Column:
    """Lower-cased, transliterated runs of letters a to z, in order."""
    return F.filter(F.split(transliterated(text), "[^a-z]+"), lambda t: t != "")


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(stop)) if stop else words


def longer(runs: Column, words: Column, n: int) -> Column:
    """Runs of n consecutive words, joined by a blank, from those of n - 1: each with the word behind it; none if there are fewer words."""
    room = F.greatest(F.size(words) - n + 1, F.lit(0))
    return F.zip_with(F.slice(runs, F.lit(1), room), F.slice(words, F.lit(n), room), lambda run, word: F.concat_ws(" ", run, word))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n consecutive words, joined by a blank; none if there are fewer."""
    out = words
    for k in range(2, n + 1):
        out = longer(out, words, k)
    return out


def code_prefix(code: Column) -> Column:
    """First word, upper case."""
    return F.upper(F.split(F.trim(code), r"\s+")[0])


def normalised(text: Column) -> Column:
    """Lower case, `&` as `and`, everything else but letters and digits as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "&", " and "), "[^a-z0-9]+", " "))


def spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cache_key(text: Column) -> Column:
    """Texts that differ in case and white space only have the same."""
    return F.lower(spaces(text))


def covered(original: Column, reworded: Column, tokens: Column) -> Column:
    """The reworded text behind those of the tokens that it lacks as whole words; the original text if that is empty."""
    padded = F.concat(F.lit(" "), cache_key(reworded), F.lit(" "))
    missing = F.filter(tokens, lambda t: ~padded.contains(F.concat(F.lit(" "), F.lower(t), F.lit(" "))))
    said = spaces(F.concat_ws(" ", F.array_join(missing, " "), reworded))
    return F.when(said == "", spaces(original)).otherwise(said)


def week_days(meets: Column) -> Column:
    """Days in a meeting pattern; TBA and null have none."""
    rules = (("M", "M"), ("Tu", "Tu"), ("W", "W"), ("Th", "Th"), ("T(?!h|u)", "T"), ("F", "F"))
    found = F.array_compact(F.array(*(F.when(meets.rlike(p), F.lit(d)) for p, d in rules)))
    return F.when(meets.isNull() | (meets == "TBA"), F.array().cast("array<string>")).otherwise(found)


def term_name(code: Column) -> Column:
    """Season and year of a term code: four digits of the year, then 00, 10, 15 or 20."""
    season = F.create_map(*(F.lit(x) for x in ("00", "Summer", "10", "Fall", "15", "Winter", "20", "Spring")))
    return F.concat_ws(" ", F.coalesce(season[F.substring(code, 5, 2)], F.lit("Unknown")), F.substring(code, 1, 4))


def links(html: Column) -> Column:
    """Values of href attributes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)


def plain(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    return spaces(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "(?s)<[^>]*>", " "))


def safe_name(key: Column) -> Column:
    """Letters and digits of a key; of a key without any, its SHA-256."""
    return F.coalesce(F.nullif(F.regexp_replace(key, "[^a-zA-Z0-9]", ""), F.lit("")), F.sha2(key.cast("binary"), 256))


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor empty; empty if none is."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))
