"""Text expressions: normalisation for keyword search, and numbers and times as a language writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_text(text: Column) -> Column:
    """Lower case, one apostrophe, punctuation as blanks, one blank around: so that words can be found whole."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "’‘´`", "''''")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{Nd}']+", " ")), F.lit(" "))


def find_keyword(text: Column, keywords: dict[str, list[str]], otherwise: str) -> Column:
    """The first label (in order) one of whose keywords occurs; keywords of up to three letters, or with blanks around, must be whole words."""
    t = normalised_text(text)
    out = None
    for label, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(f" {w} " if len(w) <= 3 else w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def format_number(value: Column, digits: int, language: Column) -> Column:
    """Fixed decimals, with a comma in French."""
    s = F.format_string(f"%.{digits}f", value)
    return F.when(language == "fr", F.translate(s, ".", ",")).otherwise(s)


def format_time(ts: Column, language: Column) -> Column:
    """6:30 PM in English, 18h30 in French, 18:30 otherwise."""
    return F.when(language == "en", F.date_format(ts, "h:mm a")).when(language == "fr", F.date_format(ts, "HH'h'mm")).otherwise(F.date_format(ts, "HH:mm"))
