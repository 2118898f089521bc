"""Column expressions over text."""

from pyspark.sql import Column, functions as F

from fraudwatch import fixed


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Without it the optimiser may copy a costly expression into every use, and
    into every element of an inner ``transform``.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.btrim(text, F.lit(fixed.SPACE_CHARS))


def missing_to_null(text: Column) -> Column:
    """The tokens a CSV reader treats as missing become null."""
    return F.when(~text.isin(fixed.MISSING_TOKENS), text)


def blank_to(text: Column, placeholder: str) -> Column:
    stripped = strip(F.coalesce(text, F.lit("")))
    return F.when(stripped == "", F.lit(placeholder)).otherwise(stripped)


def one_line(text: Column) -> Column:
    """Line breaks to spaces and ASCII commas to full-width ones."""
    return F.translate(text, "\n,", " ，")


def preview(text: Column, length: int) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def contains_either(left: Column, right: Column) -> Column:
    return F.contains(left, right) | F.contains(right, left)


def characters(text: Column) -> Column:
    """One array element per code point; an empty text has no elements."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def squeeze(text: Column) -> Column:
    """Lower case, and a run of white space becomes one space."""
    return F.regexp_replace(F.lower(text), fixed.SPACE_CLASS + "{2,}", " ")


def char_ngrams(text: Column, shortest: int = 1, longest: int = 3) -> Column:
    """All character n-grams of the squeezed text, by length.

    The pattern looks ahead for n code points and then moves on by one, so matches
    overlap.  It runs as one compiled call per length, linear in the text.
    """
    windows = lambda whole: F.concat(*[
        F.regexp_extract_all(whole, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(shortest, longest + 1)
    ])
    return bind(squeeze(text), windows)


def mail_time(date: Column) -> Column:
    """A mail's Date header as a timestamp; null when it cannot be read.

    The weekday and a trailing zone comment carry nothing and are cut off.
    """
    plain = F.regexp_replace(date, r"^\s*[A-Za-z]{3},\s*|\s*\([^)]*\)\s*$", "")
    zoned = F.regexp_replace(plain, r"\s(GMT|UTC?)$", " +0000")
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))


def quoted(text: Column) -> Column:
    """A JSON string literal; the JSON writer is used only where something needs escaping."""
    escaped = F.btrim(F.to_json(F.array(text)), F.lit("[]"))
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(F.rlike(text, F.lit(r'["\\\x00-\x1F]')), escaped).otherwise(plain)
