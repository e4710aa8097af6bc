"""Text functions of dialogue preparation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space at the ends of a text.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0" "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Markers of answers, scores and feedback.
ANSWER, SCORE, FEEDBACK = "Answer:", "Score:", "Feedback:"

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(x: Column) -> Column:
    """The text without white space at its ends; null stays null."""
    return F.btrim(x, F.lit(WHITESPACE))


def rstrip_dots(x: Column) -> Column:
    return F.rtrim(x, F.lit("."))


def has_marker(x: Column, marker: str) -> Column:
    return F.contains(x, F.lit(marker))


def after_marker(x: Column, marker: str) -> Column:
    """What follows the first marker; null without one."""
    at = F.instr(x, marker)
    return F.when(at > 0, F.substring(x, at + len(marker), F.length(x)))


def first_line(x: Column) -> Column:
    return F.substring_index(x, "\n", 1)


def first_segment(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def second_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(2))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def parse_score(x: Column) -> Column:
    """A number's text: a whole number if it is one, else a decimal one, else null."""
    whole = x.try_cast("decimal(38,0)").cast("string")
    return F.when(F.rlike(x, F.lit(INTEGER)), whole).when(F.rlike(x, F.lit(DECIMAL)), x.try_cast("double").cast("string"))


def score_of(x: Column) -> Column:
    """The score that stands between the first score marker and the line's end; null if none is a number."""
    return parse_score(rstrip_dots(strip(first_line(after_marker(x, SCORE)))))


def extract_answer(x: Column) -> Column:
    """The stripped text after the first answer marker, or the whole stripped text; null is ''."""
    return F.coalesce(strip(F.coalesce(after_marker(x, ANSWER), x)), F.lit(""))


def extract_feedback(x: Column) -> Column:
    """Feedback with its score in words where both are there; without feedback the whole text; null and empty are ''."""
    told = strip(after_marker(x, FEEDBACK))
    score = score_of(x)
    with_score = F.concat(F.lit("A score of "), score, F.lit(" is given to the answer. "), told)
    return F.when(F.coalesce(x, F.lit("")) == "", "").when(F.coalesce(told, F.lit("")) == "", strip(x)).otherwise(F.coalesce(with_score, told))


def extract_question(struct_value: Column, plain: Column) -> Column:
    """The stripped question from either of its two forms; null is ''."""
    return F.coalesce(strip(F.coalesce(struct_value, plain)), F.lit(""))


def zero_pad(n: Column, width: int) -> Column:
    """Zero-padded number; longer numbers are not cut."""
    return F.format_string(f"%0{width}d", n)


def truthy(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""
