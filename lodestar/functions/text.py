"""Text expressions: trigrams, identifiers, lines, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trigrams(value) -> Column:
    """Set of 3-character windows of the lowercased text, padded two left and one right."""
    padded = F.concat(F.lit("  "), F.lower(_c(value)), F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a, b) -> Column:
    """Dice coefficient of the trigram sets; identical texts score 1."""
    ta, tb = trigrams(a), trigrams(b)
    dice = 2 * F.size(F.array_intersect(ta, tb)) / (F.size(ta) + F.size(tb))
    return F.when(_c(a) == _c(b), F.lit(1.0)).otherwise(dice)


def identifier_words(name) -> Column:
    """``addUserRecord`` -> ``[add, user, record]``."""
    split_camel = F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(split_camel, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.transform(words, F.lower)


def pad_right(value, width) -> Column:
    """Pad with blanks to ``width``; longer text is left whole."""
    column = _c(value)
    return F.rpad(column, F.greatest(F.length(column), F.lit(width) if isinstance(width, int) else width), F.lit(" "))


def estimate_tokens(text) -> Column:
    return F.ceil(F.length(_c(text)) / 4)


def lines(text) -> Column:
    return F.split(_c(text), "\n", -1)


def count_lines(text) -> Column:
    return F.when(F.length(_c(text)) == 0, F.lit(0)).otherwise(F.size(lines(text)))


def number_lines(text, start_line: int = 1) -> Column:
    """Each line prefixed by its number, right-aligned in five columns."""

    def numbered(line, i):
        number = (i + start_line).cast("string")
        return F.concat(F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit(" ")), F.lit("  "), line)

    return F.array_join(F.transform(lines(text), numbered), "\n")


def clip(text, limit: int) -> Column:
    """Keep 30% from the head and 70% from the tail of an over-long text."""
    column = _c(text)
    head, tail = limit * 3 // 10, limit * 7 // 10
    over = (F.length(column) - limit).cast("string")
    middle = F.concat(F.lit("\n… ["), over, F.lit(" characters trimmed] …\n"))
    shortened = F.concat(F.left(column, F.lit(head)), middle, F.right(column, F.lit(tail)))
    return F.when(F.length(column) <= limit, column).otherwise(shortened)


def content_hash(text) -> Column:
    return F.substring(F.sha1(_c(text)), 1, 16)


def signature(text, max_len: int = 160) -> Column:
    """First line of a declaration without its opening brace, cut to ``max_len``."""
    first = F.trim(F.split(_c(text), "\n", 2).getItem(0))
    cut = F.regexp_replace(first, "\\s*\\{\\s*$", "")
    return F.when(F.length(cut) > max_len, F.concat(F.left(cut, F.lit(max_len - 1)), F.lit("…"))).otherwise(cut)


def to_fixed(value, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", _c(value).cast("double"))
