"""Text columns: white space, tokens, n-grams, answers and small pieces of grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers and words that results depend on.
YES = ("yes", "yeah", "yep", "true", "maybe")
NO = ("no", "none", "0", "zero", "n/a", "not", "nothing")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those")
#: A token is a run of these characters of the lower-cased text.
TOKEN = "([a-z0-9']+)"


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-case tokens, in order; null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def first_token(c: Column) -> Column:
    """The first of ``tokens``; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(c), TOKEN, 1), F.lit(""))


def ngrams(toks: Column, n: int) -> Column:
    """Every run of n tokens, joined by spaces; none if there are fewer."""
    at = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(toks, i, n), " "))


def plain_answer(c: Column) -> Column:
    return F.lower(strip(c))


def normalized_answer(c: Column) -> Column:
    """Stripped and lower-cased; a number from 0 to 12 becomes its word."""
    a = plain_answer(c)
    words = F.create_map(*(F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (str(i), w)))
    return F.coalesce(F.try_element_at(words, a), a)


def is_yes(c: Column) -> Column:
    return plain_answer(c).isin(*YES)


def is_no(c: Column) -> Column:
    return plain_answer(c).isin(*NO)


def capitalized(c: Column) -> Column:
    """The first character in upper case; the others as they are."""
    s = strip(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def without_question_mark(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\?+$", "")


def words(c: Column) -> Column:
    """Split at white space; an empty or blank text has none."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def with_article(c: Column) -> Column:
    """``a`` or ``an`` before a noun phrase, unless it has a determiner."""
    phrase = strip(c)
    head = F.get(words(phrase), F.lit(0))
    article = F.when(F.substring(head, 1, 1).isin(*"aeiou"), "an").otherwise("a")
    return F.when((phrase == "") | head.isin(*DETERMINERS), phrase).otherwise(F.concat(article, F.lit(" "), phrase))


def _sentence(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def negated(c: Column) -> Column:
    """``not`` after the first auxiliary of a simple statement, else a denial of the whole of it."""
    s = F.regexp_replace(c, r"\.+$", "")
    # fixed value: the shape of a statement that takes "not"
    shape = r"(?i)^(The|There|This|That|These|Those)\s+(.+?)\s+(is|are|was|were|has|have|can)\s+(.+)$"
    part = [F.regexp_extract(s, shape, k) for k in range(1, 5)]
    return F.when(F.rlike(s, F.lit(shape)), _sentence(part[0], " ", part[1], " ", part[2], " not ", part[3], ".")).otherwise(
        _sentence("It is not true that ", F.lower(s), ".")
    )


def subject_and_rest(c: Column) -> tuple[Column, Column]:
    """Subject (two words after ``the``, else one) and the remaining words of a clause."""
    w = words(c)
    n = F.size(w)
    size = F.when((F.get(w, F.lit(0)) == "the") & (n >= 3), 2).otherwise(1)
    subject = F.when(n < 2, c).otherwise(F.array_join(F.slice(w, F.lit(1), size), " "))
    rest = F.when(n < 2, "").otherwise(F.array_join(F.slice(w, size + 1, F.greatest(n - size, F.lit(0))), " "))
    return subject, rest


def about_subject(subject: Column, predicate: Column, be: Column) -> Column:
    """``The X be Y.`` with one ``the``."""
    return _sentence("The ", F.regexp_replace(strip(subject), "^the ", ""), " ", be, " ", predicate, ".")
