"""Operator 1: line-first quality rules.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines are removed, and
a document that loses too much of its text this way is rejected.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import map_texts

# Fixed values of the rules.
#: A line fails with at least so many ASCII punctuation marks, if they are over so many percent of its characters.
PUNCT_MARKS, PUNCT_PERCENT = 6, 30
#: A line fails with at least so many words that end in "!!" or "??", if they are over so many percent of its words.
SHOUTS, SHOUT_PERCENT = 3, 20
#: A line fails with at least so many words that are only a separator, if they are over so many percent of its words.
SEPARATORS, SEPARATOR_PERCENT = 3, 20
#: A line fails with at least so many words that are web addresses, if they are over so many percent of its words.
LINKS, LINK_PERCENT = 2, 30
LINK_STARTS = ("http://", "https://", "www.")
#: A line of at most so many words fails if it holds one of the phrases, whatever the document's language.
BOILERPLATE_WORDS = 40
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "click here", "sign up for", "log in to",
    "subscribe to our", "follow us on", "enable javascript", "back to top", "powered by", "lorem ipsum", "skip to content", "accept all cookies",
    "licensed under", "released under the",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "cliquez ici", "abonnez-vous à", "retour en haut de page",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "klicken sie hier", "newsletter abonnieren", "zurück zum seitenanfang", "cookie-einstellungen",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "aviso legal", "haga clic aquí", "suscríbete a", "volver al inicio",
)
#: A document is rejected if its removed lines hold over so many percent of its characters (white space aside).
LOST_PERCENT = 50
#: A document fails the base with fewer words, or with a larger percentage of words in repeated windows.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

SPACE = b" \t\n\x0b\x0c\r"
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = b"#*$%&|<>"
_FOLLOW = bytes(range(0x80, 0xC0))
_BOILER_TEXT = re.compile("|".join(map(re.escape, BOILERPLATE)))
_BOILER = re.compile(_BOILER_TEXT.pattern.encode())
_LINK = re.compile(b"(?i)https?://|www\\.")
_LINK_STARTS = tuple(x.encode() for x in LINK_STARTS)
_SEPARATOR = frozenset((b"|", b">", b"/", b"-", "»".encode(), "•".encode(), "·".encode()))
_NOT_PUNCT = bytes(set(range(256)) - set(_PUNCT))
_NOT_SYMBOL = bytes(set(range(256)) - set(_SYMBOLS))

OUT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_failed_lines", "failed_chars")]
    + [T.StructField("clean_text", T.StringType())]
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, n, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + WINDOW - max(i, covered)
            covered = i + WINDOW
    return n


def failing_rule(line: bytes, words: list[bytes], chars: int) -> str | None:
    """The first rule that the line fails. ``chars``: its code points without ASCII white space."""
    marks = len(line.translate(None, _NOT_PUNCT))
    if marks >= PUNCT_MARKS and 100 * marks > PUNCT_PERCENT * chars:
        return "punctuation"
    shouts = sum(w.endswith((b"!!", b"??")) for w in words) if b"!!" in line or b"??" in line else 0
    if shouts >= SHOUTS and 100 * shouts > SHOUT_PERCENT * len(words):
        return "punctuation"
    separators = sum(w in _SEPARATOR for w in words)
    if separators >= SEPARATORS and 100 * separators > SEPARATOR_PERCENT * len(words):
        return "navigation"
    links = sum(w.lower().startswith(_LINK_STARTS) for w in words) if _LINK.search(line) else 0
    if links >= LINKS and 100 * links > LINK_PERCENT * len(words):
        return "navigation"
    if len(words) <= BOILERPLATE_WORDS and boilerplate(line):
        return "boilerplate"
    return None


def boilerplate(line: bytes) -> bool:
    """Whether the line holds one of the phrases, in upper or lower case of any script."""
    return bool(_BOILER.search(line.lower()) if line.isascii() else _BOILER_TEXT.search(line.decode().lower()))


def judge(text: bytes | None) -> tuple:
    """The values of OUT for one text."""
    words = (text or b"").split()
    n_repeat = repeat_words(words)
    seen: set[bytes] = set()
    duplicates = n_lines = failed = failed_chars = 0
    kept_lines, all_chars = [], 0
    for line in (text or b"").split(b"\n"):
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        n_lines += 1
        duplicates += line in seen
        seen.add(line)
        chars = len(line.translate(None, _FOLLOW + SPACE))
        all_chars += chars
        if failing_rule(line, own, chars):
            failed, failed_chars = failed + 1, failed_chars + chars
        else:
            kept_lines.append(line)
    base_failed = len(words) < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * len(words)
    kept = not base_failed and 100 * failed_chars <= LOST_PERCENT * all_chars
    symbols = len((text or b"").translate(None, _NOT_SYMBOL))
    clean = None if text is None else b"\n".join(kept_lines).decode() if kept else ""
    return len(words), all_chars, symbols, duplicates, n_repeat, base_failed, kept, n_lines, failed, failed_chars, clean


def line_quality(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of OUT; ``keep`` names the input columns to pass on (all by default).

    Words are runs of characters other than space and U+0009 to U+000D; ``word_chars`` are their code
    points. ``clean_text`` is the text without failing lines (empty if the document is not kept). One
    row for each input row, repeated rows too. A null, empty or blank text has no words: base_failed
    is true, kept false and clean_text null for null, else empty. An input column with the name of a
    new one is replaced. Nulls in other columns pass. Rows are judged alone, whatever their length.
    """

    def compute(texts: list) -> dict[str, list]:
        return dict(zip(OUT.names, map(list, zip(*map(judge, texts), strict=True)), strict=True))

    return map_texts(df, text, compute, OUT, keep)
