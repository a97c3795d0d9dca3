"""Column functions: coercion of loose values, text normalisation, tokens, markers."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L

# Fixed values.
#: A capitalised word and those that follow, joined by small connecting words; applied to plain letters, typographic apostrophes made plain.
ENTITY = r"\b(?:[A-Z][a-zA-Z'.-]+(?:\s+(?:of|the|and|de|del|la|le|du|von|van|da|di|[A-Z][a-zA-Z'.-]+))*)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(c: Column) -> Column:
    """Missing: null or only white space (numbers: null or NaN read as text "NaN" stay)."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def clean(c: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def boolean(c: Column, default: bool | None = None) -> Column:
    """True and false words and 1 and 0; anything else is ``default``."""
    word = F.lower(F.trim(c.cast("string")))
    out = F.when(word.isin(*L.TRUE_WORDS), True).when(word.isin(*L.FALSE_WORDS), False)
    return out if default is None else F.coalesce(out, F.lit(default))


def _number(c: Column) -> Column:
    """A decimal comma or point, a percent sign or none; over 1 and up to 100 is a percentage."""
    word = F.trim(c.cast("string"))
    percent = word.endswith("%")
    x = F.regexp_replace(F.replace(word, F.lit(","), F.lit(".")), r"%$", "").try_cast("double")
    x = F.when(~F.isnan(x), x)
    return F.when(percent | ((x > 1) & (x <= 100)), x / 100).otherwise(x)


def confidence(c: Column) -> Column:
    """A share in [0, 1]; outside it is null."""
    x = _number(c)
    return F.when((x >= 0) & (x <= 1), x)


def clamped(c: Column, default: float = 0.0) -> Column:
    """A share in [0, 1]; outside it is brought to the nearer end, unreadable is ``default``."""
    x = _number(c)
    return F.when(x.isNull(), default).otherwise(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def plain_float(c: Column) -> Column:
    """A number as it is written, without any reading of percentages; unreadable and NaN is null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def integer(c: Column, default: int = 0) -> Column:
    """A number cut to a whole one."""
    return F.coalesce(c.try_cast("double").cast("long"), F.lit(default).cast("long"))


def first_filled(*cs: Column) -> Column:
    """The first that is not missing, trimmed; else null."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cs])


def upper(c: Column) -> Column:
    """Capitals letter by letter: one whose capital is several letters (ß) stays, so that lower case gives the text back."""
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return let(c, lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(F.array_join(F.transform(F.split(x, ""), one), "")))


def plain_letters(c: Column) -> Column:
    """Lower-case accented Latin-1 letters become their base letters."""
    return F.translate(c, L.ACCENTED, L.PLAIN)


def normal(c: Column) -> Column:
    """For matching: lower case, plain letters, no ASCII punctuation, single spaces."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), L.ACCENTED + "’", L.PLAIN + "'")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\p{Punct}+", ""), r"\s+", " "))


def plain_phrase(phrase: str) -> str:
    """``normal`` of a fixed phrase, worked out when the plan is made."""
    low = "".join(ch for ch in unicodedata.normalize("NFKD", phrase.lower()) if not unicodedata.combining(ch))
    return " ".join(low.replace("’", "'").translate(str.maketrans("", "", string.punctuation)).split())


def rule_text(c: Column) -> Column:
    """For rules: lower case, anything but letters, digits and question marks blank, single spaces."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-záéíóúüñ0-9 ?¿']", " "), r"\s+", " "))


def tokens(norm: Column) -> Column:
    """Words of two or more letters or digits of a normalised text that are no stopwords."""
    return F.filter(F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*L.STOPWORDS))


def contains_any(c: Column, phrases) -> Column:
    """Is any phrase a part of the text (of a word, too)? The text is worked out once, however many phrases there are."""

    def any_of(text: Column) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | text.contains(p)
        return out

    return let(c, any_of)


def negated(norm: Column) -> Column:
    """Does a normalised text hold a negation as whole words?"""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    return contains_any(padded, [f" {m} " for m in L.NEGATION_MARKERS])


def word_count(c: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"))


def entity_count(c: Column) -> Column:
    """Distinct capitalised names; those opened by a question word or article, or too short, do not count."""
    found = F.regexp_extract_all(plain_letters(F.translate(F.coalesce(c, F.lit("")), "’", "'")), F.lit(ENTITY), F.lit(0))
    names = F.filter(found, lambda m: ~F.regexp_extract(m, r"^(\S+)", 1).isin(*L.ENTITY_OPENERS) & (F.length(m) > 2))
    return F.size(F.array_distinct(names))


def truncated(c: Column, n: int) -> Column:
    """At most ``n`` characters, then a mark; 0 or less keeps all."""
    return c if n <= 0 else F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(n))), F.lit(" [...]")))


def sentences(c: Column) -> Column:
    """Sentences of a text, cut after . ! ? before white space, and at line ends; trimmed, none empty."""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n", -1), lambda s: F.trim(s)), lambda s: s != "")


def _bare(c: Column, most: int) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^[-*•]\s*", ""))
    bare = F.trim(F.btrim(F.btrim(bare, F.lit('"')), F.lit("'")))
    return let(bare, lambda x: truncated(x, most))


def claim_text(c: Column) -> Column:
    """A stated claim: single spaces, no bullet before it, no quotes around it, 600 characters and a mark at most."""
    return _bare(c, 600)


def said_sentence(c: Column) -> Column:
    """A sentence that is to be said: as a claim, 700 characters and a mark at most; null stays null."""
    return _bare(c, 700)


def appended(partial: Column, sentence: Column) -> Column:
    """A text and one more sentence after it, with a full stop between them where the text has no end."""
    ended = F.right(partial, F.lit(1)).isin(".", "!", "?")
    return F.when(sentence == "", partial).when(partial == "", sentence).when(ended, F.concat(partial, F.lit(" "), sentence)).otherwise(F.concat(partial, F.lit(". "), sentence))


def claim_sentences(c: Column) -> Column:
    """The statements of an answer: list items are sentences, lines are joined, then cut after . ! ? before white space.

    Statements of one character are left out; if no other is left the whole text is one.
    """
    joined = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\n+\s*[-*•]\s*", ". "), r"\n+", " ")

    def cut(text: Column) -> Column:
        pieces = F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n", -1), claim_text)
        return let(F.filter(pieces, lambda p: F.length(p) >= 2), lambda found: F.when((F.size(found) > 0) | (text == ""), found).otherwise(F.array(claim_text(text))))

    return let(joined, cut)


def list_cell(c: Column) -> Column:
    """A cell's list: JSON, or separated by bars, or by commas, else the cell alone; trimmed, none empty."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    parts = F.coalesce(
        parsed, F.when(raw.contains("|"), F.split(raw, r"\|", -1)).when(raw.contains(","), F.split(raw, ",", -1)).otherwise(F.array(raw))
    )
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
