"""English readings: repair, validity and acceptance."""

from pyspark.sql import functions as F

from . import chars, fixed
from .chars import col
from .rules import _lookup


def repaired(x):
    """A raw reading with acronyms and look-alikes repaired; a blank one unchanged.

    The table comes first, on the stripped text; where it has no entry the
    look-alikes are replaced and the table is asked again.
    """
    c = col(x)
    bare = chars.strip(c)
    known = F.create_map(*[F.lit(v) for p in fixed.TOKEN_ACRONYMS.items() for v in p])
    similar = F.regexp_replace(bare, r"(?<=[A-Za-z])\|(?=[A-Za-z])", "I")
    similar = F.regexp_replace(similar, "(?<=[A-Z])1(?=[A-Z])", "I")
    similar = F.regexp_replace(similar, "(?<=[A-Za-z])0(?=[A-Za-z])", "O")
    return F.when(chars.is_blank(c), c).otherwise(F.coalesce(F.try_element_at(known, bare), _lookup(fixed.TOKEN_ACRONYMS, similar)))


def valid(x):
    """Whether a reading can be English: two letters or more, no Hangul, not digits alone, mostly letters, no short mix."""
    c = col(x)
    mostly = chars.count_class(c, r"\p{L}") / F.length(c) >= 0.5
    mixed = (F.length(c) <= 3) & c.rlike("[0-9!@#$%^&*]")
    return F.when(c.isNull() | (F.length(c) < 2), False).otherwise(~chars.has_korean(c) & ~c.rlike(r"\A[0-9]+\z") & mostly & ~mixed)


def classified(english):
    """The repaired reading if it is valid English, else null."""
    fixed_text = repaired(english)
    return F.when((col(english) != "") & valid(fixed_text), fixed_text)


def in_domain(x, words=fixed.DOMAIN_WORDS):
    """Whether a word of the domain contains the text or lies in it, in any case. It decides nothing."""
    low = F.lower(col(x))
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w) | F.contains(w, low))


def good(x, least=fixed.ASCII_LEAST):
    """A reading that may replace a word: enough ASCII and a letter."""
    c = col(x)
    return F.coalesce((c != "") & (chars.ascii_ratio(c) >= least) & chars.has_letter(c), F.lit(False))


def better(first, second, least=fixed.ASCII_LEAST):
    """The first reading if good, else the second if good, else the first."""
    return F.when(good(first, least), col(first)).when(good(second, least), col(second)).otherwise(col(first))
