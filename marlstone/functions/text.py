"""Text normalisation as Column functions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.udfs import html_unescape

# Cyrillic letters and their Latin spelling.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "э": "e", "ю": "yu", "я": "ya", "ь": "", "ъ": "",
}

# Units of weight and volume.
WEIGHT_UNITS = ("кг", "kg")
VOLUME_UNITS = ("л", "l")

# Words the keyword search passes over.
KEYWORD_STOP_WORDS = (
    "и", "в", "во", "на", "под", "за", "с", "со", "из", "от", "до", "для", "без", "о", "об", "обо", "при", "по", "у",
    "к", "ко", "а", "но", "да", "или", "бы", "ли", "же", "что", "как", "где", "когда", "кто", "это", "был", "была",
    "были", "не", "нет", "the", "a", "an", "and", "or", "to", "for",
)

_UNITS = "|".join(WEIGHT_UNITS + VOLUME_UNITS)


def fold_yo(text: Column) -> Column:
    return F.replace(text, F.lit("ё"), F.lit("е"))


def squeeze(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Query text: lower case, ё as е, numbers apart from their units with a decimal point, and no
    signs but letters, digits, underscores and dots. Null is empty."""
    low = fold_yo(F.lower(F.coalesce(text, F.lit(""))))
    points = F.regexp_replace(low, rf"(?U)(\d+),(\d*)(?=\s*(?:{_UNITS})\b)", "$1.$2")
    apart = F.regexp_replace(points, rf"(?U)(\d+\.?\d*)\s*({_UNITS})\b", "$1 $2")
    return squeeze(F.regexp_replace(apart, r"(?U)[^\w\s.]", " "))


def normalize_phrase(text: Column) -> Column:
    """Entity text, after any compatibility normalisation: hyphens stay, dots go."""
    return squeeze(F.regexp_replace(fold_yo(F.lower(F.coalesce(text, F.lit("")))), r"(?U)[^\w\s-]", " "))


def transliterate(text: Column) -> Column:
    """Cyrillic letters of a normalised phrase in Latin spelling."""
    one = {k: v for k, v in LATIN.items() if len(v) <= 1}
    gone = "".join(k for k, v in one.items() if not v)
    kept = {k: v for k, v in one.items() if v}
    out = F.translate(text, "".join(kept) + gone, "".join(kept.values()))
    for letter, latin in LATIN.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, r"(?U)\s+"), lambda t: t != "")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands in ``text`` as whole words; an empty phrase never does."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), phrase, F.lit(r"\E(?!\w)"))
    return F.coalesce((phrase != "") & F.rlike(text, quoted), F.lit(False))


def slug(text: Column) -> Column:
    bare = F.regexp_replace(fold_yo(F.lower(text)), r"(?U)[^\w\s-]", "")
    return F.btrim(F.regexp_replace(bare, r"(?U)[\s-]+", "_"), F.lit("_"))


#: Character references that most pages have; texts with any other go through the full table.
_ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_OTHERS = r"&(?!(?:nbsp|quot|#39|lt|gt|amp);)[#A-Za-z]"


def unescape(text: Column) -> Column:
    """All named and numbered character references, resolved once."""
    plain = text
    for name, sign in _ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    other = text.rlike(_OTHERS)
    return F.when(other, html_unescape(F.when(other, text))).otherwise(plain)


def strip_markup(text: Column) -> Column:
    """Text of an HTML fragment: no tags, character references resolved, white space squeezed; empty
    is null."""
    return F.nullif(squeeze(unescape(F.regexp_replace(text, "<[^>]+>", " "))), F.lit(""))


def tidy_reply(text: Column) -> Column:
    """No blanks before line ends, single blanks, at most one empty line, nothing at the ends."""
    out = F.regexp_replace(text, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, " {2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def first_amount(normalized: Column, units: tuple[str, ...]) -> Column:
    """(number as written, unit) of the first amount in one of the units; null if there is none."""
    pattern = rf"(?U)\b(\d+(?:[.,]\d+)?)\s*({'|'.join(units)})\b"
    number = F.regexp_extract(normalized, pattern, 1)
    return F.when(number != "", F.struct(number.alias("number"), F.regexp_extract(normalized, pattern, 2).alias("unit")))


def amount_value(amount: Column) -> Column:
    return F.replace(amount["number"], F.lit(","), F.lit(".")).try_cast("double")


def name_amount(name: Column, units: tuple[str, ...]) -> Column:
    """First amount in a product's name; unlike in queries, it may follow a letter directly."""
    low = fold_yo(F.lower(name))
    number = F.regexp_extract(low, rf"(?U)(\d+(?:[.,]\d+)?)\s*(?:{'|'.join(units)})\b", 1)
    return F.replace(number, F.lit(","), F.lit(".")).try_cast("double")


def keywords(text: Column) -> Column:
    """Words of the keyword search, repeated ones kept; ё ends a word."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zA-Zа-яА-Я0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*KEYWORD_STOP_WORDS))


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def plural(label: Column) -> Column:
    """Plural of a group label in lower case."""
    low = F.lower(label)
    stem = F.substring(low, F.lit(1), F.length(low) - 1)
    return F.when(low.endswith("к"), F.concat(low, F.lit("и"))).when(low.endswith("а") | low.endswith("ь"), F.concat(stem, F.lit("и"))).otherwise(F.concat(low, F.lit("ы")))


def title_plural(display: Column) -> Column:
    """Plural of a product type in the title of a result; ок and ик lose their vowel."""
    low = F.lower(display)
    n = F.length(low)
    return (
        F.when(low.endswith("ок") | low.endswith("ик"), F.concat(F.substring(low, F.lit(1), n - 2), F.lit("ки")))
        .when(low.endswith("к"), F.concat(low, F.lit("и")))
        .when(low.endswith("а") | low.endswith("ь"), F.concat(F.substring(low, F.lit(1), n - 1), F.lit("и")))
        .otherwise(F.concat(low, F.lit("ы")))
    )
