"""Text, regex and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and replacement tables.
# A word character is a letter, a number or an underscore in any script;
# spelled out because \w and \b mean different things per regex dialect.
WORD = r"\p{L}\p{N}_"
NOT_WORD_BEFORE = rf"(?<![{WORD}])"
NOT_WORD_AFTER = rf"(?![{WORD}])"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
LIGATURES = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "\u00ad": "",
    "\u00a0": " ",
}
BRANDS = ("МиксерПро", "КеттлПро", "АкваТерм", "ТехноДом")
ARTICUL = rf"{NOT_WORD_BEFORE}[A-Z]{{2,5}}-[A-Z0-9]{{2,6}}{NOT_WORD_AFTER}"
VALUE_PUNCTUATION = r"[.,;:«»\"'()\-–—]"


def strip(text: Column) -> Column:
    """Trim every kind of white space (``trim`` only knows U+0020)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(rf"[^\s\x0B\x1C-\x1F\x85\p{{Z}}]"), F.lit(False))


def evidence_key(text: Column) -> Column:
    """Comparison key: case, spaces and punctuation do not matter."""
    return F.regexp_replace(F.lower(text), rf"[^{WORD}]+", "")


def normalize_value(text: Column) -> Column:
    """Comparison key for evaluation: drops spaces and a fixed punctuation set."""
    squeezed = F.regexp_replace(F.lower(text), rf"{SPACE}+", "")
    return F.regexp_replace(squeezed, VALUE_PUNCTUATION, "")


def clean_text(text: Column) -> Column:
    """Ligatures, hyphenation over a line break, runs of blanks and of newlines."""
    for char, replacement in LIGATURES.items():
        text = F.replace(text, F.lit(char), F.lit(replacement))
    text = F.regexp_replace(text, rf"([{WORD}])-\n([{WORD}])", "$1$2")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def cleans_to_nothing(text: Column) -> Column:
    """Whether ``clean_text`` would leave an empty text."""
    return ~text.rlike(r"[^\s\x0B\x1C-\x1F\x85\p{Z}\u00AD]")


def line_template(line: Column) -> Column:
    """A line with its numbers masked, so that page numbers compare equal."""
    return F.regexp_replace(strip(line), r"\p{Nd}+", "#")


def paragraphs(text: Column) -> Column:
    """Blocks between empty lines, trimmed, blanks dropped."""
    trimmed = F.transform(F.split(text, "\n\n", -1), strip)
    return F.filter(trimmed, lambda p: p != "")


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def heading(paragraph: Column) -> Column:
    """Heading text of a paragraph, or the empty string."""
    length = F.char_length(paragraph)
    spaces = length - F.char_length(F.replace(paragraph, F.lit(" "), F.lit("")))
    all_caps = (paragraph == F.upper(paragraph)) & (paragraph != F.lower(paragraph))
    return (
        F.when(all_caps & (length > 3) & (length < 80), title_case(paragraph))
        .when((length < 60) & ~paragraph.rlike(r"[.;,]\z") & (spaces <= 6), paragraph)
        .otherwise(F.lit(""))
    )


def articul(text: Column) -> Column:
    """First article code such as ``BLD-800``; NULL when there is none."""
    return F.nullif(F.regexp_extract(text, ARTICUL, 0), F.lit(""))


def brand(text: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """First brand of the list that the text contains; list order decides."""
    found = F.filter(F.array(*[F.lit(b) for b in brands]), lambda b: F.contains(text, b))
    return F.try_element_at(found, F.lit(1))


def family_of(filename: Column) -> Column:
    """Product family: the file name up to its first ``_`` or ``.``, lower-cased."""
    return F.lower(F.regexp_extract(filename, r"^[^_.]*", 0))


def price_key(model: Column) -> Column:
    """Model identifier as a price-table key."""
    key = F.regexp_replace(F.lower(model), r"[^a-z0-9]+", "_")
    return F.regexp_replace(key, r"^_+|_+$", "")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Share that is zero, not an error, over an empty base."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def escape_label(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
