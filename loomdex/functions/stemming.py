"""Snowball stemming as chains of ``regexp_replace``.

Each step reads its input once, so a stem is one linear expression. Two marker
characters carry state between steps: ``|`` ends the prefix that no step may
touch, ``!`` at the end says that an earlier alternative already applied.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.binding import let

# Vowels and suffix classes of the published Russian algorithm.
RU_VOWELS = "аеиоуыэюя"
RU_GERUND_AFTER_A = "вшись|вши|в"
RU_GERUND = "ившись|ивши|ив|ывшись|ывши|ыв"
RU_REFLEXIVE = "ся|сь"
RU_ADJECTIVE = (
    "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
)
RU_PARTICIPLE_AFTER_A = "ем|нн|вш|ющ|щ"
RU_PARTICIPLE = "ивш|ывш|ующ"
RU_VERB_AFTER_A = "ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно"
RU_VERB = (
    "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|"
    "ены|ить|ыть|ишь|ую|ю"
)
RU_NOUN = (
    "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|"
    "ях|ы|ь|ию|ью|ю|ия|ья|я"
)
RU_SUPERLATIVE = "ейше|ейш"
RU_DERIVATIONAL = "ость|ост"


def _chain(word: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        word = F.regexp_replace(word, pattern, replacement)
    return word


def _chain_where(word: Column, needed: str, steps: list[tuple[str, str]]) -> Column:
    """The chain, for words with what each of its steps needs; others stay as they are."""
    return let(word, lambda w: F.when(w.rlike(needed), _chain(w, steps)).otherwise(w))


def russian_stem(word: Column) -> Column:
    vowel, other = f"[{RU_VOWELS}]", f"[^{RU_VOWELS}]"
    mark = (rf"^({other}*{vowel})(.*)$", "$1|$2")
    open_region = r"^([^!]*\|[^!]*?)"
    steps = [
        ("ё", "е"),
        mark,
        (rf"{open_region}(?:(?<=[ая])(?:{RU_GERUND_AFTER_A})|{RU_GERUND})$", "$1!"),
        (rf"{open_region}(?:{RU_REFLEXIVE})$", "$1"),
        (
            rf"{open_region}(?:(?<=[ая])(?:{RU_PARTICIPLE_AFTER_A})|{RU_PARTICIPLE})?"
            rf"(?:{RU_ADJECTIVE})$",
            "$1!",
        ),
        (rf"{open_region}(?:(?<=[ая])(?:{RU_VERB_AFTER_A})|{RU_VERB})$", "$1!"),
        (rf"{open_region}(?:{RU_NOUN})$", "$1!"),
        (r"!$", ""),
        (r"^(.*\|.*)и$", "$1"),
        (r"\|", ""),
        # Second region: two vowel-consonant changes must precede the suffix.
        (rf"^({other}*{vowel}+{other}+{vowel}+{other}.*?)(?:{RU_DERIVATIONAL})$", "$1"),
        mark,
        (rf"^(.*\|.*?)(?:{RU_SUPERLATIVE})$", "$1!"),
        (r"^(.*\|.*)нн(!?)$", "$1н$2"),
        (r"^(.*\|.*)ь$", "$1"),
        (r"[|!]", ""),
    ]
    # Without a vowel there is no region that a step could touch.
    return F.when(word.rlike(rf"[{RU_VOWELS}ё|!]"), _chain(word, steps)).otherwise(word)


# Exceptions and suffix rules of the published English algorithm.
EN_VOWELS = "aeiouy"
EN_REGION_PREFIXES = "gener|commun|arsen"
EN_IRREGULAR = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
}
EN_INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
EN_INVARIANT_AFTER_PLURAL = (
    "inning",
    "outing",
    "canning",
    "herring",
    "earring",
    "proceed",
    "exceed",
    "succeed",
)
EN_FIRST_REGION_RULES = [
    ("ational", "ate"),
    ("ization", "ize"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("iveness", "ive"),
    ("tional", "tion"),
    ("biliti", "ble"),
    ("lessli", "less"),
    ("entli", "ent"),
    ("ation", "ate"),
    ("alism", "al"),
    ("aliti", "al"),
    ("ousli", "ous"),
    ("iviti", "ive"),
    ("fulli", "ful"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("abli", "able"),
    ("izer", "ize"),
    ("ator", "ate"),
    ("alli", "al"),
    ("bli", "ble"),
]
EN_LI_ENDINGS = "cdeghkmnrt"
EN_DERIVED_RULES = [
    ("ational", "ate"),
    ("tional", "tion"),
    ("alize", "al"),
    ("icate", "ic"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
]
EN_SECOND_REGION_SUFFIXES = (
    "ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|al|er|ic"
)


def english_stem(word: Column) -> Column:
    """Stem of a lower-case ASCII word; ``Y`` marks a consonant y on the way."""
    v, c = "[aeiouy]", "[^aeiouy!]"
    plain = rf"(?!{EN_REGION_PREFIXES}){c}*{v}+{c}"
    first = rf"(?:(?:{EN_REGION_PREFIXES})|{plain})"
    second = rf"(?:(?:{EN_REGION_PREFIXES}){c}*{v}+{c}|{plain}{c}*{v}+{c})"
    short = rf"(?:^{v}{c}|{c}{v}[^aeiouywxY!])"
    marks = [(r"^y", "Y"), (r"(?<=[aeiouy])y", "Y")]
    steps = [
        # Plurals.
        (r"^(.+)sses$", "$1ss!"),
        (r"^(..+)(?:ied|ies)$", "$1i!"),
        (r"^(.)(?:ied|ies)$", "$1ie!"),
        (r"(us|ss)$", "$1!"),
        (rf"^(.*{v}.+)s$", "$1"),
        (r"!$", ""),
        (rf"^({'|'.join(EN_INVARIANT_AFTER_PLURAL)})$", "$1!!"),
        # Past and continuous forms; the marker says which repair follows.
        (rf"^({first}.*)(?:eedly|eed)$", "$1ee!!"),
        (r"(eedly|eed)$", "$1!!"),
        (rf"^(.*{v}.*?)(?:ingly|edly|ing|ed)$", "$1!"),
        (r"(at|bl|iz)!$", "$1e!!"),
        (r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)!$", "$1~"),
        (r".~$", "!!"),
        (rf"^((?:{c}*)(?:{v}{c}|{v}[^aeiouywxY!]))!$", "$1=!"),
        # A word is short when it ends in a short syllable and has no first region.
        (rf"^({v}{c}|{c}+{v}[^aeiouywxY!])=!$", "$1e"),
        (r"=!$", ""),
        (r"(?<!!)!$", ""),
        (rf"^(.+{c})[yY]((?:!!)?)$", "$1i$2"),
    ]
    # The invariant words keep their "!!" until the very end; other words drop it.
    kept = "|".join(EN_INVARIANT_AFTER_PLURAL)
    steps.append((rf"^(?!(?:{kept})!!$)(.*)!!$", "$1"))
    stem = _chain_where(_chain(word, marks), r"[sdgyY!~=]$", steps)

    def longest(suffixes: list[str], region: str) -> list[tuple[str, str]]:
        """``#`` before the longest of the suffixes, if it lies in the region: a shorter
        one in the region does not count where a longer one is outside."""
        return [(rf"({'|'.join(suffixes)})$", "#$1"), (rf"^(?!{region}[^#]*#)([^#]*)#", "$1")]

    stem = _chain(stem, longest([*(suffix for suffix, _ in EN_FIRST_REGION_RULES), "ogi", "li"], first))
    rules = [(rf"#{suffix}$", f"{target}!") for suffix, target in EN_FIRST_REGION_RULES]
    rules += [
        (r"l#ogi$", "log!"),
        (rf"(?<=[{EN_LI_ENDINGS}])#li$", "!"),
        (r"#|(?<!!)!$", ""),
    ]
    stem = _chain(_chain_where(stem, "[#!]", rules), longest([*(suffix for suffix, _ in EN_DERIVED_RULES), "ative"], first))
    rules = [(rf"#{suffix}$", f"{target}!") for suffix, target in EN_DERIVED_RULES]
    rules += [
        (rf"^({second}.*)#ative$", "$1!"),
        (r"#|(?<!!)!$", ""),
    ]
    stem = _chain(_chain_where(stem, "[#!]", rules), longest([EN_SECOND_REGION_SUFFIXES, "ion"], second))
    rules = [
        (rf"#(?:{EN_SECOND_REGION_SUFFIXES})$", "!"),
        (r"(?<=[st])#ion$", "!"),
        (r"#|(?<!!)!$", ""),
    ]
    endings = [
        (rf"^({second}.*)e$", "$1!"),
        (rf"^({first}.*)(?<!{c}{v}[^aeiouywxY!])(?<!^{v}{c})e$", "$1!"),
        (rf"^({second}.*l)l$|^({second[:-1]}(?<=l)))l$", "$1$2!"),
        (r"!+$", ""),
    ]
    stem = _chain_where(_chain_where(stem, "[#!]", rules), "(?:e|ll|!)$", endings)
    stem = F.replace(stem, F.lit("Y"), F.lit("y"))
    irregular = F.create_map(*[F.lit(x) for pair in EN_IRREGULAR.items() for x in pair])
    return (
        F.when(F.char_length(word) <= 2, word)
        .when(word.isin(*EN_INVARIANT), word)
        .when(word.isin(*EN_IRREGULAR), F.try_element_at(irregular, word))
        .otherwise(stem)
    )
