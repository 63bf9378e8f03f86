"""The English stemmer in SQL, written from the published description: regions are
lengths, and every step looks at the longest suffix. For comparison with the plans.

Words beyond ASCII go to the Russian stemmer, which leaves words without Russian vowels
alone; so this SQL holds for tables without Russian words.
"""

from __future__ import annotations

from loomdex.functions.stemming import (
    EN_DERIVED_RULES,
    EN_FIRST_REGION_RULES,
    EN_INVARIANT,
    EN_INVARIANT_AFTER_PLURAL,
    EN_IRREGULAR,
    EN_LI_ENDINGS,
    EN_REGION_PREFIXES,
    EN_SECOND_REGION_SUFFIXES,
)
from loomdex.functions.stopwords import ENGLISH_STOP, RUSSIAN_STOP


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def cases(rules, suffix: str) -> str:
    return " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in rules).join((f"CASE {suffix} ", " END"))


def ending(suffixes) -> str:
    """The longest of the suffixes: the match that begins first."""
    return f"regexp_extract(w, '({'|'.join(suffixes)})$')"


_REGION = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
_SHORT_SYLLABLE = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_STEP2 = [old for old, _ in EN_FIRST_REGION_RULES] + ["ogi", "li"]
_STEP3 = [old for old, _ in EN_DERIVED_RULES] + ["ative"]
_STEP4 = [*EN_SECOND_REGION_SUFFIXES.split("|"), "ion"]

# A table of ``word`` goes in as english_words, (word, w) comes out of the last step.
ENGLISH_STEPS_SQL = f"""
e0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM english_words),
e1 AS (SELECT word, w, CASE WHEN regexp_matches(w, '^({EN_REGION_PREFIXES})') THEN length(regexp_extract(w, '^({EN_REGION_PREFIXES})'))
       WHEN regexp_matches(w, {_REGION}) THEN length(regexp_extract(w, {_REGION})) ELSE length(w) END AS r1 FROM e0),
e2 AS (SELECT word, w, r1, CASE WHEN regexp_matches(w[r1 + 1:], {_REGION}) THEN r1 + length(regexp_extract(w[r1 + 1:], {_REGION})) ELSE length(w) END AS r2 FROM e1),
e3 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN regexp_matches(w, '^..+(ied|ies)$') THEN w[:-3]
       WHEN regexp_matches(w, '(ied|ies)$') THEN w[:-2] WHEN regexp_matches(w, '(us|ss)$') THEN w
       WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS w FROM e2),
e4 AS (SELECT *, w IN ({listed(EN_INVARIANT_AFTER_PLURAL)}) AS done, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS s FROM e3),
e5 AS (SELECT *, w[:length(w) - length(s)] AS p FROM e4),
e6 AS (SELECT word, r1, r2, done, CASE WHEN done OR s = '' THEN w
       WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(p) >= r1 THEN p || 'ee' ELSE w END
       WHEN NOT regexp_matches(p, '[aeiouy]') THEN w
       WHEN regexp_matches(p, '(at|bl|iz)$') THEN p || 'e'
       WHEN regexp_matches(p, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN p[:-2]
       WHEN r1 >= length(p) AND regexp_matches(p, '{_SHORT_SYLLABLE}') THEN p || 'e' ELSE p END AS w FROM e5),
e7 AS (SELECT word, r1, r2, done, CASE WHEN NOT done AND regexp_matches(w, '^.+[^aeiouy][yY]$') THEN w[:-2] || 'i' ELSE w END AS w FROM e6),
e8 AS (SELECT *, {ending(_STEP2)} AS s FROM e7),
e9 AS (SELECT word, r1, r2, done, CASE WHEN done OR s = '' OR length(w) - length(s) < r1 THEN w
       WHEN s = 'ogi' THEN CASE WHEN w LIKE '%logi' THEN w[:-2] ELSE w END
       WHEN s = 'li' THEN CASE WHEN regexp_matches(w, '[{EN_LI_ENDINGS}]li$') THEN w[:-3] ELSE w END
       ELSE w[:length(w) - length(s)] || {cases(EN_FIRST_REGION_RULES, "s")} END AS w FROM e8),
e10 AS (SELECT *, {ending(_STEP3)} AS s FROM e9),
e11 AS (SELECT word, r1, r2, done, CASE WHEN done OR s = '' OR length(w) - length(s) < r1 THEN w
       WHEN s = 'ative' THEN CASE WHEN length(w) - 5 >= r2 THEN w[:-6] ELSE w END
       ELSE w[:length(w) - length(s)] || {cases(EN_DERIVED_RULES, "s")} END AS w FROM e10),
e12 AS (SELECT *, {ending(_STEP4)} AS s FROM e11),
e13 AS (SELECT word, r1, r2, done, CASE WHEN done OR s = '' OR length(w) - length(s) < r2 THEN w
       WHEN s = 'ion' AND NOT regexp_matches(w, '[st]ion$') THEN w ELSE w[:length(w) - length(s)] END AS w FROM e12),
e14 AS (SELECT word, CASE WHEN done THEN w
       WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(w[:-2], '{_SHORT_SYLLABLE}'))) THEN w[:-2]
       WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN w[:-2] ELSE w END AS w FROM e13),
english AS (SELECT word, CASE WHEN length(word) <= 2 OR word IN ({listed(EN_INVARIANT)}) THEN word
       ELSE coalesce({cases(EN_IRREGULAR.items(), "word")}, replace(w, 'Y', 'y')) END AS lexeme FROM e14)"""


def stems_sql(words_cte: str) -> str:
    """CTEs up to ``stems`` (word, lexeme) of the words of a CTE, without stop words."""
    return f"""
english_words AS (SELECT word FROM {words_cte} WHERE regexp_matches(word, '^[\\x00-\\x7F]*$') AND word NOT IN ({listed(ENGLISH_STOP)})),
{ENGLISH_STEPS_SQL},
stems AS (SELECT word, lexeme FROM english
  UNION ALL SELECT word, word FROM {words_cte} WHERE NOT regexp_matches(word, '^[\\x00-\\x7F]*$') AND word NOT IN ({listed(RUSSIAN_STOP)}))"""
