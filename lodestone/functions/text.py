"""Text functions over columns. Only Unicode normalisation and entity decoding need Python (Arrow batches)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a question that say nothing about its subject.
STOP_WORDS = ("사례", "찾아", "찾아줘", "찾아주세요", "알려줘", "알려주세요", "관련", "어떤", "있나요", "있는", "대한", "하는", "해서")
#: Marks that replace personal data, in this order.
MASKS = (
    (r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "[이메일]"),
    (r"(?<!\d)\d{3}-\d{2}-\d{5}(?!\d)", "[사업자번호]"),
    (r"(?<!\d)(\+82[- ]?|0)\d{1,2}[- .]?\d{3,4}[- .]?\d{4}(?!\d)", "[전화번호]"),
)


def _nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def nfkc_casefold(c: Column) -> Column:
    return F.pandas_udf(_nfkc_casefold, "string")(c)


def unescape(c: Column) -> Column:
    return F.pandas_udf(_unescape, "string")(c)


def squash(c: Column) -> Column:
    """For comparing quotes: compatibility forms and case folded, no white space."""
    return F.regexp_replace(nfkc_casefold(F.coalesce(c, F.lit(""))), r"\s+", "")


def name_key(c: Column) -> Column:
    """For comparing names: compatibility forms and case folded, letters and numbers only."""
    return F.regexp_replace(nfkc_casefold(c), r"[^\p{L}\p{N}]", "")


def term_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[\\s·ㆍ]", ""))


def search_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s·,.()/_-]+", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([가-힣]+|[a-z0-9]+)"), 1)


def tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of Hangul or of a-z and 0-9, without stop words; longer Hangul words are followed by all their bigrams."""
    kept = F.filter(words(c), lambda w: ~w.isin(*stop)) if stop else words(c)
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    hangul = lambda w: (w >= "가") & (F.length(w) > 2)  # noqa: E731  a word is all Hangul or all a-z and 0-9, which come before
    return F.flatten(F.transform(kept, lambda w: F.when(hangul(w), F.concat(F.array(w), pairs(w))).otherwise(F.array(w))))


def distinct_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c, ()))


def analyzed_words(folded: Column) -> Column:
    """Tokens of a text that is already folded, with inner ./- and of two characters or more (or a digit)."""
    return F.filter(F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+(?:[./-][\p{L}\p{N}]+)*)"), 1), lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]$"))


def analyzed(folded: Column) -> Column:
    """Terms of a text that is already folded: :func:`analyzed_words`, then their bigrams."""
    return F.element_at(F.transform(F.array(analyzed_words(folded)), lambda t: F.concat(t, bigrams(t))), 1)  # bound once: what bigrams repeats is a variable


def bigrams(t: Column) -> Column:
    """Neighbours as one term each; ``t`` is used several times and should be a column or a variable."""
    rest = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))


def contains_all(text: Column, terms: list[str]) -> Column:
    """Every term is in the text (lower-cased); no terms: true."""
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(F.lower(text), F.lit(term.lower()))
    return out


def occurrences(text: Column, term: str) -> Column:
    """How often a term is in a lower-cased text, not overlapping."""
    t = F.lower(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("bigint")


def snippet(text: Column, terms: list[str], before: int = 80, size: int = 260) -> Column:
    """A window around the first place of the first term (longest first) that is found, with ellipses where it cuts."""
    at = F.coalesce(*[F.nullif(F.locate(t.lower(), F.lower(text)), F.lit(0)) for t in sorted(terms, key=lambda t: (-len(t), t))], F.lit(1))
    start = F.greatest(F.lit(1), at - before)
    cut = F.replace(F.substring(text, start, F.lit(size)), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(F.length(text) >= start + size, F.lit("…")).otherwise(F.lit("")))


def highlight(text: Column, terms: list[str]) -> Column:
    found = "|".join(rf"\Q{t}\E" for t in terms)
    return F.regexp_replace(text, f"(?i)({found})", "<mark>$1</mark>")


def strip_tags(c: Column) -> Column:
    """Text of a page: no scripts and styles, tags as blanks, blanks collapsed; entities as they are."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def html_text(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(plain), r"\s+", " "))


def mask_personal(c: Column) -> Column:
    out = F.trim(F.regexp_replace(c, r"\s+", " "))
    for pattern, label in MASKS:
        out = F.regexp_replace(out, pattern, label)
    return out


def sentence(template: str, *values: Column) -> Column:
    """A template with %s for each value; null values are written as empty text."""
    return F.format_string(template, *[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def rewritten(c: Column, pattern: str, replacement: str) -> tuple[Column, Column]:
    """The text with all matches replaced ($1 and so on for groups), and how many there were."""
    return F.regexp_replace(c, pattern, replacement), F.regexp_count(c, F.lit(pattern)).cast("bigint")


def strip_part(c: Column) -> Column:
    return F.regexp_replace(c, r"_part\d+$", "")


def synonym_groups(query: str, groups: list[list[str]]) -> list[list[str]]:
    """Each word of a query with the words that mean the same."""
    key = lambda s: "".join(ch for ch in s.lower() if ch not in " \t\n·,.()/_-")
    found = [key(w) for w in query.replace(",", " ").split()]
    return [[w, *(key(x) for g in groups if w in g for x in g)] for w in found if w]


def synonym_score(text: Column, query: str, groups: list[list[str]]) -> Column:
    """Words of the query that a (keyed) text has by any synonym, and one more for the whole phrase of several words."""
    whole = "".join(ch for ch in query.lower() if ch not in " \t\n·,.()/_-")
    wanted = synonym_groups(query, groups)
    if not whole:
        return F.lit(0)
    score = F.lit(0)
    for alternatives in wanted:
        any_of = F.lit(False)
        for word in alternatives:
            any_of = any_of | F.contains(text, F.lit(word))
        score = score + any_of.cast("int")
    return score + F.contains(text, F.lit(whole)).cast("int") if len(wanted) > 1 else score


def client_key(salt: str, c: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, 16)


def won(v: Column) -> Column:
    """An amount in won: hundred millions to one digit, ten thousands, or as it is."""
    tenth = F.floor(v / F.lit(10_000_000) + 0.5) / 10
    return (
        F.when(v >= 100_000_000, F.concat(F.regexp_replace(tenth.cast("string"), r"\.0$", ""), F.lit("억원")))
        .when(v >= 10_000, F.concat(F.regexp_replace(F.format_number(v / 10_000, 3), r"\.?0+$", ""), F.lit("만원")))
        .otherwise(F.concat(F.format_number(v, 0), F.lit("원")))
    )


def numeric_text(c: Column) -> Column:
    """The cell as it stands if it reads as a number, commas aside; else empty."""
    return F.when(F.regexp_replace(c, ",", "").rlike(r"^-?\d+(\.\d+)?$"), c).otherwise(F.lit(""))


def classify(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that is found."""
    out = None
    for pattern, label in rules:
        out = F.when(c.rlike(pattern), F.lit(label)) if out is None else out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(other))


#: Lines of one release's listing, which its digest needs in one place.
MOST_LISTED = 1_000_000


def digest_of_listing(path: Column, sha: Column) -> Column:
    """Digest of a release: of its sorted lines path, tab, digest. An aggregate; it fails beyond MOST_LISTED lines."""
    lines = F.sort_array(F.collect_list(F.concat(path, F.lit("\t"), sha)))
    return F.when(F.size(lines) <= MOST_LISTED, F.sha2(F.array_join(lines, "\n"), 256)).otherwise(F.raise_error(F.lit(f"a listing has {MOST_LISTED} lines at most")).cast("string"))
