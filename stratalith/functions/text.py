"""Text functions on columns: normalisation, token estimates, sentences, URLs, page margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the embedding model per word (fixed value).
TOKENS_PER_WORD = 1.68

#: English stop words of the full-text index (fixed values, 127 words).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

#: White space as Python and Unicode know it; Java's \\s is ASCII.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeeze(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def clean(c: Column) -> Column:
    """Block text: reference markers of up to three digits removed, white space collapsed, no space before closing
    punctuation or after an opening bracket."""
    c = F.regexp_replace(c, r"\[" + SPACE + r"*\d{1,3}(?:" + SPACE + r"*[,–-]" + SPACE + r"*\d{1,3})*" + SPACE + r"*\]", "")
    c = F.regexp_replace(squeeze(c), r" +([,.;:!?)\]])", "$1")
    return F.regexp_replace(c, r"([(\[]) +", "$1")


def word_list(c: Column) -> Column:
    """The words of a text: what stands between white space."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def estimate_tokens(c: Column, per_word: float | Column = TOKENS_PER_WORD) -> Column:
    """Words times tokens per word, rounded up."""
    per = per_word if isinstance(per_word, Column) else F.lit(float(per_word))
    return F.ceil(word_count(c) * per).cast("long")


def sentences(c: Column) -> Column:
    """Text cut after . ! ? and white space where an upper-case letter, a digit or an opening bracket follows."""
    return F.split(c, r"(?<=[.!?])" + SPACE + r"+(?=[A-Z0-9(\[])")


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def lexemes(c: Column) -> Column:
    """Terms without English stop words."""
    return F.filter(terms(c), lambda t: ~t.isin(*STOP_WORDS))


def index_text(section: Column, content: Column) -> Column:
    """What is embedded and indexed of a chunk: its section, an empty line, its content."""
    return F.concat(F.coalesce(section, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))


def slug(url: Column) -> Column:
    """The last part of a URL's path: unquoted, lower case, without .pdf, other characters as single hyphens; "index" for
    an empty path."""
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    last = F.regexp_extract(F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "/+$", ""), r"([^/]*)$", 1)
    plain = F.regexp_replace(F.lower(F.coalesce(F.nullif(last, F.lit("")), F.lit("index"))), r"\.pdf$", "")
    return F.when(url.isNotNull(), F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-")))


def is_pdf(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("PATH"))).endswith(".pdf")


def citation_url(url: Column, anchor: Column) -> Column:
    """The page's address, with #anchor where the chunk has one (an empty one is none)."""
    return F.concat(url, F.coalesce(F.concat(F.lit("#"), F.nullif(anchor, F.lit(""))), F.lit("")))


def lookup_key(c: Column) -> Column:
    """Key of a place name: white space collapsed, lower case, sharp s as ss."""
    return F.regexp_replace(F.lower(squeeze(c)), "ß", "ss")


def margin_key(c: Column) -> Column:
    """A line with white space collapsed and numbers as #: running headers and footers agree."""
    return F.regexp_replace(squeeze(c), r"\d+", "#")


def is_debris(c: Column) -> Column:
    """Lines without a word of three letters, or of six tokens and more half of which are single characters."""
    tokens = word_list(c)
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    return ~c.rlike("[A-Za-z]{3,}") | ((F.size(tokens) >= 6) & (single * 2 >= F.size(tokens)))


def section_number(c: Column) -> Column:
    """"3.1" as [3, 1]; an appendix letter counts from 100 on: "A1.4" as [100, 1, 4]. null if it is no number."""
    letter = F.ascii(c) - 65 + 100
    rest = F.transform(F.filter(F.split(F.regexp_replace(c, "^[A-H]", ""), r"\."), lambda x: x != ""), lambda x: x.try_cast("int"))
    return F.when(c.rlike(r"^[A-H](?:\d{1,2}(?:\.\d{1,2}){0,3})?$"), F.concat(F.array(letter), rest)).when(c.rlike(r"^\d{1,2}(?:\.\d{1,2}){0,4}$"), rest)


def cited_numbers(answer: Column) -> Column:
    """The numbers of the citations [3] and [1, 3] of a text, each once, ascending."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9}(?:\s*,\s*\d{1,9})*)\]"), 1)
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int"))))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
