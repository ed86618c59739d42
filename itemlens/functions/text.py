"""Column expressions over free text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.labels import collapse_blanks, nullif_blank, trim_blanks

TAG = r"<[^>]+>"


def strip_html(col: Column, null_on_empty: bool = True) -> Column:
    plain = F.regexp_replace(col, TAG, " ")
    if null_on_empty:
        plain = F.replace(plain, F.lit("&nbsp;"), F.lit(" "))
        plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
        return nullif_blank(trim_blanks(collapse_blanks(plain)))
    return F.coalesce(trim_blanks(collapse_blanks(plain)), F.lit(""))


def extract_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def tokenize(col: Column, stopwords: list = K.SUBJECT_STOPWORDS) -> Column:
    """Words of three or more ASCII letters, stopwords left out, in text order.

    All runs of letters are taken first and looked up in the set of stopwords then: a regular expression that does both tries every
    stopword at every word.
    """
    words = extract_all(F.lower(F.coalesce(col, F.lit(""))), "[a-z]{3,}")
    return F.filter(words, lambda w: ~w.isin(stopwords)) if stopwords else words


def bigrams(tokens: Column) -> Column:
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.size(tokens) - 1),
        F.slice(tokens, F.lit(2), F.size(tokens) - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def extract_named_terms(
    col: Column,
    patterns: list = K.NAMED_TERM_PATTERNS,
    stop_terms: list = K.NAMED_TERM_STOP,
    min_length: int = 6,
    dedupe: bool = False,
) -> Column:
    """Every match of every pattern; a term hit by two patterns appears twice.

    ``dedupe`` keeps one of them per text.
    """
    hits = F.concat(*[extract_all(F.coalesce(col, F.lit("")), "(?U)" + p) for p in patterns])
    terms = F.transform(hits, lambda t: trim_blanks(collapse_blanks(t)))
    kept = F.filter(terms, lambda t: (F.length(t) >= min_length) & ~F.lower(t).isin(stop_terms))
    return F.array_distinct(kept) if dedupe else kept


def collapse_suffix(col: Column, suffixes: list = K.NAMED_TERM_SUFFIXES) -> Column:
    return F.lower(F.regexp_replace(col, r"(?iU)\s+(?:" + "|".join(suffixes) + r")$", ""))


def significant_words(col: Column, limit: int = 4, stopwords: list = K.CATALOGUE_STOPWORDS) -> Column:
    words = extract_all(col, r"(?U)\b[A-Za-z0-9][A-Za-z0-9\-]*\b")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(stopwords) & ~w.rlike("^[0-9]+$"))
    return F.slice(kept, 1, limit)


def escape_regex(col: Column) -> Column:
    return F.regexp_replace(col, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])", r"\\$1")


def title_probe(title: Column, generic: list = K.GENERIC_ACRONYMS) -> Column:
    """How a catalogue title is looked for: struct(kind, needle, pattern).

    kind 'acronym' - the bracketed acronym as a whole word;
    kind 'phrase'  - two or more distinguishing words, any blanks between;
    kind 'title'   - the title as it stands.
    """
    acronym = F.regexp_extract(title, r"\(([A-Z][A-Z0-9.\-]{1,14})\)", 1)
    usable = (F.length(acronym) >= 3) & ~acronym.isin(generic)
    tail = significant_words(F.regexp_extract(title, r"(?iUd)\s+(?:for|of)\s+(.+)$", 1))
    words = F.when(F.size(tail) >= 2, tail).otherwise(significant_words(title))
    phrase = F.array_join(words, " ")
    phrase_pattern = F.array_join(F.transform(words, escape_regex), r"\s+")

    def probe(kind, needle, pattern):
        return F.struct(F.lit(kind).alias("kind"), F.lower(needle).alias("needle"), pattern.alias("pattern"))

    return (
        F.when(usable, probe("acronym", acronym, F.concat(F.lit(r"\b"), escape_regex(acronym), F.lit(r"\b"))))
        .when(F.size(words) >= 2, probe("phrase", phrase, phrase_pattern))
        .otherwise(probe("title", title, escape_regex(title)))
    )


def derive_pattern(title: Column) -> Column:
    return title_probe(title)["pattern"]


def extract_outlay(col: Column) -> Column:
    digits = F.replace(F.regexp_extract(col, K.OUTLAY_PATTERN, 1), F.lit(","), F.lit(""))
    return nullif_blank(digits).try_cast("double")


def extract_company(col: Column, pattern: str = K.COMPANY_PATTERN) -> Column:
    last = F.try_element_at(extract_all(col, "(?U)" + pattern, 1), F.lit(-1))
    name = F.btrim(collapse_blanks(last), F.lit(" .,"))
    return F.when(F.length(name) >= 4, name)


def extract_activity(col: Column, label: str = "Activity") -> Column:
    pairs = F.from_json(col, "array<struct<label:string,value:string>>")
    return F.get(F.filter(pairs, lambda p: p["label"] == label), F.lit(0))["value"]
