"""From scholarly works to articles: flattening, abstract cleaning, search, and the regex sieve."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.functions.text import rebuild_abstract

#: What pages leave in an abstract field, and how an author list looks.
JUNK = (
    "search for other works by this author", "google scholar", "download citation file", "you do not have access to this content", "institutional administrator", "add to citation manager",
    "cite view this citation", "share icon share", "toolbar search", "search dropdown menu", "advanced search", "get permissions", "article history first online",
)
AUTHOR_LIST = r"(?:[A-Z]\.\s?){1,3}[A-Za-z\-]+;"
LEAST_AUTHORS = 4


def abstract_ok(text: Column) -> Column:
    """Neither empty, nor cut off, nor page junk, nor an author list."""
    cut = F.regexp_replace(text, r"(?U)\s+$", "").rlike(r"(\.\.\.|…)\z")
    junk = F.lower(text).rlike("|".join(re.escape(m).replace("\\ ", " ") for m in JUNK))
    authors = F.regexp_count(text, F.lit(AUTHOR_LIST)) >= LEAST_AUTHORS
    return F.coalesce((text != "") & ~cut & ~junk & ~authors, F.lit(False))


def clean_abstract(text: Column) -> Column:
    """The abstract, or an empty text if it isn't one."""
    return F.when(abstract_ok(text), text).otherwise("")


def flatten_works(works: DataFrame) -> DataFrame:
    """One flat row per work: title, year, authors, journal, doi, citations, clean abstract, keywords."""
    names = lambda items, get: F.filter(F.transform(F.coalesce(items, F.array()), get), lambda x: x.isNotNull() & (x != ""))
    authors = F.transform(F.filter(F.coalesce("authorships", F.array()), lambda a: a["author"].isNotNull()), lambda a: F.coalesce(a["author"]["display_name"], F.lit("")))
    return works.select(
        F.col("id").alias("id_openalex"), F.coalesce(F.nullif("title", F.lit("")), "display_name").alias("titulo"), F.col("publication_year").alias("ano"), F.array_join(authors, ", ").alias("autores"),
        F.col("primary_location.source.display_name").alias("revista"), "doi", F.col("cited_by_count").alias("citado_por"), clean_abstract(rebuild_abstract(F.col("abstract_inverted_index"))).alias("abstract"),
        F.array_join(names(F.col("keywords"), lambda k: k["display_name"]), "; ").alias("palavras_chave_openalex"),
    )


def require_abstract(articles: DataFrame, column: str = "abstract") -> DataFrame:
    return articles.where(F.length(column) > 0)


def open_access_only(works: DataFrame) -> DataFrame:
    return works.where(F.coalesce("open_access.is_oa", F.lit(False)))


_OUTSIDE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")


def _whole(phrase: str) -> str:
    return "(?i)" + _OUTSIDE[0] + r"\s+".join(re.escape(w) for w in phrase.split()) + _OUTSIDE[1]


def _in_text(text: Column) -> Callable[[str], Column]:
    """Whether a text has a phrase as whole words."""
    return lambda phrase: F.coalesce(text.rlike(_whole(phrase)), F.lit(False))


def _in_index(index: Column) -> Callable[[str], Column]:
    """The same of an inverted index, word to positions, whose text isn't rebuilt.

    Of a phrase the first word ends an entry, the last one begins an entry, and those between are entries; the
    positions of entries that fit, each less the word's place, have one in common if they stand in a row.
    """

    def held(phrase: str) -> Column:
        words = [re.escape(w) for w in phrase.split()]
        patterns = [("(?i)" if len(words) == 1 else "(?i)^" if k else "(?i)") + (_OUTSIDE[0] if k == 0 else "") + w + (_OUTSIDE[1] if k == len(words) - 1 else "$") for k, w in enumerate(words)]
        fitting = lambda pattern: F.flatten(F.map_values(F.map_filter(index, lambda w, _: w.rlike(pattern))))
        places = [F.transform(fitting(p), lambda x: x - F.lit(k)) for k, p in enumerate(patterns)]
        common = places[0]
        for other in places[1:]:
            common = F.array_intersect(common, other)
        return F.coalesce(F.size(common) > 0, F.lit(False))

    return held


def keyword_query(keywords: str | list[str], text: Column | None = None, index: Column | None = None) -> Column:
    """Any of the keywords as whole words; of several words as a phrase. Over a text or an inverted index."""
    words = [keywords] if isinstance(keywords, str) else list(keywords)
    if not words or not all(w.strip() for w in words):
        raise ValueError("give one keyword at least, none of them empty")
    if index is None:
        return F.coalesce(text.rlike("|".join(_whole(w) for w in words)), F.lit(False))
    out = F.lit(False)
    for w in words:
        out = out | _in_index(index)(w)
    return out


def boolean_query(query: str, text: Column | None = None, index: Column | None = None) -> Column:
    """AND, OR, NOT, parentheses and quoted phrases; words side by side must all be there.

    Over a text, or over a work's inverted index, so that works are searched before any text is rebuilt.
    """
    held = _in_text(text) if index is None else _in_index(index)
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    if not tokens:
        raise ValueError("the query is empty")
    at = 0

    def either() -> Column:
        nonlocal at
        left = every()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            left = left | every()
        return left

    def every() -> Column:
        nonlocal at
        left = one()
        while at < len(tokens) and tokens[at] not in ("OR", ")"):
            at += tokens[at] == "AND"
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"the query ends too soon: {query}")
        token, at = tokens[at], at + 1
        if token == "NOT":
            return ~one()
        if token == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"a parenthesis is open: {query}")
            at += 1
            return inner
        if token in (")", "AND", "OR"):
            raise ValueError(f"{token} is out of place: {query}")
        phrase = token.strip('"')
        if not phrase.strip():
            raise ValueError(f"a phrase is empty: {query}")
        return held(phrase)

    made = either()
    if at < len(tokens):
        raise ValueError(f"{tokens[at]} is out of place: {query}")
    return made


def top_relevant(works: DataFrame, n: int, relevance: str = "relevance_score", id_col: str = "id", only: Column | None = None) -> DataFrame:
    """The n most relevant works, of those that meet ``only`` (such as having an abstract)."""
    if n <= 0:
        raise ValueError("n is positive")
    return (works if only is None else works.where(only)).orderBy(F.col(relevance).desc(), id_col).limit(n)


def missing_abstract_summary(articles: DataFrame, column: str = "abstract") -> DataFrame:
    without = F.coalesce(F.length(column), F.lit(0)) == 0
    return articles.agg(F.count(F.lit(1)).alias("n_total"), F.coalesce(F.sum(without.cast("long")), F.lit(0)).alias("n_without_abstract"))


# ---- sieve ---------------------------------------------------------------------------------

#: Patterns of a property, a value with its unit, and an element.
PROPERTY = (
    r"(?i)(?:\b(?:TREO(?:\s*\+\s*Y)?|REO|REE)\b|\btotal\s+rare[-\s]?earth\s+oxides?\b|"
    r"\b(?:rare[-\s]+earth(?:\s+elements?|\s+oxides?))\s+(?:composition|content|concentration|grade|distribution|abundance|proportion|ratio)\b|"
    r"\b(?:composition|content|concentration|grade|distribution|abundance|proportion|ratio)\s+of\s+(?:the\s+)?(?:rare[-\s]+earth(?:\s+elements?|\s+oxides?)|REE|REO)\b)"
)
VALUE = r"(?i)(?<![\d.,])(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(?:wt\s*%|%|ppm|g/t)\b"
#: The same with a boundary after letters only, so that a percent sign may end the match.
VALUE_FREE = r"(?i)(?<![\d.,])(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(?:wt\s*%|%|(?:ppm|g/t)\b)"
ELEMENT = (
    r"(?i)\b(?:La|Ce|Pr|Nd|Pm|Sm|Eu|Gd|Tb|Dy|Ho|Er|Tm|Yb|Lu|Sc|Y|lanthanum|cerium|praseodymium|neodymium|promethium|samarium|europium|gadolinium|terbium|dysprosium|holmium|erbium|thulium|"
    r"ytterbium|lutetium|scandium|yttrium)\b"
)


def sieve_flag(text: Column, percent_boundary: bool = True) -> Column:
    """A value and a property are there; the cheaper pattern is tried first."""
    return F.coalesce(text.rlike(VALUE if percent_boundary else VALUE_FREE) & text.rlike(PROPERTY), F.lit(False))


def sieve(abstracts: DataFrame, text_col: str = "abstract", percent_boundary: bool = True) -> DataFrame:
    """The rows worth a model call, ids untouched; null texts never are."""
    return abstracts.where(F.col(text_col).isNotNull() & sieve_flag(F.col(text_col), percent_boundary))


def element_flag(text: Column) -> Column:
    return F.coalesce(text.rlike(ELEMENT), F.lit(False))


def sieve_report(abstracts: DataFrame, text_col: str = "abstract", percent_boundary: bool = True) -> DataFrame:
    there = F.col(text_col).isNotNull()
    totals = abstracts.agg(F.coalesce(F.sum(there.cast("long")), F.lit(0)).alias("n_abstracts"), F.coalesce(F.sum((there & sieve_flag(F.col(text_col), percent_boundary)).cast("long")), F.lit(0)).alias("n_candidates"))
    return totals.select("n_abstracts", "n_candidates", F.coalesce(F.try_divide("n_candidates", "n_abstracts"), F.lit(0.0)).alias("share"), (F.col("n_abstracts") - F.col("n_candidates")).alias("calls_saved"))
