"""Feature spaces: a registry of functions from articles to (pmid, ftype, fname) rows, distinct per article."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as T

Space = Callable[[DataFrame], DataFrame]


def _typed(ftype: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(ftype).alias("ftype"), n.alias("fname")))


def _pairs(**typed: Column) -> Column:
    return F.concat(*(_typed(t, c) for t, c in typed.items()))


def long_form(articles: DataFrame, **typed: Column) -> DataFrame:
    """One row per name of each array column; only the key goes through the explode."""
    return articles.select("pmid", F.explode(_pairs(**typed)).alias("f")).select("pmid", "f.ftype", "f.fname")


def _mqi() -> dict[str, Column]:
    issn = F.array_compact(F.array(F.col("issn")))
    return {"mesh": T.headings(F.col("meshterms")), "qual": T.qualifiers(F.col("meshterms")), "issn": issn}


def _words(**more) -> Column:
    return T.words(F.col("title"), F.col("abstract"), **more)


def _wmqia() -> dict[str, Column]:
    return {**_mqi(), "w": _words(), "a": T.authors(F.col("authors"))}


def _word_strip() -> dict[str, Column]:
    return {"w": T.words_strip(F.col("title"), F.col("abstract"))}


def mqi(articles: DataFrame) -> DataFrame:
    """Headings, qualifiers and journal."""
    return long_form(articles, **_mqi())


def word(articles: DataFrame) -> DataFrame:
    return long_form(articles, w=_words())


def word_fold(articles: DataFrame) -> DataFrame:
    return long_form(articles, w=_words(fold=True))


def word_num(articles: DataFrame) -> DataFrame:
    return long_form(articles, w=_words(numbers=True))


def word_strip(articles: DataFrame) -> DataFrame:
    return long_form(articles, **_word_strip())


def author(articles: DataFrame) -> DataFrame:
    return long_form(articles, a=T.authors(F.col("authors")))


def wmqia(articles: DataFrame) -> DataFrame:
    """Words, headings, qualifiers, journal and authors."""
    return long_form(articles, **_wmqia())


def wmqia_filt(articles: DataFrame) -> DataFrame:
    """The same without words that are tokens of the article's own headings and qualifiers."""
    staged = articles.withColumn("_w", _words()).withColumn("_tokens", T.heading_tokens(F.col("meshterms")))
    kept = F.filter("_w", lambda w: ~F.array_contains("_tokens", F.lower(w)))
    return long_form(staged, **{**_mqi(), "w": kept, "a": T.authors(F.col("authors"))})


def raw_all(articles: DataFrame) -> DataFrame:
    """Pieces between white space of title, abstract, journal, last names and headings."""
    names, terms = T.all_strings(F.col("meshterms"), F.col("authors"))
    return long_form(articles, w=T.words_raw(F.col("title"), F.col("abstract"), F.col("journal"), names, terms))


def raw_word(articles: DataFrame) -> DataFrame:
    return long_form(articles, w=T.words_raw(F.col("title"), F.col("abstract")))


SPACES: dict[str, Space] = {
    "mqi": mqi, "word": word, "word_fold": word_fold, "word_num": word_num, "word_strip": word_strip,
    "author": author, "wmqia": wmqia, "wmqia_filt": wmqia_filt, "raw_all": raw_all, "raw_word": raw_word,
}


#: Spaces that are columns of an article alone.
_COLUMNS = {"mqi": _mqi, "word_strip": _word_strip, "wmqia": _wmqia}


def sets(space: str) -> Column:
    """An article's features in one of these spaces, as one array of (ftype, fname)."""
    return _pairs(**_COLUMNS[space]())


def register(name: str, space: Space) -> None:
    """A further space, by name."""
    SPACES[name] = space


def extract(articles: DataFrame, space: str) -> DataFrame:
    if space not in SPACES:
        raise KeyError(f"no feature space {space!r}")
    return SPACES[space](articles)


def coded(articles: DataFrame, code: str, extracted: Callable[[DataFrame, str], DataFrame] = extract) -> DataFrame:
    """The features of a space by its code: its space without the types that the code leaves out. ``extracted`` gives a space's rows."""
    codes = config.SPACES | config.MORE_SPACES
    if code not in codes:
        raise KeyError(f"no feature space of code {code!r}")
    space, left_out = codes[code]
    rows = extracted(articles, space)
    return rows.where(~F.col("ftype").isin(list(left_out))) if left_out else rows
