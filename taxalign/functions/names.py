"""Scientific names taken apart, as native column expressions.

In the result NULL is an unknown ("wild") part and '' a part that is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The patterns that define the parts of an authorship.
YEAR = r"\b([12][0-9]{3})\b"
YEAR_IN_PARENS = r"\(\b([12][0-9]{3})\b\)"
INITIALS = r"^(\p{Lu}[.] )+"
TOKEN = r"\p{Lu}[\p{L}-]{3,}"
TOKEN_SHORT = r"\p{Lu}[\p{L}-]{1,}"
NAME_THEN_AUTHOR = r"^(.+?) (\(?\p{Lu}[\p{L}.'-]+.*)$"
SUBGENUS = r" \(\p{Lu}\p{L}+\) "
SUBGENUS_AT_START = r"^(\p{Lu}[\p{Ll}-]+) \(\p{Lu}[\p{Ll}-]+\) ([\p{Ll}-]+)"
NOBODY, NO_YEAR = "Someone", "1111"


def known(text: Column) -> Column:
    """'' becomes NULL."""
    return F.when(text != "", text)


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return known(F.regexp_extract(text, pattern, group))


def _last(words: Column) -> Column:
    return F.element_at(words, -1)


def _between(words: Column) -> Column:
    """All words but the first and the last."""
    return F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " ")


def is_polynomial(name: Column) -> Column:
    """False for hybrid formulas."""
    return ~(name.contains(" × ") | name.contains(" x "))


def split_name(verbatim: Column) -> dict[str, Column]:
    """canonical and authorship cut from one string; either can be NULL."""
    paren = verbatim.endswith(")") & verbatim.contains("(")
    at = F.instr(verbatim, "(")
    head = F.regexp_extract(verbatim, NAME_THEN_AUTHOR, 1)
    tail = F.regexp_extract(verbatim, NAME_THEN_AUTHOR, 2)
    canonical = (F.when(paren, F.substring(verbatim, F.lit(1), at - 1))
                 .when(tail != "", head).otherwise(verbatim))
    author = F.when(paren, F.substr(verbatim, at)).when(tail != "", tail)
    return {"canonical": known(F.trim(canonical)), "authorship": known(F.trim(author))}


def analyze_authorship(df: DataFrame, author: str, prefix: str, token_pattern: str = TOKEN) -> DataFrame:
    """Add token, year and protonymp of an authorship column, each under ``prefix``.

    Every step is a column of its own: a later step then refers to it, where one nested
    expression would repeat the earlier regexes many times over.
    """
    c = lambda name: F.col(prefix + name)
    bare = F.regexp_extract(author, YEAR_IN_PARENS, 0)
    df = df.withColumn(prefix + "bare", bare)
    df = df.withColumn(prefix + "text", F.when(
        c("bare") != "", F.replace(F.col(author), c("bare"), F.substring(c("bare"), 2, 4))).otherwise(F.col(author)))
    df = df.withColumn(prefix + "moved", c("text").contains("(") & c("text").contains(")"))
    df = df.withColumn(prefix + "plain", F.regexp_replace(
        F.when(c("moved"), F.translate(c("text"), "()", "")).otherwise(c("text")), INITIALS, ""))
    df = df.withColumns({prefix + "token": _first(c("plain"), token_pattern), prefix + "year": _first(c("plain"), YEAR, 1)})
    df = df.withColumns({
        prefix + "token": F.when(c("token") != NOBODY, c("token")),
        prefix + "year": F.when(c("year") != NO_YEAR, c("year")),
        prefix + "protonymp": F.when(F.col(author) != "", ~c("moved"))})
    return df.drop(prefix + "bare", prefix + "text", prefix + "moved", prefix + "plain")


def recover_canonical(df: DataFrame, full: str, stem: str, ad_hoc: str, prefix: str) -> DataFrame:
    """Add canonical, genus, middle and epithet under ``prefix``.

    The words are the stem's where the parser kept every word, the ad hoc ones elsewhere;
    without any parser result the ad hoc name is taken apart as it is.
    """
    c = lambda name: F.col(prefix + name)
    full_, stem_, own = F.col(full), F.col(stem), F.col(ad_hoc)
    kept = own.isNull() | (stem_.isNotNull() & (F.size(F.split(full_, " ")) >= F.size(F.split(F.trim(own), " "))))
    how = (F.when(full_.isNull(), F.when(is_polynomial(own) & own.contains(" "), "words").otherwise("whole"))
           .when(~is_polynomial(full_), "whole").when(kept, "stem").otherwise("own words"))
    df = df.withColumn(prefix + "how", how)
    text = (F.when(c("how") == "stem", F.coalesce(stem_, full_)).when(c("how") == "own words", F.trim(own))
            .otherwise(F.coalesce(full_, own)))
    df = df.withColumn(prefix + "name", text)
    df = df.withColumn(prefix + "words", F.split(c("name"), " "))
    # a one-word stem is a name above species; a lone ad hoc word is its own epithet
    one = (c("how") == "whole") | ((c("how") == "stem") & (F.size(c("words")) < 2))
    df = df.withColumn(prefix + "one", one)
    return df.withColumns({
        prefix + "canonical": F.when(c("how") == "own words", c("name")).otherwise(F.coalesce(full_, own)),
        prefix + "genus": F.when(c("how") == "whole", c("name")).otherwise(c("words")[0]),
        prefix + "middle": F.when(c("one"), "").otherwise(_between(c("words"))),
        prefix + "epithet": F.when(c("one"), "").otherwise(_last(c("words"))),
    }).drop(prefix + "how", prefix + "name", prefix + "words", prefix + "one")


def unparse(p: Column) -> Column:
    """A display name from parts, '?' standing for what is unknown."""
    genus, middle, epithet = p["genus"], p["middle"], p["epithet"]
    canonical = (F.when(epithet.isNull(), F.concat(genus, F.lit(" ?")))
                 .when(epithet == "", genus)
                 .when(middle == "", F.concat_ws(" ", genus, epithet))
                 .otherwise(F.concat_ws(" ", genus, F.coalesce(middle, F.lit("?")), epithet)))
    author = F.concat_ws(", ", F.coalesce(p["token"], F.lit("?")), p["year"])
    author = F.when(p["protonymp"], author).when(~p["protonymp"], F.concat(F.lit("("), author, F.lit(")"))).otherwise(author)
    return F.when(p["token"].isNull() & p["year"].isNull(), canonical).otherwise(F.concat_ws(" ", canonical, author))


def same_parts(p: Column, q: Column) -> Column:
    return (p["genus"].eqNullSafe(q["genus"]) & p["middle"].eqNullSafe(q["middle"])
            & p["epithet"].eqNullSafe(q["epithet"]) & p["token"].eqNullSafe(q["token"])
            & p["year"].eqNullSafe(q["year"]))


def type_key(p: Column) -> Column:
    return F.struct(p["epithet"].alias("epithet"), p["token"].alias("token"), p["year"].alias("year"))


def typelike(canonical: Column) -> Column:
    """0 for a nominotypical name (`A c c`), 1 for one word, 10 for the rest."""
    words = F.split(canonical, " ")
    n = F.size(words)
    return (F.when((n > 2) & (_last(words) == F.try_element_at(words, F.lit(-2))), 0)
            .when(n < 2, 1).otherwise(10))
