"""How likely two names share a type specimen, from their parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Outcome classes (only their order matters) and part masks.
DECLARED, HOMOTYPIC, CORRECTION, MIDDLE, MOTION, CLASH, ALL_IN = 11, 10, 9, 8.5, 8, 7, 6
BINOMIAL, NO_WAY, REVIEW, DISAGREE, HETEROTYPIC, TOPO = 5, 4, 2, 1, 0, -1
EPITHET, VICINITY, YEAR, TOKEN, GENUS, MIDDLE_PART = 32, 16, 8, 4, 2, 1
CLASS_NAMES = {
    HOMOTYPIC: "homotypic", CORRECTION: "correction", MOTION: "motion",
    BINOMIAL: "authorless", REVIEW: "review", HETEROTYPIC: "heterotypic",
}
PART_NAMES = {MIDDLE_PART: "middle", GENUS: "genus", TOKEN: "token", YEAR: "year",
              VICINITY: "vicinity", EPITHET: "epithet"}


def matched_epithet(p: Column) -> Column:
    """`Foo` is treated like `Foo foo`."""
    return F.when((p["epithet"] == "") & (p["genus"] != ""), F.lower(p["genus"])).otherwise(p["epithet"])


def matched_middle(p: Column) -> Column:
    """`G e` is treated like `G e e`."""
    return F.when(p["middle"] == "", p["epithet"]).otherwise(p["middle"])


def parts_comparison(p: Column, q: Column) -> Column:
    """struct(misses, hits) of part masks; an unknown part counts for neither."""
    checks = [
        (EPITHET, p["epithet"].isNotNull() & q["epithet"].isNotNull(), matched_epithet(p), matched_epithet(q)),
        (TOKEN, p["token"].isNotNull() & q["token"].isNotNull(), p["token"], q["token"]),
        (YEAR, p["year"].isNotNull() & q["year"].isNotNull(), p["year"], q["year"]),
        (GENUS, p["genus"].isNotNull() & q["genus"].isNotNull(), p["genus"], q["genus"]),
        (MIDDLE_PART, p["middle"].isNotNull() & q["middle"].isNotNull(), matched_middle(p), matched_middle(q)),
    ]
    hits = misses = F.lit(0)
    for mask, both, a, b in checks:
        same = a.eqNullSafe(b)
        hits = hits + F.when(both & same, mask).otherwise(0)
        misses = misses + F.when(both & ~same, mask).otherwise(0)
    return F.struct(misses.cast("int").alias("misses"), hits.cast("int").alias("hits"))


def _has(masks: Column, mask: int) -> Column:
    return masks.bitwiseAND(F.lit(mask)) == mask


def classify(misses: Column, hits: Column) -> Column:
    author = YEAR | TOKEN
    one_hit = hits.bitwiseAND(F.lit(author)) != 0
    same_genus = _has(hits, GENUS)
    return (
        F.when(~_has(hits, EPITHET) | _has(misses, author), HETEROTYPIC)
        .when(_has(hits, author), F.when(same_genus, HOMOTYPIC).otherwise(MOTION))
        .when(one_hit, F.when(same_genus, CORRECTION).otherwise(REVIEW))
        .when(misses.bitwiseAND(F.lit(author)) == 0, BINOMIAL)
        .otherwise(REVIEW)).cast("int")


def compare_names(p: Column, q: Column) -> Column:
    masks = parts_comparison(p, q)
    return classify(masks["misses"], masks["hits"])


def middle_v8(p: Column) -> Column:
    """The middle part as version 8 compares it: `G e` is treated like `G e e`, `G` like `G g g`."""
    epithet = matched_epithet(p)
    return F.when((p["middle"] == "") & epithet.isNotNull(), epithet).otherwise(p["middle"])


def classify_v8(p: Column, q: Column) -> Column:
    """The stricter classifier: it also weighs middle parts and missing parentheses."""
    def differ(a: Column, b: Column) -> Column:
        return F.coalesce(a != b, F.lit(False))

    def either_unknown(a: Column, b: Column) -> Column:
        return a.isNull() | b.isNull()

    genus_differs = differ(p["genus"], q["genus"])
    protonyms = F.coalesce(p["protonymp"] & q["protonymp"], F.lit(False))
    clash, motion = genus_differs & protonyms, genus_differs & ~protonyms
    middle_differs = differ(middle_v8(p), middle_v8(q))
    mismatches = (differ(p["token"], q["token"]).cast("int") + differ(p["year"], q["year"]).cast("int")
                  + (middle_differs | genus_differs).cast("int"))
    # equal raw epithets also count here as one reliance on an unknown
    unknowns = (either_unknown(p["token"], q["token"]).cast("int") + either_unknown(p["year"], q["year"]).cast("int")
                + F.coalesce(p["epithet"] == q["epithet"], F.lit(False)).cast("int"))
    return (
        F.when(differ(p["epithet"], q["epithet"]), HETEROTYPIC)
        .when(mismatches > 1, DISAGREE)
        .when(unknowns >= 2, BINOMIAL)
        .when(clash, CLASH).when(motion, MOTION).when(middle_differs, MIDDLE)
        .when(mismatches > 0, CORRECTION).otherwise(HOMOTYPIC)).cast("double")


def explain_class(code: Column) -> Column:
    out = code.cast("string")
    for value, word in CLASS_NAMES.items():
        out = F.when(code == value, word).otherwise(out)
    return out


def _mask_words(masks: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[
        F.when(_has(masks, m), word) for m, word in PART_NAMES.items()])), ", ")


def explain_masks(misses: Column, hits: Column) -> Column:
    return F.concat(F.lit("hits("), _mask_words(hits), F.lit(") misses("), _mask_words(misses), F.lit(")"))


def block_key(p: Column, taxon_id: Column) -> Column:
    """Epithet, else genus, else a key of the row's own."""
    return F.coalesce(F.when(p["epithet"] != "", p["epithet"]), F.when(p["genus"] != "", p["genus"]),
                      F.concat(F.lit("?"), taxon_id))


def importance(accepted: Column, p: Column, children: Column, synonyms: Column,
               scientific: Column, taxon_id: Column) -> Column:
    """Sort key: the most important record is the least."""
    form = (F.when(p["epithet"] == "", 4).when(p["middle"].eqNullSafe(p["epithet"]), 2)
            .when(p["middle"].isNull() | (p["middle"] == ""), 0).otherwise(1))
    return F.struct(F.when(accepted, 1).otherwise(2).alias("status"), form.alias("form"),
                    (-children).alias("children"), (-synonyms).alias("synonyms"),
                    scientific.alias("scientific"), taxon_id.alias("taxonID"))
