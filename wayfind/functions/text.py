"""Normalisation, postings, trigrams and query parsing as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Field weights of the text index
WEIGHTS = {"title": 1.0, "tags": 0.4, "channel": 0.4, "description": 0.2, "body": 0.2}
DESCRIPTION_CHARS = 2000
SPLIT = r"[^\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def normalize(s: pd.Series) -> pd.Series:
    """Compatibility form, full case folding, runs of white space to one space; null stays null. The library's only Python scalar function."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", v).casefold()).split()), na_action="ignore")


def normalize_ascii(s: Column) -> Column:
    """The same for ASCII text, without Python."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def tags_to_text(tags: Column) -> Column:
    return F.array_join(tags, " ")


def terms(text: Column) -> Column:
    """Lower-case words, in order, without stemming or stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: t != "")


def postings(docs: DataFrame) -> DataFrame:
    """video_id, term, pos, weight: positions go on from title to tags, channel, description (its first DESCRIPTION_CHARS) and body (whole); fields that docs lack are empty."""
    fields = {
        "title": terms(F.col("title")),
        "tags": terms(tags_to_text(F.col("tags"))),
        "channel": terms(F.col("channel_name")),
        "description": terms(F.substring("description", 1, DESCRIPTION_CHARS)) if "description" in docs.columns else None,
        "body": terms(F.col("body")) if "body" in docs.columns else None,
    }

    def weighed(words: Column, weight: float) -> Column:
        return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    return docs.select("video_id", F.posexplode(F.concat(*[weighed(words, WEIGHTS[name]) for name, words in fields.items() if words is not None])).alias("pos", "p")).select("video_id", "p.term", (F.col("pos") + 1).alias("pos"), "p.weight")


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of each word, which has two blanks before and one after."""
    padded = F.transform(terms(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3))))))


def set_similarity(x: Column, y: Column) -> Column:
    """Of two arrays without repeats: shared over all; 0 where there are none."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 where there are none."""
    return set_similarity(trigrams(a), trigrams(b))


def parse_websearch(query: Column) -> Column:
    """Struct of must, must_not (term arrays), phrases and any_of (arrays of term arrays): quoted phrases, a minus, and `or` between terms."""
    quoted = F.regexp_extract_all(query, F.lit(r'(^|\s)"([^"]*)"'), F.lit(2))
    phrases = F.filter(F.transform(quoted, terms), lambda p: F.size(p) > 0)
    rest = F.regexp_replace(query, r'-?"[^"]*"', " ")
    minus = F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(r"(^|\s)-(\S+)"), F.lit(2)), terms))
    plain = F.regexp_replace(rest, r"(^|\s)-\S+", " ")
    groups = F.regexp_extract_all(F.lower(plain), F.lit(r"(\S+(?:\s+or\s+\S+)+)"), F.lit(1))
    any_of = F.transform(groups, lambda g: F.flatten(F.transform(F.split(g, r"\s+or\s+"), terms)))
    must = terms(F.regexp_replace(F.lower(plain), r"\S+(?:\s+or\s+\S+)+", " "))
    return F.struct(F.array_distinct(must).alias("must"), F.array_distinct(minus).alias("must_not"), phrases.alias("phrases"), any_of.alias("any_of"))


def cover_density(positions: Column, n_terms: Column) -> Column:
    """Rank of a document for a query of several terms: the sum over minimal covers of weight over span.

    positions: array of (pos, term number from 0, weight), sorted. One term: the sum of its weights. A cover is an
    interval that holds all terms and no smaller such interval; it adds the mean harmonic weight of its terms over the
    number of other words in it plus 1. This follows the published cover-density method; for several terms it need not equal
    another implementation digit by digit.
    """

    def step(state: Column, p: Column) -> Column:
        last = F.map_concat(F.map_filter(state["last"], lambda k, _: k != p["term"]), F.map_from_arrays(F.array(p["term"]), F.array(F.struct(p["pos"].alias("pos"), p["weight"].alias("weight")))))
        held = F.map_values(last)
        start = F.array_min(F.transform(held, lambda h: h["pos"]))
        full = (F.size(held) == n_terms) & (start > state["start"])
        inverse = F.aggregate(held, F.lit(0.0), lambda s, h: s + 1.0 / h["weight"])
        gain = F.try_divide(n_terms / inverse, p["pos"] - start - n_terms + 2)
        return F.struct(last.alias("last"), F.when(full, start).otherwise(state["start"]).alias("start"), F.when(full, state["rank"] + gain).otherwise(state["rank"]).alias("rank"))

    empty = F.struct(F.lit(None).cast("map<int,struct<pos:int,weight:double>>").alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("rank"))
    empty = empty.withField("last", F.expr("cast(map() as map<int,struct<pos:int,weight:double>>)"))
    return F.aggregate(positions, empty, step, lambda s: s["rank"])
