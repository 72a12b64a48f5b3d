"""A vocabulary as a graph: surfaces name terms, and a term may name another one, its generic, by a surface.

Every term has one standing: the generic at the end of its chain. Chains are followed by doubling:
each round joins what is reached so far with itself, so that a longest chain of n links takes log n rounds and one more, each
written out. Of terms that name each other in a circle the first in the vocabulary's order stands for all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import matching

#: Beginnings of this many letters or more name a longer surface.
HEAD = 5


def surfaces(terms: DataFrame, brands: str | None = None) -> DataFrame:
    """(norm, category, kind, ord, id): what names a term. ``terms`` is (id, category, name, aliases, ord); kinds are 1 for a name or alias,
    2 for a name's beginning before a blank, of ``HEAD`` letters or more, 3 for what the array column ``brands`` holds."""
    none = F.array().cast("array<string>")
    named = F.transform(F.concat(F.array("name"), F.coalesce("aliases", none)), lambda s: F.struct(F.lit(1).alias("kind"), s.alias("raw")))
    if brands:
        named = F.concat(named, F.transform(F.coalesce(brands, none), lambda s: F.struct(F.lit(3).alias("kind"), s.alias("raw"))))
    d = terms.select("id", "category", "ord", F.inline(named)).select("id", "category", "ord", "kind", X.normalize(F.col("raw")).alias("norm"))
    name = terms.select("id", "category", "ord", X.words(X.normalize(F.col("name"))).alias("w"))
    begins = F.transform(F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice("w", 1, n), " "))
    heads = name.select("id", "category", "ord", F.lit(2).alias("kind"), F.explode(F.filter(begins, lambda b: F.length(b) >= HEAD)).alias("norm"))
    return d.unionByName(heads).where("norm <> ''").distinct()


def generics(links: DataFrame, names: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, generic, category, ord) and surfaces -> (id, standing): the term at the end of each chain of generics.

    ``generic`` is a surface, null or unknown where a term stands for itself. A surface that names several terms
    means the first by kind and order, and never the term itself.
    """
    able = names.where("kind < 3").select("norm", F.col("category").alias("_cat"), F.struct("kind", "ord", F.col("id").alias("to")).alias("x"))
    asked = links.where("generic is not null").select("id", "category", X.normalize(F.col("generic")).alias("norm"))
    up = asked.join(able, "norm").where((F.col("category") == F.col("_cat")) & (F.col("x.to") != F.col("id"))).groupBy("id").agg(F.min("x").alias("x")).select("id", F.col("x.to").alias("to"))
    d = links.select("id", "ord").join(up, "id", "left").select("id", F.coalesce("to", "id").alias("to"), "ord")
    # ``low``: the first term in order among those passed; of a place in a circle, of the whole circle once the steps go round it.
    d = save(d.select("id", "to", F.struct("ord", "id").alias("low")))
    one = d.select(F.col("id").alias("to"), (F.col("to") == F.col("id")).alias("last"))
    reached, open_ = d.select("to").distinct().count(), True
    while open_:
        far = d.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        d = save(d.join(far, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        now = d.agg(F.countDistinct("to").alias("n"), F.coalesce(F.max("moved"), F.lit(False)).alias("moved")).first()
        reached, open_ = now.n, now.moved or now.n < reached
    # Twice the steps reach as many terms, so the steps only move terms within their circles: ``to`` stands still or lies in
    # one. No ``low`` sank, so none will: each is at most that of its ``to``.
    end = d.select(F.col("id").alias("to"), F.col("low.id").alias("first")).join(one, "to")
    return d.select("id", "to").join(end, "to").select("id", F.when(F.col("last"), F.col("to")).otherwise(F.col("first")).alias("standing"))


def resolve(items: DataFrame, names: DataFrame, standing: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Items (…, kb_id, name, brand, categories: array) with ``term`` and ``how``: id, name, head, near, or brand with the same; null if nothing fits.

    An id of a category that the item may not have counts as none. A name is looked up whole, as the beginning of a name,
    then in ``near`` (norm, category, ord, id, sim), the likest first; the brand is looked up likewise if the name gave
    nothing. With ``standing`` (id, standing) a term is replaced by what it stands for. Ties go to the first in order. Distinct
    names are looked up once.
    """
    asked = items.select(F.explode(F.array("name", "brand")).alias("said"), "categories").distinct().where("coalesce(said, '') <> ''").withColumn("norm", X.normalize(F.col("said")))
    each = asked.select("said", "categories", "norm", F.explode("categories").alias("category"))
    found = each.join(names.where("kind <> 2 or length(norm) >= 1"), ["norm", "category"]).select("said", "categories", F.struct(F.when(F.col("kind") == 3, 1).otherwise(F.col("kind")).alias("kind"), F.lit(0.0).alias("far"), "ord", "id").alias("x"))
    if near is not None:
        like = each.join(near, ["norm", "category"]).select("said", "categories", F.struct(F.lit(4).alias("kind"), (-F.col("sim")).alias("far"), "ord", "id").alias("x"))
        found = found.unionByName(like)
    best = found.groupBy("said", "categories").agg(F.min("x").alias("x"))
    ids = names.select(F.col("id").alias("i_id"), F.col("category").alias("i_cat")).distinct()
    d = items.join(ids, F.col("kb_id") == F.col("i_id"), "left").withColumn("_id", F.when(F.array_contains("categories", F.col("i_cat")), F.col("i_id"))).drop("i_id", "i_cat")
    of = lambda c, to: best.select(F.col("said").alias(c), "categories", F.col("x").alias(to))
    d = d.join(of("name", "_n"), ["name", "categories"], "left").join(of("brand", "_b"), ["brand", "categories"], "left")
    kind = F.coalesce("_n.kind", "_b.kind")
    how = F.when(F.col("_id").isNotNull(), "id").when(kind.isNotNull(), F.concat(F.when(F.col("_n").isNull(), "brand ").otherwise(""), F.element_at(F.array(F.lit("name"), F.lit("head"), F.lit("brand"), F.lit("near")), kind)))
    d = d.withColumns({"term": F.coalesce("_id", "_n.id", "_b.id"), "how": how}).drop("_id", "_n", "_b")
    if standing is not None:
        d = d.join(standing.select(F.col("id").alias("term"), "standing"), "term", "left").withColumn("term", F.coalesce("standing", "term")).drop("standing")
    return d


def near_names(items: DataFrame, names: DataFrame, least: float = 0.8) -> DataFrame:
    """(norm, category, ord, id, sim): names and aliases that are likely meant by an item's name or brand, for ``resolve``."""
    said = items.select(F.explode(F.array("name", "brand")).alias("said")).where("coalesce(said, '') <> ''").select(X.normalize(F.col("said")).alias("norm")).distinct()
    joined = F.replace("norm", F.lit(" "), F.lit(""))
    heard = said.select(F.col("norm").alias("span"), joined.alias("s"), F.size(X.words(F.col("norm"))).alias("n_toks"))
    known = names.where("kind <> 2").select("norm").distinct().select(F.col("norm").alias("form"), joined.alias("joined"), F.size(X.words(F.col("norm"))).alias("n_toks"), F.lit(True).alias("is_name"))
    pairs = matching.fuzzy_pairs(heard, known).where(0.95 * F.col("sim") >= least)
    return pairs.join(names.where("kind <> 2"), F.col("form") == F.col("norm")).select(F.col("h_span").alias("norm"), "category", "ord", "id", "sim").distinct()


def sub_type_unstated(items: DataFrame, names: DataFrame, plain: str) -> DataFrame:
    """Resolved items (…, section, name, term, how) in which a diagnosis that is only named ``plain`` has lost its term, unless
    the term itself is so named: a type that nobody stated is no finding. ``unstated`` says where."""
    same = names.where((F.col("kind") == 1) & (F.col("norm") == plain)).select(F.col("id").alias("_same")).distinct()
    d = items.join(same, F.col("term") == F.col("_same"), "left")
    lost = (F.col("section") == "diagnosis") & (X.normalize(F.coalesce("name", F.lit(""))) == plain) & F.col("term").isNotNull() & F.col("_same").isNull()
    return d.withColumn("unstated", lost).withColumns({"term": F.when(~lost, F.col("term")), "how": F.when(~lost, F.col("how"))}).drop("_same")
