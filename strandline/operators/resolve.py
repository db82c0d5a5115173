"""Entities by tiers: exact, alias, unique prefix, unique part (KG-11..13, RET-02, RET-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import strip
from strandline.operators.context import plain_key
from strandline.session import lookup_pairs, small


def _on_run(rows: DataFrame, others: DataFrame, row_id: str) -> DataFrame:
    """Rows and others with the same run of letters: by broadcast where the others are few, else by a shuffle that spreads frequent runs."""
    return rows.join(F.broadcast(others), "run") if small(others) else lookup_pairs(rows, others, "run", F.xxhash64(row_id))


def resolve(queries: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, accents: bool = True) -> DataFrame:
    """(query, entity, tier, matches) of each distinct query.

    Tiers: 1 exact, 2 an alias of an entity, 3 the entity begins with the query and a space, 4 either contains the
    other. The lowest tier with a match counts; entity is null where that tier has several (ambiguous) or none has any.
    Case and outer spaces do not matter, nor do accents, if `accents` is False (KG-13). queries: query; entities: name; aliases: name, alias.
    """
    low = lambda c: F.lower(strip(F.col(c))) if accents else plain_key(F.col(c))
    q = queries.select("query").distinct().withColumn("q", low("query")).where("q != ''")
    e = entities.select("name").distinct().withColumn("e", low("name"))
    exact = e.join(q, e["e"] == q["q"]).select("query", "name", F.lit(1).alias("tier"))
    # What contains a text holds its first three letters somewhere: an equi-join on letter runs finds all candidates.
    runs = lambda c: F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>")))))
    e, e2 = e.where("e != ''"), e.where("e != ''")
    inner = _on_run(e.withColumn("run", F.explode(runs(F.col("e")))), q.withColumn("run", F.substring("q", 1, 3)), "name").where(F.contains("e", F.col("q")))
    outer = _on_run(q.withColumn("run", F.explode(runs(F.col("q")))), e2.withColumn("run", F.substring("e", 1, 3)), "query").where(F.contains("q", F.col("e")))
    part = inner.select("query", "name", "q", "e").unionByName(outer.select("query", "name", "q", "e")).distinct()
    loose = part.select("query", "name", F.when(F.startswith("e", F.concat("q", F.lit(" "))), 3).otherwise(4).alias("tier"))
    found = exact.unionByName(loose)
    if aliases is not None:
        a = aliases.select("name", low("alias").alias("a"))
        found = found.unionByName(a.join(q, a["a"] == q["q"]).select("query", "name", F.lit(2).alias("tier")))
    lowest = found.groupBy("query", "tier").agg(F.min("name").alias("name"), F.countDistinct("name").alias("matches")).groupBy("query").agg(F.min_by(F.struct("name", "matches"), "tier").alias("r"), F.min("tier").alias("tier"))
    out = queries.select("query").distinct().join(lowest, "query", "left")
    # Several entities that differ in case only are the same exact match, as the smallest.
    one = (F.col("r.matches") == 1) | (F.col("tier") == 1)
    return out.select("query", F.when(one, F.col("r.name")).alias("entity"), "tier", F.coalesce("r.matches", F.lit(0)).alias("matches"))


def first_profile(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """RET-02: (query, name): the profile that a query names by an alias, or else the first (by `ord`) of those of which one holds the
    other; null where there is none. profiles: name, ord, aliases (with the name)."""
    q = queries.select("query").distinct().withColumn("q", F.lower(strip(F.col("query")))).where("q != ''")
    a = profiles.select("name", "ord", F.explode("aliases").alias("alias")).withColumn("a", F.lower(strip(F.col("alias"))))
    exact = a.join(q, a["a"] == q["q"]).select("query", "name", "ord", F.lit(1).alias("tier"))
    loose = resolve_parts(q, a.select("name", "ord", "a")).withColumn("tier", F.lit(2))
    best = exact.unionByName(loose).groupBy("query").agg(F.min_by("name", F.struct("tier", "ord")).alias("name"))
    return queries.select("query").distinct().join(best, "query", "left")


def resolve_parts(q: DataFrame, a: DataFrame) -> DataFrame:
    """(query, name, ord) where one text of three letters or more holds the other, by an equi-join on its first three."""
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, 3)))
    inner = a.withColumn("run", F.explode(runs(F.col("a")))).join(q.withColumn("start", F.substring("q", 1, 3)), F.col("run") == F.col("start")).where(F.contains("a", F.col("q")))
    outer = a.withColumn("start", F.substring("a", 1, 3)).join(q.withColumn("run", F.explode(runs(F.col("q")))), F.col("run") == F.col("start")).where(F.contains("q", F.col("a")) & (F.col("a") != ""))
    return inner.select("query", "name", "ord").unionByName(outer.select("query", "name", "ord")).distinct()
