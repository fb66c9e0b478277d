"""Keyed merges of snapshots: what is new, what is kept, what goes. Each returns the whole new snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(old: DataFrame, new: DataFrame, key: str, content: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """M2: rows of ``new``; ``kept`` columns come from the old row of the key, if there is one; other keys go."""
    before = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in kept], F.lit(True).alias("_was"))
    return new.select(key, *content).join(before, key, "left").select(key, *content, *[F.col(f"_old_{c}").alias(c) for c in kept], F.when(F.col("_was"), "updated").otherwise("inserted").alias("action"))


def removed(old: DataFrame, new: DataFrame, key: str, dependants: DataFrame, ref: str) -> DataFrame:
    """Keys that the new set lacks, with how many dependants each has."""
    gone = old.select(key).distinct().join(new.select(key), key, "left_anti")
    per = dependants.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias("_n"))
    return gone.join(per, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("n_dependants"))


def last_success(attempts: DataFrame, key: str, order: Sequence[str], passed: Column, fields: Sequence[str]) -> DataFrame:
    """M4: per key the last attempt that passed, else the last: a failure never replaces a success."""
    best = F.max(F.struct(passed.alias("_p"), *order, *[F.col(f) for f in fields if f not in order]))
    return attempts.groupBy(key).agg(best.alias("b")).select(key, F.col("b._p").alias("passed"), *[F.col(f"b.{f}").alias(f) for f in fields])


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, one of each (the first by all columns), after the old ones."""
    one = new.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*new.columns))).where("_k = 1").drop("_k")
    return old.unionByName(one.join(old.select(key), key, "left_anti"))


def conditional(old: DataFrame, new: DataFrame, key: str, same: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """M7: take new values only where the guarding columns are the same, nulls included."""
    other = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in (*same, *fields)], F.lit(True).alias("_there"))
    joined = old.join(other, key, "left")
    ok = F.coalesce(F.col("_there"), F.lit(False))
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    return joined.select(key, *same, *[F.when(ok, F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) for f in fields], ok.alias("applied"))


def exclusive(solutions: DataFrame, failures: DataFrame, key: str, order: str) -> DataFrame:
    """M8: a key has a solution or a failure, whichever came last; a solution at a tie."""
    both = solutions.select(key, order, F.lit(1).alias("_s")).unionByName(failures.select(key, order, F.lit(0).alias("_s")))
    return both.groupBy(key).agg(F.max(F.struct(order, "_s")).alias("m")).select(key, F.when(F.col("m._s") == 1, "solution").otherwise("failure").alias("kind"), F.col(f"m.{order}").alias(order))


def resolved(rows: DataFrame, vocabulary: DataFrame, key: str, order: str, alias: str, why: str, most: int = 3) -> DataFrame:
    """Codes that the vocabulary knows, with a reason, once each, at most ``most`` by order; why is cut to 80."""
    known = rows.where(F.trim(why) != "").join(vocabulary, alias).select(key, order, "code", F.left(F.trim(F.col(why)), F.lit(80)).alias(why))
    once = known.withColumn("_k", F.row_number().over(Window.partitionBy(key, "code").orderBy(order))).where("_k = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order, "code"))).where(F.col("rank") <= most).drop("_k")


def any_sibling(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """If one of a group has the mark, all have been judged."""
    return rows.withColumn("judged", F.bool_or(flag).over(Window.partitionBy(by)))


def owned_delete(rows: DataFrame, wanted: DataFrame, key: str, owner: Column) -> DataFrame:
    """What a delete by this owner does to each wanted key: deleted, refused or missing."""
    own = rows.select(key, owner.alias("_own"))
    return wanted.select(key).distinct().join(own, key, "left").select(key, F.when(F.col("_own").isNull(), "missing").when(F.col("_own"), "deleted").otherwise("refused").alias("result"))


def merged_tables(tables: DataFrame, root: str, order: str, width: str, cells: str) -> DataFrame:
    """Continuations join their root if none is empty and all rows are as wide; else they stay apart."""
    per = tables.groupBy(root).agg(F.count("*").alias("n_parts"), F.min(width).alias("narrow"), F.max(width).alias("wide"), F.min(cells).alias("least"), F.sum(cells).alias("cells"))
    return per.select(root, "n_parts", ((F.col("narrow") == F.col("wide")) & (F.col("least") > 0)).alias("merged"), "cells")


def united_tables(tables: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(key, id, caption, rows, images, n_parts): tables with the rows of their continuations, and the images of all parts.

    ``tables`` has (id, cont_of, ord, caption, image, rows array<array<string>>); ``cont_of`` names a table that itself continues none. A continuation joins it if both have rows
    and all of them are as wide; else it stays a table of its own. Parts come in order of ``ord``.
    """
    keys = [key] if isinstance(key, str) else [*key]
    cells = F.coalesce("rows", F.array().cast("array<array<string>>"))
    # a table and what names it come together once: none is looked up, none is dealt out again
    one = F.struct((F.col("id") != F.col("_root")).alias("later"), "ord", F.col("id").alias("part"), "image", cells.alias("rows"), "caption")
    near = tables.withColumn("_root", F.coalesce("cont_of", "id")).groupBy(*keys, "_root").agg(F.array_sort(F.collect_list(one)).alias("_p"), F.max(F.when(F.col("id") == F.col("_root"), cells)).alias("_head"))
    wide = lambda rows: F.array_distinct(F.transform(rows, lambda r: F.size(r)))
    fits = lambda x: ~x["later"] | ((F.size("_head") > 0) & (F.size(x["rows"]) > 0) & (F.size(wide(F.concat("_head", x["rows"]))) == 1))
    marked = F.transform("_p", lambda x: F.struct(x.alias("p"), F.coalesce(fits(x), F.lit(False)).alias("fits")))
    told = near.select(*keys, F.transform(F.filter(marked, lambda x: x["fits"]), lambda x: x["p"]).alias("_its"), F.transform(F.filter(marked, lambda x: ~x["fits"]), lambda x: F.array(x["p"])).alias("_apart"))
    both = told.select(*keys, F.explode(F.filter(F.concat(F.array("_its"), "_apart"), lambda g: F.size(g) > 0)).alias("_p"))
    first = F.element_at("_p", 1)
    images = F.filter(F.transform("_p", lambda p: p["image"]), lambda i: F.coalesce(i, F.lit("")) != "")
    return both.select(*keys, first["part"].alias("id"), first["caption"].alias("caption"), F.flatten(F.transform("_p", lambda p: p["rows"])).alias("rows"), images.alias("images"), F.size("_p").alias("n_parts"))


def reset_on_change(old: DataFrame, new: DataFrame, key: str, content: Sequence[str], status: str, first: str = "draft") -> DataFrame:
    """New content; its status is the old one's only if no part of the content has changed."""
    before = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in content], F.col(status).alias("_status"))
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return new.select(key, *content).join(before, key, "left").select(key, *content, F.when(same & F.col("_status").isNotNull(), F.col("_status")).otherwise(first).alias(status))


def partial_update(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """What the update gives replaces what is there, field by field; the rest stays."""
    other = new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    return old.join(other, key, "left").select(key, *[F.coalesce(f"_n_{f}", f).alias(f) for f in fields], F.greatest(*[F.col(f"_n_{f}").isNotNull() for f in fields], F.lit(False)).alias("touched"))


def claim_orphans(rows: DataFrame, owner: str, taker: Column) -> DataFrame:
    """Rows that nobody owns get an owner."""
    return rows.withColumn(owner, F.coalesce(owner, taker))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """A parent that the update names has the new children alone, be there none of them; others keep theirs.

    ``new`` has a row with null fields for a parent that is to have none.
    """
    kept = old.join(new.select(parent).distinct(), parent, "left_anti")
    filled = F.greatest(*[F.col(c).isNotNull() for c in new.columns if c != parent], F.lit(False))
    return kept.unionByName(new.where(filled))


def stamp(rows: DataFrame, keys: DataFrame, key: str, column: str, as_of: Column) -> DataFrame:
    """The rows of some keys get a time."""
    marked = keys.select(key).distinct().withColumn("_m", F.lit(True))
    return rows.join(marked, key, "left").withColumn(column, F.when(F.col("_m"), as_of).otherwise(F.col(column))).drop("_m")


def upsert(old: DataFrame, new: DataFrame, key: str, content: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """M1: all keys of both; ``content`` is the new row's where there is one, ``kept`` the old row's unless it is null."""
    a = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in (*content, *kept)])
    b = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in (*content, *kept)], F.lit(True).alias("_given"))
    fresh = [F.when(F.col("_given"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in content]
    return a.join(b, key, "full").select(key, *fresh, *[F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in kept])


def put_failures(solutions: DataFrame, failures: DataFrame, new: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """M9: new failures, reasons cut to 240, replace the old failure and the solution of their keys: (solutions, failures)."""
    given = new.withColumn(reason, F.left(reason, F.lit(240)))
    keys = new.select(key)
    return solutions.join(keys, key, "left_anti"), failures.join(keys, key, "left_anti").unionByName(given)


def clear_failures(failures: DataFrame, cleared: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """The failures that stay, and the parents of those that went, whose time of change moves on."""
    keys = cleared.select(key)
    return failures.join(keys, key, "left_anti"), failures.join(keys, key, "left_semi").select(parent).distinct()


def update_or_report(old: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, action): the field of known keys is ``updated``; keys that are not there are ``missing``."""
    known = old.select(key).distinct().withColumn("_known", F.lit(True))
    there = F.coalesce(F.col("_known"), F.lit(False))
    return new.select(key, field).join(known, key, "left").select(key, F.when(there, F.col(field)).alias(field), F.when(there, "updated").otherwise("missing").alias("action"))


def approve(rows: DataFrame, said: DataFrame, key: str, ok: str, status: str) -> DataFrame:
    """What a person said sets the status, approved or rejected; the others keep theirs."""
    both = rows.join(said.select(key, F.col(ok).alias("_ok")), key, "left")
    return both.withColumn(status, F.when(F.col("_ok"), "approved").when(~F.col("_ok"), "rejected").otherwise(F.col(status))).drop("_ok")


def merge_warnings(tables: DataFrame, by: str, table: str, parent: str, widths: str) -> DataFrame:
    """(by, table, parent, why) of continuations that cannot be joined to their table: ``empty`` if either has no rows,
    ``width`` if their rows are not all as wide. ``widths`` is an array with one width per row."""
    above = tables.select(by, F.col(table).alias(parent), F.col(widths).alias("_above"))
    both = tables.join(above, [by, parent]).select(by, table, parent, F.coalesce(widths, F.array().cast("array<int>")).alias("_own"), F.coalesce("_above", F.array().cast("array<int>")).alias("_above"))
    why = F.when((F.size("_own") == 0) | (F.size("_above") == 0), "empty").when(F.size(F.array_union("_own", "_above")) > 1, "width")
    return both.select(by, table, parent, why.alias("why")).where("why IS NOT NULL")
