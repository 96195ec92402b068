"""Row visibility by scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

PUBLIC = "public:"


def reader_scopes(readers: DataFrame, user: str, granted: str | None = None) -> DataFrame:
    """(reader, scopes): the public scope, a named reader's own and the granted ones; empty names dropped."""
    name = F.col(user).cast("string")
    own = F.array(F.lit(PUBLIC), F.when(name != "", F.concat(F.lit("user:"), name)))
    every = F.array_union(own, F.coalesce(F.col(granted), F.array().cast("array<string>"))) if granted else own
    kept = F.array_distinct(F.filter(every, lambda s: s.isNotNull() & (F.length(s) > 0)))
    return readers.select(F.col(user).alias("reader"), kept.alias("scopes"))


def in_reach(scopes: Sequence[str], column: str = "scope_id") -> Column:
    """Whether a row's scope is among the reader's; no scopes means no rows."""
    named = [s for s in scopes if s]
    return F.col(column).isin(*named) if named else F.lit(False)


def visible(df: DataFrame, scopes: Sequence[str], column: str = "scope_id") -> DataFrame:
    """Rows one reader may see; apply to every table before any join so embeds and counts agree."""
    return df.where(in_reach(scopes, column))


def scoped_lookup(lookup, scopes: Sequence[str], column: str = "scope_id"):
    """A table lookup that shows one reader's rows of every scoped table."""

    def see(name: str) -> DataFrame:
        df = lookup(name)
        return visible(df, scopes, column) if column in df.columns else df

    return see


def check_write(df: DataFrame, scopes: Sequence[str], column: str = "scope_id") -> DataFrame:
    """Mark each written row `accepted` by the same predicate that reads use; a null scope is refused."""
    return df.withColumn("accepted", F.coalesce(in_reach(scopes, column), F.lit(False)))


def public_rows(df: DataFrame, column: str = "scope_id") -> DataFrame:
    """The rows everyone may see."""
    return visible(df, [PUBLIC], column)


def keyed_reach(df: DataFrame, link: str, parents: DataFrame, parent_key: str, subject: Column) -> DataFrame:
    """Rows whose key column names the subject, or whose parent row is visible."""
    seen = parents.select(F.col(parent_key).alias("__parent")).distinct().withColumn("__seen", F.lit(True))
    return (
        df.join(seen, F.col(link) == F.col("__parent"), "left")
        .where(F.coalesce(F.col("__seen"), F.lit(False)) | F.coalesce(subject, F.lit(False)))
        .drop("__parent", "__seen")
    )


def granted(rows: DataFrame, key: str, owner: Column, user: int, user_grants: DataFrame, group_grants: DataFrame, members: DataFrame, folder: Column | None = None) -> DataFrame:
    """Rows one user sees, with `ways`: as owner, by an own grant, by a group's grant, or through the folder.

    `user_grants` is (user, key), `group_grants` (grp, key), `members` (user, grp). Grants also name
    folders; the user's own keys are found first, so no grant of another user is joined with a row.
    """
    mine = user_grants.where(F.col("user") == user).select("key", F.lit("user").alias("way"))
    groups = members.where(F.col("user") == user).select("grp").distinct()
    shared = group_grants.join(groups, "grp").select("key", F.lit("group").alias("way"))
    reach = mine.unionByName(shared).distinct()
    own = rows.where(owner).select(key, F.lit("owner").alias("way"))
    direct = rows.join(reach, rows[key] == reach["key"]).select(rows[key], "way")
    ways = own.unionByName(direct)
    if folder is not None:
        inside = rows.withColumn("__folder", folder).join(reach, F.col("__folder") == reach["key"])
        ways = ways.unionByName(inside.select(rows[key], F.lit("folder").alias("way")))
    counted = ways.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("ways"))
    return rows.join(counted, key)
