"""Work histories: from wide rows to timelines, sub-paths and carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.ranking import nearest
from wayfarer.sources.shared import settled


def unpivot(wide: DataFrame, keys: list[str], fields: list[str], slots: int, count: str) -> DataFrame:
    """One row for each filled slot: keys, experience_number and the fields.

    Columns are named ``field_0``, ``field_1`` and so on; the first ``count`` slots
    of a row are filled. It explodes an array, so nothing is shuffled.
    """
    slot = [F.struct(*[(F.col(f"{f}_{i}") if f"{f}_{i}" in wide.columns else F.lit(None)).alias(f) for f in fields]) for i in range(slots)]
    filled = F.slice(F.array(*slot), 1, F.greatest(F.col(count).cast("int"), F.lit(0)))
    return wide.select(*keys, F.posexplode(filled).alias("experience_number", "e")).select(*keys, "experience_number", "e.*")


def numbered(df: DataFrame, person: str, *order: str) -> DataFrame:
    """Rows of a person numbered from 0 in order."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(person).orderBy(*order)) - 1)


def without_people(df: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """Drops everyone who has any bad row."""
    return df.join(df.where(bad).select(*keys).distinct(), keys, "left_anti")


def sub_paths(df: DataFrame, person: str, number: str, value: Column, keep: int | None = 16) -> DataFrame:
    """(person, length, start, prefix, target) of sub-paths of two steps and more.

    Sub-paths are generated by length and then start; the last ``keep`` of them stay.
    Of n steps there are n - length + 1 of a length, so the longest g lengths have
    g * (g + 1) / 2: only lengths that hold some of the last ``keep`` are ever made.
    """
    steps = df.groupBy(person).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), value.alias("v")))), lambda s: s["v"]).alias("steps")).withColumn("n", F.size("steps"))
    low, whole = F.lit(2), 0
    if keep is not None:
        while (whole + 1) * (whole + 2) // 2 <= keep:
            whole += 1  # the longest so many lengths stay whole
        low = F.greatest(low, F.col("n") - whole)
    paths = steps.where("n >= 2").select(person, "steps", "n", F.explode(F.sequence(low, F.col("n"))).alias("length"))
    paths = paths.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))))
    if keep is not None:  # of the next length there are whole + 1, and the last ones stay
        paths = paths.where((F.col("length") > F.col("n") - whole) | (F.col("start") > whole - (keep - whole * (whole + 1) // 2)))
    return paths.select(person, "length", "start", F.slice("steps", F.col("start") + 1, F.col("length") - 1).alias("prefix"), F.element_at("steps", F.col("start") + F.col("length")).alias("target"))


def carried_back(df: DataFrame, person: str, number: str, group: str, own: Column) -> DataFrame:
    """``carried``: from the last row back, a row takes the next one's value while both
    have the same non-null group, nulls included; any other row has its own value."""
    order = Window.partitionBy(person).orderBy(number)
    follows = F.coalesce(F.lead(group).over(order) == F.col(group), F.lit(False))
    back = Window.partitionBy(person).orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A null value is still an anchor: it is wrapped in a struct.
    anchors = df.withColumn("_anchor", F.when(~follows, F.struct(own.alias("v"))))
    return anchors.withColumn("carried", F.last("_anchor", ignorenulls=True).over(back)["v"]).drop("_anchor")


def industries(df: DataFrame, person: str, number: str, code: str, own: str, blank: str, bank: DataFrame, bank_rows: int) -> DataFrame:
    """``industry``: the last row's own; of rows with the next one's code the next one's,
    nulls included; of all others the bank row nearest to their ``vec``, or null where
    they are ``blank``."""
    order = Window.partitionBy(person).orderBy(number)
    rows = df.withColumn("_last", F.lead(number).over(order).isNull()).withColumn("_query", F.xxhash64(person, number))
    asked = rows.where(~F.col("_last") & ~F.col(blank)).select(F.col("_query").alias("query"), "vec")
    near = nearest(asked, bank, 1, bank_rows).select(F.col("query").alias("_query"), F.concat(F.lit("bank "), F.col("id")).alias("_near"))
    both = rows.join(near, "_query", "left")
    mine = F.when(F.col("_last"), F.col(own)).otherwise(F.col("_near"))
    return carried_back(both, person, number, code, mine).withColumnRenamed("carried", "industry").drop("_last", "_query", "_near")


def texts_so_far(df: DataFrame, person: str, number: str, block: Column, most: int = 12_000) -> DataFrame:
    """``so_far``: the blocks up to each row, the latest first, without empty ones, cut at ``most`` characters.

    A row looks back only as far as its text can reach: running lengths tell which
    blocks begin within ``most`` characters, so a long history costs no more than
    these for each row.
    """
    order = Window.partitionBy(person).orderBy(number)
    cut = F.substring(block, 1, most)
    sized = df.withColumn("_b", cut).withColumn("_end", F.sum(F.when(F.length("_b") > 0, F.length("_b") + 2).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = Window.partitionBy(person).orderBy("_end").rangeBetween(-most, Window.currentRow)
    held = F.filter(F.array_sort(F.collect_list(F.when(F.length("_b") > 0, F.struct(F.col(number).alias("k"), F.col("_b").alias("b")))).over(near)), lambda x: x["k"] <= F.col(number))
    return sized.withColumn("so_far", F.substring(F.array_join(F.transform(F.reverse(held), lambda x: x["b"]), "\n\n"), 1, most)).drop("_b", "_end")


def recency_rank(prefix: Column, target: Column) -> Column:
    """Place of the target among the prefix's distinct values, the latest first."""
    return F.nullif(F.array_position(F.array_distinct(F.reverse(prefix)), target), F.lit(0))


def date_extremes(df: DataFrame, groups: list[str], text: str, index: Column) -> DataFrame:
    """First and last date as written, by group and (null group) over all."""
    known = df.withColumn("_i", index).where("_i is not null")
    return known.rollup(*groups).agg(F.min_by(text, F.struct("_i", text)).alias("first_date"), F.max_by(text, F.struct("_i", text)).alias("last_date"))


def vocabulary(df: DataFrame, value: str, unknown: str | None = None) -> DataFrame:
    """(value, id): distinct values in code point order, numbered from 0.

    Ids come from counts of the values' hash-free ranges: values are range-partitioned
    and sorted, each partition's rows are numbered behind those of the ones before,
    and only the partitions' sizes are added up over all.
    """
    every = df.select(F.col(value).alias("value")).where("value is not null")
    if unknown is not None:
        every = every.union(df.sparkSession.createDataFrame([(unknown,)], "value string"))
    order = settled(every.distinct().repartitionByRange("value").select("value", F.spark_partition_id().alias("p")), "vocabulary")
    within = order.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("value")))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = order.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return within.join(base, "p").select("value", (F.col("base") + F.col("k") - 1).alias("id"))


def last_messages(df: DataFrame, chat: str, order: str, n: int, roles: list[str]) -> DataFrame:
    """The last n messages of each chat, of which only these roles then stay."""
    rank = F.row_number().over(Window.partitionBy(chat).orderBy(F.desc(order)))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r").where(F.col("role").isin(roles))


def conversation(df: DataFrame, new: DataFrame, chat: str, order: str, n: int, roles: list[str]) -> DataFrame:
    """(chat, messages) for each new turn: the chat's last n messages of these roles, and then the turn itself."""
    past = last_messages(df, chat, order, n, roles).groupBy(chat).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("past"))
    turn = F.struct(F.lit("user").alias("role"), F.col("text").alias("text"))
    earlier = F.transform(F.coalesce("past", F.array().cast(dict(past.dtypes)["past"])), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return new.join(past, chat, "left").select(chat, F.concat(earlier, F.array(turn)).alias("messages"))


def first_rows(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("row", rank).where(F.col("row") <= n)


def chronological(entries: Column, index, undated: int = 2**30) -> Column:
    """Entries by date, those without one after the others in their first order."""
    keyed = F.transform(entries, lambda e, i: F.struct(F.coalesce(index(e), F.lit(undated)).alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda s: s["e"])
