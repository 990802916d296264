"""Ranks and running totals over a whole table, without one task sorting it all.

A window with no partition sends every row to one task. Here the order of the keys is cut at
the keys of `CUTS` rows, those whose hash is least: a uniform sample, yet the same rows in
every run, so all parts of a plan agree on it. Each of these keys is a block of its own and
so are the keys between two of them, 2 * CUTS + 1 blocks at most, of about a `CUTS`-th of the
rows or a single key. What lies above a row is the sum over the blocks above, from a table of
one row for each block, and over larger keys in its own block, from a window.

A key that many rows share is among the cuts (a key of a hundredth of all rows is missed once
in 30,000 plans). In its block no row lies above another, so its rows need not meet and stay
spread by their hash; a hot tie is never one task. Nothing runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 1024


def _count_below(sorted_array: Column, value: Column, size: int) -> Column:
    """How many of at most `size` ascending values are below `value`, by binary search."""
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda n, step: F.when(F.get(sorted_array, n + step - 1) < value, n + step).otherwise(n),
    )


def _blocks(cuts: Column, key: Column) -> Column:
    """Even for the keys between two cuts, odd for a cut itself."""
    below = _count_below(cuts, key, CUTS)
    return 2 * below + F.coalesce(F.get(cuts, below) == key, F.lit(False)).cast("int")


def _with_blocks(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Add the block of each key; `keys` maps a key's column to its block's column."""
    sample = df.orderBy(F.xxhash64(*df.columns), *df.columns).limit(CUTS)
    cuts = sample.agg(F.struct(*[F.array_sort(F.collect_set(k)).alias(k) for k in keys])).scalar()
    known = df.withColumn("_cuts", cuts)
    blocks = {block: _blocks(F.col("_cuts")[k], F.col(k)) for k, block in keys.items()}
    return known.withColumns(blocks).drop("_cuts")


def _sums_above(blocked: DataFrame, columns: list[str], blocks: list[str], weights: dict) -> Column:
    """For each block column, its blocks in order and for each of them the sums of the weights
    above and in total.

    The hash of all columns is there so that this part of a plan reads the same columns as
    the others and shares their shuffles."""
    rows = blocked.select(
        F.posexplode(F.array(*blocks)).alias("_which", "_block"),
        *[w.alias(f"_{n}") for n, w in weights.items()],
        F.xxhash64(*columns).alias("_all"),
    ).where(F.col("_block").isNotNull())
    sums = rows.groupBy("_which", "_block").agg(
        F.max("_all").alias("_all"), *[F.sum(f"_{n}").alias(f"_{n}") for n in weights]
    )
    everything = Window.partitionBy("_which")
    before = everything.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct(
        "_block",
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"above_{n}") for n in weights],
        *[F.sum(f"_{n}").over(everything).alias(f"total_{n}") for n in weights],
        "_all",
    )
    # one row for each block, in one task
    listed = sums.coalesce(1).select("_which", entry.alias("_entry"))
    of_each = [
        F.array_sort(F.collect_list(F.when(F.col("_which") == i, F.col("_entry"))))
        for i in range(len(blocks))
    ]
    found = listed.agg(F.array(*of_each).alias("_entries"))
    numbers = F.transform("_entries", lambda entries: entries["_block"])
    return found.select(F.struct(numbers.alias("blocks"), F.col("_entries").alias("sums"))).scalar()


def _above(
    df: DataFrame, keys: list[str], weights: dict[str, Column]
) -> tuple[DataFrame, list[dict[str, Column]]]:
    """`df` with helper columns, and for each key the sums of the weights over larger keys
    (`above_w`) and over all rows that have the key (`total_w`)."""
    blocks = {k: f"_block_{i}" for i, k in enumerate(keys)}
    blocked = _with_blocks(df, blocks)
    offsets = _sums_above(blocked, df.columns, list(blocks.values()), weights)
    salts, larger_sums, entries, results = {}, {}, {}, []
    for i, (key, block) in enumerate(blocks.items()):
        # rows of one key, or of none, need not meet
        alone = (F.col(block) % 2 == 1) | F.col(block).isNull()
        salts[f"_salt_{i}"] = F.when(alone, F.xxhash64(*df.columns))
        inside = Window.partitionBy(block, f"_salt_{i}").orderBy(F.desc(key))
        larger = inside.rangeBetween(Window.unboundedPreceding, -1)
        for n, w in weights.items():
            larger_sums[f"_inside_{i}_{n}"] = F.coalesce(F.sum(w).over(larger), F.lit(0))
        place = _count_below(F.col("_offsets.blocks")[i], F.col(block), 2 * CUTS + 1)
        entries[f"_entry_{i}"] = F.get(F.col("_offsets.sums")[i], place)
        entry = F.col(f"_entry_{i}")
        results.append(
            {
                **{f"above_{n}": entry[f"above_{n}"] + F.col(f"_inside_{i}_{n}") for n in weights},
                **{f"total_{n}": entry[f"total_{n}"] for n in weights},
            }
        )
    # the table of blocks comes last: no shuffle moves it
    summed = blocked.withColumns(salts).withColumns(larger_sums)
    found = summed.withColumn("_offsets", offsets).withColumns(entries)
    return found, results


def running_totals(distinct: DataFrame, key: str, weights: list[str]) -> DataFrame:
    """Totals from the largest key down, over rows with one row per key.

    Adds, for each weight w: `above_w`, the sum over all larger keys, and `total_w`, the sum
    over everything."""
    found, (sums,) = _above(distinct, [key], {w: F.col(w) for w in weights})
    return found.select(*distinct.columns, *[c.alias(n) for n, c in sums.items()])


def add_ranks(df: DataFrame, values: dict[str, Column], total: str) -> DataFrame:
    """Add RANK() OVER (ORDER BY value DESC), ties included, for 64-bit integer values.

    `values` maps each new column to what it ranks, `total` names the column that gets the
    number of ranked rows. A missing value has no rank; a row without any value drops out."""
    keys = [f"_key_{i}" for i in range(len(values))]
    keyed = df.withColumns(dict(zip(keys, values.values()))).where(
        F.coalesce(*keys).isNotNull()
    )
    found, sums = _above(keyed, keys, {"n": F.lit(1)})
    ranked = [F.when(F.col(k).isNotNull(), s["above_n"] + 1) for k, s in zip(keys, sums)]
    totals = [F.when(F.col(k).isNotNull(), s["total_n"]) for k, s in zip(keys, sums)]
    return found.select(
        *df.columns,
        F.greatest(*totals, F.lit(None).cast("bigint")).alias(total),
        *[r.cast("bigint").alias(name) for name, r in zip(values, ranked)],
    )
