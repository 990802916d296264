"""Mixing sources to target weights.

Every document gets a random key, a hash of its doc_id and a seed. Slim rows of (source,
key, size) are range-sorted, so a large source spreads over many partitions; running sums
inside the partitions plus the totals of the partitions before give each document's place
in its source. Where a source's budget ends, the sums name the document that is cut: what
comes before it in key order is taken once more than what comes after, and of the cut
document only as many words as the budget still holds. A source asked for more than it
has is taken whole as often as its budget holds it, and then cut.

So the plan of a mix is one row for each source, and applying it moves no text. It is a
function of the data and the seed; partitioning, reruns and lost executors do not change it.

Sources are told apart as they are; null is a source of its own, last in order. A null text
has size 0 and is never taken. A null doc_id hashes as an empty one. Rows that agree in
doc_id and size share a place; if the cut falls on them, they share what is left evenly,
less than a word each being lost. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import fresh_name, written
from .text import chunks


@dataclass(frozen=True)
class Mix:
    """What is asked for. Sources in code point order get the weights in turn."""

    weights: Sequence[float] = (3, 1, 2)
    share: float = 1.5  # of all sizes, the size of the mix
    max_epochs: float = 2.0
    seed: int = 20_24


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 if null."""

    def count(texts: pa.Array) -> pa.Array:
        counts = [chunk.words().counts for chunk in chunks(texts)]
        return pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *counts]), pa.int64())

    return F.arrow_udf(count, "long")(text)


def random_key(doc_id: Column, seed: int) -> Column:
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.substring(F.md5(name.cast("binary")), 1, 16)


def prefix_sums(df: DataFrame, group: str, order: list[str], weights: list[str]) -> DataFrame:
    """`df`, stored, with before_<weight>: the sum over the rows of the same group that
    come earlier in `order` (nulls last in the groups).

    Rows are range-partitioned on group and order. The offsets between partitions take one
    row for each partition and group that meet."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField("_part", T.IntegerType())]
        + [T.StructField(f"before_{w}", df.schema[w].dataType) for w in weights]
    )

    def local(batches):
        part, last, carried = TaskContext.get().partitionId(), None, [0] * len(weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(group).dictionary_encode(null_encoding="encode")
            codes = groups.indices.to_numpy()
            names = groups.dictionary
            first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            run = np.cumsum(np.isin(np.arange(len(codes)), first)) - 1
            same = last is not None and names[int(codes[0])].as_py() == last[0]
            columns = []
            for i, weight in enumerate(weights):
                values = batch.column(weight).to_numpy()
                sums = np.cumsum(values) - values
                sums = sums - sums[first][run]
                if same:
                    sums = sums + np.where(run == 0, carried[i], 0)
                carried[i] = sums[-1] + values[-1]
                columns.append(pa.array(sums, batch.column(weight).type))
            last = (names[int(codes[-1])].as_py(),)
            parts = pa.array(np.full(batch.num_rows, part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, parts, *columns],
                names=[*batch.schema.names, "_part", *(f"before_{w}" for w in weights)],
            )

    keys = [F.col(group).asc_nulls_last(), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = written(ranged.mapInArrow(local, schema), "prefix-sums")
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g"))
        .agg(*(F.sum(w).alias(f"_{w}") for w in weights))
        .select("_p", "_g", *(F.sum(f"_{w}").over(before).alias(f"_{w}") for w in weights))
    )
    joined = stored.join(
        offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left"
    )
    return joined.select(
        *df.columns,
        *(
            (F.col(f"before_{w}") + F.coalesce(F.col(f"_{w}"), F.lit(0))).alias(f"before_{w}")
            for w in weights
        ),
    )


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources ordered by the level at which they stop, size over weight, stop one after the
    other while the level, what is left over the weights that are left, is above theirs."""
    ones = sizes.withColumns({"one": F.lit(1).cast("long"), "all": F.lit(0)})
    ranked = prefix_sums(
        ones.withColumns({"last": F.col("source").isNull(), "by": F.coalesce("source", F.lit(""))}),
        "all", ["last", "by"], ["one"],
    )
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    turn = (F.col("before_one") % len(mix.weights)).cast("int")
    weighted = (
        ranked.withColumn("weight", F.get(weights, turn))
        .withColumn("cap", mix.max_epochs * F.col("source_size"))
        .withColumn("stops", F.col("cap") / F.col("weight"))
    )
    levels = prefix_sums(weighted, "all", ["stops", "last", "by"], ["cap", "weight"])
    total, weight = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (mix.share * float(total or 0) - F.col("before_cap")) / (
        F.lit(weight or 1.0) - F.col("before_weight")
    )
    open_ = levels.withColumn("level", level).where(F.col("cap") >= F.col("weight") * F.col("level"))
    found = open_.agg(F.min_by("level", F.struct("stops", "last", "by"))).first()[0]
    target = F.least("cap", F.col("weight") * F.lit(found)) if found is not None else F.col("cap")
    return levels.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each source: source, source_size, target, budget (whole words), epochs
    (times everything is taken), and the place of the cut: cut_key, cut_id, cut_size, with
    cut_words to take there. Without a cut those are null."""
    slim = written(
        docs.select(
            "source",
            random_key(F.col("doc_id"), mix.seed).alias("key"),
            F.col("doc_id").cast("string").alias("id"),
            n_words(F.col("text")).alias("size"),
        ),
        "mix-sizes",
    )
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("budget", budget).withColumn("epochs", epochs.cast("long"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    goals = written(goals.withColumn("rest", rest), "mix-goals")

    places = prefix_sums(slim, "source", ["key", "id", "size"], ["size"])
    same = places["source"].eqNullSafe(goals["source"])
    ends = F.col("before_size") + F.col("size")
    near = (
        places.join(goals, same)
        .where((F.col("size") > 0) & (F.col("rest") > 0))
        .groupBy(places["source"].alias("of"), "key", "id", "size", "rest")
        .agg(F.min("before_size").alias("from"), F.max(ends).alias("to"), F.count("*").alias("n"))
        .where((F.col("from") < F.col("rest")) & (F.col("rest") <= F.col("to")))
        .select(
            "of",
            F.col("key").alias("cut_key"),
            F.col("id").alias("cut_id"),
            F.col("size").alias("cut_size"),
            F.floor((F.col("rest") - F.col("from")) / F.col("n")).cast("long").alias("cut_words"),
        )
    )
    return (
        goals.join(near, goals["source"].eqNullSafe(near["of"]), "left").drop("of", "rest")
    )


PLAN_COLUMNS = (
    "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words"
)


def planned(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """`docs` with a struct `mix`: size, source_size, target, epochs (times taken whole),
    words (taken of one more copy, if it is cut) and taken (words in all)."""
    name, per_source = fresh_name(docs, "mix"), fresh_name(docs, "plan")
    plans = written(plan(docs, mix), "mix-plan").select(
        F.col("source").alias(fresh_name(docs, "of")), F.struct(*PLAN_COLUMNS).alias(per_source)
    )
    joined = docs.join(plans, docs["source"].eqNullSafe(plans[plans.columns[0]]), "left")
    sized = joined.drop(plans.columns[0]).withColumn(name, n_words(F.col("text")))
    p, size = F.col(per_source), F.col(name)
    id_ = F.col("doc_id").cast("string")
    here = F.struct(
        random_key(F.col("doc_id"), mix.seed).alias("k"), id_.alias("i"), size.alias("s")
    )
    cut = F.struct(
        p["cut_key"].alias("k"), p["cut_id"].alias("i"), p["cut_size"].alias("s")
    )
    before = p["cut_key"].isNotNull() & (here < cut)
    at = p["cut_key"].isNotNull() & (here == cut)
    epochs = p["epochs"] + F.when(before, 1).otherwise(0)
    words = F.when(at, p["cut_words"]).otherwise(F.lit(0).cast("long"))
    result = F.struct(
        size.alias("size"),
        p["source_size"].alias("source_size"),
        p["target"].alias("target"),
        epochs.cast("long").alias("epochs"),
        words.alias("words"),
        (epochs * size + words).cast("long").alias("taken"),
    )
    return sized.withColumn(name, result).drop(per_source)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""

    def cut(texts: pa.Array, counts: pa.Array) -> pa.Array:
        wanted, out = counts.to_pylist(), []
        for chunk in chunks(texts):
            words = chunk.words()
            for i in range(len(chunk)):
                last = words.bounds[i] + (wanted[chunk.first + i] or 0) - 1
                end = words.ends[last] if last >= words.bounds[i] else chunk.offsets[i]
                out.append(chunk.data[chunk.offsets[i] : end].tobytes())
        return pa.array(out, pa.binary()).cast(pa.string())

    return F.arrow_udf(cut, "string")(text, n)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each time a document is taken,
    the last one of a cut document with its first words only."""
    name = fresh_name(docs, "mix")
    drawn = planned(docs, mix)
    m = F.col(name)
    copies = F.concat(
        F.array_repeat(F.lit(False), m["epochs"].cast("int")),
        F.array_repeat(F.lit(True), F.when(m["words"] > 0, 1).otherwise(0)),
    )
    part = fresh_name(drawn, "part")
    rows = drawn.where(m["taken"] > 0).withColumn(part, F.explode(copies))
    whole = rows.where(~F.col(part)).select(*docs.columns)
    cut = rows.where(F.col(part))
    text = first_words(F.col("text"), m["words"])
    return whole.unionByName(cut.withColumn("text", text).select(*docs.columns))
