"""Feature columns as sparse rows: medians for missing numbers, standard scales, and one place per category from a dictionary that is a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridra.operators.ranks import how, numbered, quantiles_by
from veridra.sources.workspace import stored

#: the category of a text that is not there
MISSING = "__missing__"


def dictionary(train: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, category, n, place), stored: the categories of every text column with a place from 0 in each, frequent ones first, ties by
    category. Counts are added up before the shuffle and places come from ranges, so there may be any number of categories, and one of them may
    hold most rows."""
    long = train.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(MISSING)).alias("category")) for c in cols))))
    counts = stored(long.groupBy("feature", "category").agg(F.count("*").alias("n")), "categories")
    placed = stored(numbered(counts, [F.col("feature"), F.desc("n"), F.col("category")], "at")[0], "dictionary")
    first = placed.groupBy("feature").agg(F.min("at").alias("first"))  # a row per column
    return placed.join(F.broadcast(first), "feature").select("feature", "category", "n", (F.col("at") - F.col("first")).alias("place"))


@dataclass(frozen=True)
class Encoding:
    """What `fit_encoding` learned: per number its (median, mean, deviation), the dictionary of the text columns, how many places each has, and the
    join hint that suits the dictionary's size. Only the dictionary grows with the data, and it stays a table."""

    numbers: dict[str, tuple[float, float, float]]
    words: DataFrame | None
    sizes: dict[str, int]
    hint: str

    @property
    def ranges(self) -> dict[str, tuple[int, int]]:
        """The places of every feature in the row: from, to."""
        out, at = {}, 0
        for c, n in [*((c, 1) for c in self.numbers), *self.sizes.items()]:
            out[c] = (at, at + n)
            at += n
        return out

    @property
    def size(self) -> int:
        return len(self.numbers) + sum(self.sizes.values())


def fit_encoding(train: DataFrame, features: list[str]) -> Encoding:
    """Medians, means and population deviations of the numbers, exact, and the dictionary of the texts, all of `train`. `train` is read several
    times; give it stored."""
    kinds = dict(train.dtypes)
    text = [c for c in features if kinds[c] == "string"]
    numbers = [c for c in features if c not in text]
    learned = {}
    if numbers:
        long = stored(train.select(*(F.col(c).cast("double").alias(c) for c in numbers)).unpivot([], numbers, "feature", "v"))
        median = {r.feature: r.median for r in quantiles_by(long, ["feature"], "v", {"median": 0.5}).collect()}  # a row per feature
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(median.get(c, 0.0))) for c in numbers}
        facts = train.agg(*(f(v).alias(f"{n}_{c}") for c, v in filled.items() for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first()
        learned = {c: (median.get(c, 0.0), facts[f"mean_{c}"] or 0.0, facts[f"sd_{c}"] or 1.0) for c in numbers}
    if not text:
        return Encoding(learned, None, {}, "broadcast")
    words = stored(dictionary(train, text), "dictionary")
    sizes = {r.feature: r.n for r in words.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # a row per text column
    return Encoding(learned, words, {c: sizes.get(c, 0) for c in text}, how(words))


def encoded(rows: DataFrame, e: Encoding, indices: str = "indices", values: str = "values") -> DataFrame:
    """Add the row's non-zero places and their values. Missing numbers get their median; categories that the dictionary lacks have no place."""
    at = e.ranges
    parts: list[Column] = [F.struct(F.lit(at[c][0]).alias("i"), ((F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(mean)) / F.lit(sd)).alias("v")) for c, (m, mean, sd) in e.numbers.items()]
    for k, c in enumerate(e.sizes):
        words = e.words.filter(F.col("feature") == c).select(F.col("category").alias(f"_word{k}"), F.col("place").alias(f"_place{k}")).hint(e.hint)
        rows = rows.join(words, F.coalesce(F.col(c), F.lit(MISSING)) == F.col(f"_word{k}"), "left").drop(f"_word{k}")
        # a place is below the number of categories, which a vector's int index holds
        parts.append(F.when(F.col(f"_place{k}").isNotNull(), F.struct((F.col(f"_place{k}") + at[c][0]).cast("int").alias("i"), F.lit(1.0).alias("v"))))
    entries = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x["v"] != 0)) if parts else F.array().cast("array<struct<i: int, v: double>>")
    rows = rows.withColumn("_entries", entries).drop(*(f"_place{k}" for k in range(len(e.sizes))))
    return rows.withColumns({indices: F.transform("_entries", lambda x: x["i"]), values: F.transform("_entries", lambda x: x["v"])}).drop("_entries")


def as_vector(size: int, indices: str, values: str) -> Column:
    """A sparse vector column. A vector is a struct of its kind, size, indices and values; JSON turns one into the other inside the JVM."""
    plain = F.struct(F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), F.col(indices).alias("indices"), F.col(values).alias("values")).alias("x"))
    return F.from_json(F.to_json(plain), T.StructType([T.StructField("x", VectorUDT())]))["x"]


def with_vector(rows: DataFrame, e: Encoding, out: str = "x") -> DataFrame:
    """The rows with one sparse vector of all features, for pyspark.ml."""
    return encoded(rows, e, "_indices", "_values").withColumn(out, as_vector(e.size, "_indices", "_values")).drop("_indices", "_values")


def array_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(term, n, place) of an array column's terms, stored: in how many rows each occurs, and a place from 0, frequent terms first, ties by term."""
    counts = df.select(F.explode(F.array_distinct(col)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    placed = numbered(stored(counts, "terms"), [F.desc("n"), F.col("term")], "place")[0]
    return stored(placed.select("term", "n", (F.col("place") - 1).cast("int").alias("place")), "terms")


def encode_array(df: DataFrame, keys: list[str], col: str, words: DataFrame, out: str = "places") -> DataFrame:
    """(keys..., out): the places of each row's terms in ascending order, an array however many terms there are. Rows without terms, or without any that
    the dictionary knows, have an empty one. `keys` name a row."""
    hint = how(words)
    if hint == "broadcast":
        return with_places(df.select(*keys, F.col(col).alias("_terms")), words, "_terms", out).drop("_terms")
    long = df.select(*keys, F.explode_outer(F.array_distinct(col)).alias("term"))
    return long.join(words.select("term", "place").hint(hint), "term", "left").groupBy(*keys).agg(F.array_sort(F.collect_list("place")).alias(out))


def with_places(df: DataFrame, words: DataFrame, col: str, out: str = "places") -> DataFrame:
    """The rows with the places of each row's terms in ascending order, looked up where the rows lie. For dictionaries of a checked, small size."""
    known = words.orderBy("place").select("term", "place").toArrow()
    sent = df.sparkSession.sparkContext.broadcast((known["term"].combine_chunks(), known["place"].to_numpy()))
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, places = sent.value
        size = int(places.max(initial=0)) + 1
        for batch in batches:
            lists = batch.column(at)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            found = pc.index_in(lists.flatten(), value_set=terms, skip_nulls=True)
            have = found.is_valid().to_numpy(zero_copy_only=False)
            code = np.unique(row[have] * size + places[found.drop_null().to_numpy()])
            ends = np.searchsorted(code, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array((code % size).astype(np.int32)))], [*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.array().cast("array<int>")).schema)


def decode_array(rows: DataFrame, keys: list[str], places: str, words: DataFrame, out: str = "tags") -> DataFrame:
    """(keys..., out): the terms behind the places, in order."""
    long = rows.select(*keys, F.explode_outer(places).alias("place"))
    return long.join(words.select("place", "term").hint(how(words)), "place", "left").groupBy(*keys).agg(F.array_sort(F.collect_list("term")).alias(out))
