"""Columns made fit for modelling: names, types, arrays, codes, indicators, ages, feature sets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake(name: str) -> str:
    """camelCase and separators to snake_case."""
    name = re.sub(r"[^0-9A-Za-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name))
    return name.strip("_").lower()


def snake_case(df: DataFrame) -> DataFrame:
    """Rename all columns; names that collide afterwards are an error."""
    names = [snake(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide as {', '.join(twice)}")
    return df.toDF(*names)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to columns with joined names."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterable[tuple[str, ...]]:
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, ())))


def ensure_columns(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Add the absent ones of name -> type: null, or an empty array."""
    made = {n: (F.array() if t.startswith("array") else F.lit(None)).cast(t) for n, t in wanted.items() if n not in df.columns}
    return df.withColumns(made) if made else df


def coerce(df: DataFrame, kinds: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Safe casts, and (column, lost): how many values of each were lost by them."""
    lost = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in kinds.items()))
    report = lost.unpivot([], list(kinds), "column", "lost")
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items()}), report


def order_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Listed columns first, the rest by name."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *sorted(c for c in df.columns if c not in lead))


def norm_array(values: Column) -> Column:
    """Distinct, trimmed, non-empty strings in order; null gives an empty array."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))


def code_parts(code: Column, mode: str = "zero") -> tuple[Column, Column, Column]:
    """Letters, number and rank of a code like AA12.

    zero: rank of the first letter, 0 where a part is absent. nullable: null where it is absent. base26: rank over all letters
    (A = 1, AA = 27).
    """
    upper = F.upper(F.trim(code))
    letters = F.regexp_extract(upper, "^([A-Z]+)", 1)
    number = F.regexp_extract(upper, r"(\d+)$", 1).try_cast("long")
    first = F.when(letters != "", F.ascii(letters) - 64)
    if mode == "base26":
        spread = F.filter(F.split(letters, ""), lambda c: c != "")
        first = F.when(letters != "", F.aggregate(spread, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64))
    if mode == "nullable":
        return F.nullif(letters, F.lit("")), number, first
    return letters, F.coalesce(number, F.lit(0)), F.coalesce(first, F.lit(0))


def code_features(df: DataFrame, code: str, mode: str = "zero") -> DataFrame:
    """Add index_letter, index_number and index_rank."""
    letter, number, rank = code_parts(F.col(code), mode)
    return df.withColumns({"index_letter": letter, "index_number": number.cast("long"), "index_rank": rank.cast("long")})


def impute_flag(df: DataFrame, present: Mapping[str, str], missing: Mapping[str, str]) -> DataFrame:
    """Null to 0 and negatives to 0, with a 0/1 flag that says a value was there (`present`) or not (`missing`)."""
    flags = {flag: F.col(c).isNotNull().cast("int") for c, flag in present.items()} | {flag: F.col(c).isNull().cast("int") for c, flag in missing.items()}
    filled = {c: F.greatest(F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)), F.lit(0).cast(df.schema[c].dataType)) for c in [*present, *missing]}
    return df.withColumns(flags).withColumns(filled)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls)."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).unpivot([], columns, "column", "nulls")


def vocabulary(df: DataFrame, col: str, min_df: int) -> DataFrame:
    """(term, df) of the array's terms that at least `min_df` rows have."""
    return df.select(F.explode(F.array_distinct(col)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)


def safe_names(vocab: DataFrame, term: str = "term", prefix: str = "tag__") -> DataFrame:
    """Add `column`: the term as a column name. Terms that clean to one name get eight digits of their hash, all but the first by term."""
    clean = F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(term), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    turn = F.row_number().over(Window.partitionBy("_clean").orderBy(term))
    named = vocab.withColumn("_clean", clean).withColumn("_turn", turn)
    hashed = F.concat("_clean", F.lit("_"), F.substring(F.sha2(F.col(term), 256), 1, 8))
    return named.withColumn("column", F.when(F.col("_turn") == 1, F.col("_clean")).otherwise(hashed)).drop("_clean", "_turn")


def one_hot(df: DataFrame, col: str, columns: Mapping[str, str]) -> DataFrame:
    """A 0/1 column per term of term -> column."""
    return df.withColumns({name: F.array_contains(col, term).cast("int") for term, name in columns.items()})


def one_hot_to_array(df: DataFrame, columns: Mapping[str, str], out: str = "tags") -> DataFrame:
    """The terms whose column is 1, in order."""
    return df.withColumn(out, F.array_sort(F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(t)) for t, c in columns.items())))))


def canonical_tag(tag: Column, synonyms: Mapping[str, str]) -> Column:
    """Lower case, separators to one blank, then the synonym's canonical name."""
    clean = F.trim(F.regexp_replace(F.lower(tag), r"[\s_\-]+", " "))
    known = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.coalesce(F.try_element_at(known, clean), clean)


def norm_key(value: Column) -> Column:
    """Keys that came as int, float or text to one text: 12, 12.0 and ' 12 ' are 12. Blank is null."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.nullif(F.when(whole, number.cast("long").cast("string")).otherwise(text), F.lit(""))


def standardize(df: DataFrame, aliases: Mapping[str, list[str]]) -> DataFrame:
    """Rename the first present spelling of each name; a name without any is an error."""
    by = {snake(c): c for c in df.columns}
    for name, spellings in aliases.items():
        found = next((by[snake(s)] for s in [name, *spellings] if snake(s) in by), None)
        if found is None:
            raise ValueError(f"no column for {name}")
        df = df.withColumnRenamed(found, name)
    return df


def quoted(text: Column) -> Column:
    """Percent-encoded as in a path: all but letters, digits and _.-~."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def safe_key(*parts: Column) -> Column:
    """A file name from key parts: runs of other characters become _, outer ones go."""
    joined = F.concat_ws("_", *(F.regexp_replace(F.regexp_replace(p.cast("string"), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "") for p in parts))
    return F.concat(joined, F.lit(".html"))


def snapshot_as_of(df: DataFrame, time: str, stated: int | None = None) -> DataFrame:
    """One row: the stated instant, else the latest time."""
    return df.agg(F.coalesce(F.lit(stated).cast("long"), F.max(time)).alias("as_of"))


def age_normalize(df: DataFrame, time: str, count: str, as_of: DataFrame) -> DataFrame:
    """Add age_days (null and less than one become one), per_day and log_per_day. `as_of` is a frame of one row."""
    at = as_of.first()[0]  # one number
    age = F.greatest(F.coalesce((F.lit(at) - F.col(time)) / 86400.0, F.lit(1.0)), F.lit(1.0))
    return df.withColumn("age_days", age).withColumn("per_day", F.col(count) / F.col("age_days")).withColumn("log_per_day", F.log1p("per_day"))


def bucket(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """Right-closed buckets: value <= bounds[i] is labels[i], above all the last label."""
    out = F.lit(labels[-1])
    for b, label in reversed(list(zip(bounds, labels))):
        out = F.when(value <= b, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def conform(df: DataFrame, template: T.StructType, defaults: Mapping[str, object]) -> DataFrame:
    """Partial rows to the template's columns and types: absent or null values get their default."""
    out = []
    for f in template:
        have = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(have, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else have).alias(f.name))
    return df.select(*out)


def feature_sets(columns: list[str], groups: Mapping[str, list[str]], sets: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """Set name -> present columns of its groups in order, each once. A group entry that ends in * is a prefix."""
    out = {}
    for name, members in sets.items():
        found: list[str] = []
        for g in members:
            for want in groups[g]:
                hits = sorted(c for c in columns if c.startswith(want[:-1])) if want.endswith("*") else [want] * (want in columns)
                found += [c for c in hits if c not in found]
        out[name] = found
    return out


def leaky(columns: Iterable[str], tokens: Iterable[str]) -> list[str]:
    """Columns whose cleaned name holds a leaky token."""
    return [c for c in columns if any(t in snake(c) for t in tokens)]


def drop_leaky(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    return df.drop(*leaky(df.columns, list(tokens)))


def modelable(df: DataFrame) -> DataFrame:
    """Without arrays, maps, structs and binaries."""
    return df.select(*(f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))))
