"""Result tables: what is unmatched, final order, saving, summaries and search."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators.ranges import numbered
from pairloom.sources.snapshot import Snapshot

KINDS = ("best", "partial", "unreliable", "multimatch")
RESULTS = ("type", "line", "address", "name", "address2", "name2", "ratio", "nodes1", "nodes2", "description")


def unmatched(snapshot: Snapshot, matches: DataFrame, side: str) -> DataFrame:
    """type, line, address and name of the functions that no match has, in order of id."""
    rest = snapshot.functions.select("id", "address", "name").join(matches.select(F.col(f"{side}_id").alias("id")), "id", "left_anti")
    kind = F.lit("primary" if side == "a" else "secondary").alias("type")
    return numbered(rest, "id").select(kind, "line", "address", "name")


def ordered(matches: DataFrame, a: Snapshot, b: Snapshot) -> DataFrame:
    """The result table of matches (a_id, b_id, kind, ratio, description): by kind, ratio, and the addresses."""
    x = a.functions.select(F.col("id").alias("a_id"), "address", "name", F.col("nodes").alias("nodes1"))
    y = b.functions.select(F.col("id").alias("b_id"), F.col("address").alias("address2"), F.col("name").alias("name2"), F.col("nodes").alias("nodes2"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("type"))
    number = lambda c: F.col(c).try_cast("decimal(20,0)")
    told = matches.withColumnRenamed("kind", "type").join(x, "a_id").join(y, "b_id")
    once = told.withColumn("again_", F.row_number().over(Window.partitionBy("address", "address2").orderBy(rank, F.col("ratio").desc(), "description"))).where("again_ = 1")
    order = (rank, F.col("ratio").desc(), number("address"), number("address2"), F.col("description"))
    return numbered(once, *order).select(*(F.round("ratio", 6).alias("ratio") if c == "ratio" else F.col(c) for c in RESULTS))


class ResultError(ValueError):
    """A folder that holds no usable results."""


def save(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Stored tables by name; ResultError if one is missing or the results lack a column."""
    found = {}
    for n in names or ("config", "results", "unmatched"):
        try:
            found[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        except AnalysisException as e:
            raise ResultError(f"no table {n} in {folder}") from e
    if "results" in found and (missing := set(RESULTS) - set(found["results"].columns)):
        raise ResultError(f"results have no column {', '.join(sorted(missing))}")
    return found


def totals(results: DataFrame, missing: DataFrame) -> DataFrame:
    """matches, unmatched_a and unmatched_b in one row."""
    x = results.agg(F.count("*").alias("matches"))
    y = missing.agg(F.count_if(F.col("type") == "primary").alias("unmatched_a"), F.count_if(F.col("type") == "secondary").alias("unmatched_b"))
    return x.join(F.broadcast(y))  # one row each


def nonzero_rules(stats: DataFrame) -> DataFrame:
    """The rules that found candidates, those with most first."""
    return stats.where("candidates > 0").orderBy(F.col("candidates").desc(), "line")


def function_info(functions: DataFrame, address: str) -> DataFrame:
    """All columns of the function at an address."""
    return functions.where(F.col("address") == address)


def compared(runs: DataFrame, baseline: str) -> DataFrame:
    """runs (run, type, count) with each count's difference from the run named baseline; kinds that one lacks count 0 there."""
    every = runs.select("run").distinct().join(F.broadcast(runs.select("type").distinct()))  # a handful of kinds
    base = runs.where(F.col("run") == baseline).select("type", F.col("count").alias("base"))
    full = every.join(runs, ["run", "type"], "left").join(F.broadcast(base), "type", "left").fillna(0, ["count", "base"])
    return full.select("run", "type", "count", (F.col("count") - F.col("base")).alias("delta"))


def summary(results: DataFrame, missing: DataFrame) -> DataFrame:
    return results.groupBy("type").count().union(missing.groupBy("type").count())


def page(results: DataFrame, kind: str, limit: int, offset: int) -> DataFrame:
    """One page of a kind, the least alike first."""
    return results.where(F.col("type") == kind).orderBy("ratio", "line").offset(offset).limit(limit)


def unmatched_page(missing: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of the unmatched records, in the order of their lines, A's before B's."""
    return missing.select("type", "address", "name", "line").orderBy("line", "type").offset(offset).limit(limit).drop("line")


def search_unmatched(missing: DataFrame, text: str, limit: int) -> DataFrame:
    """The first unmatched records whose name or address contains text, whatever its case."""
    return unmatched_page(search(missing, text, ("name", "address")), limit, 0)


def search(table: DataFrame, text: str, columns: tuple[str, ...] = ("name", "name2", "address", "address2")) -> DataFrame:
    """Rows in which any of the columns contains text, whatever its case."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return table.where(found)


def histogram(results: DataFrame, spark: SparkSession) -> DataFrame:
    """Results by tenths of the ratio, empty tenths included; 1 falls into the last."""
    tenth = F.least(F.floor(F.col("ratio") * 10), F.lit(9)).cast("long")
    return spark.range(10).toDF("bucket").join(results.groupBy(tenth.alias("bucket")).count(), "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"))


def analyzed(results: DataFrame) -> DataFrame:
    """Counts by kind, mean ratio and nodes."""
    return results.groupBy("type").agg(F.count("*").alias("matches"), F.avg("ratio").alias("mean_ratio"), F.sum("nodes1").alias("nodes1"), F.sum("nodes2").alias("nodes2"))


def field_fill(functions: DataFrame) -> DataFrame:
    """How many rows have a value, and none that is empty, in each column; one row a column."""
    counted = functions.agg(*(F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in functions.columns))
    return counted.unpivot([], functions.columns, "field", "filled")


#: Columns of instructions whose filling is told, and the names it goes by.
INSTRUCTION_FIELDS = (
    ("comment1", "instruction_comment1"), ("comment2", "instruction_comment2"), ("operand_names", "instruction_operand_names"), ("name", "instruction_names"), ("type", "instruction_types"),
    ("pseudocomment", "instruction_pseudocomments"), ("pseudoitp", "instruction_pseudoitp"),
)


def instruction_fill(instructions: DataFrame) -> DataFrame:
    """How many instructions there are, and how many have a value in each told column; a column that isn't there has none."""
    named = [(F.col(c).cast("string") if c in instructions.columns else F.lit(None).cast("string")).alias(n) for c, n in INSTRUCTION_FIELDS]
    filled = field_fill(instructions.select(*named))
    return instructions.agg(F.lit("instruction_rows").alias("field"), F.count("*").alias("filled")).union(filled)
