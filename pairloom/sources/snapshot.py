"""A snapshot: one DataFrame for each table, read from and written to Parquet.

Stored snapshots change by commits over all their tables (see manifest); folders of plain Parquet tables, as other tools write
them, are read too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators.ranges import numbered
from pairloom.sources import manifest
from pairloom.sources.tables import written

#: Tables that a stored snapshot must have, and the columns that matching cannot do without.
REQUIRED = {"functions": ("id", "name", "address", "nodes", "instructions", "bytes_hash")}


#: The form of stored snapshots; others are not read.
FORMAT = "1"


class SnapshotError(ValueError):
    """A folder that holds no usable snapshot."""


@dataclass
class ExportHooks:
    """keep: the functions to write; change: what becomes of them; on_failure: called with the error if writing breaks off;
    reason: why a function is left out, '' if it isn't (see features.skip_reason)."""

    keep: Column = field(default_factory=lambda: F.lit(True))
    change: Callable[[DataFrame], DataFrame] = lambda df: df
    on_failure: Callable[[Exception], None] | None = None
    reason: Column = field(default_factory=lambda: F.lit(""))


@dataclass
class Snapshot:
    frames: dict[str, DataFrame]
    program: dict[str, str] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError:
            raise AttributeError(name) from None

    def validate(self) -> Snapshot:
        """Itself, or SnapshotError for missing tables or columns or no valid function."""
        for name, columns in REQUIRED.items():
            if name not in self.frames:
                raise SnapshotError(f"the snapshot has no table {name}")
            if missing := set(columns) - set(self.frames[name].columns):
                raise SnapshotError(f"{name} has no column {', '.join(sorted(missing))}")
        if self.functions.where(valid_function()).isEmpty():
            raise SnapshotError("the snapshot has no function")
        return self

    def save(self, folder: str, hooks: ExportHooks | None = None, batch: str | None = None) -> None:
        """Writes all tables in one commit, in place of what the folder holds. hooks: which functions are written, with their
        rows in the other tables, and how; what became of them is counted while writing and stored as program data."""
        spark, frames, counted = self.functions.sparkSession, dict(self.frames), Observation()
        try:
            begun = manifest.state(spark, folder)
            if hooks:
                told = self.functions.withColumn("reason_", F.coalesce(hooks.reason, F.lit(""))).withColumn("out_", F.when(~F.coalesce(hooks.keep, F.lit(False)) & (F.col("reason_") == ""), "left-out").otherwise(F.col("reason_")))
                kept = told.observe(counted, *_counters(F.col("out_"))).where("out_ = ''").drop("reason_", "out_")
                kept = written(hooks.change(kept), "exported")
                ids = kept.select(F.col("id").alias("func_id"))
                frames = {n: df.join(ids, "func_id", "left_semi").select(*df.columns) if "func_id" in df.columns else df for n, df in frames.items()} | {"functions": kept}
                values = {f"export.{k}": str(v) for k, v in counted.get.items() if v or not k.startswith("skip_reason.")}
                frames["program_data"] = program_data(spark, self.program | values)
            elif self.program and "program_data" not in frames:
                frames["program_data"] = program_data(spark, self.program)
            frames |= self._about(frames)
            staged = {name: manifest.stage(df, folder, name) for name, df in frames.items()}
            manifest.commit(spark, folder, begun, staged, _top(frames), batch, fresh=True)
        except Exception as e:
            if hooks and hooks.on_failure:
                hooks.on_failure(e)
            raise

    def _about(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables version, program (a row with processor and md5sum) and, where functions have primes and calls are known,
        callgraph_factors: the products of the call graph, as powers of primes."""
        from pairloom.functions.features import factor_counts  # which itself needs snapshots

        spark, functions = self.functions.sparkSession, frames["functions"]
        about = {
            "version": spark.createDataFrame([(FORMAT,)], "value string"),
            "program": spark.createDataFrame([(1, self.program.get("processor"), self.program.get("md5sum"))], "id long, processor string, md5sum string"),
        }
        if "callgraph" in frames and "primes_value" in functions.columns:
            about["callgraph_factors"] = factor_counts(functions, frames["callgraph"])
        return about

    def append(self, folder: str, batch: str | None = None) -> int:
        """Adds functions whose address the stored snapshot lacks, and their rows in the other tables; gives their number.

        They get new ids after all that were given out, in the order of their own ids, and their rows follow them. All tables
        change in one commit. A batch that the folder has taken in before adds nothing.
        """
        spark = self.functions.sparkSession
        begun = manifest.state(spark, folder)
        if batch is not None and batch in begun.batches:
            return 0
        if begun.version < 0:
            begun = self._taken_over(folder)
        stored = begun.read(spark, folder, "functions")
        fresh = written(self.functions.join(stored.select("address"), "address", "left_anti").select(*self.functions.columns), "fresh")
        ids = written(numbered(fresh.select(F.col("id").alias("old_id")), "old_id").select("old_id", (F.col("line") + begun.top + 1).alias("new_id")), "ids")
        added = ids.count()
        staged = {}
        for name, df in self.frames.items():
            key = "id" if name == "functions" else "func_id"
            if key in df.columns:
                moved = (fresh if name == "functions" else df).join(ids.withColumnRenamed("old_id", key), key).drop(key).withColumnRenamed("new_id", key)
                staged[name] = manifest.stage(moved.select(*(F.col(f.name).cast(f.dataType) for f in df.schema)), folder, name)
        manifest.commit(spark, folder, begun, staged, begun.top + added, batch)
        return added

    def _taken_over(self, folder: str) -> manifest.State:
        """A folder of plain tables as a first commit of their copies."""
        spark = self.functions.sparkSession
        frames = {}
        for name in {*self.frames, "program_data"}:
            try:
                frames[name] = spark.read.parquet(f"{folder}/{name}.parquet")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        if "functions" not in frames:
            raise SnapshotError(f"{folder} holds no snapshot")
        Snapshot(frames).save(folder)
        return manifest.state(spark, folder)


def _top(frames: dict[str, DataFrame]) -> int:
    """The highest id that a table gives a function."""
    used = [df.agg(F.max("id" if n == "functions" else "func_id")) for n, df in frames.items() if n == "functions" or "func_id" in df.columns]
    return max((df.first()[0] or 0 for df in used), default=0)


# Why functions are left out.
SKIP_REASONS = ("invalid-function", "outside-range", "library", "thunk", "nullsub", "small-function")


def _counters(reason: Column) -> list[Column]:
    """How many functions there are, how many go out and how many don't, and why, with one number for each reason."""
    each = [F.count_if(reason == r).alias(f"skip_reason.{r}") for r in (*SKIP_REASONS, "left-out")]
    return [F.count("*").alias("total_functions"), F.count_if(reason == "").alias("exported_functions"), F.count_if(reason != "").alias("skipped_functions"), *each]


def export_metadata(functions: DataFrame, reason: Column) -> DataFrame:
    """name, type and value of what an export of functions would count, by reason ('' for those that go out), with the last
    function (of the highest id) that goes out. Reasons that don't occur have no row; no function gives zeros and no last one."""
    told = functions.select("id", "name", "address", F.coalesce(reason, F.lit("")).alias("reason"))
    last = F.max_by(F.struct(F.col("address").cast("string").alias("address"), "name"), F.when(F.col("reason") == "", F.col("id")))
    one = told.agg(*_counters(F.col("reason")), last.alias("last"))
    number = lambda c: F.struct(F.lit(f"export.{c}").alias("name"), F.lit("integer").alias("type"), F.col(f"`{c}`").cast("string").alias("value"))
    text = lambda c, kind: F.struct(F.lit(f"export.last_function_{c}").alias("name"), F.lit(kind).alias("type"), F.col(f"last.{c}").alias("value"))
    rows = F.array(*(number(c) for c in one.columns if c != "last"), text("address", "address"), text("name", "text"))
    return one.select(F.explode(rows).alias("r")).select("r.*").where("value is not null and not (name like 'export.skip_reason.%' and value = '0')")


def load(spark: SparkSession, folder: str, *names: str) -> Snapshot:
    """The named tables of a stored snapshot, with its program data; blocks and block_edges are made of the four block tables
    where they aren't stored themselves."""
    kept = manifest.state(spark, folder)
    if "version" in kept.tables and (found := {r.value for r in kept.read(spark, folder, "version").collect()}) != {FORMAT}:
        raise SnapshotError(f"{folder} is of version {', '.join(sorted(map(str, found))) or 'none'}, not {FORMAT}")

    def frame(name: str) -> DataFrame:
        return kept.read(spark, folder, name) if name in kept.tables else spark.read.parquet(f"{folder}/{name}.parquet")

    frames: dict[str, DataFrame] = {}
    for name in names or ("functions",):
        try:
            frames[name] = frame(name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            if name not in ("blocks", "block_edges"):
                raise SnapshotError(f"the snapshot has no table {name}") from None
            made = blocks_of(frame("basic_blocks"), frame("function_bblocks"), frame("bb_instructions"), frame("instructions"), frame("bb_relations"))
            frames |= {k: v for k, v in zip(("blocks", "block_edges"), made, strict=True) if k in names}
    try:
        program = program_map(frame("program_data"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        program = {}
    return Snapshot(frames, program).validate()


def program_map(program_data: DataFrame) -> dict[str, str]:
    """The last value (by id) of each name of program_data (id, name, value): some dozens of names."""
    return {r.name: r.value for r in program_data.groupBy("name").agg(F.max_by("value", "id").alias("value")).collect()}


def program_data(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, n, v) for k, (n, v) in enumerate(sorted(values.items()))], "id long, name string, value string")


def replace_program_data(spark: SparkSession, folder: str, values: dict[str, str]) -> None:
    """Puts values in place of the stored program data, in a commit of its own where the folder has commits."""
    begun, rows = manifest.state(spark, folder), program_data(spark, values)
    if begun.version < 0:
        rows.write.mode("overwrite").parquet(f"{folder}/program_data.parquet")
    else:
        manifest.commit(spark, folder, begun, {"program_data": manifest.stage(rows, folder, "program_data")}, begun.top, whole=("program_data",))


def blocks_of(basic_blocks: DataFrame, function_bblocks: DataFrame, bb_instructions: DataFrame, instructions: DataFrame, bb_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """blocks (func_id, num, bb_id, mnemonics_list, inst_total) and block_edges (func_id, parent, child) of a snapshot whose
    blocks are kept in basic_blocks (id, num, address), function_bblocks (function_id, basic_block_id), bb_instructions
    (id, basic_block_id, instruction_id), instructions (id, mnemonic) and bb_relations (parent_id, child_id).

    A function's blocks are numbered from 0 by num, then id. Instructions stand in the order of bb_instructions. Blocks
    without instructions have an empty list; edges to blocks of other functions are left out.
    """
    place = F.row_number().over(Window.partitionBy("func_id").orderBy("num", "bb_id")) - 1
    held = function_bblocks.select(F.col("function_id").alias("func_id"), F.col("basic_block_id").alias("bb_id")).distinct()
    placed = held.join(basic_blocks.select(F.col("id").alias("bb_id"), "num"), "bb_id").withColumn("place", place)
    words = bb_instructions.join(instructions.select(F.col("id").alias("instruction_id"), "mnemonic"), "instruction_id")
    lists = words.groupBy(F.col("basic_block_id").alias("bb_id")).agg(F.array_sort(F.collect_list(F.struct("id", "mnemonic"))).alias("m"))
    blocks = placed.join(lists, "bb_id", "left").select("func_id", F.col("place").cast("int").alias("num"), "bb_id", F.coalesce(F.array_join("m.mnemonic", ","), F.lit("")).alias("mnemonics_list"), F.greatest(F.size("m"), F.lit(0)).alias("inst_total"))
    end = lambda k: placed.select("func_id", F.col("bb_id").alias(f"{k}_id"), F.col("place").cast("int").alias(k))
    edges = bb_relations.join(end("parent"), "parent_id").join(end("child"), ["child_id", "func_id"]).select("func_id", "parent", "child")
    return blocks, edges


def valid_function() -> Column:
    return F.coalesce((F.col("address") != "0") & (F.col("name") != ""), F.lit(False))


def address_number(column: str) -> Column:
    """An address text as a number: decimal, 0x-prefixed or bare hexadecimal; null for anything else."""
    c = F.trim(F.col(column))
    hexadecimal = F.when(c.rlike("^0[xX][0-9a-fA-F]+$"), F.substr(c, F.lit(3))).when(c.rlike("^[0-9a-fA-F]+$"), c)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("decimal(20,0)")).otherwise(F.conv(hexadecimal, 16, 10).try_cast("decimal(20,0)"))


def compilation_units(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units by source file, numbered by their least function, and which function is in which."""
    named = functions.where(F.coalesce(F.col("source_file") != "", F.lit(False)))
    number = address_number("address")
    units = named.groupBy(F.col("source_file").alias("name")).agg(F.min("id").alias("cu_id"), F.count("*").alias("functions"), F.min(number).alias("start_ea"), F.max(number).alias("end_ea"))
    return units, named.join(units.select("cu_id", F.col("name").alias("source_file")), "source_file").select("cu_id", F.col("id").alias("func_id"))
