"""What to carry over from matched records of B to A, and why not."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.sources.snapshot import Snapshot
from pairloom.sources.tables import written

# Beginnings of names that tools give.
AUTO_NAMES = ("sub_", "nullsub_", "j_", "loc_", "byte_", "word_", "dword_", "qword_", "off_", "unk_")


@dataclass(frozen=True)
class Options:
    """kinds: of matches that count; least: their ratio. What is carried over: names (names given by tools only if not
    skip_auto_names), prototypes, comments and flags of functions, and comments, operands and pseudocode comments of
    instructions."""

    kinds: tuple[str, ...] = ("best", "partial")
    least: float = 0.5
    skip_auto_names: bool = True
    names: bool = True
    prototypes: bool = True
    comments: bool = True
    flags: bool = False
    instruction_comments: bool = True
    operands: bool = True
    pseudocode_comments: bool = True


def _unfit(options: Options) -> Column:
    """Why a match doesn't count; null if it does."""
    return F.when(~F.col("kind").isin(*options.kinds) | F.col("kind").isNull(), "skip_kind").when(F.coalesce(F.col("ratio") < options.least, F.lit(True)), "skip_ratio")


def _name_reason(options: Options) -> Column:
    """rename_function, or the first reason against it, over name_a and name_b."""
    auto = F.lit(False)
    for p in AUTO_NAMES if options.skip_auto_names else ():
        auto = auto | F.lower("name_b").startswith(p)
    return (
        F.when(F.coalesce(F.col("name_b"), F.lit("")) == "", "skip_empty_name")
        .when(F.col("name_a").eqNullSafe(F.col("name_b")), "skip_same_name")
        .when(auto, "skip_auto_name")
        .otherwise("rename_function")
    )


def _named(matches: DataFrame, a: Snapshot, b: Snapshot, columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    x, y = (s.functions.select(F.col("id").alias(f"{k}_id"), *(F.col(c).alias(f"{c}_{k}") for c in columns), F.lit(True).alias(f"known_{k}")) for s, k in ((a, "a"), (b, "b")))
    return matches.join(x, "a_id", how).join(y, "b_id", how)


def renames(matches: DataFrame, a: Snapshot, b: Snapshot, least: float = 0.5) -> DataFrame:
    """a_id, b_id, name_a, name_b and operation for matches (a_id, b_id, kind, ratio): whether A's record takes B's name."""
    options = Options(least=least)
    told = _named(matches, a, b, ("name",)).withColumn("operation", F.coalesce(_unfit(options), _name_reason(options)))
    return told.select("a_id", "b_id", "name_a", "name_b", "operation")


_ITEM = r'\[\s*(\d+)\s*,\s*"([^"\\]*(?:\\.[^"\\]*)*)"\s*\]'


def forced_operands(text: str | Column) -> Column:
    """The pairs (number, name) of a text like [[0,"a"],[1,"b"]], an array of structs. A text that is no such list, up to where
    it breaks off or closes, has none; empty names don't count; a backslash stands for the character after it."""
    text = F.col(text) if isinstance(text, str) else text
    whole = F.coalesce(text.rlike(rf"(?s)^\s*\[(\s*{_ITEM}\s*,?)*(\s*\].*)?\z"), F.lit(False))
    closed = F.regexp_extract(text, rf"(?s)^(\s*\[(?:\s*{_ITEM}\s*,?)*)", 1)
    pick = lambda k: F.regexp_extract_all(closed, F.lit(f"(?s){_ITEM}"), F.lit(k))
    pairs = F.zip_with(pick(1), pick(2), lambda n, v: F.struct(n.cast("int").alias("number"), F.regexp_replace(v, r"(?s)\\(.)", "$1").alias("name")))
    return F.when(whole, F.filter(pairs, lambda p: p["name"] != "")).otherwise(F.array().cast("array<struct<number:int,name:string>>"))


#: The ids of so many matches at most are sent to all tasks.
FEW = 2_000_000

#: Column of instructions, option and operation.
_INSTRUCTIONS = (
    ("comment1", "instruction_comments", "set_instruction_comment"),
    ("comment2", "instruction_comments", "set_repeatable_instruction_comment"),
    ("pseudocomment", "pseudocode_comments", "set_pseudocode_comment"),
    ("operand_names", "operands", "set_forced_operand"),
)


def _spans(instructions: DataFrame) -> DataFrame:
    """Of each record, the first and last place of its instructions, and whether they are there once each with none between
    left out: then a place between them is known to be there. Told by the number of places and the exclusive or of their hashes."""
    place = F.col("pos").cast("long")
    told = instructions.where("pos is not null").groupBy("func_id").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(place)).alias("sign"))
    wanted = F.aggregate(F.sequence("first", "last"), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.xxhash64(i)))
    whole = F.when(F.col("n") == F.col("last") - F.col("first") + 1, F.col("sign") == wanted).otherwise(False)
    return told.select(F.col("func_id").alias("a_id"), "first", "last", whole.alias("whole"))


def plan(matches: DataFrame, a: Snapshot, b: Snapshot, options: Options = Options()) -> DataFrame:  # noqa: B008
    """a_id, b_id, pos, operation, value and number for matches (a_id, b_id, kind, ratio): everything that A's records take
    from B's, and why matches and names are skipped.

    pos: the place of an instruction in its record, null for records; instructions of one place belong together. number: flags,
    or which operand. Texts that B lacks or that A has already are left out, so are columns that a side doesn't have. A match
    with an unknown record is skipped. Repeated matches give repeated rows.

    Records are joined once for all their columns. Of the instructions, only those that carry something are sent: where A's
    places have no gaps, their span tells that a place is there. Up to FEW matches are broadcast as ids and spans.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    item = lambda operation, value, number=nothing("long"): F.struct(operation.alias("operation"), value.alias("value"), number.cast("long").alias("number"))
    none = F.array().cast("array<struct<operation:string,value:string,number:bigint>>")
    on_both = lambda c: c in a.functions.columns and c in b.functions.columns
    carried = [(c, o) for c, wanted, o in (("prototype", options.prototypes, "apply_prototype"), ("comment", options.comments, "set_function_comment")) if wanted and on_both(c)]
    flags = options.flags and on_both("function_flags")
    told = _named(matches, a, b, ("name", *(c for c, _ in carried), *["function_flags"] * flags), "left")
    told = told.withColumn("reason", F.coalesce(_unfit(options), F.when(F.col("known_a").isNull() | F.col("known_b").isNull(), "skip_missing_source")))
    lists = []
    if options.names:
        named = _name_reason(options)
        lists.append(F.array(item(named, F.when(named == "rename_function", F.col("name_b")))))
    for c, operation in carried:
        lists.append(F.when(F.expr(f"{c}_b <> '' and not ({c}_a <=> {c}_b)"), F.array(item(F.lit(operation), F.col(f"{c}_b")))).otherwise(none))
    if flags:
        lists.append(F.when(F.expr("function_flags_b <> 0 and not (function_flags_a <=> function_flags_b)"), F.array(item(F.lit("set_function_flags"), nothing("string"), F.col("function_flags_b")))).otherwise(none))
    items = F.when(F.col("reason").isNotNull(), F.array(item(F.col("reason"), nothing("string")))).otherwise(F.concat(*lists, none))
    held = [x for x in _INSTRUCTIONS if getattr(options, x[1]) and all("instructions" in s.frames and x[0] in s.instructions.columns for s in (a, b))]
    told = told.select("a_id", "b_id", F.col("reason").isNull().alias("fit"), items.alias("items"))
    if held:
        told = written(told.join(_spans(a.instructions), "a_id", "left"), "told")
    out = told.select("a_id", "b_id", nothing("int").alias("pos"), F.explode("items").alias("x"))
    if held:
        fit = told.where("fit and first is not null").select("a_id", "b_id", "first", "last", "whole")
        some = reduce(Column.__or__, (F.coalesce(F.col(c) != "", F.lit(False)) for c, _, _ in held))
        side = lambda s, k: s.select(F.col("func_id").alias(f"{k}_id"), "pos", *(F.col(c).alias(f"{c}_{k}") for c, _, _ in held))
        given, ours = side(b.instructions.where(some), "b"), side(a.instructions.where(some), "a")
        whole = fit.where("whole").drop("whole")
        if fit.count() <= FEW:  # then instructions of other records are dropped where they are read
            whole = F.broadcast(whole)
            ours = ours.join(F.broadcast(fit.select("a_id").distinct()), "a_id", "left_semi")
        met = given.join(whole, "b_id").where("pos between first and last").drop("first", "last").join(ours, ["a_id", "pos"], "left")
        if not fit.where("not whole").isEmpty():  # places with gaps, or there twice
            met = met.unionByName(given.join(fit.where("not whole").select("a_id", "b_id"), "b_id").join(side(a.instructions, "a"), ["a_id", "pos"]))
        differ = lambda c: F.col(f"{c}_b").isNotNull() & (F.col(f"{c}_b") != "") & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
        lists = []
        for c, _, operation in held:
            if c == "operand_names":
                found = F.transform(forced_operands(f"{c}_b"), lambda p: item(F.lit("set_forced_operand"), p["name"], p["number"]))
            else:
                found = F.array(item(F.lit(operation), F.col(f"{c}_b")))
            lists.append(F.when(differ(c), found).otherwise(none))
        out = out.union(met.select("a_id", "b_id", F.col("pos").cast("int").alias("pos"), F.explode(F.concat(*lists)).alias("x")))
    return out.select("a_id", "b_id", "pos", "x.operation", "x.value", "x.number")


def counters(planned: DataFrame) -> DataFrame:
    return planned.groupBy("operation").count()
