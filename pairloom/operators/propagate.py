"""Passes that lead from matched records to further pairs.

Each takes seeds (a_id, b_id), two snapshots and the pairs that are taken (the seeds, if none are given), and returns new
pairs (a_id, b_id, ratio, description), one-to-one and with both ends free of those taken. Greedy choices follow a fixed
order of ids. No pass has a limit on users of a constant, records of a gap or names of a text, unless it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.assign import greedy
from pairloom.operators.candidates import same_name as named_pairs
from pairloom.operators.ranges import last_mark, numbered
from pairloom.operators.similarity import bag_ratio, line_bag
from pairloom.sources.snapshot import Snapshot
from pairloom.sources.tables import written

#: Names that tools give, as patterns in which case doesn't matter and _ stands for any character.
AUTOMATIC = ("sub_%", "nullsub_%", "j_%")


def proper_name(name: str) -> Column:
    """Longer than three characters and of no automatic kind."""
    c = F.length(name) > 3
    for p in AUTOMATIC:
        c &= ~F.col(name).ilike(p)
    return F.coalesce(c, F.lit(False))


def _or(taken: DataFrame | None, seeds: DataFrame) -> DataFrame:
    return seeds if taken is None else taken


def free(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs with both ends outside of seeds."""
    return pairs.join(seeds.select("a_id"), "a_id", "left_anti").join(seeds.select("b_id"), "b_id", "left_anti")


def _sized(pairs: DataFrame, a: Snapshot, b: Snapshot, percent: int, nodes: int) -> DataFrame:
    """Pairs whose node counts are within percent of each other, without those with few nodes on both sides."""
    x, y = (s.functions.select(F.col("id").alias(f"{k}_id"), F.col("nodes").alias(f"nodes_{k}")) for s, k in ((a, "a"), (b, "b")))
    near = F.least("nodes_a", "nodes_b") * 100 >= percent * F.greatest("nodes_a", "nodes_b")
    return pairs.join(x, "a_id").join(y, "b_id").where(near & ((F.col("nodes_a") >= nodes) | (F.col("nodes_b") >= nodes)))


def text_ratio(pairs: DataFrame, a: Snapshot, b: Snapshot) -> DataFrame:
    """pairs with `text`: the best line overlap of the clean and the raw texts."""
    columns = ("clean_assembly", "clean_pseudo", "assembly", "pseudocode")
    x, y = (s.functions.select(F.col("id").alias(f"{k}_id"), *(line_bag(c).alias(f"{c}_{k}") for c in columns)) for s, k in ((a, "a"), (b, "b")))
    wide = pairs.join(x, "a_id").join(y, "b_id")
    return wide.withColumn("text", F.greatest(*(bag_ratio(f"{c}_a", f"{c}_b") for c in columns))).drop(*(f"{c}_{k}" for c in columns for k in "ab"))


def _told(pairs: DataFrame, ratio: Column, description: str) -> DataFrame:
    return pairs.select("a_id", "b_id", ratio.alias("ratio"), F.lit(description).alias("description"))


def same_name(seeds: DataFrame, a: Snapshot, b: Snapshot, least: float = 0.5) -> DataFrame:
    """Pairs of one name, taken in the order of A's ids."""
    found = text_ratio(free(named_pairs(a, b), seeds), a, b).where(F.col("text") >= least)
    ratio = F.when(F.col("text") < 1, F.least(F.col("text") + 0.01, F.lit(1.0))).otherwise(F.col("text"))
    return greedy(_told(found, ratio, "Same name"), [F.col("a_id"), F.col("b_id")])


def call_candidates(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Callees at one place of the call lists of a seed's two ends, if the lists are of one length; fewer than two nodes on
    both sides, or node counts of less than a quarter of each other, don't count.

    strict: only calls of the very type "call", else all whose type begins so.
    """

    def lists(s: Snapshot, k: str) -> DataFrame:
        calls = s.callgraph.where(F.col("type") == "call" if strict else F.col("type").like("call%"))
        known = calls.join(s.functions.select("address", F.col("id").alias("callee")), "address")
        per = Window.partitionBy("func_id")
        place = F.row_number().over(per.orderBy("ordinal", "callee"))
        return known.select(F.col("func_id").alias(f"{k}_id"), place.alias("place"), F.count("*").over(per).alias("n"), F.col("callee").alias(f"callee_{k}"))

    met = seeds.select("a_id", "b_id").join(lists(a, "a"), "a_id").join(lists(b, "b"), ["b_id", "place", "n"])
    pairs = met.select(F.col("callee_a").alias("a_id"), F.col("callee_b").alias("b_id")).distinct()
    return _sized(free(pairs, _or(taken, seeds)), a, b, 25, 2)


def call_references(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None) -> DataFrame:
    return greedy(_told(call_candidates(seeds, a, b, taken), F.lit(0.6), "Call reference"), [F.col("a_id"), F.col("b_id")])


def affine_candidates(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Records of one name, not automatic, in the gaps between seeds that follow each other in both snapshots; only gaps of
    at most `most` records on each side, if it is given. Addresses are compared as numbers.
    """
    number = F.col("address").try_cast("decimal(20,0)").alias("at")
    x, y = (s.functions.select("id", "name", number) for s in (a, b))
    at = seeds.select("a_id", "b_id").join(x.select(F.col("id").alias("a_id"), F.col("at").alias("at_a")), "a_id").join(y.select(F.col("id").alias("b_id"), F.col("at").alias("at_b")), "b_id")
    line = written(numbered(at.select("at_a", "at_b"), "at_a", "at_b"), "seeds")
    after = line.select(F.col("at_a").alias("next_a"), F.col("at_b").alias("next_b"), (F.col("line") - 1).alias("line"))
    gaps = line.join(after, "line").where("next_a > at_a and next_b > at_b").withColumn("gap", F.col("at_a"))

    def inside(functions: DataFrame, k: str) -> DataFrame:
        """Each gap's records: a record belongs to the last seed before it."""
        mark = F.struct(F.col(f"at_{k}").alias("from"), F.col(f"next_{k}").alias("until"), "gap").alias("mark")
        marks = gaps.select(F.col(f"at_{k}").alias("at"), F.lit(0).alias("is_record"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), mark)
        rows = functions.select("at", F.lit(1).alias("is_record"), "id", "name", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"))
        held = last_mark(marks.union(rows), ("at", "is_record"), "mark").where("is_record = 1 and at > mark.from and at < mark.until").withColumn("gap", F.col("mark.gap"))
        if most is not None:
            held = held.join(held.groupBy("gap").count().where(F.col("count") <= most).select("gap"), "gap", "left_semi")
        return held.select("gap", "name", F.col("id").alias(f"{k}_id"))

    met = inside(x, "a").join(inside(y, "b"), ["gap", "name"]).where("substr(name, 1, 4) <> 'sub_'")
    return free(met.select("a_id", "b_id").distinct(), _or(taken, seeds))


def locally_affine(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None) -> DataFrame:
    return greedy(_told(affine_candidates(seeds, a, b, taken), F.lit(0.7), "Local affinity"), [F.col("a_id"), F.col("b_id")])


def diffing_candidates(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None) -> DataFrame:
    """Functions that both ends of a seed name in their `names`."""
    refers = lambda s, k: s.functions.select(F.col("id").alias(f"{k}_id"), F.explode(F.array_distinct(F.from_json("names", "array<string>"))).alias("name"))
    shared = seeds.select("a_id", "b_id").join(refers(a, "a"), "a_id").join(refers(b, "b"), ["b_id", "name"]).where(proper_name("name")).select("name").distinct()
    first = lambda s, k: s.functions.groupBy("name").agg(F.min("id").alias(f"{k}_id"))
    pairs = shared.join(first(a, "a"), "name").join(first(b, "b"), "name").select("a_id", "b_id")
    return _sized(free(pairs, _or(taken, seeds)), a, b, 25, 3)


def matches_diffing(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None) -> DataFrame:
    found = text_ratio(diffing_candidates(seeds, a, b, taken).select("a_id", "b_id"), a, b)
    ratio = F.greatest(F.lit(0.6), F.col("text"))
    return greedy(_told(found, F.when(ratio < 1, ratio + 0.01).otherwise(ratio), "Diffing of matches"), [F.col("a_id"), F.col("b_id")])


_CALL = r"\bcall +([A-Za-z_][A-Za-z0-9_]*)"


def _called_alone(seeds: DataFrame, a: Snapshot, b: Snapshot, column: str) -> DataFrame:
    """Seeds with x, names called only in A's text, and y, those called only in B's."""
    called = lambda s, k: s.functions.select(F.col("id").alias(f"{k}_id"), F.filter(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(_CALL), F.lit(1))), lambda x: (F.length(x) > 3) & ~x.startswith("sub_") & ~x.startswith("loc_")).alias(f"called_{k}"))
    met = seeds.select("a_id", "b_id").join(called(a, "a"), "a_id").join(called(b, "b"), "b_id")
    return met.select("a_id", "b_id", F.array_except("called_a", "called_b").alias("x"), F.array_except("called_b", "called_a").alias("y"))


def rename_candidates(seeds: DataFrame, a: Snapshot, b: Snapshot, column: str = "assembly") -> DataFrame:
    """name_a, name_b: names called only in A's text crossed with names called only in B's, within a seed."""
    only = _called_alone(seeds, a, b, column)
    return only.select(F.explode("x").alias("name_a"), "y").select("name_a", F.explode("y").alias("name_b")).distinct()


def renamed(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None, least: float = 0.5, column: str = "assembly") -> DataFrame:
    """Only names that free functions of the snapshots bear are crossed, the first function of each."""
    only, out = written(_called_alone(seeds, a, b, column), "called"), _or(taken, seeds)
    first = lambda s, k: s.functions.groupBy("name").agg(F.min("id").alias("id")).join(out.select(F.col(f"{k}_id").alias("id")), "id", "left_anti")
    borne = lambda s, k, names: only.select("a_id", "b_id", F.explode(names).alias("name")).join(first(s, k), "name").select("a_id", "b_id", F.col("id").alias(f"borne_{k}"))
    pairs = borne(a, "a", "x").join(borne(b, "b", "y"), ["a_id", "b_id"]).select(F.col("borne_a").alias("a_id"), F.col("borne_b").alias("b_id")).distinct()
    found = text_ratio(_sized(pairs, a, b, 0, 3).select("a_id", "b_id"), a, b)
    ratio = F.greatest(F.lit(0.5), F.col("text"))
    return greedy(_told(found.where(ratio >= least), F.least(ratio + 0.01, F.lit(1.0)), "Renamed"), [F.col("ratio").desc(), F.col("a_id"), F.col("b_id")])


def constant_candidates(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """For each constant that both ends of a seed use: the first pair of its users, free, that have one name and no automatic
    one. Only constants of at most `most` users on each side, if it is given. Users meet by constant and name, so a
    constant that many use makes no more pairs than names are shared."""
    out = _or(taken, seeds)

    def users(s: Snapshot) -> DataFrame:
        uses = s.constants.select("func_id", "constant").distinct()
        return uses if most is None else uses.join(uses.groupBy("constant").count().where(F.col("count") <= most).select("constant"), "constant", "left_semi")

    x, y = users(a), users(b)
    shared = seeds.select("a_id", "b_id").join(x.withColumnRenamed("func_id", "a_id"), "a_id").join(y.withColumnRenamed("func_id", "b_id"), ["b_id", "constant"]).select("constant").distinct()
    named = lambda s, u, k: free_side(u.join(shared, "constant", "left_semi").join(s.functions.select(F.col("id").alias("func_id"), "name").where("substr(name, 1, 4) <> 'sub_'"), "func_id").withColumnRenamed("func_id", f"{k}_id"), out, k)
    first = lambda df, k: df.groupBy("constant", "name").agg(F.min(f"{k}_id").alias(f"{k}_id"))  # noqa: E731  the first pair is of first users
    met = first(named(a, x, "a"), "a").join(first(named(b, y, "b"), "b"), ["constant", "name"])
    return met.groupBy("constant").agg(F.min(F.struct("a_id", "b_id")).alias("p")).select("constant", "p.a_id", "p.b_id")


def free_side(rows: DataFrame, seeds: DataFrame, side: str) -> DataFrame:
    return rows.join(seeds.select(f"{side}_id"), f"{side}_id", "left_anti")


def related_constants(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None) -> DataFrame:
    pairs = constant_candidates(seeds, a, b, taken).select("a_id", "b_id").distinct()
    return greedy(_told(pairs, F.lit(0.6), "Related constants"), [F.col("a_id"), F.col("b_id")])


def unit_candidates(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None) -> DataFrame:
    """Functions of one name in compilation units of one name."""
    named = lambda s: s.compilation_unit_functions.join(s.compilation_units.select("cu_id", F.col("name").alias("cu_name")), "cu_id").select("cu_name", "func_id")
    held = lambda s, k: named(s).join(s.functions.select(F.col("id").alias("func_id"), "name"), "func_id").select("cu_name", "name", F.col("func_id").alias(f"{k}_id"))
    return free(held(a, "a").join(held(b, "b"), ["cu_name", "name"]).select("a_id", "b_id").distinct(), _or(taken, seeds))


def compilation_units(seeds: DataFrame, a: Snapshot, b: Snapshot, taken: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    found = text_ratio(unit_candidates(seeds, a, b, taken), a, b).where(F.col("text") >= least)
    return greedy(_told(found, F.least(F.col("text") + 0.01, F.lit(1.0)), "Compilation unit"), [F.col("a_id"), F.col("b_id")])


@dataclass(frozen=True)
class Pass:
    """run: the pass; least: the ratio that its seeds have at least; clear: seeds are best and partial matches alone; slow:
    left out where slow rules are."""

    run: Callable[..., DataFrame]
    least: float = 0.5
    clear: bool = False
    slow: bool = False


#: In this order, again and again until a round adds nothing.
PASSES = (Pass(matches_diffing, clear=True), Pass(renamed, clear=True), Pass(related_constants, 0.8, clear=True, slow=True), Pass(compilation_units), Pass(call_references), Pass(locally_affine))


def seeds_of(step: Pass, matches: DataFrame) -> DataFrame:
    return matches.where((F.col("ratio") >= step.least) & (F.col("kind").isin("best", "partial") if step.clear else F.col("kind") != "multimatch")).select("a_id", "b_id")
