"""Differences of two texts, graphs and call lists as rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.assign import greedy
from pairloom.operators.ranges import last_mark
from pairloom.operators.refine import with_degrees
from pairloom.operators.similarity import lcs_ratio_of, split_lines
from pairloom.sources.snapshot import Snapshot, address_number
from pairloom.sources.tables import written


class _Table:
    """Which cells of the table of longest common subsequences are higher than the one before them in their row.

    A row is one whole number, a bit a cell (Hyyro 2004); every so many rows are kept, and those between are made again
    when they are asked for, so texts of any length are compared exactly, in memory of about the square root of the table.
    """

    def __init__(self, x: list[str], y: list[str]):
        self.x, self.ones, self.places = x, (1 << len(y)) - 1, {}
        for j, line in enumerate(y):
            self.places[line] = self.places.get(line, 0) | 1 << j
        self.step = max(1, math.isqrt(len(x)))
        row, self.kept = self.ones, [self.ones]
        for i, line in enumerate(x, 1):
            row = self._next(row, line)
            if i % self.step == 0:
                self.kept.append(row)
        self.block, self.rows = -1, []

    def _next(self, row: int, line: str) -> int:
        met = row & self.places.get(line, 0)
        return ((row + met) | (row - met)) & self.ones

    def higher(self, i: int, j: int) -> bool:
        """Whether i lines of x and j of y have one more line in common than i and j - 1."""
        k = i // self.step
        if k != self.block:
            self.block, self.rows = k, [self.kept[k]]
            for line in self.x[k * self.step : (k + 1) * self.step]:
                self.rows.append(self._next(self.rows[-1], line))
        return not self.rows[i - k * self.step] >> (j - 1) & 1


def line_script(left: str | None, right: str | None) -> list[tuple[str, int | None, int | None]]:
    """(same, removed or added, place left, place right) along a longest common subsequence, added lines first from the end."""
    x, y = split_lines(left or ""), split_lines(right or "")
    table, out, i, j = _Table(x, y), [], len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(("same", i, j))
        elif j and (not i or not table.higher(i, j)):
            j -= 1
            out.append(("added", None, j))
        else:
            i -= 1
            out.append(("removed", i, None))
    return out[::-1]


#: So many rows of a line diff, about, are in one batch.
ROWS = 50_000


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the line diffs of a_id, b_id, text_a and text_b; no more pairs are held than `ROWS` rows need."""
    schema = None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("a_id"), batch.schema.field("b_id"), ("at", pa.int32()), ("kind", pa.string()), ("left_index", pa.int32()), ("right_index", pa.int32()), ("line", pa.string())])
        columns: list[list] = [[] for _ in schema]
        for k in range(batch.num_rows):
            a_id, b_id, left, right = (batch.column(c)[k].as_py() for c in ("a_id", "b_id", "text_a", "text_b"))
            x, y = split_lines(left or ""), split_lines(right or "")
            for at, (kind, i, j) in enumerate(line_script(left, right)):
                for c, v in zip(columns, (a_id, b_id, at, kind, i, j, y[j] if i is None else x[i]), strict=True):
                    c.append(v)
            if len(columns[0]) >= ROWS or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                columns = [[] for _ in schema]


def line_diff(pairs: DataFrame) -> DataFrame:
    """pairs (a_id, b_id, text_a, text_b) as rows a_id, b_id, at, kind, left_index, right_index and line."""
    kinds = dict(pairs.dtypes)
    read = pairs.select("a_id", "b_id", F.col("text_a").cast("string"), F.col("text_b").cast("string"))
    return read.mapInArrow(_scripts, f"a_id {kinds['a_id']}, b_id {kinds['b_id']}, at int, kind string, left_index int, right_index int, line string")


def changed_rows(diff: DataFrame) -> DataFrame:
    """A line diff with lines side by side: in each run of removed and added lines, the n-th removed and the n-th added one
    are one row of kind changed. Columns a_id, b_id, at, kind, left_index, right_index; rows keep their order."""
    pair = Window.partitionBy("a_id", "b_id").orderBy("at")
    breaks = F.sum((F.col("kind") == "same").cast("int")).over(pair)
    marked = diff.withColumn("run", breaks)
    place = F.row_number().over(Window.partitionBy("a_id", "b_id", "run", "kind").orderBy("at"))
    marked = marked.withColumn("n", F.when(F.col("kind") == "same", 0).otherwise(place))
    rows = marked.groupBy("a_id", "b_id", "run", "n").agg(F.min("at").alias("at"), F.max("left_index").alias("left_index"), F.max("right_index").alias("right_index"), F.count("*").alias("lines"), F.first("kind").alias("kind"))
    return rows.select("a_id", "b_id", "at", F.when(F.col("lines") == 2, "changed").otherwise(F.col("kind")).alias("kind"), "left_index", "right_index")


def unified_diff(pairs: DataFrame, context: int = 3) -> DataFrame:
    """pairs (a_id, b_id, text_a, text_b) with `diff`, a unified diff made of the line diff's rows; empty for equal texts."""
    rows = line_diff(pairs)
    pair = Window.partitionBy("a_id", "b_id").orderBy("at")
    own = (F.col("kind") != "same").cast("int")
    near = F.max(own).over(pair.rowsBetween(-context, context)) == 1
    before = lambda kinds: F.sum(F.col("kind").isin(*kinds).cast("int")).over(pair) - F.col("kind").isin(*kinds).cast("int")
    told = rows.withColumns({"near": near, "left_before": before(("same", "removed")), "right_before": before(("same", "added"))})
    begins = F.col("near") & ~F.coalesce(F.lag("near").over(pair), F.lit(False))
    told = told.withColumn("hunk", F.sum(begins.cast("int")).over(pair)).where("near")
    sign = F.when(F.col("kind") == "same", " ").when(F.col("kind") == "removed", "-").otherwise("+")
    count = lambda other: F.count_if(F.col("kind") != other)
    hunks = told.groupBy("a_id", "b_id", "hunk").agg(F.min("left_before").alias("p"), F.min("right_before").alias("q"), count("added").alias("m"), count("removed").alias("n"), F.array_sort(F.collect_list(F.struct("at", F.concat(sign, "line").alias("line")))).alias("lines"))
    where = lambda start, n: F.concat((F.col(start) + (F.col(n) > 0).cast("int")).cast("string"), F.when(F.col(n) == 1, "").otherwise(F.concat(F.lit(","), F.col(n).cast("string"))))
    text = F.concat(F.lit("@@ -"), where("p", "m"), F.lit(" +"), where("q", "n"), F.lit(" @@\n"), F.array_join("lines.line", "\n"))
    whole = hunks.groupBy("a_id", "b_id").agg(F.array_sort(F.collect_list(F.struct("hunk", text.alias("text")))).alias("h")).select("a_id", "b_id", F.concat(F.lit("--- a\n+++ b\n"), F.array_join("h.text", "\n")).alias("diff"))
    return pairs.select("a_id", "b_id").join(whole, ["a_id", "b_id"], "left").select("a_id", "b_id", F.coalesce("diff", F.lit("")).alias("diff"))


def _graphs(pairs: DataFrame, s: Snapshot, k: str) -> DataFrame:
    """The blocks of one side of each pair, with instruction counts and the places of their successors in order."""
    after = s.block_edges.groupBy("func_id", F.col("parent").alias("num")).agg(F.array_sort(F.collect_list("child")).alias("after"))
    blocks = s.blocks.select("func_id", "num", "inst_total").join(after, ["func_id", "num"], "left")
    return pairs.select("a_id", "b_id").join(blocks.withColumnRenamed("func_id", f"{k}_id"), f"{k}_id").select("a_id", "b_id", "num", F.col("inst_total").alias(f"inst_{k}"), F.coalesce("after", F.array().cast("array<int>")).alias(f"after_{k}"))


def graph_diff(pairs: DataFrame, a: Snapshot, b: Snapshot) -> DataFrame:
    """Blocks at one place of a pair's records: same, changed, or of one side; by instruction count and successors."""
    met = _graphs(pairs, a, "a").join(_graphs(pairs, b, "b"), ["a_id", "b_id", "num"], "full_outer")
    status = F.when(F.col("inst_b").isNull(), "primary-only").when(F.col("inst_a").isNull(), "secondary-only").when((F.col("inst_a") == F.col("inst_b")) & (F.col("after_a") == F.col("after_b")), "same").otherwise("changed")
    return met.select("a_id", "b_id", "num", status.alias("status"))


def edge_diff(pairs: DataFrame, a: Snapshot, b: Snapshot) -> DataFrame:
    """Edges (parent, child) of a pair's graphs: same, or of one side. With graph_diff's nodes, the context of a graph."""
    side = lambda s, k: pairs.select("a_id", "b_id").join(s.block_edges.distinct().withColumnRenamed("func_id", f"{k}_id"), f"{k}_id").select("a_id", "b_id", "parent", "child", F.lit(True).alias(k))
    met = side(a, "a").join(side(b, "b"), ["a_id", "b_id", "parent", "child"], "full_outer")
    return met.select("a_id", "b_id", "parent", "child", F.when(F.col("b").isNull(), "primary-only").when(F.col("a").isNull(), "secondary-only").otherwise("same").alias("status"))


def resolved_calls(s: Snapshot) -> DataFrame:
    """func_id, ordinal and callee of calls: the function at the address, else the one whose range holds it (the last that
    begins before it). Addresses are compared as numbers; calls to elsewhere are left out."""
    starts = s.functions.select(address_number("address").alias("at"), F.lit(0).alias("is_call"), F.lit(None).cast("long").alias("func_id"), F.lit(None).cast("int").alias("ordinal"), F.struct(F.col("id").alias("callee"), address_number("address").alias("from"), F.col("size").cast("long").alias("size")).alias("mark"))
    calls = s.callgraph.select(address_number("address").alias("at"), F.lit(1).alias("is_call"), "func_id", F.col("ordinal").cast("int"), F.lit(None).cast(starts.schema["mark"].dataType).alias("mark"))
    held = last_mark(starts.union(calls), ("at", "is_call"), "mark").where("is_call = 1 and (at = mark.from or at < mark.from + mark.size)")
    return held.select("func_id", "ordinal", F.col("mark.callee").alias("callee"))


def call_context(pairs: DataFrame, a: Snapshot, b: Snapshot) -> DataFrame:
    """Callees of a pair's records, side by side in the order of the calls; null where one list is shorter."""

    def side(s: Snapshot, k: str) -> DataFrame:
        known = resolved_calls(s).join(s.functions.select(F.col("id").alias("callee"), F.col("name").alias(f"callee_{k}")), "callee")
        return pairs.select("a_id", "b_id").join(known.select(F.col("func_id").alias(f"{k}_id"), "ordinal", f"callee_{k}"), f"{k}_id")

    return side(a, "a").join(side(b, "b"), ["a_id", "b_id", "ordinal"], "full_outer").select("a_id", "b_id", "ordinal", "callee_a", "callee_b")


def caller_context(pairs: DataFrame, a: Snapshot, b: Snapshot) -> DataFrame:
    """Callers of a pair's records, one row for each calling function, side by side in the order of their ids."""

    def side(s: Snapshot, k: str) -> DataFrame:
        calls = resolved_calls(s).select(F.col("callee").alias(f"{k}_id"), "func_id").distinct()
        met = pairs.select("a_id", "b_id").join(calls, f"{k}_id").join(s.functions.select(F.col("id").alias("func_id"), F.col("name").alias(f"caller_{k}")), "func_id")
        return met.select("a_id", "b_id", F.row_number().over(Window.partitionBy("a_id", "b_id").orderBy("func_id")).alias("ordinal"), f"caller_{k}")

    return side(a, "a").join(side(b, "b"), ["a_id", "b_id", "ordinal"], "full_outer").select("a_id", "b_id", "ordinal", "caller_a", "caller_b")


# Mnemonics that end a block.
JUMPS = frozenset("jmp je jne jz jnz jg jl jge jle ja jb jae jbe jc jnc jo jno js jns jp jnp jcxz jecxz jrcxz loop".split())
RETURNS = frozenset(("ret", "retn"))


def text_graphs(texts: DataFrame) -> DataFrame:
    """id, block, first, last and successors of assembly texts (id, text); a null or empty text has no block.

    A label begins a block; a jump or return ends one. A jump leads to its label (the last of its name), and all but jmp and
    returns lead on to the next block.
    """
    listed = texts.where("text <> ''").select("id", F.posexplode(F.split(F.regexp_replace("text", "\n\\z", ""), "\n")).alias("pos", "line"))
    head = F.trim(F.regexp_extract("line", "^\\s*([^:]*):", 1))
    label = F.when(F.contains(F.col("line"), F.lit(":")) & (head != "") & ~F.contains(head, F.lit(" ")), F.lower(head))
    words = F.filter(F.split(F.lower(F.trim("line")), "\\s+"), lambda x: x != "")
    words = F.when(F.coalesce(F.get(words, F.lit(0)), F.lit("")).endswith(":"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    named = listed.select("id", "pos", label.alias("label"), words.alias("words")).withColumn("op", F.coalesce(F.get("words", F.lit(0)), F.lit("")))
    line = Window.partitionBy("id").orderBy("pos")
    last_of = F.max("pos").over(Window.partitionBy("id", "label"))
    begins = (F.col("pos") == 0) | (F.col("label").isNotNull() & (F.col("pos") == last_of)) | F.coalesce(F.lag(F.col("op").isin(*JUMPS, *RETURNS)).over(line), F.lit(False))
    dealt = written(named.withColumn("begins", begins).withColumn("block", (F.sum(F.col("begins").cast("int")).over(line) - 1).cast("int")).select("id", "pos", "label", "words", "op", "begins", "block"), "lines")
    blocks = dealt.groupBy("id", "block").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max_by("op", "pos").alias("op"), F.max_by("words", "pos").alias("words"))
    target = F.get(F.filter(F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda x: ~x.isin("short", "near")), F.lit(0))
    blocks = blocks.select("id", "block", "first", "last", "op", F.when(F.col("op").isin(*JUMPS), F.rtrim(target, F.lit(","))).alias("label"))
    places = dealt.where("label is not null and begins").groupBy("id", "label").agg(F.max_by("block", "pos").alias("to"))
    ends = Window.partitionBy("id")
    onward = F.when(~F.col("op").isin(*RETURNS, "jmp") & (F.col("block") < F.max("block").over(ends)), F.col("block") + 1)
    after = F.array_sort(F.array_distinct(F.array_compact(F.array("to", onward))))
    return blocks.join(places, ["id", "label"], "left").select("id", "block", "first", "last", after.alias("successors"))


def _closeness(x: str, y: str) -> Column:
    return 1.0 - F.abs(F.col(x) - F.col(y)) / (F.greatest(x, y) + 1)


def _alike() -> Column:
    """Weights of common lines, counts, degrees and place, over columns c_a and c_b."""

    @F.pandas_udf("double")
    def text(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio_of("\n".join(x), "\n".join(y)) if len(x) and len(y) else float(len(x) == len(y)) for x, y in zip(left, right, strict=True)], dtype="float64")

    return 0.6 * text("lines_a", "lines_b") + 0.15 * _closeness("count_a", "count_b") + 0.1 * _closeness("outdegree_a", "outdegree_b") + 0.1 * _closeness("indegree_a", "indegree_b") + 0.05 * _closeness("num_a", "num_b")


def block_pairs(pairs: DataFrame, a: Snapshot, b: Snapshot) -> DataFrame:
    """a_id, b_id, num_a, num_b, kind and score of the blocks of each pair: equal ones, the n-th of A with the n-th of B; then
    the most alike from 0.5 up; then those at one place from 0.35 up; then the rest, of one side.

    Without a line in common, blocks that have any are alike by 0.4 at most, so candidates are joined by their lines.
    """
    keys = ["a_id", "b_id"]

    def side(s: Snapshot, k: str) -> DataFrame:
        lines = F.filter(F.split("mnemonics_list", ","), lambda x: x != "")
        known = with_degrees(s.blocks, s.block_edges).withColumn("lines", lines).withColumn("count", F.size("lines"))
        held = pairs.select(*keys).distinct().join(known.withColumnRenamed("func_id", f"{k}_id"), f"{k}_id")
        return written(held.select(*keys, *(F.col(c).alias(f"{c}_{k}") for c in ("num", "lines", "count", "indegree", "outdegree"))), "blocks")

    def rest(df: DataFrame, found: DataFrame, k: str) -> DataFrame:
        return df.join(found.select(*keys, f"num_{k}"), [*keys, f"num_{k}"], "left_anti")

    def scored(met: DataFrame) -> DataFrame:
        return met.withColumn("score", _alike()).select(*keys, "num_a", "num_b", "score")

    x, y = side(a, "a"), side(b, "b")
    place = lambda k: F.row_number().over(Window.partitionBy(*keys, f"lines_{k}").orderBy(f"num_{k}"))
    equal = lambda df, k: df.where(f"count_{k} > 0").select(*keys, F.col(f"lines_{k}").alias("lines"), place(k).alias("n"), f"num_{k}")
    found = written(equal(x, "a").join(equal(y, "b"), [*keys, "lines", "n"]).select(*keys, "num_a", "num_b", F.lit("exact").alias("kind"), F.lit(1.0).alias("score")), "block-pairs")
    p, q = rest(x, found, "a"), rest(y, found, "b")
    by_line = lambda df, k: df.select(*keys, f"num_{k}", F.explode(F.when(F.col(f"count_{k}") > 0, F.array_distinct(f"lines_{k}")).otherwise(F.array(F.lit("")))).alias("line"))
    near = by_line(p, "a").join(by_line(q, "b"), [*keys, "line"]).select(*keys, "num_a", "num_b").distinct()
    like = scored(near.join(p, [*keys, "num_a"]).join(q, [*keys, "num_b"])).where("score >= 0.5").select(*keys, F.col("num_a").alias("a"), F.col("num_b").alias("b"), "score")
    ends = like.select(F.col("a_id").alias("pair_a"), F.col("b_id").alias("pair_b"), F.col("a").alias("a_id"), F.col("b").alias("b_id"), "score", F.abs(F.col("a") - F.col("b")).alias("far"))
    taken = greedy(ends, [F.col("score").desc(), F.col("far"), F.col("a_id"), F.col("b_id")], ["pair_a", "pair_b"])
    found = written(found.union(taken.select(F.col("pair_a").alias("a_id"), F.col("pair_b").alias("b_id"), F.col("a_id").alias("num_a"), F.col("b_id").alias("num_b"), F.lit("similar").alias("kind"), "score")), "block-pairs")
    p, q = rest(x, found, "a"), rest(y, found, "b")
    same = scored(p.withColumn("num_b", F.col("num_a")).join(q, [*keys, "num_b"])).where("score >= 0.35").select(*keys, "num_a", "num_b", F.lit("ordinal").alias("kind"), "score")
    found = written(found.union(same), "block-pairs")
    alone = lambda df, k, kind: rest(df, found, k).select(*keys, *(F.col(f"num_{k}") if k == c else F.lit(None).cast("int").alias(f"num_{c}") for c in "ab"), F.lit(kind).alias("kind"), F.lit(0.0).alias("score"))
    return found.union(alone(x, "a", "primary-only")).union(alone(y, "b", "secondary-only"))


def within(pairs: DataFrame, s: Snapshot, column: str = "assembly") -> dict[str, DataFrame]:
    """Two records of one snapshot side by side, for pairs (a_id, b_id) of its ids: lines of a text column, blocks, edges,
    callees and callers. A record set against itself differs nowhere; pairs with an unknown id have no rows."""
    texts = lambda k: s.functions.select(F.col("id").alias(f"{k}_id"), F.col(column).alias(f"text_{k}"))
    found = {"lines": line_diff(pairs.select("a_id", "b_id").join(texts("a"), "a_id").join(texts("b"), "b_id"))}
    if "blocks" in s.frames and "block_edges" in s.frames:
        found |= {"blocks": graph_diff(pairs, s, s), "edges": edge_diff(pairs, s, s)}
    if "callgraph" in s.frames:
        found |= {"callees": call_context(pairs, s, s), "callers": caller_context(pairs, s, s)}
    return found
