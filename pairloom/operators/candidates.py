"""Candidate pairs of a rule: an equi-join of narrow frames.

Frames carry only the columns that the rule reads. A wide text that serves as a key travels as its MD5, so shuffles move
16 bytes for it; its length, where a rule asks for it, is a column of its own.
Conditions on one side alone hold before the join. Where there are many pairs, the records of A that share a key are dealt
over a bounded number of tasks, so what is shuffled and held grows with the records and only what comes out with the pairs.
"""

from __future__ import annotations

import math
import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.rules import POSTFIX, Rule
from pairloom.sources.snapshot import Snapshot
from pairloom.sources.tables import written

WIDE = frozenset(("assembly", "clean_assembly", "pseudocode", "clean_pseudo", "microcode", "clean_microcode", "mnemonics", "constants", "names", "pseudocode_hash1", "pseudocode_hash2", "pseudocode_hash3"))
_COLUMN = re.compile(r"\b(d?f)\.(\w+)")


def _reads(rule: Rule, side: str, postfix: str) -> set[str]:
    """The columns, derived ones included, that the rule reads on a side (f or df)."""
    text = " ".join((rule.where, postfix, *(k if not k.isidentifier() else f"f.{k} df.{k}" for k in rule.keys)))
    own = {c for s, c in _COLUMN.findall(text) if s == side}
    # a key that is SQL is written for f and holds for both sides
    own |= {c for k in rule.keys if not k.isidentifier() for _, c in _COLUMN.findall(k)}
    return own | ({rule.rare[0]} if rule.rare else set()) | ({"source_file"} if rule.ordered else set())


def _joined(rule: Rule, snapshot: Snapshot, side: str) -> DataFrame:
    """functions with the columns of the rule's source."""
    functions = snapshot.functions
    if rule.source == "constants":
        return functions.join(snapshot.constants.select("func_id", "constant"), functions.id == F.col("func_id")).drop("func_id")
    if rule.source == "units":
        units = snapshot.compilation_units.select("cu_id", F.col("name").alias("cu_name"), F.col("pseudocode_primes").alias("cu_pseudocode_primes"))
        bridge = snapshot.compilation_unit_functions.join(units, "cu_id").drop("cu_id")
        return functions.join(bridge, functions.id == F.col("func_id")).drop("func_id")
    if rule.source == "instructions":
        named = functions.where("name not ilike 'nullsub%'").select(F.col("id").alias("func_id"))
        once = snapshot.instructions.where("disasm <> ''").join(named, "func_id").groupBy("disasm").agg(F.count("*").alias("n"), F.max("func_id").alias("func_id")).where("n = 1")
        return functions.join(once.select("disasm", "func_id"), functions.id == F.col("func_id")).drop("func_id")
    if rule.source == "blocks":
        blocks = snapshot.blocks.where("inst_total > 0").select("func_id", "mnemonics_list", "inst_total")
        if side == "f":
            blocks = blocks.groupBy("mnemonics_list").agg(F.count("*").alias("n"), F.max("func_id").alias("func_id"), F.max("inst_total").alias("inst_total")).where("n = 1").drop("n")
        return functions.join(blocks, functions.id == F.col("func_id")).drop("func_id")
    return functions


def _narrow(rule: Rule, snapshot: Snapshot, side: str, postfix: str) -> DataFrame:
    wanted = _reads(rule, side, postfix) - {"id"}
    frame = _joined(rule, snapshot, side)
    columns: list[Column] = [F.col("id")]
    for c in sorted(wanted):
        if c.endswith("_length") and c not in frame.columns:
            columns.append(F.length(c.removesuffix("_length")).alias(c))
        elif c in WIDE and c in rule.keys and c not in _compared(rule):
            columns.append(F.unhex(F.md5(c)).alias(c))
        else:
            columns.append(F.col(c))
    return frame.select(*columns)


def _compared(rule: Rule) -> set[str]:
    """Columns whose text, not only its equality, the rule's conditions read."""
    return {c for _, c in _COLUMN.findall(rule.where)}


def _key(key: str) -> str:
    return f"f.{key} = df.{key}" if key.isidentifier() else f"{key} = {re.sub(r'[(]f[.]', '(df.', key)}"


def _rare_values(rule: Rule, frame: DataFrame) -> DataFrame:
    column, most = rule.rare
    kept = frame.where(F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)) > 0) if most == 1 else frame.where(F.col(column) != "0")
    return kept.groupBy(column).count().where(F.col("count") <= most).select(column)


def _conjuncts(condition: str, word: str = "and") -> list[str]:
    """The parts of a condition that a plain `and` (or another word) joins; one part where that isn't sure."""
    if re.search(r"\b(between|case)\b", condition, re.I):
        return [condition]
    parts, depth, quoted = [""], 0, False
    for piece in re.split(rf"(['()]|\s+{word}\s+)", condition):
        quoted ^= piece == "'"
        depth += 0 if quoted else (piece == "(") - (piece == ")")
        if piece.strip() == word and not depth and not quoted:
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def _read_by(condition: str) -> set[str]:
    return {s for s, _ in _COLUMN.findall(condition)}


def _either(condition: str) -> list[str]:
    """The parts of a condition in brackets that `or` joins, if each reads one side only."""
    parts = _conjuncts(condition[1:-1], "or") if condition[:1] == "(" and condition[-1:] == ")" else []
    return parts if len(parts) > 1 and all(len(_read_by(p)) == 1 for p in parts) else []


#: Up to so many pairs a plain join does.
FEW = 4_000_000
#: So many pairs of one key are a share.
SHARE = 1_000_000


def _sides(rule: Rule, a: Snapshot, b: Snapshot, postfix: str) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Both sides' records that meet the conditions on one side alone, as the keys and a struct (f or df) of what else is
    read, then the keys' names and the conditions on both."""
    frames = {"f": _narrow(rule, a, "f", postfix), "df": _narrow(rule, b, "df", postfix)}
    if rule.rare:
        column, most = rule.rare
        x, y = _rare_values(rule, a.functions), _rare_values(rule, b.functions)
        if most == 1:  # unique on both sides
            frames = {"f": frames["f"].join(x, column, "left_semi"), "df": frames["df"].join(y, column, "left_semi")}
        else:  # rare on either side
            frames["f"] = frames["f"].join(x.union(y).distinct(), column, "left_semi")
    parts = [c for text in (rule.where, postfix) for c in _conjuncts(text)]
    read = {c: _read_by(c) for c in parts}
    across, tests = [], {}  # what one side alone says of a pair is asked once a record
    for c in parts:
        if len(read[c]) != 1:
            own = {p: f"test_{len(tests) + i}" for i, p in enumerate(_either(c))}
            tests |= own
            across.append(" or ".join(f"{min(_read_by(p))}.{n}" for p, n in own.items()) or c)
    names = [f"key_{i}" for i in range(len(rule.keys))]
    out = []
    for side, frame in frames.items():
        frame = frame.alias(side)
        for c in parts:
            if read[c] == {side}:
                frame = frame.where(F.expr(c))
        keys = [F.expr(f"{side}.{k}" if k.isidentifier() else re.sub(r"[(]f[.]", f"({side}.", k)) for k in rule.keys]
        made = {n: F.expr(p) for p, n in tests.items() if _read_by(p) == {side}}
        told = sorted({"id"} | {c for x in across for s, c in _COLUMN.findall(x) if s == side and c not in made} | ({"source_file"} if rule.ordered else set()))
        frame = frame.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.struct(*(v.alias(n) for n, v in made.items()), *(F.col(f"{side}.{c}").alias(c) for c in told)).alias(side))
        out.append(frame.dropna(subset=names))
    return out[0], out[1], names, across


def _dealt(x: DataFrame, y: DataFrame, keys: list[str], counts: DataFrame, pairs: float) -> DataFrame:
    """The join of x and y, with x's records of one key dealt over blocks and y's over strips of a quarter of a block's length;
    a share is a block beside a strip. What is shuffled is a row for hundreds of pairs. Each record of a block meets the same
    strip in the same order, so the ids that come out repeat within a page of Parquet and compress to a small part of what they
    take in other orders; strips are of one length, a multiple of 8, since Parquet packs ids by eights. Tasks are as many as the
    pairs need, not as the bytes of the narrow records do."""
    tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2_000, int(pairs // (40 * SHARE))))
    strip = math.isqrt(SHARE // 4)
    strip = max(1, strip - strip % 8 if strip > 8 else strip)
    parts = {"blocks_": F.ceil(F.col("n_f") / (4 * strip)).cast("long"), "strips_": F.ceil(F.col("n_df") / strip).cast("long")}
    many = written(counts.withColumns(parts).where("blocks_ > 1 or strips_ > 1").select(*keys, *parts), "many")
    n = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), n(c) - 1))
    flat = lambda s, k: [F.col(f"{k}.{c}").alias(f"{k}_{c}") for c in s.schema[k].dataType.names]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(f"df.{c}" for c in y.schema["df"].dataType.names if c.startswith("test_")), "df.id"))
    f = x.join(many, keys, "left").select(*keys, *flat(x, "f"), F.pmod(F.xxhash64("f.id"), n("blocks_")).alias("block_"), each("strips_").alias("strip_"))
    df = y.withColumn("strip_", F.floor((place - 1) / strip)).join(many, keys, "left").select(*keys, *flat(y, "df"), "strip_", each("blocks_").alias("block_"))
    share = [*keys, "strip_", "block_"]
    met = f.repartition(tasks, *share).join(df.repartition(tasks, *share).hint("merge"), share)  # a merge join keeps shares together
    return met.select(*keys, *(F.struct(*(F.col(f"{k}_{c}").alias(c) for c in s.schema[k].dataType.names)).alias(k) for s, k in ((x, "f"), (y, "df"))))


def members(rule: Rule, a: Snapshot, b: Snapshot, postfix: str = POSTFIX) -> tuple[DataFrame, DataFrame, list[str]]:
    """The records of both sides (id and the keys) that the rule lets in, and the keys' names, for rules whose conditions read
    one side each: their candidates are all pairs of one key."""
    x, y, keys, across = _sides(rule, a, b, postfix)
    if across or rule.also:
        raise ValueError(f"{rule.name}: conditions on pairs")
    return written(x.select(*keys, "f.id"), "f"), written(y.select(*keys, "df.id"), "df"), keys


def all_pairs(x: DataFrame, y: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """f and df, structs of the other columns, for each pair of rows of one key; nothing is shuffled by pairs."""
    x, y = (s.dropna(subset=keys).select(*keys, F.struct(*(c for c in s.columns if c not in keys)).alias(k)) for s, k in ((x, "f"), (y, "df")))
    counts, n = _counted(x, y, keys)
    return _dealt(x, y, keys, counts, n) if n > few else x.join(y, keys)


def _counted(x: DataFrame, y: DataFrame, keys: list[str]) -> tuple[DataFrame, float]:
    """Each key's records on both sides (n_f, n_df), and the number of pairs in all."""
    each = x.groupBy(*keys).agg(F.count("*").alias("n_f")).join(y.groupBy(*keys).agg(F.count("*").alias("n_df")), keys)
    counts = written(each, "counts")
    return counts, counts.agg(F.sum(F.col("n_f").cast("double") * F.col("n_df"))).first()[0] or 0


def candidates(rule: Rule, a: Snapshot, b: Snapshot, postfix: str = POSTFIX, few: int = FEW) -> DataFrame:
    """a_id, b_id, description and order_key (1: one source file, 0: two, -1: unknown) for each pair that the rule finds.

    Pairs come as often as the rule's joins give them, or once where it says so. Null keys match nothing.
    """
    x, y, keys, across = _sides(rule, a, b, postfix)
    x, y = written(x, "f"), written(y, "df")
    n, once, dealt = x.count() * y.count(), rule.distinct or rule.also is not None, False
    if n > few:
        counts, n = _counted(x, y, keys)
        dealt = n > few
        if once and not rule.source:  # records of different ids, each on one row, make no pair twice
            once = any(not s.groupBy(f"{k}.id").count().where("count > 1").isEmpty() for s, k in ((x, "f"), (y, "df")))
    met = _dealt(x, y, keys, counts, n) if dealt else x.join(y, keys)
    same = F.coalesce(F.expr("cast(f.source_file = df.source_file as int)"), F.lit(-1)) if rule.ordered else F.lit(0)
    fit = met.where(F.expr(" and ".join(f"({c})" for c in across))) if across else met
    found = fit.select(F.col("f.id").alias("a_id"), F.col("df.id").alias("b_id"), F.lit(rule.label or rule.name).alias("description"), same.alias("order_key"))
    found = found.distinct() if once else found
    if not rule.also:
        return found
    more = candidates(replace(rule.also, distinct=True), a, b, postfix, few)
    both = found.union(more)
    return both.distinct() if (rule.also.label or rule.also.name) == (rule.label or rule.name) or rule.also.also else both


def by_address(a: Snapshot, b: Snapshot) -> DataFrame:
    """Pairs of one address and one bytes_hash."""
    x, y = (s.functions.where("bytes_hash <> ''").select("id", "address", "bytes_hash") for s in (a, b))
    return x.withColumnRenamed("id", "a_id").join(y.withColumnRenamed("id", "b_id"), ["address", "bytes_hash"]).select("a_id", "b_id")


EQUAL = ("address", "name", "mangled_function", "nodes", "edges", "size", "bytes_hash")


def equal_rows(a: Snapshot, b: Snapshot) -> DataFrame:
    """The rows of EQUAL that both snapshots have; nulls are equal."""
    return a.functions.select(*EQUAL).intersect(b.functions.select(*EQUAL))


def same_name(a: Snapshot, b: Snapshot) -> DataFrame:
    """Pairs of one name or one mangled name, without automatic and short names: two equi-joins, not one with an OR."""
    fit = "length(name) > 3 and name not ilike 'sub_%' and name not ilike 'nullsub_%' and name not ilike 'j_%'"
    x, y = (s.functions.where(fit).select("id", "name", "mangled_function") for s in (a, b))
    x, y = x.withColumnsRenamed({"id": "a_id"}), y.withColumnsRenamed({"id": "b_id"})
    by_name = x.join(y.drop("mangled_function"), "name").select("a_id", "b_id")
    by_mangled = x.where("mangled_function <> ''").drop("name").join(y.drop("name"), "mangled_function").select("a_id", "b_id")
    return by_name.union(by_mangled).distinct()


def oracle(rule: Rule, postfix: str = POSTFIX) -> str:
    """The rule as a DuckDB query over a_functions, b_functions and their child tables."""

    def side(s: str, name: str) -> str:
        if rule.source == "constants":
            return f"(select x.*, constant from {s}_functions x join {s}_constants c on c.func_id = x.id) {name}"
        if rule.source == "units":
            return f"(select x.*, u.name cu_name, u.pseudocode_primes cu_pseudocode_primes from {s}_functions x join {s}_compilation_unit_functions c on c.func_id = x.id join {s}_compilation_units u on u.cu_id = c.cu_id) {name}"
        if rule.source == "instructions":
            return f"(select x.*, disasm from {s}_functions x join (select disasm, max(i.func_id) func_id from {s}_instructions i join {s}_functions g on g.id = i.func_id where disasm <> '' and g.name not ilike 'nullsub%' group by disasm having count(*) = 1) i on i.func_id = x.id) {name}"
        if rule.source == "blocks":
            blocks = f"(select * from {s}_blocks where inst_total > 0)"
            blocks = f"(select mnemonics_list, max(func_id) func_id, max(inst_total) inst_total from {blocks} group by mnemonics_list having count(*) = 1)" if name == "f" else blocks
            return f"(select x.*, mnemonics_list, inst_total from {s}_functions x join {blocks} i on i.func_id = x.id) {name}"
        return f"{s}_functions {name}"

    conditions = [*map(_key, rule.keys), rule.where, postfix]
    if rule.rare:
        column, most = rule.rare
        kept = f"coalesce(try_cast({column} as double), 0) > 0" if most == 1 else f"{column} <> '0'"
        x, y = (f"select {column} from {s}_functions where {kept} group by {column} having count(*) <= {most}" for s in "ab")
        conditions.append(f"f.{column} in ({x}) and df.{column} in ({y})" if most == 1 else f"f.{column} in ({x} union {y})")
    where = re.sub(r"\b(d?f)\.(\w+)_length\b", r"length(\1.\2)", " and ".join(conditions))
    text = f"select {'distinct ' if rule.distinct else ''}f.id a_id, df.id b_id, '{rule.label or rule.name}' description from {side('a', 'f')}, {side('b', 'df')} where {where}"
    return f"{text} union {oracle(rule.also, postfix)}" if rule.also else text
