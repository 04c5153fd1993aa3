"""Feature mathematics of records: cleaned texts, constants, prime products and graph measures."""

from __future__ import annotations

import base64
import math
from decimal import Context, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranges import numbered
from pairloom.operators.similarity import small_primes

# Beginnings of automatic names, and operand sizes.
AUTO_PREFIXES = ("loc_", "j_nullsub_", "nullsub_", "j_sub_", "sub_", "qword_", "dword_", "byte_", "word_", "off_", "def_", "unk_", "asc_", "stru_", "dbl_", "locret_", "flt_", "jpt_")
SIZES = ("dword ptr ", "byte ptr ", "word ptr ", "qword ptr ", "short ptr")


def _replaced(c: Column, *changes: tuple[str, str]) -> Column:
    for pattern, by in changes:
        c = F.regexp_replace(c, f"(?im){pattern}", by)
    return c


def clean_assembly(column: str) -> Column:
    """Each line without comments, sizes, automatic names and addresses; null stays null."""
    return clean_assembly_of(F.col(column))


def clean_assembly_of(text: Column) -> Column:
    return _replaced(
        text,
        (";.*$", ""),
        (" # .*$", ""),
        *((f"{p}[a-f0-9]+", "XXXX") for p in AUTO_PREFIXES),
        *((f"{p}[a-f0-9]+", "") for p in SIZES),
        (r"\+[a-f0-9]+h\+", "+XXXX+"),
        (r"\.\.[a-f0-9]{8}", "XXX"),
        (r"[ \t]+$", ""),
        ("a[a-z]+[a-z0-9]+_[0-9]+", "aXXX"),
        ("#0x[a-z0-9]+", "0xXXX"),
    )


def clean_pseudocode(column: str) -> Column:
    """The text without comments, and with the numbers of automatic names, variables and arguments left out."""
    return _replaced(F.col(column), (" // .*", ""), *((f"{p}[a-f0-9]+", f"{p}XXXX") for p in AUTO_PREFIXES), ("v[0-9]+", "vXXX"), ("a[0-9]+", "aXXX"), ("arg_[0-9]+", "aXXX"))


# Mnemonics of intermediate code.
MICROCODE = (
    "nop", "stx", "ldx", "ldc", "mov", "neg", "lnot", "bnot", "xds", "xdu", "low", "high", "add", "sub", "mul", "udiv", "sdiv", "umod", "smod", "or", "and", "xor", "shl", "shr",
    "sar", "cfadd", "ofadd", "cfshl", "cfshr", "sets", "seto", "setp", "setnz", "setz", "setae", "setb", "seta", "setbe", "setg", "setge", "setl", "setle", "jcnd", "jnz", "jz",
    "jae", "jb", "ja", "jbe", "jg", "jge", "jl", "jle", "jtbl", "ijmp", "goto", "call", "icall", "ret", "push", "pop", "und", "ext", "f2i", "f2u", "i2f", "u2f", "f2f",
    "fneg", "fadd", "fsub", "fmul", "fdiv",
)
_MNEMONIC = rf"(?:^|(?<=\s))(?:{'|'.join(sorted(MICROCODE, key=len, reverse=True))})(?=[\s.]|$)"


def _microcode_lines(column: str) -> Column:
    """The lines without comments that have more than two words."""
    bare = F.transform(F.split(F.col(column), "\n"), lambda x: F.trim(F.regexp_replace(x, "(?s);.*", "")))
    return F.filter(bare, lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\w+"), F.lit(0))) > 2)


def clean_microcode(column: str) -> Column:
    """Each line from its first known mnemonic on, cleaned as assembly; lines without one, and lines of at most two words, are
    left out. Null stays null."""
    lines = F.transform(_microcode_lines(column), lambda x: F.regexp_extract(x, f"({_MNEMONIC}.*)$", 1))
    return clean_assembly_of(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def microcode_mnemonics(column: str) -> Column:
    """The distinct places in MICROCODE, in the order of names, of the mnemonics that the lines begin with: what prime_product
    makes microcode_spp of."""
    names = F.array(*map(F.lit, sorted(MICROCODE)))
    found = F.transform(_microcode_lines(column), lambda x: F.regexp_extract(x, f"({_MNEMONIC})", 1))
    return F.transform(F.array_distinct(F.filter(found, lambda x: x != "")), lambda x: F.array_position(names, x).cast("int") - 1)


def primes_value(column: str = "cyclomatic_complexity") -> Column:
    """The prime at the place of the complexity, as text; null beyond the primes that are known (below 10,000)."""
    return F.get(F.array(*map(F.lit, map(str, small_primes()))), F.col(column).cast("int"))


def referred_names(column: str) -> Column:
    """JSON text of the distinct names of an array, in order, cut at a bracket; without automatic ones."""
    cut = F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.regexp_extract(x, r"^([^(]*)", 1))
    return F.to_json(F.array_sort(F.array_distinct(F.filter(cut, lambda x: (x != "") & ~x.startswith("sub_") & ~x.startswith("nullsub_")))))


def switch_text(column: str) -> Column:
    """JSON text of an array of structs (size, cases) as pairs of the table's size and its distinct cases in order; tables
    without cases are left out."""
    told = F.transform(F.filter(F.col(column), lambda x: F.size(x["cases"]) > 0), lambda x: F.concat(F.lit("["), x["size"].cast("string"), F.lit(","), F.to_json(F.array_sort(F.array_distinct(x["cases"]))), F.lit("]")))
    return F.concat(F.lit("["), F.coalesce(F.array_join(told, ","), F.lit("")), F.lit("]"))


def constant_list(numbers: DataFrame, strings: DataFrame) -> DataFrame:
    """func_id and constants, JSON text in first-seen order, from numbers (func_id, pos, value, referenced) and strings
    (func_id, pos, value): telling numbers and strings of 2 to 255 characters, each once."""
    kept = numbers.where(telling_constant("value", F.coalesce("referenced", F.lit(False)))).select("func_id", "pos", F.col("value").cast("string").alias("value"))
    every = kept.union(strings.where("length(value) between 2 and 255").select("func_id", "pos", "value"))
    once = every.groupBy("func_id", "value").agg(F.min("pos").alias("pos"))
    return once.groupBy("func_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])).alias("constants"))


def degrees(functions: DataFrame, references: DataFrame) -> DataFrame:
    """id, indegree and outdegree from references (func_id, address, type): all that lead to a function's address, and the
    calls from it."""
    into = references.groupBy("address").agg(F.count("*").alias("indegree"))
    out = references.where("type like 'call%'").groupBy(F.col("func_id").alias("id")).agg(F.count("*").alias("outdegree"))
    return functions.select("id", "address").join(into, "address", "left").join(out, "id", "left").select("id", F.coalesce("indegree", F.lit(0)).alias("indegree"), F.coalesce("outdegree", F.lit(0)).alias("outdegree"))


def skip_reason(low: int | None = None, high: int | None = None, exclude_library_thunk: bool = True, ignore_small: bool = False) -> Column:
    """Why a function (address as a number, name, size, is_library, is_thunk) is left out of a snapshot; empty if it isn't."""
    no = F.lit(False)
    outside = (F.col("address") < low if low is not None else no) | (F.col("address") > high if high is not None else no)
    out = F.when(F.col("address").isNull(), "invalid-function").when(outside, "outside-range")
    if exclude_library_thunk:
        out = out.when(F.coalesce("is_library", no), "library").when(F.coalesce("is_thunk", no), "thunk").when(F.coalesce(F.col("name").startswith("nullsub_"), no), "nullsub")
    if ignore_small:
        out = out.when(F.coalesce(F.col("size") <= 6, no), "small-function")
    return out.otherwise("")


def factor_counts(functions: DataFrame, references: DataFrame) -> DataFrame:
    """prime, n_all and n_called: how often each primes_value above 1 occurs among all functions and among those that call or
    are called. The products of the call graph are the primes to these powers; as text they would grow with the table."""
    ends = references.join(functions.select(F.col("id").alias("func_id"), F.col("address").alias("from")), "func_id")
    part = ends.select(F.explode(F.array("from", "address")).alias("address")).distinct().withColumn("called", F.lit(1))
    known = functions.select("address", F.col("primes_value").try_cast("long").alias("prime")).where("prime > 1").join(part, "address", "left")
    return known.groupBy("prime").agg(F.count("*").alias("n_all"), F.count("called").alias("n_called"))


# The primes of the graph hash.
_ENTRY, _EXIT, _BLOCK, _INTO, _OUT, _LOOP, _COMPONENT, _NO_RETURN, _LIBRARY, _THUNK, _CALL, _DATA, _ELSEWHERE = 2, 3, 5, 7, 11, 19, 37, 41, 43, 47, 23, 29, 31


def graph_hash(graphs: DataFrame) -> DataFrame:
    """id and kgh_hash of graphs (id, nodes, edges as in graph_measures, and the counts loops, components, calls, data_refs,
    outer_refs and flags no_return, library, thunk; nulls are 0): a product of primes, as text."""

    @F.pandas_udf("string")
    def product(nodes: pd.Series, edges: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for n, es, c in zip(nodes, edges, counts, strict=True):
            n, es = int(n or 0), es if es is not None else ()
            entries = n - len({e["b"] for e in es if 0 <= e["b"] < n})
            exits = n - len({e["a"] for e in es if 0 <= e["a"] < n})
            powers = [(_ENTRY, entries), (_EXIT, exits), (_BLOCK, n), (_INTO, len(es)), (_OUT, len(es)), *zip((_LOOP, _COMPONENT, _CALL, _DATA, _ELSEWHERE, _NO_RETURN, _LIBRARY, _THUNK), map(int, c), strict=True)]
            out.append(decimal_text(math.prod(p**k for p, k in powers)))
        return pd.Series(out)

    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    counts = F.array(*map(number, ("loops", "components", "calls", "data_refs", "outer_refs", "no_return", "library", "thunk")))
    return graphs.select("id", product("nodes", "edges", counts).alias("kgh_hash"))


def decimal_text(n: int) -> str:
    """The digits of a number of any size: str() writes a few thousand at most."""
    if n < 10**4_000:
        return str(n)
    half = n.bit_length() * 3 // 20
    high, low = divmod(n, 10**half)
    return decimal_text(high) + decimal_text(low).zfill(half)


def cyclomatic(nodes: str = "nodes", edges: str = "edges") -> Column:
    return F.greatest(F.lit(0), F.col(edges) - F.col(nodes) + 2)


def telling_constant(column: str, referenced: Column | None = None) -> Column:
    """Whether a number is large enough, no power of two, no complement of one, and no address that data refers to."""
    n = F.col(column).cast("bigint")
    inverted = F.bitwise_not(n)
    single = lambda x: (x != 0) & (x.bitwiseAND(x - 1) == 0)
    keep = (n >= 0x1000) & ~single(n) & ~single(inverted)
    return F.coalesce(keep & ~referenced if referenced is not None else keep, F.lit(False))


def prime_product(ordinals: str | Column) -> Column:
    """The product of the primes at the given places (from 0), as text; 1 for an empty or null list."""

    @F.pandas_udf("string")
    def run(places: pd.Series) -> pd.Series:
        primes = small_primes()
        return pd.Series([decimal_text(math.prod(primes[i] for i in (x if x is not None else ()))) for x in places])

    return run(ordinals)


def components_in_order(nodes: int, edges: list[tuple[int, int]]) -> tuple[list[list[int]], list[int]]:
    """Strongly connected components in topological order, and each node's place in it (Tarjan, without recursion)."""
    after: list[list[int]] = [[] for _ in range(nodes)]
    for a, b in edges:
        if 0 <= a < nodes and 0 <= b < nodes:
            after[a].append(b)
    index, low, on, stack, found = [-1] * nodes, [0] * nodes, [False] * nodes, [], []
    count = 0
    for root in range(nodes):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            again = False
            for j in range(k, len(after[v])):
                w = after[v][j]
                if index[w] < 0:
                    work += [(v, j + 1), (w, 0)]
                    again = True
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            if again:
                continue
            if low[v] == index[v]:
                part = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    part.append(w)
                    if w == v:
                        break
                found.append(sorted(part))
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
    found.reverse()
    place = [0] * nodes
    for k, part in enumerate(found):
        for v in part:
            place[v] = k
    return found, place


def _prime_at(place: int) -> int:
    """1 beyond the known primes."""
    primes = small_primes()
    return primes[place] if place < len(primes) else 1


#: Sums of square roots are taken with so many digits and told with fewer, so that the order of edges leaves no trace.
_DIGITS, _TOLD = Context(prec=50), Context(prec=21)


@lru_cache(100_000)
def _edge_weight(place: int, own_in: int, own_out: int, other_in: int, other_out: int) -> Decimal:
    c = _DIGITS
    root = lambda n, k: c.multiply(Decimal(n), c.sqrt(Decimal(k)))
    total = Decimal(place)
    for part in (root(own_in, 2), root(own_out, 3), root(other_in, 5), root(other_out, 7)):
        total = c.add(total, part)
    return c.divide(Decimal(1), c.sqrt(total))


def md_text(place: list[int], pairs: list[tuple[int, int]]) -> str:
    """The index of a graph, of 21 digits, from its nodes' topological places and its edges; "0" without edges. Graphs of equal
    places and degrees have equal texts, in whatever order their edges come."""
    out, into = [0] * len(place), [0] * len(place)
    for a, b in pairs:
        out[a] += 1
        into[b] += 1
    total = Decimal(0)
    for a, b in pairs:
        total = _DIGITS.add(total, _edge_weight(place[a], into[a], out[a], into[b], out[b]))
    if not total:
        return "0"
    text = format(_TOLD.plus(total), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def graph_measures(graphs: DataFrame) -> DataFrame:
    """id, strongly_connected, loops, tarjan_topological_sort, md_index (a text of 21 digits, made to be a key) and
    strongly_connected_spp (the product of the primes at the sizes of components of several nodes) for graphs (id, nodes, edges),
    where edges is an array of structs (a, b) of node places. Null edges are none."""

    @F.pandas_udf("strongly_connected long, loops long, tarjan_topological_sort string, md_index string, strongly_connected_spp string")
    def measured(nodes: pd.Series, edges: pd.Series) -> pd.DataFrame:
        rows = []
        for n, es in zip(nodes, edges, strict=True):
            pairs = [(int(e["a"]), int(e["b"])) for e in (es if es is not None else ())]
            parts, place = components_in_order(int(n or 0), pairs)
            own = {a for a, b in pairs if a == b}
            loops = sum(len(p) > 1 or p[0] in own for p in parts)
            md = md_text(place, pairs)
            sizes = decimal_text(math.prod(_prime_at(len(p)) for p in parts if len(p) > 1))
            rows.append((len(parts), loops, str(parts).replace(" ", ""), md, sizes))
        return pd.DataFrame(rows, columns=["strongly_connected", "loops", "tarjan_topological_sort", "md_index", "strongly_connected_spp"])

    return graphs.select("id", measured("nodes", "edges").alias("m")).select("id", "m.*")


def block_sums(data: bytes, size: int = 512) -> bytes:
    """The sums of the bytes of each block, modulo 255, without those that are 0."""
    return bytes(s for k in range(0, len(data), size) if (s := sum(data[k : k + size]) % 255))


def _hash_of(data: bytes, length: int = 32) -> str:
    """Each of the second to 33rd block sums twice, in base64, cut to length; nothing for fewer than 32 sums."""
    sums = block_sums(data)
    if len(sums) < length:
        return ""
    twice = bytes(s for s in sums[1 : length + 1] for _ in range(2))
    return base64.b64encode(twice).decode().rstrip("=")[:length]


def fuzzy_hashes_of(text: str | None) -> tuple[str, str, str]:
    """Hashes of the text with each block doubled, of the text, and of the text from its end."""
    data = (text or "").encode()
    doubled = b"".join(data[k : k + 512] * 2 for k in range(0, len(data), 512))
    return _hash_of(doubled), _hash_of(data), _hash_of(data[::-1])


def fuzzy_hashes(text: str | Column) -> Column:
    """A struct of pseudocode_hash1, pseudocode_hash2 and pseudocode_hash3; empty for short and null texts."""

    @F.pandas_udf("pseudocode_hash1 string, pseudocode_hash2 string, pseudocode_hash3 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fuzzy_hashes_of(t) for t in texts], columns=["pseudocode_hash1", "pseudocode_hash2", "pseudocode_hash3"])

    return run(text)


def byte_hashes(functions: DataFrame, instructions: DataFrame) -> DataFrame:
    """id, bytes_hash, function_hash and bytes_sum of functions (id) from instructions (func_id, pos, bytes, offset1, offset2).

    function_hash digests all bytes of a function's instructions in order. bytes_hash leaves out operands that change with the
    place of code and data: an instruction is cut by the offsets of its first two operands, where these are addresses, numbers
    or displacements (null or 0 where not), to one byte at least. bytes_sum adds up the bytes that are left. Null bytes are
    none; a function without instructions has the digests of nothing. Only one function's instructions come together.
    """
    whole = F.coalesce("bytes", F.lit(b""))
    left = F.octet_length(whole) - F.coalesce("offset1", F.lit(0)) - F.coalesce("offset2", F.lit(0))
    # bytes travel as they are, once; digits are made where a function's instructions have come together
    told = instructions.select("func_id", F.struct("pos", whole.alias("whole"), F.when(left > 0, left).otherwise(1).alias("n")).alias("x"))
    lists = told.groupBy(F.col("func_id").alias("id")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = lambda f: F.coalesce(F.array_join(F.transform("x", f), ""), F.lit(""))
    known = functions.select("id").join(lists, "id", "left")
    known = known.select("id", joined(lambda r: F.substr(F.hex(r["whole"]), F.lit(1), 2 * r["n"])).alias("kept"), joined(lambda r: F.hex(r["whole"])).alias("whole"))
    pairs = F.filter(F.split("kept", "(?<=\\G..)"), lambda p: p != "")
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, p: n + F.conv(p, 16, 10).cast("long"))
    return known.select("id", F.md5(F.unhex("kept")).alias("bytes_hash"), F.md5(F.unhex("whole")).alias("function_hash"), total.alias("bytes_sum"))


def mnemonic_counts(instructions: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """id, ordinal and n: how often each mnemonic stands in each function of instructions (func_id, mnemonic), told by its
    place among all mnemonics in order.

    dictionary (mnemonic): all mnemonics there are, by default those that occur. They are numbered over ranges of their order
    and joined, so a dictionary of any size is one. The product of the primes at the ordinals, each to its power n, is what
    mnemonics_spp says; kept as powers it doesn't grow to thousands of digits. Null, empty and unknown mnemonics don't count.
    """
    counted = instructions.where("mnemonic <> ''").groupBy(F.col("func_id").alias("id"), "mnemonic").agg(F.count("*").alias("n"))
    every = (counted if dictionary is None else dictionary.where("mnemonic <> ''")).select("mnemonic").distinct()
    return counted.join(numbered(every, "mnemonic", column="ordinal"), "mnemonic").select("id", "ordinal", "n")


def mnemonics_product(counts: DataFrame) -> DataFrame:
    """id and mnemonics_spp, the product as text, of mnemonic_counts; an ordinal beyond the known primes counts as 1."""
    lists = counts.where(F.col("ordinal") < len(small_primes())).groupBy("id").agg(F.flatten(F.collect_list(F.array_repeat(F.col("ordinal").cast("int"), F.col("n").cast("int")))).alias("places"))
    return counts.select("id").distinct().join(lists, "id", "left").select("id", prime_product("places").alias("mnemonics_spp"))
