"""Two snapshots of one body of records, made from the `documents` table: A is the table, B a changed edition of it.

B lacks the later copies of equal texts; some phrases of its texts are replaced and some lines broken, wherever they stand,
and some names and addresses are others. All columns are made of whole texts.
The same definitions are written for Spark SQL and for DuckDB; only splitting, unnesting and regular expressions differ.
Null texts count as empty. doc_id must be unique and not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.sources.snapshot import Snapshot
from pairloom.sources.tables import table

TABLES = ("functions", "instructions", "blocks", "block_edges", "callgraph", "constants", "compilation_units", "compilation_unit_functions")


def _words(dialect: str, expression: str, sort: bool) -> str:
    """JSON text of the distinct words of `expression` of ten or more letters, or capitalised ones of six or more."""
    split = {"spark": f"split({expression}, ' ')", "duckdb": f"string_split({expression}, ' ')"}[dialect]
    long = "length(x) >= 10" if sort else "length(x) >= 6 and substr(x, 1, 1) between 'A' and 'Z'"
    if dialect == "spark":
        return f"concat('[', array_join(transform(array_sort(array_distinct(filter({split}, x -> {long}))), x -> concat('\"', x, '\"')), ','), ']')"
    return f"'[' || coalesce(array_to_string([('\"' || x || '\"') for x in list_sort(list_distinct([x for x in {split} if {long}]))], ','), '') || ']'"


def _functions(dialect: str, side: str, source: str) -> str:
    spark = dialect == "spark"
    g = "" if spark else ", 'g'"
    changed = "coalesce(text, '')" if side == "a" else "replace(replace(replace(coalesce(text, ''), ' of the ', ' of the system '), ' de ', ' di '), ' der ', ' der' || chr(10))"
    text = "coalesce(text, '')"
    equal = f"unhex(md5({text}))" if spark else text  # a wide text as a key travels as its MD5
    keep = "" if side == "a" else f"where doc_id in (select min(doc_id) from {source} group by {equal})"
    # a letter for each line, so like texts have like strings
    digest = "array_join(transform({}, x -> substr(md5(x), 1, 1)), '')" if spark else "coalesce(array_to_string([substr(md5(x), 1, 1) for x in {}], ''), '')"
    lines = "split(clean_pseudo, chr(10))" if spark else "string_split(clean_pseudo, chr(10))"
    in_order = f"array_sort({lines})" if spark else f"list_sort({lines})"
    name = "'fn_' || cast(doc_id as string)" if side == "a" else "case when doc_id % 3 = 0 then 'sub_' else 'fn_' end || cast(doc_id as string)"
    address = "4096 + 16 * doc_id" if side == "a" else "4096 + 16 * doc_id + case when doc_id % 13 = 0 then 8 else 0 end"
    count = lambda c: f"(length(text) - length(replace(text, {c}, '')))"
    return f"""
select id, doc_id, name, cast(null as string) mangled_function, address, address rva, segment_rva, source_file, nodes, nodes - 1 + commas edges, nodes - 1 + commas - nodes + 2 cyclomatic_complexity,
  doc_id % 3 indegree, doc_id % 4 outdegree, size, instructions, 1 + nodes % 9 + dots % 3 strongly_connected, dots % 8 loops, nodes pseudocode_lines,
  length(constants) - length(replace(constants, '","', 'xx')) + case when constants = '[]' then 0 else 1 end constants_count,
  text pseudocode, clean_pseudo, text assembly, clean_assembly, regexp_replace(clean_assembly, '[aeiou]', ''{g}) clean_microcode, regexp_replace(clean_assembly, '[^a-z]', ''{g}) mnemonics,
  '["fn_' || cast(doc_id + 1 as string) || '"' || case when names = '[]' then ']' else ',' || substr(names, 2) end names, constants, case when nodes % 6 = 0 then '[[' || cast(nodes as string) || ']]' else '[]' end switches, lang || '(' || cast(instructions % 5 as string) || ')' prototype2, '[[' || cast(nodes as string) || ']]' tarjan_topological_sort,
  md5(text) bytes_hash, md5(clean_pseudo) function_hash, {digest.format(lines)} pseudocode_hash1, reverse({digest.format(lines)}) pseudocode_hash2, {digest.format(in_order)} pseudocode_hash3,
  cast(pow(2, nodes % 7) as bigint) || '' primes_value, cast(cast(pow(2, nodes % 7) * pow(3, (nodes - 1 + commas) % 5) * pow(5, instructions % 4) as bigint) as string) || '000000000000000000000000000000' pseudocode_primes,
  cast(cast(pow(2, nodes % 7) * pow(3, instructions % 5) as bigint) as string) mnemonics_spp, cast(cast(pow(2, nodes % 5) * pow(3, instructions % 3) as bigint) as string) microcode_spp, cast(cast(pow(2, 1 + nodes % 9) as bigint) as string) strongly_connected_spp,
  cast(nodes * 1000 + nodes - 1 + commas as string) kgh_hash, cast((nodes - 1 + commas) * 7 + nodes * 3 + dots as string) md_index
from (select *, regexp_replace(lower(text), '[0-9]+', 'N'{g}) clean_pseudo, regexp_replace(lower(text), '[.,;:!?]', ''{g}) clean_assembly, {_words(dialect, "plain", True)} constants, {_words(dialect, "plain", False)} names
  from (select doc_id, doc_id + 1 id, {name} name, cast({address} as string) address, cast({address} + 1 as string) segment_rva, source source_file, lang, text, length(text) size, {count("chr(10)")} + 1 nodes, {count("' '")} + 1 instructions, {count("','")} commas, {count("'.'")} dots,
      replace(replace(replace(text, chr(10), ' '), '"', ''), chr(92), '') plain
    from (select doc_id, lang, source, {changed} text from {source} {keep}) changed) counted) cleaned"""


def _sql(dialect: str, side: str, source: str = "documents") -> dict[str, str]:
    f = f"{side}_functions"
    if dialect == "spark":
        token = f"select id func_id, pos, disasm from (select id, posexplode(split(assembly, ' ')) as (pos, disasm) from {f})"
        line = f"select id func_id, num, line from (select id, posexplode(split(assembly, chr(10))) as (num, line) from {f})"
        constant = f"select id func_id, explode(array_distinct(from_json(constants, 'array<string>'))) constant from {f}"
        # the first two letters of each word, in order
        block = f"select func_id, num, func_id * 1000000 + num bb_id, array_join(transform(filter(split(line, ' '), x -> x <> ''), x -> lower(substr(x, 1, 2))), ',') mnemonics_list, size(filter(split(line, ' '), x -> x <> '')) inst_total from ({line})"
    else:
        token = f"select id func_id, cast(pos - 1 as integer) pos, disasm from (select id, unnest(string_split(assembly, ' ')) disasm, generate_subscripts(string_split(assembly, ' '), 1) pos from {f})"
        line = f"select id func_id, cast(num - 1 as integer) num, line from (select id, unnest(string_split(assembly, chr(10))) line, generate_subscripts(string_split(assembly, chr(10)), 1) num from {f})"
        constant = f"select func_id, constant from (select id func_id, unnest(list_distinct(from_json(constants, '[\"VARCHAR\"]'))) constant from {f})"
        block = f"select func_id, num, func_id * 1000000 + num bb_id, coalesce(array_to_string([lower(substr(x, 1, 2)) for x in string_split(line, ' ') if x <> ''], ','), '') mnemonics_list, len([x for x in string_split(line, ' ') if x <> '']) inst_total from ({line})"
    # each block leads to the next, and some lead back
    edge = f"select x.func_id, x.num parent, x.num + 1 child from ({block}) x join ({block}) y on y.func_id = x.func_id and y.num = x.num + 1 union all select func_id, num parent, cast(floor(num / 2) as int) child from ({block}) x where inst_total % 3 = 0 and num > 0"
    call = " union all ".join(f"select f.id func_id, g.address address, 'call near' type, {k} ordinal from {f} f join {f} g on g.id = f.id + {k} where f.doc_id % 4 = 0" for k in (1, 2))
    return {
        f: _functions(dialect, side, source),
        f"{side}_instructions": token,
        f"{side}_blocks": block,
        f"{side}_block_edges": edge,
        f"{side}_callgraph": call,
        f"{side}_constants": constant,
        f"{side}_compilation_units": f"select min(id) cu_id, source_file name, count(*) functions, min(pseudocode_primes) pseudocode_primes, min(primes_value) primes_value, min(cast(address as bigint)) start_ea, max(cast(address as bigint)) end_ea from {f} where source_file is not null group by source_file",
        f"{side}_compilation_unit_functions": f"select cu_id, id func_id from {f} join (select min(id) cu_id, source_file from {f} where source_file is not null group by source_file) u using (source_file)",
    }


def duckdb_ctes(*names: str) -> str:
    """`with` clauses that define the named snapshot tables and what they need."""
    every = _sql("duckdb", "a") | _sql("duckdb", "b")
    wanted = [n for n in every if n in names or n.endswith("_functions") and n.count("_") == 1 and any(x.startswith(n[:2]) for x in names)]
    return "with " + ",\n".join(f"{n} as materialized ({every[n]})" for n in wanted)


def pair(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """Snapshots A and B of a scale-factor directory."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = []
    for side in "ab":
        queries = _sql("spark", side, "{documents}")
        f = f"{side}_functions"
        functions = spark.sql(queries[f], documents=documents)
        frames: dict[str, DataFrame] = {"functions": functions}
        for name in TABLES[1:]:
            frames[name] = spark.sql(queries[f"{side}_{name}"].replace(f, "{functions}"), functions=functions)
        out.append(Snapshot(frames, {"processor": "text"}))
    return out[0], out[1]
