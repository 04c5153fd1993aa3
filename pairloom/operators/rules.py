"""The blocking rules: which records of two snapshots may be the same.

Each rule joins functions f of A and df of B on equal keys, with further conditions. Names, order, thresholds and
categories are fixed values: results depend on them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

UNRELIABLE, SLOW, SAME_CPU = 1, 2, 4
CATEGORIES = ("best", "partial", "experimental", "unreliable")
MODES = ("no_false_positives", "ratio", "ratio_with_minimum", "trusted_ratio_with_minimum")
POSTFIX = "f.instructions > 5 and df.instructions > 5"


@dataclass(frozen=True)
class Rule:
    """keys: columns equal on both sides, or SQL of one; where: further conditions; source: what functions are joined
    with on each side first (constants, units, or none); ordered: rows of one source file come later."""

    name: str
    category: str
    mode: str
    keys: tuple[str, ...]
    where: str = "true"
    minimum: float = 0.0
    flags: int = 0
    distinct: bool = False
    ordered: bool = False
    source: str = ""
    rare: tuple[str, int] | None = None
    also: Rule | None = None
    label: str = ""

    @property
    def unreliable(self) -> bool:
        return self.category == "unreliable" or bool(self.flags & UNRELIABLE)

    @property
    def slow(self) -> bool:
        return bool(self.flags & SLOW)

    @property
    def same_cpu(self) -> bool:
        return bool(self.flags & SAME_CPU)

    def fields(self) -> list[str]:
        """The columns of functions that the rule reads, sorted."""
        text = " ".join([self.where, *(f"f.{k}" for k in self.keys if k.isidentifier()), *(k for k in self.keys if not k.isidentifier())])
        found = set(re.findall(r"\bd?f\.(\w+)", text)) | ({self.rare[0]} if self.rare else set())
        return sorted({re.sub("_length$", "", c) for c in found} | set(self.also.fields() if self.also else ()))

    def least_ratio(self, default: float = 0.5, trusted: float = 0.3) -> float:
        return {"no_false_positives": 1.0, "ratio": default, "ratio_with_minimum": self.minimum}.get(self.mode, self.minimum or trusted)


def both(condition: str) -> str:
    """The condition on f, for both sides."""
    return f"{condition} and {re.sub(r'(^|[^a-z])f[.]', r'\1df.', condition)}"


NAMED = "((f.name = df.name and substr(f.name, 1, 4) <> 'sub_') or substr(f.name, 1, 4) = 'sub_' or substr(df.name, 1, 4) = 'sub_')"
EITHER_SUB = "(substr(f.name, 1, 4) = 'sub_' or substr(df.name, 1, 4) = 'sub_')"
NO_NULLSUB = "f.name not ilike 'nullsub%' and df.name not ilike 'nullsub%'"
LARGE = f"(({both('f.nodes > 1')} and {both('f.instructions > 5')}) or ({both('f.instructions > 10')}))"
HALF_SIZE = "f.nodes is not null and df.nodes is not null and greatest(f.nodes, df.nodes) > 0 and least(f.nodes, df.nodes) * 100 >= 51 * greatest(f.nodes, df.nodes)"

# The rules in their order.
RULES = (
    Rule("Same RVA and hash", "best", "no_false_positives", ("bytes_hash", "instructions"), f"(f.rva = df.rva or f.segment_rva = df.segment_rva) and {NAMED} and {both('f.nodes >= 3')}", flags=SAME_CPU),
    Rule("Same order and hash", "best", "no_false_positives", ("id", "bytes_hash", "instructions"), f"{NAMED} and {LARGE}", flags=SAME_CPU),
    Rule("Function Hash", "best", "no_false_positives", ("function_hash",), LARGE, flags=SAME_CPU, distinct=True),
    Rule("Bytes hash", "best", "no_false_positives", ("bytes_hash",), both("f.instructions > 5"), flags=SAME_CPU, distinct=True),
    Rule("Same address and mnemonics", "best", "ratio", ("address", "mnemonics", "instructions"), f"df.instructions > 5 and {NAMED}", distinct=True, ordered=True),
    Rule("Same cleaned assembly", "best", "ratio", ("clean_assembly",), f"{both('f.nodes >= 3')} and {NO_NULLSUB}", flags=SAME_CPU, ordered=True),
    Rule("Same cleaned microcode", "best", "ratio", ("clean_microcode",), f"{both('f.clean_microcode_length > 0')} and {both('f.instructions > 3')} and {NO_NULLSUB}", flags=SAME_CPU, ordered=True),
    Rule("Same cleaned pseudo-code", "best", "ratio", ("clean_pseudo",), f"{both('f.clean_pseudo_length > 0')} and {both('f.pseudocode_lines > 5')} and {NO_NULLSUB}", ordered=True),
    Rule("Same address, nodes, edges and mnemonics", "best", "ratio", ("rva", "instructions", "nodes", "edges", "mnemonics"), f"{both('f.instructions > 3')} and f.nodes > 1", ordered=True),
    Rule("Same RVA", "best", "ratio_with_minimum", ("rva",), f"{NAMED} and {both('f.nodes >= 3')}", 0.7, SAME_CPU, distinct=True, ordered=True),
    Rule("Equal assembly or pseudo-code", "best", "no_false_positives", ("pseudocode",), f"f.pseudocode_lines >= 5 and {NO_NULLSUB}", label="Equal pseudo-code", also=Rule("Equal assembly", "best", "no_false_positives", ("assembly",), f"{both('f.instructions >= 4')} and {NO_NULLSUB}")),
    Rule("Microcode mnemonics small primes product", "best", "ratio", ("microcode_spp",), f"{both("f.microcode_spp <> '1'")} and {both('f.instructions > 5')} and {both('f.nodes > 2')} and {NO_NULLSUB}", ordered=True),
    Rule("Same unique MD Index", "best", "ratio", ("md_index",), both("f.nodes >= 5"), ordered=True, rare=("md_index", 1)),
    Rule("Same named compilation unit function match", "partial", "trusted_ratio_with_minimum", ("cu_name", "primes_value", "nodes"), "f.cu_name <> '' and f.nodes >= 5", 0.44, source="units"),
    Rule("Same anonymous compilation unit function match", "partial", "ratio_with_minimum", ("cu_name", "pseudocode_primes", "nodes"), "f.cu_name <> '' and f.nodes >= 5", 0.449, ordered=True, source="units"),
    Rule("Same compilation unit", "partial", "ratio", ("cu_pseudocode_primes",), f"{both('f.nodes > 4')} and {EITHER_SUB}", flags=SLOW, source="units"),
    Rule("Same KOKA hash and constants", "partial", "ratio", ("constant", "kgh_hash"), "f.nodes >= 3", source="constants"),
    Rule("Same KOKA hash and MD-Index", "partial", "ratio", ("kgh_hash", "md_index", "nodes", "outdegree", "indegree"), f"f.nodes >= 4 and {EITHER_SUB}"),
    Rule("Same constants", "partial", "ratio_with_minimum", ("constants", "constants_count"), "f.constants_count > 1", 0.5, ordered=True),
    Rule("Same rare KOKA hash", "partial", "ratio_with_minimum", ("kgh_hash",), f"f.nodes > 5 and {EITHER_SUB}", 0.45, rare=("kgh_hash", 2)),
    Rule("Same rare MD Index", "partial", "ratio", ("md_index",), "f.nodes > 10", ordered=True, rare=("md_index", 2)),
    Rule("Same address and rare constant", "partial", "ratio_with_minimum", ("constant", "address"), "true", 0.5, distinct=True, ordered=True, source="constants"),
    Rule("Same rare constant", "partial", "ratio_with_minimum", ("constant",), f"{both('f.nodes >= 3')} and f.constants_count > 0", 0.2, SLOW, source="constants"),
    Rule("Same MD Index and constants", "partial", "ratio", ("md_index", "constants"), f"f.md_index > '0' and {both('f.nodes >= 3')} and f.constants_count > 0", distinct=True, ordered=True),
    Rule("Import names hash", "partial", "ratio", ("names", "md_index", "instructions"), f"f.names <> '[]' and {both('f.nodes > 5')}", distinct=True, ordered=True),
    Rule("Mnemonics and names", "partial", "ratio", ("mnemonics", "instructions", "names"), f"f.names <> '[]' and {both('f.instructions > 5')}", ordered=True),
    Rule("Pseudo-code fuzzy hash", "partial", "ratio", ("pseudocode_hash1", "pseudocode_hash2", "pseudocode_hash3"), both("f.instructions > 5"), distinct=True, ordered=True),
    Rule("Similar pseudo-code and names", "partial", "ratio_with_minimum", ("pseudocode_lines", "names"), f"f.names <> '[]' and df.pseudocode_lines > 5 and {both('f.pseudocode_length is not null')}", 0.579, distinct=True, ordered=True),
    Rule("Mnemonics small-primes-product", "partial", "ratio_with_minimum", ("mnemonics_spp", "instructions"), f"{both('f.nodes > 1')} and df.instructions > 5", 0.6),
    Rule("Same nodes, edges, loops and strongly connected components", "partial", "ratio_with_minimum", ("nodes", "edges", "strongly_connected", "loops"), f"{both('f.nodes > 5')} and f.loops > 0 and {EITHER_SUB}", 0.549),
    Rule("Same low complexity, prototype and names", "partial", "ratio_with_minimum", ("names", "cyclomatic_complexity", "prototype2"), "f.names <> '[]' and f.cyclomatic_complexity < 20", 0.5, distinct=True),
    Rule("Same low complexity and names", "partial", "ratio_with_minimum", ("names", "cyclomatic_complexity"), f"f.names <> '[]' and f.cyclomatic_complexity < 15 and {EITHER_SUB}", 0.5),
    Rule("Switch structures", "partial", "ratio_with_minimum", ("switches",), f"f.switches <> '[]' and {both('f.nodes > 5')}", 0.5, ordered=True),
    Rule("Pseudo-code fuzzy (normal)", "partial", "ratio_with_minimum", ("pseudocode_hash1",), both("f.pseudocode_lines > 5"), 0.5, distinct=True, ordered=True),
    Rule("Pseudo-code fuzzy (mixed)", "partial", "ratio", ("pseudocode_hash3",), both("f.pseudocode_lines > 5"), distinct=True, ordered=True),
    Rule("Pseudo-code fuzzy (reverse)", "partial", "ratio", ("pseudocode_hash2",), both("f.pseudocode_lines > 5"), distinct=True, ordered=True),
    Rule("Pseudo-code fuzzy AST hash", "partial", "ratio_with_minimum", ("pseudocode_primes",), "f.pseudocode_primes_length >= 35 and f.pseudocode_lines >= 3", 0.35, distinct=True, ordered=True),
    Rule("Partial pseudo-code fuzzy hash (normal)", "partial", "ratio_with_minimum", ("substr(f.pseudocode_hash1, 1, 16)",), both("f.nodes > 5"), 0.5, SLOW | UNRELIABLE, distinct=True, ordered=True),
    Rule("Partial pseudo-code fuzzy hash (reverse)", "partial", "ratio_with_minimum", ("substr(f.pseudocode_hash2, 1, 16)",), both("f.nodes > 5"), 0.5, SLOW | UNRELIABLE, distinct=True, ordered=True),
    Rule("Partial pseudo-code fuzzy hash (mixed)", "partial", "ratio_with_minimum", ("substr(f.pseudocode_hash3, 1, 16)",), both("f.nodes > 5"), 0.5, SLOW | UNRELIABLE, distinct=True, ordered=True),
    Rule("Same rare assembly instruction", "partial", "ratio_with_minimum", ("disasm",), f"f.name <> df.name and {HALF_SIZE}", 0.5, SAME_CPU, distinct=True, source="instructions"),
    Rule("Same rare basic block mnemonics list", "partial", "ratio_with_minimum", ("mnemonics_list",), f"{both('f.nodes > 3')} and df.inst_total >= 6 and {HALF_SIZE}", 0.5, source="blocks"),
    Rule("Loop count", "partial", "ratio_with_minimum", ("loops",), f"df.loops > 1 and {both('f.nodes >= 3')}", 0.49, SLOW, ordered=True),
    Rule("Same graph", "unreliable", "ratio_with_minimum", ("nodes", "edges", "indegree", "outdegree", "cyclomatic_complexity", "strongly_connected", "loops", "tarjan_topological_sort", "strongly_connected_spp"), both("f.nodes > 5"), 0.5),
    Rule("Strongly connected components", "unreliable", "ratio_with_minimum", ("strongly_connected",), f"df.strongly_connected > 1 and {both('f.nodes > 5')} and f.strongly_connected_spp > '1' and df.strongly_connected_spp > '1'", 0.8, SLOW, ordered=True),
    Rule("Nodes, edges, complexity and mnemonics", "unreliable", "ratio", ("nodes", "edges", "mnemonics", "cyclomatic_complexity"), "f.nodes > 1 and f.edges > 0", flags=SLOW, distinct=True, ordered=True),
    Rule("Nodes, edges, complexity and prototype", "unreliable", "ratio", ("nodes", "edges", "prototype2", "cyclomatic_complexity"), "f.prototype2 <> 'int()'", flags=SLOW, distinct=True, ordered=True),
    Rule("Nodes, edges, complexity, in-degree and out-degree", "unreliable", "ratio", ("nodes", "edges", "cyclomatic_complexity", "indegree", "outdegree"), "f.nodes >= 3 and f.edges > 2", flags=SLOW, distinct=True, ordered=True),
    Rule("Nodes, edges and complexity", "unreliable", "ratio", ("nodes", "edges", "cyclomatic_complexity"), "f.nodes > 1 and f.edges > 0", flags=SLOW, distinct=True, ordered=True),
    Rule("Same high complexity", "unreliable", "ratio", ("cyclomatic_complexity",), "f.cyclomatic_complexity >= 50", flags=SLOW, ordered=True),
    Rule("Topological sort hash", "unreliable", "ratio", ("strongly_connected", "tarjan_topological_sort"), "f.strongly_connected >= 3 and f.nodes > 10", ordered=True),
)


def slug(k: int) -> str:
    """rule_01_same_rva_and_hash for the first rule, and so on."""
    return f"rule_{k + 1:02d}_{re.sub('[^a-z0-9]+', '_', RULES[k].name.lower()).strip('_')}"


def gated(rules: tuple[Rule, ...] = RULES, *, same_cpu: bool = True, slow: bool = True, unreliable: bool = False, experimental: bool = False) -> list[tuple[int, Rule]]:
    """The rules that options let run, with their places in the order."""
    return [
        (k, r)
        for k, r in enumerate(rules)
        if (experimental or r.category != "experimental") and (unreliable or not r.unreliable) and (same_cpu or not r.same_cpu) and (slow or not r.slow)
    ]


def problems(rules: tuple[Rule, ...] = RULES, columns: frozenset[str] | None = None) -> list[str]:
    """What is wrong with a list of rules: repeated names, missing minimums, unknown columns, flags that exclude each other."""
    out, seen = [], set()
    for r in rules:
        if r.name in seen:
            out.append(f"{r.name}: the name is taken")
        seen.add(r.name)
        if r.category not in CATEGORIES or r.mode not in MODES:
            out.append(f"{r.name}: unknown category or mode")
        if r.mode == "ratio_with_minimum" and not r.minimum:
            out.append(f"{r.name}: no minimum")
        if not r.fields():
            out.append(f"{r.name}: no column")
        if r.same_cpu and r.slow:
            out.append(f"{r.name}: both slow and for one processor")
        joined = {"constant", "cu_name", "cu_pseudocode_primes", "disasm", "mnemonics_list", "inst_total"}
        if columns is not None and (unknown := set(r.fields()) - columns - joined):
            out.append(f"{r.name}: unknown column {', '.join(sorted(unknown))}")
    return out


def renamed(rule: Rule, name: str) -> Rule:
    return replace(rule, name=name)
