"""Features of an export and the full import plan against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import features
from pairloom.operators import importplan, textdiff
from pairloom.operators.similarity import small_primes
from pairloom.sources.snapshot import Snapshot
from pairloom.sources.testpair import pair


def test_byte_hashes_cut_operands(spark):
    rows = [(1, 1, b"\xaa\x01\x02", 1, None), (1, 0, b"\x10\x20\x30\x40", 1, 2), (1, 2, b"\x99", 5, 5), (2, 0, None, None, None), (4, 0, b"\x00\xff", 0, 0)]
    instructions = spark.createDataFrame(rows, "func_id long, pos int, bytes binary, offset1 int, offset2 int")
    found = {r.id: r for r in features.byte_hashes(spark.range(1, 5).toDF("id"), instructions).collect()}
    md5 = lambda b: hashlib.md5(b).hexdigest()
    wanted = {1: (b"\x10\xaa\x01\x99", b"\x10\x20\x30\x40\xaa\x01\x02\x99"), 2: (b"", b""), 3: (b"", b""), 4: (b"\x00\xff", b"\x00\xff")}
    assert {k: (r.bytes_hash, r.function_hash, r.bytes_sum) for k, r in found.items()} == {k: (md5(x), md5(y), sum(x)) for k, (x, y) in wanted.items()}


def test_mnemonics_count_by_their_place(spark):
    rows = [(1, "mov"), (1, "add"), (1, "mov"), (2, "ret"), (2, None), (3, ""), (2, "odd")]
    instructions = spark.createDataFrame(rows, "func_id long, mnemonic string")
    dictionary = spark.createDataFrame([("ret",), ("add",), ("mov",), ("add",), (None,)], "mnemonic string")
    known = features.mnemonic_counts(instructions, dictionary)
    assert sorted(map(tuple, known.collect())) == [(1, 0, 1), (1, 1, 2), (2, 2, 1)]
    p = small_primes()
    assert {r.id: int(r.mnemonics_spp) for r in features.mnemonics_product(known).collect()} == {1: p[0] * p[1] ** 2, 2: p[2]}
    assert sorted(map(tuple, features.mnemonic_counts(instructions).collect())) == [(1, 0, 1), (1, 1, 2), (2, 2, 1), (2, 3, 1)]
    assert features.mnemonic_counts(instructions.limit(0)).count() == 0


def test_graph_texts_do_not_depend_on_the_order_of_edges():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 12)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 40))]
        place = features.components_in_order(n, edges)[1]
        text = features.md_text(place, edges)
        out, into = ([sum(e[k] == v for e in edges) for v in range(n)] for k in (0, 1))
        plain = math.fsum(1 / math.sqrt(place[a] + into[a] * 2**0.5 + out[a] * 3**0.5 + into[b] * 5**0.5 + out[b] * 7**0.5) for a, b in edges)
        assert float(text) == pytest.approx(plain, rel=1e-12)
        assert len(text.replace(".", "").lstrip("0")) <= 21
        for _ in range(5):
            rng.shuffle(edges)
            assert features.md_text(place, edges) == text
    assert features.md_text([0, 0], []) == "0"


def test_microcode_lines_of_two_words_are_skipped(spark):
    df = spark.createDataFrame([("goto 5\n1 mov eax, ebx\nret\n2. add r1, r2 ; goto 7\nadd x;mov a, b",)], "m string")
    found = df.select(features.clean_microcode("m").alias("c"), features.microcode_mnemonics("m").alias("p")).first()
    assert found.c == "mov eax, ebx\nadd r1, r2"
    assert [sorted(features.MICROCODE)[k] for k in found.p] == ["mov", "add"]


def plain_operands(text):
    """A character at a time."""
    out, at = [], 0

    def skip():
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def take(c):
        nonlocal at
        skip()
        if at < len(text) and text[at] == c:
            at += 1
            return True
        return False

    if not text or not take("["):
        return []
    while at < len(text):
        skip()
        if text[at : at + 1] == "]":
            break
        if not take("["):
            return []
        skip()
        digits = ""
        while at < len(text) and text[at].isdigit():
            digits, at = digits + text[at], at + 1
        if not digits or not take(",") or not take('"'):
            return []
        name, closed = "", False
        while at < len(text) and not closed:
            c, at = text[at], at + 1
            if c == '"':
                closed = True
            elif c == "\\" and at < len(text):
                name, at = name + text[at], at + 1
            else:
                name += c
        if not closed or not take("]"):
            return []
        if name:
            out.append((int(digits), name))
        skip()
        if text[at : at + 1] == ",":
            at += 1
    return out


def test_forced_operands_equal_reading_one_character_at_a_time(spark):
    texts = [None, "", "[]", "[", '[[0,"a"]]', ' [ [ 1 , "b c" ] , [2,"d\\"e\\\\"] ]', '[[0,""],[1,"x"]]', '[[0,"a"]', '[[0,"a"],', '[[0,"a"], ', '[[0,"a"],[x,"b"]]', '[[0,"a"][1,"b"]]', '[[0,"a"]] rest [[1,"b"]]', '[["a",0]]', '[[0,"a\n"]]', '[[0,"a]']
    rng = random.Random(1)
    texts += ["".join(rng.choice(['[', ']', ',', '"', "1", "a", " ", "\\", '[1,"b"]']) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += ["[" + ",".join(rng.choice(['[1,"b"]', '[2, "c\\""]', '[3,""]', "[4]"]) for _ in range(rng.randint(1, 3))) + rng.choice(["]", "", " ", ", "]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r.k: [(p.number, p.name) for p in r.o] for r in df.select("k", importplan.forced_operands("t").alias("o")).collect()}
    assert [(t, found[k]) for k, t in enumerate(texts)] == [(t, plain_operands(t)) for t in texts]


def test_the_plan_brings_from_b_to_a_and_says_what_it_skips(spark):
    functions = lambda rows: spark.createDataFrame(rows, "id long, name string, prototype string, comment string, function_flags long")
    words = "func_id long, pos int, comment1 string, comment2 string, pseudocomment string, operand_names string"
    a = Snapshot({"functions": functions([(1, "old", None, "", 0), (2, "x", "p", "c", 4), (3, "y", "", "", 0)]), "instructions": spark.createDataFrame([(1, 0, "", None, "z", ""), (1, 1, "k", "", "", '[[0,"q"]]')], words)})
    b = Snapshot({"functions": functions([(1, "new", "int f()", "why", 2), (2, "sub_1", "p", "c", 4), (3, "", "", None, None)]), "instructions": spark.createDataFrame([(1, 0, "m", "n", "z", '[[0,"r"],[1,"s"]]'), (1, 1, "k", None, "t", '[[0,"q"]]'), (1, 2, "far", "", "", "")], words)})
    matches = spark.createDataFrame([(1, 1, "best", 1.0), (2, 2, "partial", 0.5), (3, 3, "best", 0.9), (1, 9, "best", 1.0), (1, 2, "partial", 0.4), (2, 1, "multimatch", 1.0), (3, 2, None, None)], "a_id long, b_id long, kind string, ratio double")
    found = {tuple(r) for r in importplan.plan(matches, a, b, importplan.Options(flags=True)).collect()}
    assert found == {
        (1, 1, None, "rename_function", "new", None), (1, 1, None, "apply_prototype", "int f()", None), (1, 1, None, "set_function_comment", "why", None), (1, 1, None, "set_function_flags", None, 2),
        (1, 1, 0, "set_instruction_comment", "m", None), (1, 1, 0, "set_repeatable_instruction_comment", "n", None), (1, 1, 0, "set_forced_operand", "r", 0), (1, 1, 0, "set_forced_operand", "s", 1), (1, 1, 1, "set_pseudocode_comment", "t", None),
        (2, 2, None, "skip_auto_name", None, None), (3, 3, None, "skip_empty_name", None, None), (1, 9, None, "skip_missing_source", None, None), (1, 2, None, "skip_ratio", None, None), (2, 1, None, "skip_kind", None, None), (3, 2, None, "skip_kind", None, None),
    }
    plain = importplan.plan(matches, a, b, importplan.Options(kinds=("partial",), skip_auto_names=False, instruction_comments=False, operands=False, pseudocode_comments=False))
    assert {(r.operation, r.value) for r in plain.where("operation not like 'skip%'").collect()} == {("rename_function", "sub_1")}
    assert importplan.plan(matches.limit(0), a, b).count() == 0


def _commented(spark, rows):
    functions = spark.createDataFrame([(k, "n") for k in {r[0] for r in rows}], "id long, name string")
    return Snapshot({"functions": functions, "instructions": spark.createDataFrame(rows, "func_id long, pos int, comment1 string")})


def test_instructions_meet_by_place_whether_or_not_places_have_gaps(spark):
    """Record 1 has all its places, 2 lacks some, 3 has some twice, 4 has one twice and lacks one, 5 starts late."""
    places = {1: [0, 1, 2, 3], 2: [0, 2, 3], 3: [0, 1, 1, 2], 4: [0, 0, 2], 5: [2, 3, 4]}
    x = [(k, p, "old" if i % 2 else None) for k, at in places.items() for i, p in enumerate(at)]
    y = [(k + 10, p, c) for k in places for p, c in ((0, "old"), (1, "new"), (2, None), (2, "new"), (3, ""), (3, "old"), (4, "new"), (9, "far"))]
    matches = spark.createDataFrame([(k, k + 10, "best", 1.0) for k in (*places, 1)], "a_id long, b_id long, kind string, ratio double")
    found = importplan.plan(matches, _commented(spark, x), _commented(spark, y)).where("operation like 'set_%'")
    wanted = [(k, k + 10, p, "set_instruction_comment", d, None) for k in (*places, 1) for i, p, c in x if i == k for j, q, d in y if j == k + 10 and q == p and d and d != c]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str) and len(wanted) > 15


def _shuffled(spark):
    """Rows that this session's stages have shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_instructions_that_carry_nothing_are_not_sent(spark, tmp_path):
    """Both sides have 20,000 instructions, of which 200 have a comment."""
    rows = [(k, p, f"c{p}" if p % 100 == k % 2 else None) for k in range(20) for p in range(1_000)]
    a, b = _commented(spark, rows), _commented(spark, [(k, p, c and c + "!") for k, p, c in rows])
    for s, k in ((a, "a"), (b, "b")):
        s.instructions.write.parquet(str(tmp_path / k))
        s.frames["instructions"] = spark.read.parquet(str(tmp_path / k))
    before = _shuffled(spark)
    found = importplan.plan(spark.createDataFrame([(k, k, "best", 1.0) for k in range(20)], "a_id long, b_id long, kind string, ratio double"), a, b)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert found.where("operation like 'set_%'").count() == 200
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert _shuffled(spark) - before < 5_000


def test_records_of_one_snapshot_side_by_side(spark):
    a, _ = pair(spark, "/root/testdata/sf0.001")
    pairs = a.functions.where("id <= 6").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    found = textdiff.within(pairs, a)
    assert set(found) == {"lines", "blocks", "edges", "callees", "callers"}
    assert {r.status for k in ("blocks", "edges") for r in found[k].collect()} <= {"same"}
    assert all(r.callee_a == r.callee_b for r in found["callees"].collect()) and all(r.caller_a == r.caller_b for r in found["callers"].collect())
    assert {r.kind for r in found["lines"].collect()} == {"same"}
    assert textdiff.within(pairs.withColumn("b_id", F.lit(-1).cast("long")), a)["lines"].count() == 0
