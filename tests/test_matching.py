"""Similarity, assignment and the smaller operators against small models of their own."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import assign, candidates, ml, patchscan, propagate, ranges, refine, results, rules, similarity, textdiff
from pairloom.plans import session
from pairloom.sources import snapshot
from pairloom.sources.snapshot import Snapshot, SnapshotError
from pairloom.sources.testpair import pair


@pytest.mark.parametrize(("left", "right", "wanted"), [("a\nb\nc", "a\nx\nc", 0.6666667), ("a\nb", "b\na", 1.0), ("a\nb\nb", "b\nb\nc", 0.6666667), ("", "a", 0.0), (None, None, 0.0)])
def test_quick_ratio(left, right, wanted):
    assert similarity.quick_ratio_of(left, right) == pytest.approx(wanted, abs=1e-7)


@pytest.mark.parametrize(("left", "right", "wanted"), [("30", "42", 1 / 3), ("30", "30", 1.0), ("2310", "2730", 0.6), ("30030", "39270", 2 / 3), ("4", "9", -1.0), ("", "9", 0.0), ("1", "0", 0.0)])
def test_prime_ratio(left, right, wanted):
    assert similarity.prime_ratio_of(left, right) == pytest.approx(wanted)


def test_rules_are_complete():
    assert len(rules.RULES) == 51 and not rules.problems()
    assert len(rules.gated()) == 40 and len(rules.gated(slow=False)) == 37
    twice = (rules.RULES[0], rules.renamed(rules.RULES[1], rules.RULES[0].name))
    assert rules.problems(twice)


def _greedy(pairs):
    a, b, out = set(), set(), set()
    for w, x, y in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.add((x, y))
    return out


def test_greedy_equals_the_sequential_one(spark):
    pick, rows, wanted = random.Random(3), [], set()
    for g in range(12):
        pairs = [(pick.randrange(4), x, y) for x, y in {(pick.randrange(9), pick.randrange(9)) for _ in range(25)}]
        rows += [(g, *p) for p in pairs]
        wanted |= {(g, x, y) for x, y in _greedy(pairs)}
    df = spark.createDataFrame(rows, "g int, w int, a_id long, b_id long")
    found = assign.greedy(df, [F.col("w").desc(), F.col("a_id"), F.col("b_id")], ["g"]).collect()
    assert {(r.g, r.a_id, r.b_id) for r in found} == wanted


def _classify(matches):
    a, b, given, out = set(), set(), set(), {}
    for rule, x, y, ratio, below, _, name_a, name_b in sorted(matches):
        if name_a.startswith("nullsub_") or name_b.startswith("nullsub_") or (x, y) in given or (x in a) and (y in b) or (x in a or y in b) and ratio < 1:
            out[rule, x, y] = None
            continue
        given.add((x, y))
        if x in a or y in b:
            out[rule, x, y] = "multimatch"
        else:
            a.add(x)
            b.add(y)
            out[rule, x, y] = "best" if ratio >= 1 else below
    return out


def test_classify_equals_the_sequential_one(spark):
    pick, rows = random.Random(5), []
    for rule in range(8):
        xs, ys = random.Random(rule).sample(range(9), 6), random.Random(rule + 50).sample(range(9), 6)
        rows += [(rule, x, y, pick.choice((0.6, 1.0)), "partial", "", pick.choice(("f", "nullsub_1", "nullsubX")), "g") for x, y in zip(xs, ys, strict=True)]
    df = spark.createDataFrame(rows, "rule int, a_id long, b_id long, ratio double, below_one string, description string, name_a string, name_b string")
    found = {(r.rule, r.a_id, r.b_id): r.kind for r in assign.classify(df).collect()}
    assert found == _classify(rows)


def test_ranges(spark):
    pick = random.Random(1)
    rows = [(i, pick.randrange(1000), i if pick.random() < 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, at long, mark long")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r.id: r.line for r in ranges.numbered(df, "at", "id").collect()} == {r[0]: k for k, r in enumerate(order)}
    last, wanted = None, {}
    for i, _, mark in order:
        last = mark if mark is not None else last
        wanted[i] = last
    assert {r.id: r.mark for r in ranges.last_mark(df, ("at", "id"), "mark").collect()} == wanted


def test_line_script():
    for left, right in (("a\nb\nc", "a\nc\nd"), ("", "x"), ("x", ""), ("", ""), ("a\na", "a")):
        script = textdiff.line_script(left, right)
        x, y = similarity.split_lines(left), similarity.split_lines(right)
        assert [x[i] for k, i, _ in script if k != "added"] == x and [y[j] for k, _, j in script if k != "removed"] == y
        assert all(x[i] == y[j] for k, i, j in script if k == "same")
    pick = random.Random(8)
    for _ in range(300):
        x, y = ([pick.choice("abcd") for _ in range(pick.randrange(14))] for _ in "ab")
        assert textdiff.line_script("\n".join(x), "\n".join(y)) == _script(x, y)
        table = _table(x, y)
        assert similarity.lcs_ratio_of("\n".join(x), "\n".join(y)) == (2 * table[-1][-1] / (len(x) + len(y)) if x and y else 0.0)
    long = [str(k % 997) for k in range(12_000)]
    script = textdiff.line_script("\n".join(long), "\n".join([*long[:500], "new", *long[501:9_000], *long[9_001:]]))
    assert [k for k, _, _ in script].count("same") == 11_998 and len(script) == 12_001


def _table(x, y):
    rows = [[0] * (len(y) + 1)]
    for a in x:
        rows.append([0])
        for j, b in enumerate(y):
            rows[-1].append(rows[-2][j] + 1 if a == b else max(rows[-2][j + 1], rows[-1][j]))
    return rows


def _script(x, y):
    """The same from the whole table."""
    rows, out, i, j = _table(x, y), [], len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(("same", i, j))
        elif j and (not i or rows[i][j - 1] >= rows[i - 1][j]):
            j -= 1
            out.append(("added", None, j))
        else:
            i -= 1
            out.append(("removed", i, None))
    return out[::-1]


def test_diffs_as_rows(spark):
    rows = [(1, 1, "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk", "a\nb\nx\nd\ne\nf\ng\nh\ni\nj\nk\nl"), (2, 2, "a", "a"), (3, 3, None, "z"), (4, 4, "", None)]
    pairs = spark.createDataFrame(rows, "a_id long, b_id long, text_a string, text_b string")
    found = {r.a_id: r.diff for r in textdiff.unified_diff(pairs, context=1).collect()}
    assert found == {1: "--- a\n+++ b\n@@ -2,3 +2,3 @@\n b\n-c\n+x\n d\n@@ -11 +11,2 @@\n k\n+l", 2: "", 3: "--- a\n+++ b\n@@ -0,0 +1 @@\n+z", 4: ""}
    side = textdiff.changed_rows(textdiff.line_diff(pairs)).where("a_id = 1 and kind <> 'same'").orderBy("at").collect()
    assert [(r.kind, r.left_index, r.right_index) for r in side] == [("changed", 2, 2), ("added", None, 11)]


def test_patch_scan(spark):
    rows = [
        (1, "jl label1\nmov eax, 1", "jb label1\nmov eax, 1"),
        (2, "mov eax, 1\nret", "mov eax, 1\nret"),
        (3, "x = foo();\nreturn x;", "x = foo();\nsprintf(buf, x);\nreturn x;"),
        (4, "x = read();\nprocess(x);", "x = read();\nif ( x < max_size )\nprocess(x);"),
        (5, None, None),
        (6, "", "if ( x > 0 )"),
    ]
    found = {r.id: (r.indicator, r.detail) for r in patchscan.scan(spark.createDataFrame(rows, "id int, text_a string, text_b string")).collect()}
    assert found[1] == ("signed_unsigned", "jl -> jb") and found[2] == (None, None) and found[5] == (None, None) and found[6] == (None, None)
    assert found[3][0] == "unsafe_pattern" and "printf" in found[3][1]
    assert found[4][0] == "size_check"


def test_ensemble(spark):
    model = ml.Ensemble.parse('{"features": ["ratio"], "trees": [{"nodes": [{"feature": 0, "threshold": 0.5, "left": 1, "right": 9}, {"value": 0.4}]}]}')
    found = spark.createDataFrame([(0.5,), (0.6,)], "ratio double").select(model.score().alias("s")).collect()
    assert [r.s for r in found] == [0.4, 0.0]
    with pytest.raises(ValueError):
        ml.Ensemble.parse('{"features": [], "trees": []}')


def test_snapshot_folder(spark, tmp_path):
    a, b = pair(spark, "/root/testdata/sf0.001")
    narrow = lambda s: Snapshot({"functions": s.functions.select("id", "name", "address", "nodes", "instructions", "bytes_hash"), "constants": s.constants})
    narrow(a).save(str(tmp_path))
    n = snapshot.load(spark, str(tmp_path), "functions", "constants").functions.count()
    narrow(b).append(str(tmp_path))
    more = snapshot.load(spark, str(tmp_path)).functions
    assert more.count() > n and more.select("address").distinct().count() == more.count()
    with pytest.raises(SnapshotError):
        Snapshot({"functions": a.functions.where("false").select("id", "name", "address", "nodes", "instructions", "bytes_hash")}).validate()
    with pytest.raises(SnapshotError):
        Snapshot({}).validate()


def test_address_numbers(spark):
    rows = [("4096",), ("0x1000",), ("1f",), ("",), (None,), ("zz",), ("18446744073709551615",)]
    found = [r.n for r in spark.createDataFrame(rows, "x string").select(snapshot.address_number("x").alias("n")).collect()]
    assert [None if x is None else int(x) for x in found] == [4096, 4096, 31, None, None, None, 2**64 - 1]


def test_session(spark):
    a, b = pair(spark, "/root/testdata/sf0.001")
    steps, vetoed = [], rules.RULES[0].name
    hooks = session.Hooks(on_progress=steps.append, on_candidates=lambda r, df: None if r.name == vetoed else df)
    found = session.run(a, b, session.Options(propagation=False), hooks)
    rows = found.results.collect()
    assert rows and sorted(r.line for r in rows) == list(range(len(rows))) and "rules" in steps
    clear = [r for r in rows if r.type != "multimatch"]
    assert len({r.address for r in clear}) == len(clear) == len({r.address2 for r in clear})
    assert all(s.candidates == s.accepted + s.rejected + s.skipped + s.multimatches for s in found.stats.collect())
    assert found.stats.where(F.col("name") == vetoed).first().candidates == 0
    same = session.run(a, a, session.Options(propagation=False, equal_share=0.99))
    assert same.notes["nearly_equal"] and same.unmatched.isEmpty()
    exact = session.run_exact(a, a)
    assert exact.results.where("type = 'best'").count() > 0 and not exact.unmatched.isEmpty()


def test_rules_equal_a_session_one_by_one(spark):
    """Assignment, classification, cleaning and ambiguity of twelve rules, pair by pair, against the session's."""
    a, b = pair(spark, "/root/testdata/sf0.001")
    wanted = [r for r in rules.RULES if not r.slow][4:16]
    found = session.run(a, b, session.Options(propagation=False, blocks=False), session.Hooks(rules=lambda _: tuple(wanted)))
    x, y = ({r.id: r for r in s.functions.select("id", "address", "name").collect()} for s in (a, b))
    equal = {(r.address, r.name) for r in candidates.equal_rows(a, b).collect()}
    matches = [(i, j, 1.0, "best") for i, r in x.items() for j, t in y.items() if (r.address, r.name) in equal and (t.address, t.name) == (r.address, r.name)]
    seeds = spark.createDataFrame([m[:2] for m in matches], "a_id long, b_id long")
    matches += [(r.a_id, r.b_id, r.ratio, "best" if r.ratio >= 1 else "partial") for r in propagate.same_name(seeds, a, b).collect()]
    left, right, given = {m[0] for m in matches}, {m[1] for m in matches}, {m[:2] for m in matches}
    for rule in wanted:
        rows = {(r.a_id, r.b_id): r.order_key for r in candidates.candidates(rule, a, b).orderBy(F.desc("order_key")).collect()}
        exact, least = rule.mode == "no_false_positives", rule.least_ratio()
        scored = similarity.scores(spark.createDataFrame(list(rows) or [(0, 0)], "a_id long, b_id long"), a, b).withColumn("final", similarity.final_ratio(F.lit(least), F.lit(exact), False)).collect()
        of = {(r.a_id, r.b_id): (1.0 if exact else r.ratio, 1.0 if exact else r.final) for r in scored}
        used_a, used_b = set(), set()
        for i, j in sorted(rows, key=lambda p: (-of[p][0], rows[p], p)):
            if i in used_a or j in used_b:
                continue
            used_a.add(i)
            used_b.add(j)
            ratio = of[i, j][1]
            if ratio < least or x[i].name.startswith("nullsub_") or y[j].name.startswith("nullsub_") or (i, j) in given or (i in left) and (j in right) or (i in left or j in right) and ratio < 1:
                continue
            given.add((i, j))
            if not (i in left or j in right):
                left.add(i)
                right.add(j)
                matches.append((i, j, ratio, "best" if ratio >= 1 else "unreliable" if rule.unreliable and not exact else "partial"))
    kept = {(i, j): r for r, i, j in _clean([(r, i, j) for i, j, r, _ in matches])}
    top_a, top_b = {}, {}
    for (i, j), r in kept.items():
        top_a[i], top_b[j] = max(r, top_a.get(i, 0)), max(r, top_b.get(j, 0))
    kinds = {(i, j): "multimatch" if r < max(top_a[i], top_b[j]) else next(k for p, q, t, k in matches if (p, q, t) == (i, j, r)) for (i, j), r in kept.items()}
    assert {(r.a_id, r.b_id): (round(r.ratio, 9), r.kind) for r in found.matches.collect()} == {p: (round(kept[p], 9), k) for p, k in kinds.items()}
    assert len(kinds) > 50


def test_session_runs_passes_and_blocks(spark):
    a, b = pair(spark, "/root/testdata/sf0.001")
    steps = []
    hooks = session.Hooks(rules=lambda found: found[:2], on_progress=steps.append)
    found = session.run(a, b, session.Options(iterations=1), hooks)
    assert {f"pass 1: {p.run.__name__}" for p in propagate.PASSES} <= set(steps) and steps[-2:] == ["blocks", "results"]
    added = {"Diffing of matches", "Renamed", "Related constants", "Compilation unit", "Call reference", "Local affinity"}
    assert any(r.description in added for r in found.results.collect())


def test_session_refines_and_filters(spark):
    a, b = pair(spark, "/root/testdata/sf0.001")
    ids = a.functions.join(b.functions.select("id"), "id").where("nodes >= 3").select("id").limit(5)
    matches = ids.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(0.5).alias("ratio"), F.lit("x").alias("description"), F.lit("partial").alias("kind"))
    about = {r.a_id: r for r in refine.structural(matches, refine.match_blocks(matches, a, b), a, b).collect()}
    rows = session.refined(matches, a, b).collect()
    assert len(rows) == 5 and any(r.ratio != 0.5 for r in rows)
    large = {r.id for r in b.functions.where("nodes >= 3").select("id").collect()}
    assert all(r.ratio == pytest.approx(0.3 + 0.4 * about[r.a_id].structural) for r in rows if r.b_id in large and about[r.a_id].matched)
    hooks = session.Hooks(rules=lambda found: found[:1])
    left = session.run(a, b, session.Options(propagation=False, model=ml.Ensemble((0.0,))), hooks)
    assert left.matches.where("kind in ('partial', 'unreliable')").isEmpty() and not left.matches.isEmpty()


def test_slow_and_relaxed_do_not_depend_on_counts():
    assert session.Options().slow is True and session.Options().relaxed is False


def test_text_graphs(spark):
    text = "start:\n cmp eax, 1\n jz short done\n mov eax, 2\n jmp start\ndone:\n ret\n nop"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "mov a, b")], "id long, text string")
    found = sorted((r.id, r.block, r["first"], r["last"], list(r.successors)) for r in textdiff.text_graphs(rows).collect())
    assert found == [(1, 0, 0, 2, [1, 2]), (1, 1, 3, 4, [0]), (1, 2, 5, 6, []), (1, 3, 7, 7, []), (4, 0, 0, 0, [])]


def _graph(spark, blocks, edges):
    b = spark.createDataFrame([(1, k, x, len([w for w in x.split(",") if w])) for k, x in enumerate(blocks)], "func_id long, num int, mnemonics_list string, inst_total int")
    return Snapshot({"blocks": b, "block_edges": spark.createDataFrame([(1, *e) for e in edges], "func_id long, parent int, child int")})


def test_block_pairs(spark):
    left = _graph(spark, ["a,b", "c,d,e", "x"], [])
    right = _graph(spark, ["c,d,f", "a,b", "y", "q,r,s,t,u,v"], [])
    pairs = spark.createDataFrame([(1, 1)], "a_id long, b_id long")
    found = textdiff.block_pairs(pairs, left, right).collect()
    assert {(r.num_a, r.num_b, r.kind) for r in found} == {(0, 1, "exact"), (1, 0, "similar"), (2, 2, "ordinal"), (None, 3, "secondary-only")}


def _matched(left, right):
    """Block matching one by one, as it is defined; blocks are (list, count, into, out)."""
    used_a, used_b, out = set(), set(), []

    def take(i, j, ratio):
        used_a.add(i)
        used_b.add(j)
        out.append((i, j, ratio))

    for i, x in enumerate(left):
        places = [j for j, y in enumerate(right) if y[0] == x[0]]
        if x[1] >= 2 and len(places) == 1 and places[0] not in used_b:
            take(i, places[0], 1.0)
    for at, ratio in ((2, 0.8), (3, 0.6)):
        i, j = (next((k for k, x in enumerate(s) if x[at] == 0 and k not in u), None) for s, u in ((left, used_a), (right, used_b)))
        if i is not None and j is not None:
            take(i, j, ratio)
    for i, x in enumerate(left):
        best = max(((3 * (x[1] == y[1]) + (x[2] == y[2]) + (x[3] == y[3]), -j) for j, y in enumerate(right) if j not in used_b), default=(0, 0))
        if i not in used_a and best[0] >= 3:
            take(i, -best[1], 0.4)
    return sorted(out)


def test_block_matching_equals_one_by_one(spark):
    pick = random.Random(4)
    pairs = spark.createDataFrame([(1, 1)], "a_id long, b_id long")
    for _ in range(4):
        sides = []
        for _ in "ab":
            blocks = [",".join(pick.choice("xyz") for _ in range(pick.randrange(1, 4))) for _ in range(pick.randrange(1, 9))]
            edges = sorted({(pick.randrange(len(blocks)), pick.randrange(len(blocks))) for _ in range(5)})
            sides.append((blocks, edges))
        (x, p), (y, q) = sides
        about = lambda blocks, edges: [(t, len(t.split(",")), sum(e[1] == k for e in edges), sum(e[0] == k for e in edges)) for k, t in enumerate(blocks)]
        found = refine.match_blocks(pairs, _graph(spark, x, p), _graph(spark, y, q)).collect()
        assert sorted((r.num_a, r.num_b, r.ratio) for r in found) == _matched(about(x, p), about(y, q))


def test_ties_take_few_rounds(spark, monkeypatch):
    """2,000 by 2,000 equal pairs in blocks of 50, and one block of 300 by 200."""
    pairs = spark.range(2_000).select((F.col("id") % 2_000).alias("a_id"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k")).select("a_id", (F.floor(F.col("a_id") / 50) * 50 + F.col("k")).alias("b_id"), F.lit(1.0).alias("ratio"))
    large = spark.range(300).select((F.col("id") + 10_000).alias("a_id")).join(spark.range(200).select((F.col("id") + 10_000).alias("b_id"))).withColumn("ratio", F.lit(0.5))
    rounds, plain = [], assign.mutual_best
    monkeypatch.setattr(assign, "mutual_best", lambda *x: rounds.append(1) or plain(*x))
    found = assign.greedy(pairs.union(large), [F.col("ratio").desc(), F.col("a_id"), F.col("b_id")]).collect()
    assert len(rounds) <= 5 and {(r.a_id, r.b_id) for r in found} == {(k, k) for k in [*range(2_000), *range(10_000, 10_200)]}


def _clean(matches):
    best_a, best_b, seen, out = {}, {}, set(), []
    for r, x, y in sorted(matches, key=lambda m: -m[0]):
        if (x, y) in seen or best_a.get(x, r) > r or best_b.get(y, r) > r:
            continue
        seen.add((x, y))
        best_a[x] = best_b[y] = r
        out.append((r, x, y))
    return sorted(out)


def test_clean_equals_the_sequential_one(spark):
    pick = random.Random(9)
    for _ in range(3):
        rows = [(pick.choice((0.5, 0.6, 0.7, 0.8)), x, y) for x, y in {(pick.randrange(8), pick.randrange(8)) for _ in range(20)}]
        df = spark.createDataFrame([(x, y, r, "", "partial") for r, x, y in rows] + [(1, 1, 1.0, "", "multimatch")], "a_id long, b_id long, ratio double, description string, kind string")
        assert sorted((r.ratio, r.a_id, r.b_id) for r in assign.clean(df).collect()) == _clean(rows)


def test_large_primes_and_numbers():
    huge = str(3) + "0" * 10_000
    assert similarity.prime_vector(huge) == {2: 10_000, 3: 1, 5: 10_000} and similarity.prime_ratio_of(huge, "30") < 0.01
    assert similarity.whole_number("123" * 3_000) == sum(int("123") * 10 ** (3 * k) for k in range(3_000))


def test_stored_blocks_and_new_ids(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    functions = lambda rows: frame([(*r, 1, 1, "h") for r in rows], "id long, name string, address string, nodes int, instructions int, bytes_hash string")
    frames = {
        "functions": functions([(1, "f", "16"), (2, "g", "32")]),
        "basic_blocks": frame([(10, 1, "20"), (11, 0, "16"), (12, 0, "32")], "id long, num int, address string"),
        "function_bblocks": frame([(1, 10), (1, 11), (2, 12)], "function_id long, basic_block_id long"),
        "bb_instructions": frame([(1, 11, 5), (2, 11, 4), (3, 10, 6)], "id long, basic_block_id long, instruction_id long"),
        "instructions": frame([(4, 1, "mov"), (5, 1, "cmp"), (6, 1, "ret")], "id long, func_id long, mnemonic string"),
        "bb_relations": frame([(11, 10), (11, 12)], "parent_id long, child_id long"),
        "constants": frame([(1, "7"), (2, "8")], "func_id long, constant string"),
    }
    Snapshot(frames).save(str(tmp_path))
    snapshot.replace_program_data(spark, str(tmp_path), {"processor": "x"})
    found = snapshot.load(spark, str(tmp_path), "functions", "blocks", "block_edges")
    assert found.program == {"processor": "x"} and session.same_processor(found, found) and not session.same_processor(found, Snapshot({}))
    assert sorted((r.func_id, r.num, r.mnemonics_list, r.inst_total) for r in found.blocks.collect()) == [(1, 0, "cmp,mov", 2), (1, 1, "ret", 1), (2, 0, "", 0)]
    assert [tuple(r) for r in found.block_edges.collect()] == [(1, 0, 1)]
    more = Snapshot({"functions": functions([(1, "h", "48"), (2, "f", "16"), (7, "i", "64")]), "constants": frame([(1, "9"), (2, "0"), (7, "5")], "func_id long, constant string")})
    assert more.append(str(tmp_path)) == 2 and more.append(str(tmp_path)) == 0
    stored = snapshot.load(spark, str(tmp_path), "functions", "constants")
    assert sorted((r.id, r.name) for r in stored.functions.collect()) == [(1, "f"), (2, "g"), (3, "h"), (4, "i")]
    assert sorted((r.func_id, r.constant) for r in stored.constants.collect()) == [(1, "7"), (2, "8"), (3, "9"), (4, "5")]
    hooks = snapshot.ExportHooks(F.col("name") == "f", lambda df: df.withColumn("name", F.upper("name")))
    stored.save(str(tmp_path / "less"), hooks)
    less = snapshot.load(spark, str(tmp_path / "less"), "functions", "constants")
    assert [r.name for r in less.functions.collect()] == ["F"] and less.constants.count() == 1


def test_result_tools(spark, tmp_path):
    rows = [("best", 0, "1", "f", "2", "g", 1.0, 3, 3, "x"), ("partial", 1, "3", "h", "4", "i", 0.5, 2, 2, "y")]
    table = spark.createDataFrame(rows, "type string, line long, address string, name string, address2 string, name2 string, ratio double, nodes1 int, nodes2 int, description string")
    missing = spark.createDataFrame([("primary", 0, "9", "z")], "type string, line long, address string, name string")
    assert tuple(results.totals(table, missing).first()) == (2, 1, 0)
    results.save(str(tmp_path), results=table, unmatched=missing)
    assert results.load(spark, str(tmp_path), "results", "unmatched")["results"].count() == 2
    with pytest.raises(results.ResultError):
        results.load(spark, str(tmp_path), "config")
    missing.write.parquet(str(tmp_path / "bad/results.parquet"))
    with pytest.raises(results.ResultError):
        results.load(spark, str(tmp_path / "bad"), "results")
    stats = spark.createDataFrame([(0, "a", 0), (1, "b", 5), (2, "c", 9)], "line long, name string, candidates long")
    assert [r.name for r in results.nonzero_rules(stats).collect()] == ["c", "b"]
    runs = spark.createDataFrame([("x", "best", 5), ("x", "partial", 1), ("y", "best", 7)], "run string, type string, count long")
    assert {tuple(r) for r in results.compared(runs, "x").collect()} == {("x", "best", 5, 0), ("x", "partial", 1, 0), ("y", "best", 7, 2), ("y", "partial", 0, -1)}
    assert results.function_info(table, "3").first().name == "h"


def test_patch_stream(spark):
    a, b = (Snapshot({"functions": spark.createDataFrame(rows, "id long, assembly string, pseudocode string")}) for rows in ([(1, "jl x", "y"), (2, "a", "b")], [(1, "jb x", "y"), (2, "a", "b\ngets(c)")]))
    matches = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.9), (2, 2, 1.0)], "a_id long, b_id long, ratio double")
    assert {tuple(r) for r in patchscan.risks(matches, a, b).collect()} == {(1, 1, "signed_unsigned", "jl -> jb"), (2, 2, "unsafe_pattern", "gets")}


def test_ml_export(spark, tmp_path):
    row = [(1, 2, 0.5, *range(len(ml.FEATURES) - 1))]
    df = spark.createDataFrame(row, "a_id long, b_id long, ratio double, " + ", ".join(f"{c} long" for c in ml.FEATURES[1:]))
    for form in ("csv", "json"):
        ml.export(df, str(tmp_path / form), form)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["a_id", "b_id", *ml.FEATURES] and spark.read.json(str(tmp_path / "json")).count() == 1


def test_edges_and_callers(spark):
    f = lambda rows: spark.createDataFrame(rows, "id long, address string, size int, name string")
    c = lambda rows: spark.createDataFrame(rows, "func_id long, address string, type string, ordinal int")
    a = Snapshot({"functions": f([(1, "16", 8, "f"), (2, "0x20", 16, "g")]), "callgraph": c([(1, "35", "call", 1), (2, "16", "call", 1), (1, "60", "call", 2)])})
    assert {tuple(r) for r in textdiff.resolved_calls(a).collect()} == {(1, 1, 2), (2, 1, 1)}
    pairs = spark.createDataFrame([(1, 1)], "a_id long, b_id long")
    assert [tuple(r) for r in textdiff.caller_context(pairs, a, a).collect()] == [(1, 1, 1, "g", "g")]
