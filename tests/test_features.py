import random

from pyspark.sql import functions as F

from pairloom.functions import features
from pairloom.streaming.ingest import ingest


def test_cleaning(spark):
    rows = [("mov eax, dword ptr 0 ; note\ncall sub_401000 \nlea loc_1f, x # c", "v12 = sub_40(a3, arg_8); // why\nx"), (None, None), ("", "")]
    found = spark.createDataFrame(rows, "a string, p string").select(features.clean_assembly("a").alias("a"), features.clean_pseudocode("p").alias("p")).collect()
    assert found[0].a == "mov eax,\ncall XXXX\nlea XXXX, x" and found[0].p == "vXXX = sub_XXXX(aXXX, aXXX);\nx"
    assert found[1].a is None and found[2].p == ""


def test_constants(spark):
    rows = [(0xFFF, False), (0x1000, False), (0x1001, True), (-256, False), (None, False)]
    found = {r.n: r.k for r in spark.createDataFrame([(n,) for n, _ in rows], "n long").select("n", features.telling_constant("n").alias("k")).collect()}
    assert found == dict(rows)


def test_components_in_order():
    pick = random.Random(2)
    for _ in range(200):
        n = pick.randrange(1, 9)
        edges = [(pick.randrange(n), pick.randrange(n)) for _ in range(pick.randrange(14))]
        reach = [[i == j or (i, j) in edges for j in range(n)] for i in range(n)]
        for k in range(n):
            reach = [[reach[i][j] or reach[i][k] and reach[k][j] for j in range(n)] for i in range(n)]
        parts, place = features.components_in_order(n, edges)
        assert sorted(v for p in parts for v in p) == list(range(n))
        assert all((place[i] == place[j]) == (reach[i][j] and reach[j][i]) for i in range(n) for j in range(n))
        assert all(place[a] <= place[b] for a, b in edges)


def test_graph_measures(spark):
    rows = [(1, 3, [(0, 1), (1, 2), (2, 1)]), (2, 0, None), (3, 1, [(0, 0)])]
    df = spark.createDataFrame(rows, "id long, nodes long, edges array<struct<a:int,b:int>>")
    found = {r.id: r for r in features.graph_measures(df).collect()}
    assert (found[1].strongly_connected, found[1].loops, found[1].tarjan_topological_sort) == (2, 1, "[[0],[1,2]]") and float(found[1].md_index) > 0
    assert (found[2].strongly_connected, found[2].md_index) == (0, "0") and found[3].loops == 1


def test_prime_product(spark):
    df = spark.createDataFrame([([0, 0, 1],), ([],), (None,)], "x array<int>")
    assert [r.p for r in df.select(features.prime_product("x").alias("p")).collect()] == ["12", "1", "1"]


def test_ingest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, address string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    df.withColumn("id", F.col("id") + 10).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.address for r in spark.read.parquet(str(tmp_path / "out/functions.parquet")).collect()) == ["a", "b"]


def _plain_hash(data):
    """The definition, window by window."""
    import base64

    sums = [s for k in range(len(data) // 512 + 1) if (s := sum(data[512 * k : 512 * (k + 1)]) % 255)]
    extra, out = min(len(sums) // 32, 1), []
    for c in range(32):
        window = sums[c : c + extra + 1]
        out += [window[1]] * 2 if len(window) > 1 else []
    return base64.b64encode(bytes(out)).decode().rstrip("=")[:32]


def test_fuzzy_hashes():
    pick = random.Random(3)
    for n in (0, 5, 512, 8000, 16384, 20000, 40000):
        text = "".join(pick.choice("abcdefgh \n") for _ in range(n))
        data = text.encode()
        doubled = b"".join(data[k : k + 512] * 2 for k in range(0, len(data), 512))
        assert features.fuzzy_hashes_of(text) == tuple(map(_plain_hash, (doubled, data, data[::-1])))
    assert features.fuzzy_hashes_of(None) == ("", "", "")


def test_microcode(spark):
    rows = [("0. 1 mov eax, ebx ; x\nnothing here\n  add.4 #5, sub_401000\n\n2 mov r1, r2",), (None,), ("",)]
    found = spark.createDataFrame(rows, "m string").select(features.clean_microcode("m").alias("c"), features.microcode_mnemonics("m").alias("p")).collect()
    assert found[0].c == "mov eax, ebx\nadd.4 #5, XXXX\nmov r1, r2" and found[1].c is None and found[2].c == ""
    names = sorted(features.MICROCODE)
    assert [names[k] for k in found[0].p] == ["mov", "add"] and len(set(features.MICROCODE)) == len(features.MICROCODE)


def test_names_switches_and_primes(spark):
    rows = [(["open(int)", "sub_1", "nullsub_2", "alpha", "open"], [(4, [3, 1, 3]), (2, [])], 3), (None, [], 0), ([], None, None)]
    df = spark.createDataFrame(rows, "n array<string>, s array<struct<size:int,cases:array<int>>>, c int")
    found = df.select(features.referred_names("n").alias("n"), features.switch_text("s").alias("s"), features.primes_value("c").alias("p")).collect()
    assert [tuple(r) for r in found] == [('["alpha","open"]', "[[4,[1,3]]]", "7"), ("[]", "[]", "2"), ("[]", "[]", None)]


def test_constant_lists(spark):
    numbers = spark.createDataFrame([(1, 3, 0x1001, False), (1, 1, 0x2003, None), (1, 2, 0x1000, False), (1, 4, 0x2003, False), (2, 1, 0x1001, True)], "func_id long, pos int, value long, referenced boolean")
    strings = spark.createDataFrame([(1, 2, "text"), (1, 5, "x"), (1, 6, None)], "func_id long, pos int, value string")
    assert [(r.func_id, r.constants) for r in features.constant_list(numbers, strings).collect()] == [(1, '["8195","text","4097"]')]


def test_degrees_and_reasons(spark):
    functions = spark.createDataFrame([(1, "16", "2"), (2, "32", "3"), (3, "48", "3"), (4, "64", "1")], "id long, address string, primes_value string")
    calls = spark.createDataFrame([(1, "32", "call near"), (1, "32", "call near"), (1, "99", "call far"), (2, "16", "jump"), (4, "4", "jump")], "func_id long, address string, type string")
    assert {tuple(r) for r in features.degrees(functions, calls).collect()} == {(1, 1, 3), (2, 2, 0), (3, 0, 0), (4, 0, 0)}
    assert {tuple(r) for r in features.factor_counts(functions, calls).collect()} == {(2, 1, 1), (3, 2, 1)}
    rows = [(None, "f", 9, False, False), (5, "f", 9, False, False), (50, "f", 9, True, False), (50, "f", 9, None, True), (50, "nullsub_1", 9, None, None), (50, "f", 6, None, None), (50, "f", 7, None, None)]
    df = spark.createDataFrame(rows, "address long, name string, size int, is_library boolean, is_thunk boolean")
    assert [r.w for r in df.select(features.skip_reason(10, 100, ignore_small=True).alias("w")).collect()] == ["invalid-function", "outside-range", "library", "thunk", "nullsub", "small-function", ""]


def test_graph_hash(spark):
    rows = [(1, 3, [(0, 1), (1, 2), (2, 1)], 1, 2, 0, 1), (2, 0, None, None, None, None, None), (3, 5_000, [], None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, nodes long, edges array<struct<a:int,b:int>>, loops int, components int, calls int, data_refs int").withColumns({c: F.lit(None).cast("boolean") for c in ("outer_refs", "no_return", "library", "thunk")})
    found = {r.id: r.kgh_hash for r in features.graph_hash(df).collect()}
    assert found[1] == str(2 * 5**3 * 7**3 * 11**3 * 19 * 37**2 * 29) and found[2] == "1" and len(found[3]) == 7386 and found[3][-4:] == "0" * 4
    assert features.decimal_text(7**9_000)[:30] == str(7**9_000 // 10 ** (len(features.decimal_text(7**9_000)) - 30))
