"""Operators 11 to 13 against SQL and plain versions that share no code with them."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from oracle import assert_same, connect

from pairloom.llm import divergence, gray_simhash, periodic_runs, queries

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "a b c a b c a b c a b c d", "en", "x"), (2, None, "en", None), (3, "", None, "x"), (4, "na " * 40, "fr", "y"), (4, "na " * 40, "fr", "y"), (5, "Über über ÜBER\tund\x0bDas das", "de", "z"),
    (6, " ".join(str(k % 50) for k in range(30_000)), "en", "x"), (None, "a b c a b c a b c a b c d", "en", "x"), (7, " \t\n ", "en", "x"), (8, "one two", "en", "y"), (9, "one two", "en", "x"),
]


def frame(spark, rows=ROWS):
    """Documents with columns whose names the operators use themselves."""
    extra = "term string, n int, p int, part string, rank int, runs string, node int, fingerprint string, component_id int"
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows], f"doc_id long, text string, lang string, source string, {extra}")


# divergence

def test_divergence_of_odd_rows_equals_its_sql(spark):
    rows = [(k, f"the Cat {'sat ' * (k % 4)} on_mat{k % 3} é{'x' * (k % 2)}", ["en", None, "fr"][k % 3], ["s1", "s2", None, "s4"][k % 4]) for k in range(90)] + [r for r in ROWS if r[0] != 6]
    docs = frame(spark, rows)
    con = connect(SF)
    con.execute("drop view documents")
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    assert_same(divergence.audit(docs).toPandas(), con.execute(divergence.ORACLE).df())


def test_divergence_of_groups_without_terms_is_zero(spark):
    found = divergence.audit(frame(spark, [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "x", "fr", "a")])).collect()
    assert {tuple(r) for r in found} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.audit(frame(spark, [])).count() == 0


def test_divergence_holds_counts_beyond_longs(spark):
    df = spark.createDataFrame([(2 * 10**17, 4 * 10**17, 5)], "n long, total long, v long")
    assert df.select(divergence._share("n", "total")).first()[0] == 1 + 10**9 * (2 * 10**17 + 2) // (4 * 10**17 + 10)


# runs

def plain_runs(w, least, times):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


@pytest.mark.parametrize(("least", "times"), [(2, 2), (6, 4), (4, 3)])
def test_runs_equal_trying_all_periods(least, times):
    rng = random.Random(least)
    for _ in range(3000):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.4:
            a, p = rng.randrange(n), rng.randint(1, 6)
            w = [x if i < a else w[min(n - 1, a + (i - a) % p)] for i, x in enumerate(w)]
        wanted = plain_runs(w, least, times)
        assert periodic_runs.all_runs(w, least, times) == wanted
        codes = np.array(w, np.int64)
        cut = [(b + s, m, p) for b, e in periodic_runs.pieces(codes, np.zeros(n, np.int64), least, times) for s, m, p in periodic_runs.all_runs(w[b:e], least, times)]
        assert sorted(cut) == wanted


def test_pieces_leave_out_what_cannot_repeat():
    rng = np.random.default_rng(0)
    assert list(periodic_runs.pieces(rng.permutation(5000), np.zeros(5000, np.int64), 6, 4)) == []
    one = np.r_[rng.permutation(500), np.tile([7, 8, 9], 5), 500 + rng.permutation(500)]
    # one owner's words don't count for another's
    assert list(periodic_runs.pieces(np.r_[one, one], np.repeat([0, 1], len(one)), 6, 4)) == [(500, 515), (len(one) + 500, len(one) + 515)]


def test_factors_are_the_longest_earlier_pieces():
    rng = random.Random(3)
    for _ in range(500):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        at = 0
        for begin, size, earlier in periodic_runs.factors(w):
            assert begin == at
            longest = max((m for s in range(begin) for m in range(1, len(w) - begin + 1) if w[s : s + m] == w[begin : begin + m]), default=0)
            assert (size, earlier < 0) == (max(longest, 1), longest == 0)
            assert earlier < 0 or earlier < begin and w[earlier : earlier + size] == w[begin : begin + size]
            at += size
        assert at == len(w)


def plain_op12(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    numbers = {x: k for k, x in enumerate(dict.fromkeys(w))}
    runs = plain_runs([numbers[x] for x in w], 6, 4)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_equals_a_plain_version(spark):
    found = {tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    wanted = {plain_op12(*r) for r in docs}
    assert wanted <= found
    assert sum(r[1] > 0 for r in wanted) >= 10


def test_runs_of_odd_rows(spark):
    rows = [r for r in ROWS if r[0] != 6]
    found = periodic_runs.digests(periodic_runs.find(queries._repeating(frame(spark, rows)))).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(plain_op12(r[0], r[1])) for r in rows)
    long = periodic_runs.find(frame(spark, [ROWS[6]])).first()
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 50)]
    assert long.collapsed == " ".join(map(str, range(50)))
    assert periodic_runs.find(frame(spark, [])).count() == 0


# SimHash

def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    above = list(range(len(prints)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                above[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(prints))]


@pytest.mark.parametrize("index", [{}, {"size": 15, "tasks": 3}])
def test_op13_equals_comparing_all(spark, index):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    wanted = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components(prints, [r.doc_id for r in rows]), strict=True)}
    found = gray_simhash.near_duplicates(docs, **index)
    assert {tuple(r) for r in found.collect()} == wanted
    if not index:
        assert found.columns == queries.op13_simhash_near_dedup(spark, SF).columns


def test_links_of_clusters_equal_comparing_all(spark):
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 2**64, 12, np.uint64)
    prints = bases[rng.integers(0, 12, 900)]
    for _ in range(5):  # chains of links inside a cluster, over many ranges
        prints = prints ^ np.where(rng.random(900) < 0.6, np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64), np.uint64(0))
    prints = np.unique(prints)
    reps = rng.permutation(len(prints)).tolist()
    classes = spark.createDataFrame(list(zip(prints.view(np.int64).tolist(), reps, strict=True)), "fingerprint long, rep long")
    wanted = dict(zip(prints.view(np.int64).tolist(), plain_components([int(p) for p in prints], reps), strict=True))
    assert len(set(wanted.values())) < len(wanted) // 2
    for size in (40, 1000):
        assert dict(map(tuple, gray_simhash.linked(classes, size=size).collect())) == wanted


def test_tree_finds_all_within_the_distance():
    rng = np.random.default_rng(1)
    bits = np.unique(rng.integers(0, 2**64, 3000, np.uint64) & np.uint64(0x3FF))
    bits = np.array(sorted(bits.tolist(), key=_rank), np.uint64)
    queries_, tree = rng.integers(0, 2**10, 200, np.uint64), gray_simhash.GrayTree(bits, fan=4)
    found = {(int(q), int(m)) for qs, ms in tree.search(queries_, 2, most=500) for q, m in zip(qs, ms, strict=True)}
    assert found == {(i, j) for i, q in enumerate(queries_) for j, b in enumerate(bits) if int(q ^ b).bit_count() <= 2}


def _rank(x):
    r = 0
    while x:
        r ^= x
        x >>= 1
    return r


def test_gray_rank_is_the_place_in_the_code(spark):
    codes = [k ^ (k >> 1) for k in range(200)] + [2**64 - 1 - k for k in range(3)]
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "x long")
    assert [r[0] + 2**63 for r in df.select(gray_simhash.gray_rank("x")).collect()] == [_rank(c) for c in codes]


def test_simhash_of_odd_rows(spark):
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in gray_simhash.near_duplicates(frame(spark)).collect()}
    zero = "0" * 16
    assert {(2, zero, 2), (3, zero, 2), (7, zero, 2)} <= found
    assert {(8, f"{plain_fingerprint('one two'):016x}", 8), (9, f"{plain_fingerprint('one two'):016x}", 8)} <= found
    assert (None, f"{plain_fingerprint(ROWS[0][1]):016x}", None) in found
    assert gray_simhash.near_duplicates(frame(spark, [])).count() == 0
