"""The corpus operators against brute force, round trips and held-out labels, with nulls, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from pairloom.llm import chain_crf, components, decision_list, hamming_dedup, html_template, line_crf, ngram_lm, pii_crf, queries, secret_crf, sentencepiece_codec, url_rules, winnow
from pairloom.sources.tables import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = sentencepiece_codec.Pieces.load(queries.PIECES)

#: Nulls, empty and long texts, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three"), (6, "one two three"), (7, "one two three four five six"), (7, "one two three four five six"),
    (None, "one two three four five six"), (8, "Ünï 𝄞 ▁x x@y.zz +1 (017) 555-7713 then 4111 1111 1111 1111 and 1.2.3.4 token = \"0123456789abcdef01\""), (9, "word " * 20_000), (10, "x" * 50_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ("n_words", "hit_", "row_", "kept", "score", "component", "signature", "n_chars", "quality", "spans", "words_", "at_")
    return df.select("*", *(F.lit(7).cast("long").alias(n) for n in names))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF).toPandas(), connect(SF).execute(queries.oracle_sql()[name]).df())


# 1

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><!-- <p>no</p> -->
<div class="ad">advert</div><div class="cookie-notice">notice</div>%s<aside>side</aside><form>form</form><section id=comments>reader</section><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize("inner", ["<article><h1>Head &amp;  line</h1><p>One <b>bo</b>ld<br>two\n&lt;x&gt; &nbsp;<p>Two<ul><li>a<li>b</ul></article>", "<div><h1>Head &amp;  line</h1><p>One <b>bo</b>ld<br>two\n&lt;x&gt; &nbsp;<p>Two<ul><li>a<li>b</ul></div>"])
def test_article(inner):
    assert html_template.article(PAGE % inner, []) == "Head & line\nOne bold two <x>\nTwo\na\nb"


def test_template_leaves_out_what_repeats(spark):
    rows = [(i, "http://h.example/x", f"<body><div>Site name<p>Always the same words</div><div><p>Only page {i * 77} says {i}</div><div>Small print</div></body>") for i in range(20)]
    rows += [(90, None, None), (91, "http://h.example/x", ""), (92, "no", "<p>a<p>b"), (92, "no", "<p>a<p>b"), (93, "http://other/", "x < y &amp z <broken")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("host"), F.lit(3).alias("classes"))
    found = html_template.extract(pages).collect()
    texts = defaultdict(list)
    for r in found:
        assert r.n_chars == len(r.text)
        texts[r.page_id].append(r.text)
    assert texts[3] == ["Only page 231 says 3"] and texts[90] == [""] and texts[91] == [""] and texts[92] == ["a\nb"] * 2 and len(found) == len(rows)
    assert html_template.extract(pages.where("false")).count() == 0
    shuffled = html_template.extract(pages, small_tokens=0).collect()  # the join that splits hosts
    assert sorted((r.page_id, r.text) for r in shuffled) == sorted((r.page_id, r.text) for r in found)


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in queries.op1_html_extraction(spark, SF).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html_template.references.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</h1>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_template_leaves_out_what_repeats_in_main(spark):
    page = "<body><div>Site</div><main><h1>Title {0}</h1><p>Own words {0}<div>Share this story with your friends</div><p>By <b>writer {0}</b></main></body>"
    other = "<body><section><article><p>Own note {0}<p>All notes are free</article></section></body>"
    rows = [(i, "http://h.example/x", page.format(i)) for i in range(8)] + [(100 + i, "http://h.example/y", other.format(i)) for i in range(8)]
    rows += [(200 + i, "http://copies.example/", "<body><main><p>One article<p>on every page</main></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for found in (html_template.extract(pages), html_template.extract(pages, small_tokens=0)):
        texts = {r.page_id: r.text for r in found.collect()}
        assert len(texts) == len(rows) and all(texts[i] == f"Title {i}\nOwn words {i}\nBy writer {i}" for i in range(8))
        assert all(texts[100 + i] == f"Own note {i}" and texts[200 + i] == "One article\non every page" for i in range(8))


def test_names_that_mark_nothing():
    page = lambda x: f"<article><p>a</p>{x}</article>"
    assert html_template.article(page("<svg width=1 /><p>kept</p>"), []) == "a\nkept"
    assert html_template.article(page("<svg><title>t</title><path d='x'/></svg><p>kept</p>"), []) == "a\nkept"
    for name in ("related-work", "social-sciences", "share-price", "searchlight", "header-bidding-explained"):
        assert html_template.article(page(f'<div class="{name}"><p>kept</p></div>'), []) == "a\nkept"
    for name in ("related-articles", "share", "site-header", "comments-list", "cookie-notice", "ad_slot-3"):
        assert html_template.article(page(f'<div class="x {name}"><p>left out</p></div>'), []) == "a"


def test_template_decides_without_article_or_main(spark):
    """Unmarked divisions: what repeats and a slot full of links go, and only because a template was found."""
    page = "<body><div>Site name</div><div>Hot: <a href=/{0}>teaser number {0} of many</a></div><div><p>First words {0}<p>Then {0} <a href=x>and {0}</a> an end {0}</div><div>All rights reserved</div></body>"
    rows = [(i, "http://h.example/x", page.format(i * 7)) for i in range(12)]
    found = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"First words {i * 7}\nThen {i * 7} and {i * 7} an end {i * 7}" for i in range(12))
    assert html_template.article(rows[3][2], []) != found[3] and "Site name" in html_template.article(rows[3][2], [])


def _without_names(page):
    """The page in divisions whose names say nothing: no article, nav, header, footer or aside, and classes as numbers."""
    for k, tag in enumerate(("article", "nav", "footer", "header", "aside")):
        page = re.sub(f"<{tag}(?=[ >])", f'<div class="q{k}"' if k else "<div", page).replace(f"</{tag}>", "</div>")
    return re.sub('class="(?!q[0-9])[^"]*"', lambda m: f'class="z{sum(map(ord, m[0]))}"', page)


def test_template_alone_gives_the_articles_of_the_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, SF, "pages").collect()]
    want = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, _PAGES)).collect()}
    bare = spark.createDataFrame([(i, url, page and _without_names(page)) for i, url, page in rows], _PAGES)
    for found in (html_template.extract(bare), html_template.extract(bare, small_tokens=0)):
        assert {r.page_id: r.text for r in found.collect()} == want
    assert all(html_template.article(_without_names(page), []) != want[i] for i, _, page in rows)


_PAGES = "page_id long, url string, html string"


def test_kinds_of_holders(spark):
    """Links, few variants and short texts go whatever their names; a section inside the main text stays, however short."""
    body = "<body><div class=a><a href=x>teaser {0}</a><a href=y>teaser {0} more of it</a></div><div class=b>{2}</div><div class=c>said {0}</div><div class=d><h1>Head {0}</h1>{1}<section>end {0}</section></div></body>"
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, "http://h.example/x", body.format(i, words(i), f"variant {i % 2} " + f"of{i % 2} " * 40)) for i in range(20)]
    rows += [(100 + i, f"http://h{i}.example/x", body.format(i, words(i), words(i + 50))) for i in range(8)]  # a page a host
    rows += [(200 + i, "http://copies.example/", body.format(1, words(1), "legal")) for i in range(8)]  # nothing varies
    for found in (html_template.extract(spark.createDataFrame(rows, _PAGES)), html_template.extract(spark.createDataFrame(rows, _PAGES), small_tokens=0)):
        texts = {r.page_id: r.text for r in found.collect()}
        assert all(texts[i] == f"Head {i}\n{words(i)}\nend {i}" for i in range(20))
        assert all(texts[100 + i] == f"{words(i + 50)}\nHead {i}\n{words(i)}\nend {i}" for i in range(8))
        assert all("w1x59" in texts[200 + i] for i in range(8))


def test_repeated_pages_have_a_template(spark):
    page = "<body><div>Site</div><div><p>Own {0}</div><div>Print {1}</div></body>"
    rows = [(i, "http://h.example/x", page.format(i, "small")) for i in range(8)] * 2
    found = html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in found) == sorted(f"Own {i}" for i in range(8) for _ in range(2))


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<b><li>", "<script ", "</script ", "<p><ul><b>", "<a href='", '<x y="', "</p>", "<body><div>", "<tr><td>", "&amp", "<!-- ", "<svg "])
def test_hostile_pages(piece):
    """A megabyte of one piece, with something unclosed at its end, in seconds."""
    page = piece * (1_000_000 // len(piece)) + "'<b>x\""
    began = time.time()
    html_template.article(page, [], {0: html_template.SHORT})
    assert time.time() - began < 20


# 2


def _windows(words):
    n = min(len(words), 10)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_winnowing_equals_all_windows(spark):
    pick = random.Random(2)
    text = lambda n: " ".join(pick.choice("abcd") for _ in range(n))
    items = [(1, text(12)), (2, text(30)), (3, "a b"), (4, "a b"), (5, None), (6, "?!"), (None, text(10)), (7, text(10))]
    rows = [(i, text(pick.randrange(60))) for i in range(60)] + [(60, items[1][1] + " " + items[0][1]), (61, None), (62, "z a B! z")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for most in (8_000_000, 1):  # by a broadcast index, and by a join
        for r in winnow.decontaminate(d, b, max_chars=most).collect():
            words, hit, found = plain(dict(rows)[r.doc_id]), set(), set()
            for i, t in items:
                for w in _windows(plain(t)):
                    for p in range(len(words) - len(w) + 1):
                        if tuple(words[p : p + len(w)]) == w:
                            hit |= set(range(p, p + len(w)))
                            found |= {i} - {None}
            ids = ",".join(sorted(map(str, found)))
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


def test_fingerprints_are_few_and_enough():
    """Far fewer fingerprints than grams, and one in each window, the same wherever the window stands."""
    numpy, how, pick = winnow.np, winnow.Winnowing(), random.Random(3)
    ids = numpy.array([pick.randrange(50) for _ in range(5_000)], numpy.int32)
    kept = how.kept(ids)
    assert len(kept) == len(ids) - how.window + 1 and 1 + (numpy.diff(kept) != 0).sum() < len(ids) / 3
    assert (how.kept(ids[700:800]) == kept[700:791]).all()
    index = winnow.ItemIndex([(7, b" ".join(b"w%d" % x for x in ids[100:400]))], how)
    assert len(index.prints) < 100
    other = [b"x", *(b"w%d" % x for x in ids[150:180]), b"y", *(b"w%d" % x for x in ids[200:209]), b"z"]
    assert winnow.merged(*index.hits(numpy.array(index.numbers(other), numpy.int32))[:2]).tolist() == [1, 31]


def test_repeated_words_and_shared_phrases(spark):
    """One word thousands of times, and thousands of items that share a phrase: each document's work follows its own words."""
    phrase, pick = "choose the one best answer to each of the questions", random.Random(4)
    items = [(i, f"{phrase} {' '.join(f'w{pick.randrange(9)}' for _ in range(6))}") for i in range(3_000)]
    items += [(5_000, "so " * 4_000), (5_001, "so so")]
    rows = [(0, f"a {phrase} b {phrase}"), (1, "so " * 16_000), (2, "so " * 9 + "x"), (3, "clean"), (4, items[7][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    by_window: dict[tuple, set] = {}
    for i, t in items:
        for w in _windows(t.split()):
            by_window.setdefault(w, set()).add(i)
    want = {}
    for i, t in rows:
        words, hit, found = t.split(), set(), set()
        for n in (2, 10):
            for p in range(len(words) - n + 1):
                if own := by_window.get(tuple(words[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= own
        want[i] = (len(hit), sorted(found))
    for most in (8_000_000, 1):
        got = {r.doc_id: (r.n_hit, sorted(r.item_ids)) for r in winnow.decontaminate(d, b, max_chars=most).collect()}
        assert got == want
    index = winnow.ItemIndex([(i, t.encode()) for i, t in items], winnow.Winnowing())
    began = time.perf_counter()
    index.hits(winnow.np.array(index.numbers([b"so"] * 16_000), winnow.np.int32))
    assert time.perf_counter() - began < 1


def test_winnowing_of_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, "three four")], "item_id long, text string")
    assert winnow.decontaminate(odd, items).count() == len(ODD)
    kept = winnow.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert winnow.keep_clean(odd, items.where("false")).count() == len(ODD) and winnow.keep_clean(none, items).count() == 0
    a, b = (sorted(map(str, winnow.decontaminate(odd, items, max_chars=m).drop("item_ids").collect())) for m in (100, 1))
    assert a == b


# 3


def _best(part):
    scores = {t: (s, i) for t, s, i in PIECES.pieces}
    best = [(0.0, [])] + [None] * len(part)
    for end in range(1, len(part) + 1):
        for start in range(max(0, end - 48), end):  # the longest last piece first
            w = part[start:end]
            if w in scores:
                new = best[start][0] + scores[w][0], best[start][1] + [scores[w][1]]
            elif len(w) == 1:
                new = best[start][0] + PIECES.unknown_score, best[start][1] + [PIECES.byte_ids[x] for x in w.encode()]
            else:
                continue
            if best[end] is None or new[0] > best[end][0]:
                best[end] = new
    return best[-1][1]


def test_viterbi_equals_dynamic_programming():
    encoder, decoder, pick = sentencepiece_codec.Encoder(PIECES, remember=50), sentencepiece_codec.Decoder(PIECES), random.Random(1)
    alphabet = [*"abcde éß▁ ,.!\n\t1239梦𝄞ǅ²", "the", "ing", " "]
    for _ in range(600):
        text = "".join(pick.choice(alphabet) for _ in range(pick.randrange(40)))
        ids = encoder.encode(text).tolist()
        assert decoder.decode(ids) == text
        if text and "▁" not in text:
            assert ids == _best("▁" + text.replace(" ", "▁"))


def test_encoding_of_odd_rows(odd, none):
    found = sentencepiece_codec.encode(odd, PIECES)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in found.collect())
    texts = sorted((r.doc_id or 0, r.text) for r in sentencepiece_codec.decode(found, PIECES).collect())
    assert texts == sorted((i or 0, t or "") for i, t in ODD)
    assert sentencepiece_codec.encode(none, PIECES).count() == 0


# 4


def _components(rows):
    sets, at = {}, defaultdict(set)
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    near = {i: {i} for i in sets}
    for i in sets:
        for j in sets:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                near[i].add(j)
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        at[i] = min(seen)
    return sets, at


@pytest.mark.parametrize("blocks", [(4096, 512), (3, 2)])
def test_near_duplicates_equal_all_pairs(spark, blocks):
    pick = random.Random(4)
    base = [[f"w{pick.randrange(500)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):  # texts along a line of changes, linked with some and not with others
        words = list(pick.choice(base))
        for _ in range(pick.randrange(5)):
            words[pick.randrange(60)] = f"x{pick.randrange(50)}"
        rows.append((i + 1, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a b c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets, at = _components(rows)
    for r in hamming_dedup.near_duplicates(d, block=blocks[0], text_block=blocks[1]).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), at[r.doc_id], at[r.doc_id] == r.doc_id)


def test_every_pair_within_the_distance_shares_a_key():
    import numpy as np

    how, pick = hamming_dedup.Signatures(), np.random.default_rng(0)
    x = pick.integers(0, 2**16, (200, how.size)).astype(np.uint16)
    y = x.copy()
    for row in y:
        row[pick.choice(how.size, how.distance, replace=False)] += 1
    assert (hamming_dedup._long_keys(x, how) == hamming_dedup._long_keys(y, how)).any(1).all()


def test_dedup_of_odd_rows(odd, none):
    found = hamming_dedup.near_duplicates(odd).collect()
    assert len(found) == len(ODD) and {r.component_id for r in found if r.doc_id in (5, 6)} == {5}
    assert [r.n_shingles for r in found if r.doc_id == 9] == [1]
    found = {(r.doc_id, r.component_id, r.kept) for r in hamming_dedup.near_duplicates(odd).collect()}
    assert (None, None, True) in found and (6, 5, False) in found
    kept = hamming_dedup.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and ids.count(6) == 0
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()}
    assert hamming_dedup.near_duplicates(none).count() == 0


def test_components(spark):
    pick = random.Random(9)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for i in {x for e in edges if e[0] != e[1] for x in e}:
        seen, todo = {i}, [i]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert found[i] == min(seen)


# 5


def test_base_statistics(odd, docs, spark):
    rows = ODD + list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in decision_list.base_statistics(df).collect():
        t = rows[r.doc_id][1] or ""
        w = SPACED.findall(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_learned_rules_on_a_fold_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rules = decision_list.learn(docs, labels.where(queries.fold(3) != 1))
    judged = decision_list.judge(docs.where(queries.fold(3) == 1).select("doc_id", "text"), rules).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    right = sum(r["count"] for r in judged if r.kept == (r.quality == 1))
    assert right >= 0.97 * sum(r["count"] for r in judged) > 0
    kept = decision_list.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == decision_list.judge(docs.select("doc_id", "text"), rules).where("kept").count()


def test_rules_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(4, 0), (4, 1), (7, 1), (None, 1), (9, None)], "doc_id long, quality int")
    assert decision_list.keep_good(odd, decision_list.learn(odd, labels)).columns == odd.columns
    rules = decision_list.learn(none, labels.where("false"))
    assert rules == [] and decision_list.keep_good(none, rules).count() == 0


# 6 and 9

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _personal(t):
    number = lambda m: re.sub("[^0-9]", "", m)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(number(m[0])) <= 19 and pii_crf.luhn(number(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(number(m[0])) <= 15]


def _secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secret_crf.KINDS.index(s[0])))


def test_base_spans(docs):
    pick = random.Random(6)
    texts = [t or "" for _, t in ODD] + docs.text.tolist()
    texts += ["".join(pick.choice(["a", "9", "12", ".", "@", "-", "+", " ", "(", ")", "4111 1111 1111 1111", "x.y", "token", "=", "'", "AKIA", "0123456789abcdef", "API_KEY:"]) for _ in range(30)) for _ in range(3000)]
    for t in texts:
        assert pii_crf.base_spans(t) == _personal(t) and secret_crf.base_spans(t) == _secrets(t)


@pytest.mark.parametrize("module", [pii_crf, secret_crf])
def test_taggers(module, spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model, columns = module.learn(docs), chain_crf.Columns()
    found = hit = 0
    texts = [r.text for r in docs.select("text").collect()]
    for k, t in enumerate(texts):
        base = module.base_spans(t)
        spans = model.spans(t, columns, base)
        assert set(base) <= set(spans)
        others = [s for s in spans if s not in base]
        assert not any(a < y and x < b for _, a, b in others for _, x, y in base)
        wanted = base if module is pii_crf else module.values(t)
        if wanted:
            changed, moved = module.variant(t, wanted, k if module is pii_crf else random.Random(k))
            got = model.spans(changed, columns, module.base_spans(changed))
            found += len(moved)
            hit += sum(any(a < s[-1] and s[-2] < b for _, a, b in got) for s in moved)
    assert hit >= 0.95 * found > 0
    out = module.find(odd, model).collect()
    assert len(out) == len(ODD) and [r.spans for r in out if r.doc_id == 1] == [""]
    assert module.find(none, model).count() == 0 and module.learn(none) is not None


def _enumerated(e, transitions, held, skips=(), agree=None):
    """Marginals and the best labels of one sequence by trying all labellings."""
    np, kinds = chain_crf.np, e.shape[1]
    total, best, out = 0.0, (-math.inf, None), np.zeros_like(e)
    for y in product(range(kinds), repeat=len(e)):
        x = sum(e[k, j] for k, j in enumerate(y)) + sum(transitions[a, b] for a, b in zip(y, y[1:], strict=False))
        x += (transitions[0, y[0]] + transitions[y[-1], 0]) * held + sum(agree[y[i], y[j]] for i, j in skips)
        best = max(best, (x, [-v for v in y]))
        total += math.exp(x)
        for k, j in enumerate(y):
            out[k, j] += math.exp(x)
    return out / total, [-v for v in best[1]]


@pytest.mark.parametrize("held", [False, True])
def test_chain_equals_enumeration(held):
    np = chain_crf.np
    draw = np.random.default_rng(5)
    for n in (1, 2, 5):
        chain = chain_crf.Chain(draw.normal(size=(6, 3)), draw.normal(size=(3, 3)) * 2, held)
        flat = chain_crf.Flat.of([[[int(draw.integers(6)) for _ in range(3)] for _ in range(n)]])
        p, best = _enumerated(chain.emissions(flat), chain.transitions, held)
        assert np.allclose(chain.marginals(flat), p) and chain.viterbi(chain.emissions(flat)) == best


def test_training_follows_the_likelihood():
    """The slope of the log-likelihood of a held chain, and what training does to it."""
    np = chain_crf.np
    draw = np.random.default_rng(6)
    sequences = [[[int(draw.integers(5))] for _ in range(k)] for k in (3, 1, 4, 2)]
    flat, labels = chain_crf.Flat.of(sequences), draw.integers(0, 3, 10)

    def likelihood(chain):
        e, out, at = chain.emissions(flat), 0.0, 0
        for n in flat.lengths:
            y = labels[at : at + n]
            own = sum(e[at + k, y[k]] for k in range(n)) + sum(chain.transitions[a, b] for a, b in zip(y, y[1:], strict=False)) + chain.transitions[0, y[0]] + chain.transitions[y[-1], 0]
            every = [sum(e[at + k, v] for k, v in enumerate(z)) + sum(chain.transitions[a, b] for a, b in zip(z, z[1:], strict=False)) + chain.transitions[0, z[0]] + chain.transitions[z[-1], 0] for z in product(range(3), repeat=int(n))]
            out += own - math.log(sum(map(math.exp, every)))
            at += n
        return out

    fitted = chain_crf.train(flat, labels, 5, 3, held=True, l2=0.0, steps=400)
    best = likelihood(fitted)
    assert best > likelihood(chain_crf.Chain(np.zeros((5, 3)), np.zeros((3, 3)), True))
    for _ in range(20):  # no near model is clearly better
        other = chain_crf.Chain(fitted.weights + 0.02 * draw.normal(size=(5, 3)), fitted.transitions + 0.02 * draw.normal(size=(3, 3)), True)
        assert likelihood(other) < best + 0.02


def test_message_passing_equals_enumeration_without_loops():
    np = chain_crf.np
    draw = np.random.default_rng(7)
    kinds = len(pii_crf.LABELS)
    chain = chain_crf.Chain(draw.normal(size=(8, kinds)), draw.normal(size=(kinds, kinds)), True)
    flat = chain_crf.Flat.of([[[1], [2]], [[3]], [[4]]])  # three runs, the skip edges join them to a tree
    model = pii_crf.SkipChain(chain, 1.7)
    e = chain.bounded(chain.emissions(flat), np.array([0, 2, 3]), np.array([1, 2, 3]))
    transitions = np.zeros((kinds, kinds))
    total, out = 0.0, np.zeros_like(e)
    for y in product(range(kinds), repeat=4):
        x = math.exp(sum(e[k, j] for k, j in enumerate(y)) + chain.transitions[y[0], y[1]] + transitions[y[1], y[2]] + 1.7 * (pii_crf.AGREE[y[1], y[2]] + pii_crf.AGREE[y[2], y[3]]))
        total += x
        for k, j in enumerate(y):
            out[k, j] += x
    assert np.allclose(model.marginals(flat, [(1, 2), (2, 3)]), out / total, atol=1e-3)
    alone = model.marginals(flat, [])
    assert np.allclose(alone, chain.marginals(flat)) and not np.allclose(alone, out / total, atol=1e-2)


def test_repeats_agree():
    """A skip edge lends a doubtful token the label of its like."""
    np = chain_crf.np
    chain = chain_crf.Chain(np.zeros((3, len(pii_crf.LABELS))), np.zeros((len(pii_crf.LABELS),) * 2), True)
    chain.weights[1, 7], chain.weights[2, 0] = 6.0, 0.5
    flat = chain_crf.Flat.of([[[1]], [[2]]])
    assert pii_crf.SkipChain(chain, 2.0).marginals(flat, [(0, 1)]).argmax(1).tolist() != pii_crf.SkipChain(chain, 2.0).marginals(flat, []).argmax(1).tolist()


def test_spelled_alike():
    same = [["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["+1 (743) 555-3824", "17435553824", "001 743 555 3824"], ["A.B@c.org", "a.b(at)c.org", "a[dot]b{at}c[dot]org"], ["192.168.100.200", "192[.]168[.]100[.]200"]]
    keys = [{pii_crf.spelled_alike(t) for t in row} for row in same]
    assert all(len(k) == 1 for k in keys) and len(set.union(*keys)) == len(same)
    assert len({pii_crf.spelled_alike(t) for t in ("1.2.3", "12.3", "123", "192.168.100.200", "192168100200")}) == 5


def _planted(docs, pieces):
    """Texts with pieces between two of their words, and where the first piece is then."""
    for k, (text, row) in enumerate(zip(docs, pieces, strict=False)):
        words = text.split(" ")
        at = k * 31 % (len(words) + 1)
        before = "".join(w + " " for w in words[:at])
        yield " ".join([before + row[0], *words[at:], *row[1:]]), len(before)


def test_entities_that_the_patterns_miss(spark):
    """Found: numbers that a pattern runs together, and known things in unknown spellings, the latter by skip edges alone.
    Nothing is added to plain numbers, and to documents as they are nothing but cards side by side."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    model, columns = pii_crf.learn(docs), chain_crf.Columns()
    added = lambda m, t: [s for s in m.spans(t, columns, base) if s not in base] if (base := pii_crf.base_spans(t)) is not None else []
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    for t in texts:
        assert all(k == "card" and pii_crf.luhn(t[a:b]) and 13 <= b - a <= 19 for k, a, b in added(model, t))
    draw = random.Random(3)
    first = ["4" + "".join(draw.choice("0123456789") for _ in range(14)) for _ in range(100)]
    cards = [next(c + d for d in "0123456789" if pii_crf.luhn(c + d)) for c in first]
    phones = ["1" + "".join(draw.choice("23456789") for _ in range(10)) for _ in range(100)]
    short = [t for t in texts if len(t) < 6_000][:100]
    # two cards that the pattern takes for one number
    twice = list(_planted(short, [(f"{c} {c}",) for c in cards]))
    found = [{("card", at, at + 16), ("card", at + 17, at + 33)} & set(added(model, t)) for t, at in twice]
    assert sum(map(len, found)) >= 0.95 * 2 * len(twice)
    # known elsewhere in the text: with skip edges, and without
    chain = pii_crf.SkipChain(model.chain, 0.0, model.least, 0.0)
    for kind, pieces in (("card", [(f"({c[:8]}){c[8:]}", c) for c in cards]), ("phone", [(p, f"+{p[0]} ({p[1:4]}) {p[4:7]}-{p[7:]}") for p in phones])):
        known = [(t, (kind, at, at + len(row[0]))) for (t, at), row in zip(_planted(short, pieces), pieces, strict=True)]
        assert sum(s in added(model, t) for t, s in known) >= 0.85 * len(known)
        assert sum(s in added(chain, t) for t, s in known) <= 0.2 * len(known)
    # what is none, half of it in forms that training lacks
    for plain in ("10:42:17.306", "4,513,220", "ISBN 978-3-551-55167-2", "7301928455", "300.12.400.1", "2021-11-04", "4111111111111112", "3.1.4"):
        for (t, at), bare in zip(_planted(short, [(plain,)] * 100), short, strict=True):
            assert not [s for s in added(model, t) if s[1] < at + len(plain) and s[2] > at], (plain, bare[:40])
    # through the query: the same document with and without the known spelling
    rows = [(1, f"call {phones[0]} or +1 ({phones[0][1:4]}) {phones[0][4:7]}-{phones[0][7:]} of the"), (2, f"call {phones[0]} or not of the")]
    out = {r.doc_id: r.spans for r in pii_crf.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out[1] == "phone:5:16,phone:20:37" and out[2] == ""


LONG = ["9" * 10_000 + ".1.1.1", "1.1.1." + "0" * 9_000 + "255", "1.1.1.256 " * 3, "+1" + " " * 50_000, "+" + "1" * 50_000, "a" * 100_000 + "@" * 1_000, "1 " * 100_000, "token" + " " * 50_000, "0123456789abcde " * 20_000, "x1" * 100_000, "(at)" * 20_000]


def test_long_runs(spark):
    """Numbers beyond what int() reads, and texts on which patterns might work long; seconds for all of them."""
    began = time.time()
    assert pii_crf.base_spans(LONG[0]) == [] and pii_crf.base_spans(LONG[1]) == [("ip", 0, len(LONG[1]))] and pii_crf.base_spans(LONG[2]) == []
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    model, tagger = pii_crf.learn(df), secret_crf.learn(df)
    assert pii_crf.find(df, model).count() == len(LONG) == secret_crf.find(df, tagger).count()
    assert [r.text for r in pii_crf.redact(df.where("doc_id = 1"), model).collect()] == ["[IP]"]
    for t in LONG:
        pii_crf.SkipChain(chain_crf.Chain(chain_crf.np.zeros((chain_crf.WIDTH, 9)), chain_crf.np.zeros((9, 9)), True)).spans(t, chain_crf.Columns(), [])
        secret_crf.Tagger(chain_crf.Chain(chain_crf.np.zeros((chain_crf.WIDTH, 3)), chain_crf.np.zeros((3, 3)), True)).spans(t, chain_crf.Columns(), [])
    assert time.time() - began < 120


#: Secrets and numbers in spellings that no variant has.
OTHER_SECRETS = ["pwd = CorrectHorseBattery", "passwd: hunter2xyz", "Bearer mF_9.B5f-4.1JqM", "export KEY=abcd1234efgh5678zz", "signing_secret: Zq8rT5vX2mN7", "client_key := 77fa-90Bc-QQ1z-77aa", "credential: MorningTrain42", "auth = tR9vKm2LpQ8s"]
NO_SECRETS = ["the secret of the forest is old", "a token of love, weekly", "in private, he said", "see https://example.com/private/path", "the key to the door", "password rules are hard to learn", "an author and a bearer of news", "credentials of the ambassador"]


def test_secrets_outside_the_variants(spark):
    model, columns = secret_crf.learn(table(spark, "/root/testdata/sf0.01", "documents")), chain_crf.Columns()
    found = [t for t in OTHER_SECRETS if model.spans(f"we wrote {t} in it", columns, [])]
    wrong = [t for t in NO_SECRETS if model.spans(f"we wrote {t} in it", columns, [])]
    assert len(found) >= 6 and not wrong


PLAIN = ["ARE!! THE!! 233.233.171.252!! HE", "from version 10.4.3.2 on", "on 2021-03-04 at noon", "order 48-2231-9921-77 was sent", "it cost 123456.7891 in all"]


def test_plain_numbers_are_no_secrets(spark):
    """Over the documents as they are no plain number is marked; of secrets planted in them most are found, and little else."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("text is not null")
    model, columns = secret_crf.learn(docs), chain_crf.Columns()
    assert not [t for t in PLAIN if model.spans(t, columns, [])]
    added = lambda t: [t[a:b] for k, a, b in model.spans(t, columns, secret_crf.base_spans(t)) if k == "secret"]
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert not [x for t in texts for x in added(t) if re.fullmatch(r"[0-9]+([./:_-][0-9]+)*", x)]
    pick, true, false, planted = random.Random(9), 0, 0, 0
    for t in texts[:400]:
        words, secret = t.split(" "), pick.choice(OTHER_SECRETS)
        words.insert(pick.randrange(len(words) + 1), secret)
        found = added(" ".join(words))
        value = re.split("[ =]", secret)[-1]
        planted += 1
        true += any(x in secret and value in x for x in found)
        false += sum(x not in secret for x in found)
    assert true >= 0.75 * planted and false <= 0.02 * planted, (true, false, planted)


def test_tokens_near_many_cores():
    assert len(secret_crf.tokens_of("token" * 20_000 + " a b c d e f g h")) == 1 + secret_crf.NEAR
    assert [t.text for t in secret_crf.tokens_of("token a token b c d e f g")] == "token a token b c d e".split()


def test_beliefs_without_joint_ones():
    """Resting messages change no belief by more than the tolerance, loops or not."""
    numpy = chain_crf.np
    pick = numpy.random.default_rng(8)
    e, edges = pick.normal(size=(200, 9)), pick.integers(0, 200, (300, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    potentials, which = pick.normal(size=(2, 9, 9)) * 0.3, pick.integers(0, 2, len(edges))
    p, joint = pii_crf.beliefs(e, edges, potentials, which)
    q, none = pii_crf.beliefs(e, edges, potentials, which, joint=False, close=0.0, block=7)
    assert none is None and joint.shape == (len(edges), 9, 9) and abs(p - q).max() < 1e-3


def test_redaction(spark, odd):
    model = pii_crf.learn(odd)
    out = pii_crf.redact(odd, model)
    assert out.columns == odd.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[1] == (None, 7) and texts[2] == ("", 0)
    assert "[EMAIL]" in texts[8][0] and "555-7713" not in texts[8][0] and texts[8][1] == len(texts[8][0])
    assert pii_crf.redacted("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


# 7


def counted_model(texts, order):
    """p(context, word) of an interpolated modified Kneser-Ney model by plain counting; texts: lists of words."""
    grams = [Counter(g for t in texts for g in zip(*([*["<s>"] * (order - 1), *t][i:] for i in range(order)), strict=False))]
    for _ in range(order - 1):  # continuation counts, but occurrences where a text begins
        shorter = Counter()
        for g, k in grams[0].items():
            shorter[g[1:]] += k if len(g) > 2 and g[1] == "<s>" else 1
        grams.insert(0, shorter)
    cuts = [ngram_lm.discounts(*(sum(x == k for x in t.values()) for k in (1, 2, 3, 4))) for t in grams]
    cut = lambda k, d: max(0.0, k - d[min(k, 3) - 1]) if k else 0.0
    contexts = [defaultdict(lambda: [0, 0, 0, 0]) for _ in grams]
    for t, of in zip(grams, contexts, strict=True):
        for g, k in t.items():
            of[g[:-1]][0] += k
            of[g[:-1]][min(k, 3)] += 1

    def p(context, word):
        out = 1 / (len(grams[0]) + 1)
        for k in range(order):
            h = tuple(context[len(context) - k :])
            if h in contexts[k]:
                x = contexts[k][h]
                out = cut(grams[k][(*h, word)], cuts[k]) / x[0] + sum(d * n for d, n in zip(cuts[k], x[1:], strict=True)) / x[0] * out
        return out

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_equals_counting(spark, order):
    rows = table(spark, SF, "documents")
    model = ngram_lm.learn(rows.where(queries.fold(10) != 0), order, a_bucket=20_000, block=1_000, most_parts=3)
    docs = {r.doc_id: [*SPACED.findall((r.text or "").translate(LOWER)), " end"] for r in rows.collect()}
    train = [d for d in docs if zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for d in train for w in docs[d])
    n, v = sum(c.values()), len(c)
    p = counted_model([docs[d] for d in train], order)
    assert sum(p(["of", "the", "the"][1 - order :], w) for w in c) + p(["of", "the", "the"][1 - order :], "\0") == pytest.approx(1)
    assert model.words.tokens == n
    for r in ngram_lm.score(rows, model).collect():
        words = docs[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(words), sum(w in c for w in words))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        padded = [*["<s>"] * (order - 1), *words]
        assert r.score == pytest.approx(sum(math.log10(p(padded[i : i + order - 1], w)) for i, w in enumerate(words)))


def test_query_of_the_model(spark):
    found = queries.op7_lm_scoring(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in found)
    assert {r.train_tokens for r in found} == {sum(r.n_tokens for r in found if not r.held_out)}
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_meets_what_training_lacks(spark):
    """Few distinct n-grams, so most parts are empty, and known words in new order."""
    text = spark.createDataFrame([(i, "a b c d e f g h " * 40) for i in range(10)], "doc_id long, text string")
    other = spark.createDataFrame([(1, "h g f e d c b a"), (2, "b c d x"), (3, None)], "doc_id long, text string")
    for order in (2, 3):
        model = ngram_lm.learn(text, order, a_bucket=50, most_parts=40)
        p = counted_model([[*"abcdefgh" * 40, " end"]] * 10, order)
        for r in ngram_lm.score(other, model).collect():
            words = {1: [*"hgfedcba", " end"], 2: [*"bcdx", " end"], 3: [" end"]}[r.doc_id]
            padded = [*["<s>"] * (order - 1), *words]
            assert r.score == pytest.approx(sum(math.log10(p(padded[i : i + order - 1], w)) for i, w in enumerate(words)))


def test_large_counts_are_kept(tmp_path):
    """Counts beyond 32 bits stand in a file of their own."""
    keys = ngram_lm.key_of([ngram_lm.np.arange(5), ngram_lm.np.arange(5)])
    words = ngram_lm.Vocabulary(str(tmp_path), 0, (5,), 10)
    blob = ngram_lm._packed([ngram_lm.np.arange(5), ngram_lm.np.arange(5), ngram_lm.np.array([1, 2**32 - 1, 7, 2**40, 2])])
    row = ngram_lm._batch([(0, 0, blob)], ngram_lm._BLOB_TYPES)
    list(ngram_lm._tables(str(tmp_path), 2, None, 10, 5)(iter([row])))
    model = ngram_lm.Model(words, 2, ngram_lm.Layout(1, 0, 10), 10, 1, ((0.5, 1.0, 1.5),) * 2, (frozenset([0]),), 1, 1.0)
    assert model._about(2, keys, ngram_lm.np.zeros(5, int))[:, 0].tolist() == [1, 2**32 - 1, 7, 2**40, 2]


def test_words_hash_by_their_bytes():
    """Words of any size: equal hashes just for equal words, and one end for each text."""
    pick = random.Random(3)
    words = sorted({"".join(pick.choice("ab\0é") for _ in range(n)) for n in [*range(1, 40), *range(60, 70), 500] for _ in range(20)})
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(60))).encode() for _ in range(100)] + [b"", b" \n\x0b", b"A a"]
    hashes, codes, sizes = ngram_lm.hashed_tokens(texts)
    flat = [w for t in texts for w in [*t.lower().split(), b" end"]]
    assert sizes.tolist() == [len(t.split()) + 1 for t in texts] and len(codes) == len(flat)
    assert len(set(zip(codes.tolist(), flat, strict=True))) == len(set(flat)) == len(set(hashes.tolist())) == len(hashes)
    other = ngram_lm.hashed_tokens(texts[::-1])
    assert set(other[0].tolist()) == set(hashes.tolist())


def test_numbers_in_a_byte_come_back():
    np = ngram_lm.np
    rows = np.array([*product(range(9), range(7), range(4), range(2), (0, 1, 13, 14, 300))])
    low, large = ngram_lm._narrowed(rows)
    found = ngram_lm._widened(low, 5)
    assert (found[~large] == rows[~large]).all() and (found[large] == ngram_lm._FULL).all() and (~large).sum() > 40


def test_order_is_stable():
    pick = ngram_lm.np.random.default_rng(1)
    for most in (2, 2**40, 2**64 - 1):
        keys = pick.integers(0, most, 5_000, ngram_lm.np.uint64)
        keys = ngram_lm.np.concatenate([keys, keys[::2], keys[::3] ^ ngram_lm.np.uint64(1)])
        assert (ngram_lm._order(keys) == ngram_lm.np.argsort(keys, kind="stable")).all()
    assert len(ngram_lm._order(keys[:0])) == 0 and ngram_lm._order(keys[:1]).tolist() == [0]


@pytest.mark.parametrize("n", [1, 100, 5_000])
def test_keys_are_found(tmp_path, n):
    np = ngram_lm.np
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64 - 1, n, np.uint64))
    ngram_lm.Keys.save(str(tmp_path), "k", [keys[: n // 3], keys[n // 3 :]])
    at, ok = ngram_lm.Keys.find(str(tmp_path), "k", np.concatenate([keys[::-1], keys ^ np.uint64(2**30), np.array([0, 2**64 - 1], np.uint64)]))
    assert at[:n].tolist() == list(range(n))[::-1] and ok[:n].all() and not ok[n:].any()


def test_model_takes_a_byte_a_number(spark):
    """What is known of an n-gram takes five bytes of key and one for its numbers if they are small, nothing is written besides the model and
    the words' counts, and frequent words have the low numbers."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("*"))
    model = ngram_lm.learn(table(spark, SF, "documents"))
    assert {f.name.split("-")[1] for f in set(shared.glob("*")) - before} == {"lm", "unigrams"}
    size = lambda name: sum(f.stat().st_size for f in Path(model.words.folder).glob(f"{name}-*"))
    assert 5 * size("about-3") == size("keys-3") - 3 and 5 * size("about-2") == size("keys-2") - 3
    ids, counts = model.words.find(ngram_lm.load(model.words.folder, "words-0", "uint64"))
    assert sorted(ids.tolist()) == list(range(model.words.words)) and counts.sum() == model.words.tokens
    falling = counts[ngram_lm.np.argsort(ids)]
    assert (2 * falling[:-1] > falling[1:]).all()


def test_model_of_odd_rows(odd, none):
    small = ngram_lm.learn(odd, a_bucket=500, block=3)  # many buckets and blocks, hot words dealt over them
    whole = ngram_lm.learn(odd)
    x, y = ({(r.doc_id, r.n_tokens): round(r.score, 9) for r in ngram_lm.score(odd, m).collect()} for m in (small, whole))
    assert x == y and len(ngram_lm.score(odd, whole).collect()) == len(ODD)
    assert all(r.score <= 0 for r in ngram_lm.score(odd, ngram_lm.learn(none)).collect())
    assert ngram_lm.score(none, whole).count() == 0


# 8


def test_chain_equals_enumeration():
    import itertools

    import numpy as np

    pick = np.random.default_rng(1)
    model = chain_crf.Chain(pick.normal(size=(6, 3)), pick.normal(size=(3, 3)))
    sequences = [[[0, 2], [1], [5, 5]], [[3]], [[4, 1], [2]]]
    flat = chain_crf.Flat.of(sequences)
    e, got, at = model.emissions(flat), model.marginals(flat), 0
    for s in sequences:
        n = len(s)
        own = e[at : at + n]
        every = list(itertools.product(range(3), repeat=n))
        score = np.array([sum(own[t, y[t]] for t in range(n)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:], strict=False)) for y in every])
        w = np.exp(score - score.max())
        for t in range(n):
            assert np.allclose(got[at + t], [w[[y[t] == k for y in every]].sum() / w.sum() for k in range(3)])
        assert tuple(model.viterbi(own)) == every[int(score.argmax())]
        at += n


def test_classifier_on_held_out_labels(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    found = queries.op8_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.97 * len(found) > 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    labels = spark.createDataFrame([(4, 0), (7, 1), (9, 0), (5, 1), (None, 0)], "doc_id long, quality int")
    assert line_crf.score(odd, line_crf.learn(odd, labels)).count() == len(ODD)
    untrained = line_crf.learn(odd, labels.where("false"))
    assert {r.score for r in line_crf.score(odd, untrained).collect()} == {0.5} and line_crf.score(none, untrained).count() == 0


def test_capitals_late_in_a_line_count():
    start = "small letters " * 6  # more than 64 bytes of ASCII
    for late in ("ÉÀÖ", "ДЖЯ", "ΩΣΔ"):
        line = (start + late).encode()
        assert line_crf.statistics([line])[0, 3] == pytest.approx(3 / len(line.replace(b" ", b"")))


# 10


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "http://a.COM", "http://a.com/", "HTTP://WWW.Example.com/en/x?q#f", "http://m.example.com/en/", "http://xexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://casino.example.org/x", "http://casinox.example.org/", "http://phish.example.org/a/login/", "a://b?c/d"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *urls])], "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("rule"))
    found = {r.page_id: r for r in url_rules.judge_urls(pages).collect()}
    assert len(found) == 2 * len(urls) and url_rules.judge_urls(pages.where("false")).count() == 0
    for k, u in enumerate([*urls, *urls]):
        r = found[k]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [x for x in url_rules.HOST_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        blocked = any(re.search(x.regex(), (u or "").lower(), re.S) for x in url_rules.PATTERN_RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.name, best.action if best else "block" if blocked else "allow")


def test_many_rules_equal_trying_all(spark):
    """100,000 rules from a table: few are tried on a URL, and the verdicts are those of trying all that could fit."""
    rows = [(None, None, f"^site{k % 50_000}^page{k}^", "block" if k % 3 else "allow") for k in range(99_000)]
    rows += [("h.example", f"/{k}/", None, "block") for k in range(990)] + [("h.example", "/5/x", None, "allow"), (None, None, "*gif", "block"), (None, None, "no", None), (None, None, None, "allow")]
    hosts, patterns = url_rules.rules_of(spark.createDataFrame(rows, "host string, path string, pattern string, action string"))
    assert (len(hosts), len(patterns)) == (991, 99_001)
    urls = [f"http://site{k}.example/a/page{k + j}/x" for k in range(40) for j in (0, 1, 50_000)] + ["http://x.h.example/5/xyz", "http://h.example/77/", "http://h.example/1000/", "http://a/b.gif", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r for r in url_rules.judge_urls(pages, hosts, patterns).collect()}
    frequency = url_rules.literal_frequency(pages, patterns)
    index = url_rules.PatternIndex(patterns, frequency)
    near = [r for r in patterns if r.pattern == "*gif" or int(re.search("page([0-9]+)", r.pattern)[1]) in {*range(45), *range(50_000, 50_045)}]
    for k, u in enumerate(urls):
        assert len(index.candidates((u or "").lower())) <= 5
        first = next((r.action for r in near if re.search(r.regex(), (u or "").lower(), re.S)), "allow")
        own = {"http://x.h.example/5/xyz": ("h.example/5/x", "allow"), "http://h.example/77/": ("h.example/77/", "block")}.get(u, (None, first))
        assert (found[k].rule, found[k].verdict) == own


def test_rules_without_a_literal_are_tried_always():
    rules = [url_rules.PatternRule("*gif"), url_rules.PatternRule("^ads^", "allow")]
    index = url_rules.PatternIndex(rules, {})
    assert index.find("http://x/ads/y.gif") == "block" and index.find("http://x/ads/") == "allow" and index.find("http://x/") is None
