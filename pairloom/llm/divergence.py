"""How the sources of a language differ from one another in their words: an audit in plain relational steps.

Terms are taken by a regular expression and counted by language and source. Each language keeps the terms that enough of
its documents have; its groups are crossed with these, so that terms a group lacks count 0, and get smoothed shares in parts
of a billion. The shares of two sources of a language meet in a self-join on language and term, and the distances
floor((p-q)^2 / (p+q)) add up. All arithmetic is exact.

Null text, lang and source are read as ''. Empty texts have no terms, but their groups occur. Repeated rows count as often as
they stand there. A language that keeps no term has distances of 0 and no terms. Of equal values the item with the lesser
UTF-8 bytes comes first. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.tables import written

#: Runs of ASCII letters and non-ASCII characters.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A share of 1.
WHOLE = 1_000_000_000


def _lowered(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) of docs (text, lang, source).

    A document's terms and its distinct terms are exploded into one table, so counts are summed in the tasks before a row is
    sent, and no row is sent for a document.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    read = docs.select(empty("lang"), empty("source"), F.regexp_extract_all(_lowered(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)).alias("terms"))
    marked = F.array(F.struct(F.col("terms").alias("t"), F.lit(1).alias("n"), F.lit(0).alias("d")), F.struct(F.array_distinct("terms").alias("t"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    parts = read.select("lang", "source", F.explode(marked).alias("x")).select("lang", "source", F.explode("x.t").alias("term"), "x.n", "x.d")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


def _share(count: str, total: str) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 v)); decimals, so that the counts of any corpus fit."""
    return F.expr(f"cast(1 + (cast({count} + 2 as decimal(20,0)) * {WHOLE} div (cast({total} as decimal(20,0)) + 2 * v)) as long)")


def shares(docs: DataFrame, least_docs: int = 10, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Every occurring group (lang, source), and lang, source, term, n, p (the group's share) and q (the language's) for
    each group and each kept term of its language.

    The crossing joins a language's groups and terms on language and one of `salts` parts of the terms, so that one language
    is spread over many tasks.
    """
    counts = written(term_counts(docs), "terms")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    groups = docs.select(empty("lang"), empty("source")).distinct()
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "vocabulary")
    known = written(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").withColumn("total", F.coalesce("total", F.lit(0))), "groups")
    salted = groups.where("v > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dense = salted.join(kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")), ["lang", "salt"]).drop("salt")
    full = dense.join(known, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return groups.select("lang", "source"), written(full.select("lang", "source", "term", "n", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q")), "shares")


_DISTANCE = "((p - q) * (p - q)) div (p + q)"


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank. Part `pair`: the distance to each other source of the language. Part
    `term`: the most_terms terms that the group uses more than its language and that part them most."""
    groups, full = shares(docs, least_docs)
    left = full.select("lang", "term", "source", "p")
    right = full.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    # the distance is the same from both sides
    half = left.join(right, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.expr(f"sum({_DISTANCE})").alias("value"))
    half = written(half, "distances")
    found = half.union(half.select("lang", "other", "source", "value"))
    others = groups.join(groups.withColumnRenamed("source", "other"), "lang").where("source <> other")
    pairs = others.join(found, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = full.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_DISTANCE).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= most_terms))


ORACLE = r"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
g as (select distinct lang, source from d),
o as (select r, lang, source, unnest(t) term from d),
c as (select lang, source, term, count(*) n from o group by all),
k as (select lang, term from o group by all having count(distinct r) >= 10),
v as (select lang, count(*) v from k group by all),
e as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint n from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select *, (sum(n) over (partition by lang, source))::hugeint a, (sum(n) over (partition by lang, term))::hugeint b, (sum(n) over (partition by lang))::hugeint z from e),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (a + 2 * v) p, 1 + (1000000000::hugeint * (b + 2)) // (z + 2 * v) q from s join v using (lang)),
x as (select x.lang, x.source, y.source item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) f from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
m as (select g.lang, g.source, 'pair' part, h.source item, coalesce(x.f, 0)::bigint "value" from g join g h on g.lang = h.lang and g.source <> h.source left join x on x.lang = g.lang and x.source = g.source and x.item = h.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q),
w as (select *, (row_number() over (partition by lang, source, part order by "value" desc, item))::integer "rank" from m)
select * from w where part = 'pair' or "rank" <= 10"""
