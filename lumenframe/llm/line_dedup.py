"""Line dedup: a deletion-neighbourhood join under an edit bound of one character.

Emitting every one-character deletion of every line would cost the square of its length. The neighbourhood is therefore
made in three levels. A line of length L with its middle third deleted, or its first, or its last, stands for all
deletions inside that third: two lines within one edit agree in at least one of these keys, because the edit lies in one
third and the other two are anchored at the line's ends. Lines that share such a key go on with that third alone, in
blocks of 48 or more characters, and those that still share a key emit all one-character deletions of their block. Lines
whose deletions agree are at most one edit apart: the same position means a substitution, a line that equals another's
deletion an insertion. So no group is ever paired out, and no link within the bound is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound, cut, text_or_empty

#: The edit bound is relative to the length: one edit in so many characters, and one at most. Default of the parameter
#: ``min_near_chars``; shorter lines have no edit to spare ("Page 1" and "Page 2").
MIN_NEAR_CHARS = 16
BLOCK = 48
STEP = 1.25
#: The lines that occur most often, so many at most and each more often than so, are dealt out over so many keys in the last
#: join. No other line can have more than 1 in COMMON of all lines.
COMMON, OFTEN, SALTS = 1000, 1000, 64


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("dkey"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("norm", F.trim(F.replace(F.replace("line", F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))))
    return rows.select("doc_id", "dkey", "line_no", "norm", F.char_length("norm").alias("n"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), F.col("norm")).alias("h2"))


def _third(n: Column) -> Column:
    """A width that is at most a third of n and changes at few lengths, so that few lines need keys of two widths."""
    w = F.floor(F.pow(F.lit(STEP), F.floor(F.log(F.greatest(n, F.lit(3)) / 3.0) / math.log(STEP))))
    return F.least(w, F.floor(F.greatest(n, F.lit(3)) / 3)).cast("int")


def _block(n: Column) -> Column:
    """Block width of the second level: 48, or about the square root of very long parts."""
    return F.greatest(F.lit(BLOCK), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1))) / 2)).cast("int"))


def _gapped(s: Column, n: Column, w: Column, m: Column, seed: Column) -> Column:
    """For i below m: the hash of s without its part i, and that part. The i parts before it are counted from the left end, those after it from the right end."""
    part = lambda i: F.struct(
        F.xxhash64(seed, w, m, i, F.left(s, i * w), F.right(s, (m - 1 - i) * w)).alias("key"),
        F.substring(s, i * w + 1, F.greatest(n - (m - 1) * w, F.lit(0))).alias("mid"),
    )
    return F.transform(F.sequence(F.lit(0), m - 1), part)


def _first_keys(uniq: DataFrame) -> DataFrame:
    """Only the keys of the first level; the parts are cut again for the few lines that share one."""
    n, s = F.char_length("norm"), F.col("norm")
    keys = lambda w: [F.struct(F.xxhash64(w, F.lit(i), F.left(s, w * i), F.right(s, w * (2 - i))).alias("key"), w.alias("w"), F.lit(i).alias("i")) for i in range(3)]
    w, v = _third(n), _third(n + 1)
    return uniq.select("h1", "h2", F.explode(F.when(w == v, F.array(*keys(w))).otherwise(F.array(*keys(w), *keys(v)))).alias("k")).select("h1", "h2", "k.*")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose key occurs with two different lines at least; lines come once each, so a common one adds one row."""
    same = Window.partitionBy("key")
    met = keys.withColumn("lo", F.min("h1").over(same)).withColumn("hi", F.max("h1").over(same))
    return met.where("lo <> hi").drop("lo", "hi")


def near_links(uniq: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, near): of each line with others within one edit, the earliest occurrence of any of those."""
    cand = _shared(_first_keys(uniq))
    mids = uniq.join(cand, ["h1", "h2"]).select("h1", "h2", "key", F.substring("norm", F.col("i") * F.col("w") + 1, F.char_length("norm") - 2 * F.col("w")).alias("mid"))
    m = F.char_length("mid")
    parts = lambda n: (_block(n), F.greatest(F.floor(n / _block(n)), F.lit(1)).cast("int"))
    (w, k), (v, l) = parts(m), parts(m + 1)
    blocks = F.when((w == v) & (k == l), _gapped(F.col("mid"), m, w, k, F.col("key"))).otherwise(F.concat(_gapped(F.col("mid"), m, w, k, F.col("key")), _gapped(F.col("mid"), m, v, l, F.col("key"))))
    blocks = scratch.cut(_shared(mids.select("h1", "h2", F.explode(blocks).alias("b")).select("h1", "h2", "b.*")))
    b, n = F.col("mid"), F.char_length("mid")
    gone = lambda i: F.xxhash64(F.col("key"), F.concat(F.left(b, i - 1), F.substring(b, i + 1, n)))
    deletions = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(F.struct(F.xxhash64(gone(i), i).alias("v"), F.lit(1).alias("d")), F.struct(F.xxhash64(gone(i), F.lit(0)).alias("v"), F.lit(2).alias("d"))))))
    whole = F.array(F.struct(F.xxhash64(F.xxhash64("key", "mid"), F.lit(0)).alias("v"), F.lit(0).alias("d")))
    variants = blocks.select("h1", "key", F.explode(F.concat(whole, F.coalesce(deletions, F.array().cast("array<struct<v:bigint,d:int>>")))).alias("x")).select("h1", "key", "x.*")
    # A group holds the lines that differ in one character at one place, so it is bounded by the alphabet, not by the data.
    # Its rows are three numbers; texts and places are fetched for the few groups of two lines and more.
    group = Window.partitionBy("v")
    several = variants.withColumn("lo", F.min("h1").over(group)).withColumn("hi", F.max("h1").over(group)).where("lo <> hi").drop("lo", "hi")
    variants = several.join(blocks, ["h1", "key"]).join(firsts, ["h1", "h2"])
    of = lambda d: F.min(F.when(F.col("d") == d, F.struct("first", "mid"))).over(group)
    met = variants.select("h1", "h2", "first", "mid", "d", of(0).alias("s0"), of(1).alias("s1"), of(2).alias("s2"))
    other = F.when(F.col("d") == 1, F.col("s1")).when(F.col("d") == 2, F.col("s0")).otherwise(F.col("s2"))
    met = met.withColumn("o", other).where(F.col("o").isNotNull() & (F.col("o.first") != F.col("first")) & F.levenshtein("mid", "o.mid", 1).between(0, 1))
    return met.groupBy("h1", "h2").agg(F.min("o.first").alias("near"))


def line_classes(docs: DataFrame, min_near_chars: int = MIN_NEAR_CHARS) -> DataFrame:
    """One row per line: doc_id, dkey (hash of the text), line_no, n_chars (trimmed), keeper_doc_id, keeper_line_no, kept.

    A line is kept if no earlier line, by (doc_id, text hash, line_no), is within one edit of it after tabs and carriage
    returns became spaces and the ends were trimmed; lines under ``min_near_chars`` characters must be equal. Lines are
    judged on the input, not on what is left. The keeper is the earliest line within the bound. Blank lines are kept and
    keep themselves. A null text is one blank line. A null doc_id is earlier than all others. Rows that repeat both doc_id
    and text get the same decisions. An empty table gives no rows; very long lines are compared whole. Further columns are
    not read, whatever their names.
    """
    lines = _lines(docs)
    real = lines.where("n > 0")
    here = F.struct("doc_id", "dkey", "line_no")
    text = F.when(F.col("n") >= min_near_chars, F.col("norm"))
    distinct = real.groupBy("h1", "h2").agg(F.first(text).alias("norm"), F.min(here).alias("first"), F.count("*").alias("n_lines"))
    blank = F.col("n") == 0
    salted = lambda k: F.when(F.col("often"), F.xxhash64("h2", k)).otherwise(F.col("h2"))
    with Scratch(docs.sparkSession) as scratch:
        distinct = scratch.cut(distinct)  # the one table with the text of lines, each once
        firsts = distinct.select("h1", "h2", "first")
        links = near_links(distinct.where("norm is not null").select("h1", "h2", "norm"), firsts, scratch)
        best = F.least("first", F.coalesce("near", "first"))
        classes = firsts.join(links, ["h1", "h2"], "left").select("h1", "h2", best.alias("keeper"))
        often = distinct.where(F.col("n_lines") > OFTEN).orderBy(F.desc("n_lines"), "h1", "h2").limit(COMMON).select("h1", "h2", F.lit(True).alias("often"))
        often = F.broadcast(often)  # COMMON rows at most
        every = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        classes = classes.join(often, ["h1", "h2"], "left").withColumn("salt", F.explode(every)).select("h1", salted(F.col("salt")).alias("h2"), "keeper")
        spread = lines.drop("norm").join(often, ["h1", "h2"], "left").withColumn("h2", salted(F.pmod(F.xxhash64("dkey", "line_no"), F.lit(SALTS)).cast("int"))).drop("often")
        spread = spread.withColumn("h1", F.when(blank, F.xxhash64("dkey", "line_no")).otherwise(F.col("h1")))  # blank lines meet nothing
        out = spread.join(classes, ["h1", "h2"], "left")
        keeper = F.when(blank, here).otherwise(F.col("keeper"))
        return cut(out.select("doc_id", "dkey", "line_no", F.col("n").cast("bigint").alias("n_chars"), keeper["doc_id"].alias("keeper_doc_id"), keeper["line_no"].alias("keeper_line_no"), keeper.eqNullSafe(here).alias("kept")))


def dedup_lines(docs: DataFrame, min_near_chars: int = MIN_NEAR_CHARS) -> DataFrame:
    """``docs`` without the lines that ``line_classes`` does not keep; documents that lose all their lines are dropped.

    Documents that had no line with text before, null texts among them, are left as they are; very long lines are compared
    whole; of equal lines the earliest stays, and rows that repeat both doc_id and text get the same decisions; an empty
    table stays empty. Columns pass through unchanged, whatever their names, text excepted.
    """
    gone = line_classes(docs, min_near_chars).where("not kept").groupBy(F.col("doc_id").alias("of"), F.col("dkey").alias("key")).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("dkey"))
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("dkey") == F.col("key")), "left")
    cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.lit(1 << 30)))
    parts = F.struct(F.split("row.text", "\n").alias("lines"), cuts.alias("cuts"))
    run = lambda x, i: F.slice(x["lines"], F.get(x["cuts"], i) + 2, F.get(x["cuts"], i + 1) - F.get(x["cuts"], i) - 1)  # noqa: E731  lines between two that go
    left = bound(parts, lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["cuts"]) - 2), lambda i: run(x, i))), "\n"))
    met = met.withColumn("text", F.when(F.col("gone").isNotNull(), left))
    out = met.where(F.col("gone").isNull() | (F.trim(F.regexp_replace("text", r"[\n\t\r]", " ")) != ""))
    return out.select(F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField("text", F.col("text"))).alias("row")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return line_classes(docs).drop("dkey")


#: The textbook form: every one-character deletion of every distinct line. doc_id is unique here, so ties cannot occur.
ORACLE_SQL = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[\\t\\r]', ' ', 'g'), ' ') AS norm FROM raw),
pos AS (SELECT *, doc_id * 100000000 + line_no AS here FROM lines),
uniq AS (SELECT norm, min(here) AS first FROM pos WHERE norm <> '' GROUP BY norm),
del AS (SELECT norm, first, i, hash(substr(norm, 1, i - 1) || substr(norm, i + 1)) AS v FROM uniq, LATERAL (SELECT unnest(range(1, length(norm) + 1)) AS i) WHERE length(norm) >= {MIN_NEAR_CHARS}),
sub AS (SELECT norm, min(first) OVER (PARTITION BY v, i) AS near FROM del),
longs AS (SELECT norm, first, hash(norm) AS v FROM uniq WHERE length(norm) >= {MIN_NEAR_CHARS}),
ins AS (SELECT a.norm, b.first AS near FROM longs a JOIN del b ON a.v = b.v UNION ALL SELECT b.norm, a.first AS near FROM longs a JOIN del b ON a.v = b.v),
near AS (SELECT norm, min(near) AS near FROM (SELECT * FROM sub UNION ALL SELECT * FROM ins) GROUP BY norm),
classes AS (SELECT u.norm, least(u.first, coalesce(n.near, u.first)) AS keeper FROM uniq u LEFT JOIN near n USING (norm))
SELECT p.doc_id, p.line_no::INTEGER AS line_no, length(p.norm)::BIGINT AS n_chars,
       CASE WHEN p.norm = '' THEN p.doc_id ELSE c.keeper // 100000000 END AS keeper_doc_id,
       CASE WHEN p.norm = '' THEN p.line_no ELSE c.keeper % 100000000 END::INTEGER AS keeper_line_no,
       CASE WHEN p.norm = '' THEN true ELSE c.keeper = p.here END AS kept
FROM pos p LEFT JOIN classes c USING (norm)
"""
