"""Operator 4: line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is trimmed of spaces, lower-cased and split at spaces. A line of at least
`min_words` words is dropped if an earlier line (by doc_id, then place) is at word edit
distance 0 or 1 from it, whether or not that line is itself kept; shorter lines stay.
A document is a doc_id with its text: of texts that share an id, a hash of the text
tells which is earlier, and rows that share both are one document. Where no id repeats,
the hash decides nothing and is left out of the shuffles.

Equal lines meet by two 64-bit hashes; each distinct line goes on with its earliest
place. Lines at distance 1 agree in one half, so lines whose halves no other line has
drop out without loss. Each remaining line emits its deletion neighbourhood (itself,
and itself without one word of the half that may differ) as hashed keys:

* lines with the same key and deleted place differ in that one word, so all but the
  earliest are near an earlier one;
* a line that equals a key of a longer line is that line without one word.

The earliest line of each key stands for the others, so a key that a third of all
lines have costs rows in proportion to its lines. The edit distance of every match is
verified on the words.

Defined results: a null text stays null and has no lines; an empty text has one empty
line; rows that share a doc_id are dropped lines from one by one, and equal rows alike;
rows whose doc_id is null keep all lines; very long texts and lines are taken whole;
other columns, of any name, are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalflow.llm.common import Scratch

MIN_WORDS = 5
#: The document that a line belongs to.
OWNER = ["doc_id", "text_hash"]


def _words(line: Column) -> Column:
    return F.split(F.lower(F.trim(line)), " ")


def _owned(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents that take part, and the columns that tell one from another: doc_id, and text_hash where an id repeats."""
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    repeats = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    return (docs.withColumn("text_hash", F.xxhash64("text")), OWNER) if repeats else (docs, OWNER[:1])


def _lines(docs: DataFrame, owner: list[str], min_words: int) -> DataFrame:
    """owner, pos, w (words), n: lines that take part."""
    return (
        docs.select(*owner, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select(*owner, "pos", _words(F.col("line")).alias("w"))
        .withColumn("n", F.size("w")).where(F.col("n") >= min_words)
    )


def _keyed(lines: DataFrame, owner: list[str]) -> DataFrame:
    n, w = F.col("n"), F.col("w")
    h, g = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return lines.select(
        *owner, "pos", "n", F.xxhash64(w).alias("k1"), F.xxhash64(F.lit(1), w).alias("k2"),
        F.array(
            F.xxhash64(n, F.lit("p"), F.slice(w, F.lit(1), h)),
            F.xxhash64(n, F.lit("s"), F.slice(w, h + 1, n)),
            F.xxhash64(n - 1, F.lit("p"), F.slice(w, F.lit(1), g)),
            F.xxhash64(n - 1, F.lit("s"), F.slice(w, g + 2, n)),
        ).alias("halves"),
    )


def dropped_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash (null where no id repeats), pos (from 0) of every line to drop."""
    scratch = Scratch(documents.sparkSession)
    docs, owner = _owned(documents)
    # Lines are split and hashed once: both the grouping and the search for copies read the written keys.
    keyed = scratch.save(_keyed(_lines(docs, owner, min_words), owner), "keyed")
    place = F.struct(*owner, "pos")
    uniq = scratch.save(keyed.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("halves").alias("halves")), "uniq")
    # Later copies of a line: only lines that occur twice go on to the join.
    twice = uniq.where("copies > 1").select("k1", "k2", "first")
    copies = keyed.select("k1", "k2", *owner, "pos").join(twice, ["k1", "k2"]).where(place > F.col("first")).select(*owner, "pos")

    half = uniq.select("first.*", F.posexplode("halves").alias("side", "half"))
    shared = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    near = (
        half.join(shared, "half").groupBy(*owner, "pos")
        .agg(F.max(F.col("side") % 2 == 0).alias("late"), F.max(F.col("side") % 2 == 1).alias("early"))
        .groupBy(*owner).agg(F.collect_list(F.struct("pos", "late", "early")).alias("near"))
    )
    open_ = scratch.save(
        docs.select(*owner, F.split("text", "\n").alias("lines")).join(near, owner)
        .select(*owner, F.explode(F.transform("near", lambda x: F.struct(x["pos"].alias("pos"), x["late"].alias("late"), x["early"].alias("early"), F.element_at("lines", x["pos"] + 1).alias("line")))).alias("x"))
        .select(F.struct(*owner, "x.pos").alias("at"), "x.late", "x.early", _words(F.col("x.line")).alias("w"))
        .dropDuplicates(["at"]), "open",
    )
    variants = scratch.save(_variants(open_), "variants")
    by_place = variants.groupBy("v", "i").agg(F.min("at").alias("lead"), F.count(F.lit(1)).alias("n"))
    whole = (
        by_place.groupBy("v").agg(F.min(F.when(F.col("i") < 0, F.col("lead"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("lead"))).alias("cut"))
        .where("whole is not null and cut is not null")
    )
    pairs = (
        variants.join(by_place.where("i >= 0 and n > 1").select("v", "i", "lead"), ["v", "i"]).where("at > lead").select("at", F.col("lead").alias("by"))
        .unionByName(variants.where("i >= 0").join(whole.select("v", "whole"), "v").where("at > whole").select("at", F.col("whole").alias("by")))
        .unionByName(whole.where("whole > cut").select(F.col("whole").alias("at"), F.col("cut").alias("by")))
        .groupBy("at").agg(F.min("by").alias("by"))
    )
    text = open_.select("at", "w")
    verified = (
        pairs.join(text, "at").join(text.select(F.col("at").alias("by"), F.col("w").alias("u")), "by").where(within_one(F.col("w"), F.col("u"))).select("at.*")
    )
    every = copies.unionByName(verified)
    dropped = scratch.save(every if owner == OWNER else every.select("doc_id", F.lit(None).cast("long").alias("text_hash"), "pos"), "dropped")
    for table in (keyed, uniq, open_, variants):
        scratch.free(table)
    return dropped


def _variants(open_: DataFrame) -> DataFrame:
    """v (key), i (deleted place, -1: none), at: the deletion neighbourhood of each line."""
    n = F.size("w")
    middle = F.floor((n - 1) / 2).cast("int")
    places = F.sequence(F.when(F.col("early"), F.lit(0)).otherwise(middle), F.when(F.col("late"), n - 1).otherwise(middle))
    each = F.transform(places, lambda i: F.struct(F.xxhash64(F.slice("w", F.lit(1), i), F.slice("w", i + 2, n)).alias("v"), i.cast("int").alias("i")))
    return (
        open_.select("at", F.explode(F.concat(each, F.array(F.struct(F.xxhash64("w").alias("v"), F.lit(-1).alias("i"))))).alias("x"))
        .select("x.v", "x.i", "at")
    )


def within_one(a: Column, b: Column) -> Column:
    """Whether two word lists are at edit distance 0 or 1: what they share at both ends leaves at most one word."""

    def common(x: Column, y: Column) -> Column:
        miss = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(miss == 0, F.size(x)).otherwise(miss - 1)

    most = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= most - 1)


def without(documents: DataFrame, dropped: DataFrame) -> tuple[DataFrame, str, str]:
    """`documents` with the lines left in `text`, and the names of two more columns: number of lines, number of dropped ones."""
    taken = {c.lower() for c in documents.columns}

    def free(name: str) -> str:
        while name in taken:
            name = f"_{name}"
        return name

    n_lines, n_dropped, marks, own, key = map(free, ("n_lines", "n_dropped", "marks", "text_hash", "key_of"))
    gaps = F.zip_with("d", F.concat(F.array(F.lit(-1)), F.slice("d", F.lit(1), F.size("d") - 1)), lambda p, q: F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1")))
    marked = (
        dropped.groupBy(*OWNER).agg(F.array_sort(F.collect_set("pos")).alias("d"))
        .select(F.col("doc_id").alias(key), F.col("text_hash").alias(own), F.size("d").cast("long").alias(n_dropped), F.array_join(gaps, "").cast("binary").alias(marks))
    )
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: F.coalesce(F.substring(F.col(marks), i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True)))
    same = F.col(own).isNull() | (F.xxhash64("text") == F.col(own))
    out = (
        documents.join(marked, (F.col("doc_id") == F.col(key)) & same, "left")
        .withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("text", F.when(F.col(marks).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn(n_dropped, F.coalesce(n_dropped, F.lit(0).cast("long")))
        .drop(marks, key, own)
    )
    return out, n_lines, n_dropped


def digest(documents: DataFrame, **kw) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    docs = documents.select("doc_id", "text")
    out, n_lines, n_dropped = without(docs, dropped_lines(docs, **kw))
    return out.select(
        "doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def dedup(documents: DataFrame, **kw) -> DataFrame:
    """`documents` with the lines left; a document that had words and has none left is a copy of earlier lines and goes."""
    names = documents.columns
    out, _, n_dropped = without(documents, dropped_lines(documents.select("doc_id", "text"), **kw))
    gone = (F.col(n_dropped) > 0) & (F.trim(F.regexp_replace("text", "[\\s]+", " ")) == "")
    return out.where(~F.coalesce(gone, F.lit(False))).select(*names)


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, string_split(lower(trim(ls[i], ' ')), ' ') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
t AS (SELECT doc_id, pos, w, len(w) AS n FROM l WHERE len(w) >= 5),
u AS (SELECT w, n, min((doc_id, pos)) AS f FROM t GROUP BY w, n),
c AS (
  SELECT a.f AS x, a.w AS wa, b.w AS wb, a.n AS na, b.n AS nb FROM u a JOIN u b ON a.w[1] = b.w[1] AND b.n BETWEEN a.n - 1 AND a.n + 1 WHERE b.f < a.f
  UNION ALL
  SELECT a.f, a.w, b.w, a.n, b.n FROM u a JOIN u b ON a.w[a.n] = b.w[b.n] AND b.n BETWEEN a.n - 1 AND a.n + 1 WHERE b.f < a.f),
v AS (
  SELECT DISTINCT x FROM c
  WHERE (CASE WHEN na = nb THEN len(list_filter(range(1, na + 1), lambda i: wa[i] <> wb[i])) = 1
    WHEN na > nb THEN len(list_filter(range(1, na + 1), lambda i: list_concat(wa[1 : i - 1], wa[i + 1 : na]) = wb)) > 0
    ELSE len(list_filter(range(1, nb + 1), lambda i: list_concat(wb[1 : i - 1], wb[i + 1 : nb]) = wa)) > 0 END)),
x AS (
  SELECT t.doc_id, t.pos FROM t JOIN u ON t.w = u.w WHERE (t.doc_id, t.pos) > u.f
  UNION SELECT x[1], x[2] FROM (SELECT struct_extract_at(x, 1) AS a, struct_extract_at(x, 2) AS b, [a, b] AS x FROM v)),
g AS (SELECT doc_id, list(pos) AS p FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.p), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN g.p IS NULL THEN coalesce(d.text, '') ELSE coalesce(array_to_string(list_filter(d.ls, lambda s, i: NOT list_contains(g.p, i - 1)), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
