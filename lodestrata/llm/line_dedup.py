"""Line deduplication (operator 10): exact copies, and lines one word apart by a deletion-neighbourhood join.

Lines are compared as sequences of lower-cased words.  Of equal lines the earliest stays, by (doc_id, text hash, line
number).  A line of at least ``min_words`` words also goes if an earlier line is within one inserted, deleted or replaced
word of it.  Lines without words stay.

Only DataFrame functions are used.  Every line emits its variants with one word deleted as hashed keys: with the place of
the word, which is equal for lines that differ in that word; without it, which is equal to the full key of a line that
lacks the word.  Every word is hashed with its place, so permuted words give other keys.  Equal keys give candidates, and
the edit distance of each is verified on the words.

Two lines one edit apart share the words of their first or of their second half, so lines whose halves occur in no other
line emit nothing, and the others emit only variants of the half that may differ.  All members of a key with a place are
one replacement apart, so each is compared with the earliest only; a key without a place belongs to one shorter line, so
a variant meets one line.  Rows grow with the number of words, whatever the size of a group.

Defined results: null and empty texts have one line without words and stay as they are (null as empty); equal ids are
told apart by their texts, and rows equal in both keep and lose the same lines; an empty table gives no rows; a document
whose worded lines all go keeps an empty text and ``emptied`` true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 8
BROADCAST_ROWS = 500_000


def _plain(line: Column) -> Column:
    """The lower-cased words with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\x0b\f\r]{2,}|[\t\x0b\f\r]", " "))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast side if it is written and within ``BROADCAST_ROWS`` (rows of a few longs), else a plain one."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and last floor(n/2) and ceil(n/2) words; the lowest bit tells the side."""
    few, many = (n / 2).cast("int"), ((n + 1) / 2).cast("int")

    def key(size: Column, last: int) -> Column:
        part = F.call_function("substring_index", line, F.lit(" "), -size if last else size)
        return F.shiftleft(F.xxhash64(size, part), 1).bitwiseOR(F.lit(last).cast("bigint"))

    return F.when(few == many, F.array(key(few, 0), key(few, 1))).otherwise(F.array(key(few, 0), key(many, 0), key(few, 1), key(many, 1)))


def one_edit(a: Column, b: Column) -> Column:
    """True if two word arrays are within one inserted, deleted or replaced word."""
    most = F.greatest(F.size(a), F.size(b))

    def common_run(x: Column, y: Column) -> Column:
        differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differ == 0, most).otherwise(differ - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common_run(a, b) + common_run(F.reverse(a), F.reverse(b)) >= most - 1)


def _lines(docs: DataFrame) -> DataFrame:
    text = common.text_of()
    # most texts hold only single blanks: their lines need no search for others
    odd = F.contains(text, F.lit("  "))
    for blank in "\t\x0b\f\r":
        odd = odd | F.contains(text, F.lit(blank))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), odd.alias("odd"), F.lower(text).alias("text"))
    rows = rows.select("doc_id", "th", "odd", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    line = F.when(F.col("odd"), _plain(F.col("line"))).otherwise(F.trim("line"))
    rows = rows.select("doc_id", "th", "n", line.alias("line")).where("line <> ''")
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _near(docs: DataFrame, distinct: DataFrame, min_words: int, made: list[DataFrame]) -> DataFrame:
    """The places of distinct lines that have an earlier line one edit away.  ``made`` gets the tables written for it."""

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(common.persist(df, name))
        return made[-1]

    line = ["h1", "h2"]  # 128 bits name a line
    keys = distinct.where(F.col("size") >= min_words).select(*line, F.explode("keys").alias("k"))
    several = (F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))
    shared = written(keys.groupBy("k").agg(several.alias("several")).where("several").select("k"), "half-keys")
    hits = keys.join(_small(shared), "k").groupBy(*line).agg(F.bit_or(F.lit(1).cast("bigint").bitwiseAND(F.col("k") + 1)).alias("front"), F.bit_or(F.col("k").bitwiseAND(F.lit(1).cast("bigint"))).alias("back"))
    hits = written(distinct.join(hits, line).select(*line, "pos", "front", "back"), "candidates")
    # the words of each candidate, from the place where it stands first
    place = hits.groupBy(F.col("pos.doc_id").alias("d"), F.col("pos.th").alias("t"))
    place = written(place.agg(F.collect_list(F.struct("pos.n", *line, "front", "back")).alias("at")), "places")
    text = common.text_of()
    texts = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    # copies of a whole row stand at the same place: one of them is enough
    both = texts.join(_small(place), texts.doc_id.eqNullSafe(place.d) & (texts.th == place.t))
    # the lines are bound to a lambda's variable: no row carries all of them along for each candidate
    wanted = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.transform("at", lambda x: F.struct(x.alias("x"), F.get(lines, x["n"]).alias("line"))))[0]
    both = both.select("doc_id", "th", F.explode(wanted).alias("y")).select("doc_id", "th", "y.x.*", "y.line")
    rows = both.select(*line, F.struct("doc_id", "th", "n").alias("pos"), F.split(_plain(F.col("line")), " ").alias("w"), "front", "back")
    rows = written(rows.dropDuplicates([*line, "pos"]).withColumn("size", F.size("w")), "candidate-lines")
    # hashes of each word with its place, and with the place that it has once an earlier word is gone
    here, ahead = F.transform("w", lambda x, i: F.xxhash64(x, i)), F.transform("w", lambda x, i: F.xxhash64(x, i - 1))
    words = rows.select(*line, "pos", "size", "front", "back", here.alias("g"), ahead.alias("s"))
    words = words.withColumns({"gx": _xor(F.col("g")), "sx": _xor(F.col("s"))})
    each = words.select(*line, "pos", "size", "front", "back", "gx", "sx", F.posexplode(F.arrays_zip("g", "s")).alias("i", "x"))
    each = each.select(*line, "pos", "size", "front", "back", "i", "x.g", "x.s", "gx", "sx")
    half = (F.col("size") / 2).cast("int")
    may_differ = ((F.col("front") == 1) & (F.col("i") >= half)) | ((F.col("back") == 1) & (F.col("i") < F.col("size") - half))
    # replaced words: (size, place, the other words at theirs); the first of a key's lines stands for all of them
    replaced = each.where(may_differ).select(*line, "pos", F.xxhash64("size", "i", F.col("gx").bitwiseXOR(F.col("g"))).alias("k"))
    groups = replaced.groupBy("k").agg(several.alias("several"), F.min(F.struct("pos", *line)).alias("first")).where("several")
    groups = written(groups.select("k", F.col("first.h1").alias("o1"), F.col("first.h2").alias("o2")), "replaced-keys")
    pairs = replaced.join(_small(groups), "k").where("h1 <> o1 OR h2 <> o2").select(*line, "o1", "o2")
    # inserted words: a longer line's words without one, each at its place then, meet the words of the shorter line.  The
    # order of the words is part of the key, so a key belongs to one shorter line
    run = Window.partitionBy(*line).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.bit_xor(F.col("g").bitwiseXOR(F.col("s"))).over(run).bitwiseXOR(F.col("g")).bitwiseXOR(F.col("sx"))
    variants = each.select(*line, "size", "front", "back", "i", before.alias("left")).where(may_differ)
    variants = variants.select(*line, F.xxhash64(F.col("size") - 1, "left").alias("k"))
    full = written(words.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.xxhash64("size", "gx").alias("k")), "full-keys")
    pairs = pairs.unionByName(variants.join(_small(full), "k").select(*line, "o1", "o2")).distinct()
    mine = rows.select(*line, F.col("pos").alias("h_pos"), F.col("w").alias("h_w"))
    other = rows.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("pos").alias("o_pos"), F.col("w").alias("o_w"))
    checked = pairs.join(mine, line).join(other, ["o1", "o2"]).where(one_edit(F.col("h_w"), F.col("o_w")))
    later = F.when(F.col("h_pos") > F.col("o_pos"), F.col("h_pos")).otherwise(F.col("o_pos"))
    return checked.select(later.alias("pos")).distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the remaining lines as ``text``, and n_lines, n_dropped and emptied (columns so named go)."""
    docs = docs.drop("n_lines", "n_dropped", "emptied")
    size = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    rows = _lines(docs).withColumn("size", size).withColumn("keys", F.when(F.col("size") >= min_words, _half_keys(F.col("line"), F.col("size"))))
    pos = F.min(F.struct("doc_id", "th", "n")).alias("pos")
    distinct = rows.groupBy("h1", "h2").agg(pos, F.first("size").alias("size"), F.first("keys").alias("keys"))
    distinct = common.persist(distinct, "lines")
    made: list[DataFrame] = []
    gone = common.persist(_near(docs, distinct, min_words, made), "near-lines")
    for table in made:
        common.drop(table)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    kept = distinct.select("pos.doc_id", "pos.th", "pos.n")
    gone = gone.select(F.col("pos.doc_id").alias("d"), F.col("pos.th").alias("t"), F.col("pos.n").alias("m"))
    kept = kept.join(gone, same("doc_id", "d") & same("th", "t") & same("n", "m"), "left_anti")
    kept = kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th")).agg(F.array_sort(F.collect_list("n")).alias("kept_n"))
    return _apply(docs, kept)


def _apply(docs: DataFrame, kept: DataFrame) -> DataFrame:
    th, d, t, ns, lines, wordless = common.fresh(docs, "th", "kept_id", "kept_th", "kept_n", "kept_lines", "wordless")
    kept = kept.toDF(d, t, ns)
    rows = docs.withColumn("text", common.text_of()).withColumn(th, F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(t)), "left")
    rows = rows.withColumn(lines, F.split("text", "\n", -1))
    blank = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(r"[^ \t\x0b\f\r]")), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    rows = rows.withColumn(wordless, blank)
    keep = F.array_sort(F.concat(F.coalesce(F.col(ns), F.array().cast("array<int>")), F.col(wordless)))
    # the lines are bound to a lambda's variable, else they would be split again for each one kept
    chosen = F.transform(F.array(F.col(lines)), lambda all_lines: F.transform(keep, lambda i: F.get(all_lines, i)))[0]
    out = {"n_lines": F.size(lines).cast("bigint"), "n_dropped": (F.size(lines) - F.size(keep)).cast("bigint"), "text": F.array_join(chosen, "\n")}
    out["emptied"] = (F.size(wordless) < F.size(lines)) & F.col(ns).isNull()
    out["text"] = F.when(out["emptied"], F.lit("")).otherwise(out["text"])
    return rows.withColumns(out).select(*docs.columns, "n_lines", "n_dropped", "emptied")


def op10(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "emptied", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, n, list_filter(regexp_split_to_array(lower(ls[n]), '[ \t\x0b\f\r]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM d)),
u AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min(struct_pack(doc_id, n)) AS pos FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT s, pos, i, array_to_string(w[:i - 1], ' ') || chr(1) || array_to_string(w[i + 1:], ' ') AS k,
             array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS del, len(w) AS size
      FROM (SELECT s, w, pos, unnest(range(1, len(w) + 1)) AS i FROM u WHERE len(w) >= 8)),
r AS (SELECT s FROM (SELECT s, pos, min(pos) OVER (PARTITION BY i, k) AS first FROM v) WHERE first < pos),
p AS (SELECT v.s AS long, v.pos AS lp, u.s AS short, u.pos AS sp FROM v JOIN u ON v.del = u.s WHERE len(u.w) >= 8),
g AS (SELECT s FROM r UNION SELECT CASE WHEN lp > sp THEN long ELSE short END FROM p),
kept AS (SELECT pos.doc_id AS doc_id, pos.n AS n FROM u WHERE s NOT IN (SELECT s FROM g)),
f AS (SELECT d.doc_id, l.n, d.ls[l.n] AS line, len(l.w) = 0 AS blank, kept.n IS NOT NULL AS k FROM d JOIN l USING (doc_id) LEFT JOIN kept ON kept.doc_id = l.doc_id AND kept.n = l.n)
SELECT doc_id, count(*) AS n_lines, count(*) - count(*) FILTER (blank OR k) AS n_dropped, bool_or(NOT blank) AND NOT bool_or(k) AS emptied,
       sha256(CASE WHEN bool_or(NOT blank) AND NOT bool_or(k) THEN '' ELSE coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (blank OR k), '') END) AS text_sha256
FROM f GROUP BY doc_id
"""
