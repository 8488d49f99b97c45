"""Operator 3: benchmark decontamination by winnowing. DataFrame functions only.

Of every ``span`` - ``GRAM`` + 1 consecutive word-grams, texts keep the one with the least hash
(all of those that tie), so two texts that share ``span`` words share a kept gram at the
same place of that span. Documents' and items' kept grams are equi-joined and each hit is
extended word by word, up to span - GRAM words to either side; when span words or more agree
those words of the document are hit. An item with fewer than ``span`` words is one gram of
its own length, sought at every place.

Defined cases: null or wordless texts have no words, no hits and no items; an item without words
occurs nowhere; repeated rows come back as often as they came in; rows that share a doc_id but
not a text are judged apart; empty tables give no rows or no hits; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, few, saved, table

SPAN, GRAM, SALTS = 10, 5, 16
#: ASCII characters that are neither digit nor letter; they separate words.
GAPS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, ASCII letters and all characters beyond ASCII."""
    plain = F.translate(text, UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once (a lambda's variable is not inlined again)."""
    return F.transform(F.array(value), body)[0]


def _gram_hashes(h: Column, n: int) -> Column:
    """Hash of every run of n words, from an array of word hashes."""
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(F.lit(n), *[F.get(h, i + j) for j in range(n)]))


def _winnow(g: Column, width: int) -> Column:
    """Places of the grams that are least in some run of ``width`` (all of those that tie)."""
    last = F.size(g) - width
    mins = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice(g, i + 1, width)))

    def kept(m: Column) -> Column:
        lo = lambda j: F.greatest(j - (width - 1), F.lit(0))
        return F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda j: F.get(g, j) == F.array_max(F.slice(m, lo(j) + 1, F.least(j, last) - lo(j) + 1)))

    return _let(mins, kept)


def fingerprints(words: Column, span: int, gram: int = GRAM) -> Column:
    """The winnowed (hash, pos) of an array of at least ``span`` words."""
    marks = lambda g: F.transform(_winnow(g, span - gram + 1), lambda j: F.struct(F.get(g, j).alias("hash"), j.cast("int").alias("pos")))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(_gram_hashes(h, gram), marks))


def _around(words: str, pos: Column, gram: Column, reach: int) -> Column:
    """(left: words before, nearest first; mid; right: words after)."""
    w = F.col(words)
    return F.struct(
        F.array(*[F.get(w, F.when(pos > k, pos - 1 - k)) for k in range(reach)]).alias("left"),
        F.slice(w, pos + 1, gram).alias("mid"),
        F.array(*[F.get(w, pos + gram + k) for k in range(reach)]).alias("right"),
    )


def _agree(a: str, b: str, reach: int) -> Column:
    """How many of the first words of two arrays are equal."""
    out = F.lit(reach)
    for k in reversed(range(reach)):
        out = F.when(F.coalesce(F.get(F.col(a), F.lit(k)) != F.get(F.col(b), F.lit(k)), F.lit(True)), F.lit(k)).otherwise(out)
    return out


def item_marks(items: DataFrame, span: int, gram: int = GRAM) -> DataFrame:
    """Items' fingerprints with the words around them: (i_hash, gram, ctx, ids). Items that agree there share a row."""
    rows = items.select(F.col("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("n_words", F.size("words"))
    short = F.array(F.struct(F.lit(0).alias("pos"), F.col("n_words").alias("gram"), _run_hash(F.col("words")).alias("hash")))
    long = F.transform(fingerprints(F.col("words"), span, gram), lambda m: F.struct(m["pos"].alias("pos"), F.lit(gram).alias("gram"), m["hash"].alias("hash")))
    rows = rows.withColumn("m", F.explode(F.when(F.col("n_words") < span, short).otherwise(long)))
    reach = span - gram
    whole = F.col("n_words") < span
    rows = rows.select(F.col("m.hash").alias("i_hash"), F.when(whole, F.col("m.gram")).otherwise(0).alias("i_short"), _around("words", F.col("m.pos"), F.col("m.gram"), reach).alias("ctx"), "item_id")
    return rows.groupBy("i_hash", "i_short", "ctx").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))


def _run_hash(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: F.xxhash64(a, w))


def _short_hashes(lengths: list[int], words: Column) -> Column:
    """(hash, pos, short) of every run of each of the short items' lengths."""
    run = lambda k: F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(_run_hash(F.slice(words, i + 1, F.lit(k))).alias("hash"), i.cast("int").alias("pos"), F.lit(k).alias("short")))
    return F.flatten(F.array(*[F.when(F.size(words) >= k, run(k)).otherwise(F.array()) for k in lengths]))


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id") -> DataFrame:
    """Per document (rows with equal id and text together): id, row_key, copies, n_words, runs (hit word intervals), items.

    Only hashes and places of the documents' fingerprints are exploded and met with the items' distinct
    hashes: by broadcast while these are at most ``BROADCAST_ROWS`` (of 16 bytes), beyond that by a shuffle, salted
    by document and place. The words around the places that met are read again, from those documents alone, and
    taken out of the text in one row a document.
    """
    reach = span - gram
    marks = saved(item_marks(items, span, gram), "items")
    lengths = sorted(r[0] for r in marks.where("i_short > 0").select("i_short").distinct().collect())  # fewer than span
    hashes = marks.select("i_hash", "i_short").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("row_key"), words_of(F.col("text")).alias("words"))
    keyed = F.transform(fingerprints(F.col("words"), span, gram), lambda m: F.struct(m["hash"].alias("hash"), m["pos"].alias("pos"), F.lit(0).alias("short")))
    keyed = F.when(F.size("words") >= span, keyed).otherwise(F.array())
    if lengths:
        keyed = F.concat(keyed, _short_hashes(lengths, F.col("words")))
    # under place -1, a mark for the document itself: its number of words
    first = F.array(F.struct(F.lit(None).cast("bigint").alias("hash"), F.lit(-1).alias("pos"), F.size("words").alias("short")))
    seen = rows.select("id", "row_key", F.explode(F.concat(first, keyed)).alias("m")).select("id", "row_key", "m.hash", "m.pos", "m.short")
    same = (F.col("hash") == F.col("i_hash")) & (F.col("short") == F.col("i_short"))
    if few(hashes, BROADCAST_ROWS):
        found = seen.join(F.broadcast(hashes), same, "left")
    else:
        salt = F.pmod(F.xxhash64("id", "row_key", "pos"), F.lit(SALTS))
        found = seen.withColumn("salt", salt).join(hashes.withColumn("i_salt", _salts()), same & (F.col("salt") == F.col("i_salt")), "left")
    found = saved(found.where("pos < 0 or i_hash is not null").select("id", "row_key", "hash", "pos", "short"), "found")
    places = found.where("pos >= 0").groupBy("id", "row_key").agg(F.collect_set(F.struct("hash", "pos", "short")).alias("places")).withColumnsRenamed({"id": "p_id", "row_key": "p_key"})
    places = saved(places, "places")
    mine = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("row_key") == F.col("p_key"))
    size = lambda m: F.when(m["short"] > 0, m["short"]).otherwise(gram)
    # of the texts only those that met something are moved: their keys (16 bytes each) filter the documents first
    keys = places.select("p_id", "p_key")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("row_key"), "text")
    texts = texts.join(F.broadcast(keys) if few(keys, BROADCAST_ROWS) else keys, mine, "left_semi")
    near = texts.join(places, mine).withColumn("words", words_of(F.col("text")))
    near = near.select("id", "row_key", F.explode(F.transform("places", lambda m: F.struct(m["hash"].alias("hash"), m["pos"].alias("pos"), m["short"].alias("short"), _around("words", m["pos"], size(m), reach).alias("here")))).alias("m"))
    near = near.select("id", "row_key", "m.*").withColumn("salt", F.pmod(F.xxhash64("id", "row_key", "pos"), F.lit(SALTS)))
    met = near.join(marks.withColumn("i_salt", _salts()), same & (F.col("salt") == F.col("i_salt")))
    met = met.withColumn("l", F.when(F.col("short") > 0, 0).otherwise(_agree("here.left", "ctx.left", reach))).withColumn("r", F.when(F.col("short") > 0, 0).otherwise(_agree("here.right", "ctx.right", reach)))
    true = (F.col("here.mid") == F.col("ctx.mid")) & ((F.col("short") > 0) | (F.col("l") + F.col("r") + gram >= span))
    runs = F.struct((F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.when(F.col("short") > 0, F.col("short")).otherwise(gram) + F.col("r")).alias("hi"))
    met = met.where(true).withColumn("run", runs)
    met = met.groupBy("id", "row_key").agg(F.array_sort(F.collect_set("run")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    met = saved(met.withColumnsRenamed({"id": "p_id", "row_key": "p_key"}), "met")
    every = found.where("pos < 0").groupBy("id", "row_key").agg(F.count("*").alias("copies"), F.max("short").alias("n_words"))
    none = lambda like: F.coalesce(F.col(like), F.array().cast(met.schema[like].dataType))
    return every.join(met, mine, "left").select("id", "row_key", "copies", "n_words", none("runs").alias("runs"), none("items").alias("items"))


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))


def covered(runs: Column) -> Column:
    """Number of places in a sorted array of (lo, hi)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(runs, zero, lambda a, r: F.struct(F.greatest(a["end"], r["hi"].cast("bigint")).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("bigint"), r["hi"] - F.greatest(a["end"], r["lo"].cast("bigint")))).alias("n")))["n"]


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items (sorted), runs."""
    found = hits(docs, items, span, gram)
    rows = found.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), F.col("row_key"), F.col("n_words").cast("long").alias("n_words"), covered(F.col("runs")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "runs")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), lens AS (
  SELECT DISTINCT least(len(w), {SPAN}) AS n FROM b WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {SPAN}) AS n, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT k, item_id, n, i FROM dw JOIN iw USING (n, g)
), words AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k
), ids AS (
  SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT k, item_id::VARCHAR AS x FROM hit) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN ids USING (k)
"""
