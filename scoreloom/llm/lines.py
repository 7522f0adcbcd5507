"""Line dedup: first occurrences by document id, decisions as compressed per-document bitmaps.

Lines travel as 128-bit key hashes, never as text. Occurrences are range-partitioned by (hash, id, position)
and sorted that way, so even a line that a third of all documents hold is spread over many ranges; each range
streams its runs and reports one candidate first occurrence per key, and the few candidates of a key that
crosses ranges meet in a small aggregate. The hashes are written once before that, since ranges are chosen by a
sample and the rows are used twice. Documents then receive a sparse bitmap, 64 lines a word, that names
only words with a dropped line; the text is cut by its own bitmap at the end.

Defined results: a null or empty text is one empty line; a row without id neither drops lines nor loses any;
rows that share an id never drop each other's lines; an empty table gives an empty table; columns other than
the named ones are carried along (``drop_repeated_lines``) or ignored (``line_digest``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.columns import WS, ascii_lower, columns_of, let, whole
from scoreloom.sources.scratch import settle

#: A key's occurrences are dealt over so many join tasks; only repeated keys are copied for it.
SALTS = 16


def lines(text: str | Column) -> Column:
    return F.split(whole(text), "\n")


def occurrences(docs: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    """(_id, _t, _p, _h, _g): one row per line whose key has at least ``least`` code points."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(whole(text)).alias("_t"), F.posexplode(F.transform(lines(text), lambda x: key_hash(x, least))).alias("_p", "_k"))
    return rows.filter("_k is not null").select("_id", "_t", "_p", F.col("_k.h").alias("_h"), F.col("_k.g").alias("_g"))


def key_hash(line: Column, least: int) -> Column:
    """Two 64-bit hashes of a line's key, or null where the key is short."""
    return let(F.btrim(line, F.lit(WS)), lambda s: F.when(F.length(s) >= least, let(ascii_lower(s), lambda k: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g")))))


def dropped_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(_id, _t, dropped): for each row that loses lines, the words (number, bits) of its bitmap that are not
    zero. ``_t`` is the hash of the text, so that rows sharing an id keep their own bitmaps."""
    occ = settle(occurrences(docs, id_col, text, least)).repartitionByRange(F.col("_h"), F.col("_g"), F.col("_id"), F.col("_p")).sortWithinPartitions("_h", "_g", "_id", "_p")
    first = occ.groupBy("_h", "_g").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last").select("_h", "_g", "_first")
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    late = occ.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(first, ["_h", "_g", "_salt"]).filter("_id > _first").select("_id", "_t", F.shiftright("_p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_p") % 64).alias("b"))
    return late.groupBy("_id", "_t", "w").agg(F.bit_or("b").alias("b")).groupBy("_id", "_t").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("dropped"))


def _with_bitmap(docs: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    """``docs`` with columns _x (lines) and _keep (lines that stay)."""
    bits = dropped_bitmaps(docs, id_col, text, least)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(whole(f"`{text}`")).alias("_t"))
    joined = rows.join(bits, ["_id", "_t"], "left")
    x = lines(F.col(f"_doc.{text}"))

    def stays(line: Column, p: Column) -> Column:
        return F.call_function("shiftright", F.coalesce(F.try_element_at(F.col("dropped"), F.shiftright(p, 6)), F.lit(0).cast("long")), p % 64).bitwiseAND(F.lit(1).cast("long")) == 0

    return joined.select("_doc", F.size(x).cast("long").alias("_n"), F.when(F.col("dropped").isNull(), x).otherwise(F.filter(x, stays)).alias("_keep"))


def line_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    out = _with_bitmap(columns_of(docs, id_col, text), id_col, text, least)
    return out.select(F.col(f"_doc.{id_col}").alias(id_col), F.col("_n").alias("n_lines"), (F.col("_n") - F.size("_keep")).alias("n_dropped"),
                      F.sha2(F.array_join("_keep", "\n"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 10, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated lines cut out of the text; ``length``, where such a column exists, is the new size."""
    out = _with_bitmap(docs, id_col, text, least).withColumn("_text", F.when(F.col(f"_doc.{text}").isNotNull(), F.array_join("_keep", "\n")))
    pick = {text: F.col("_text"), length: F.length("_text").cast(dict(docs.dtypes).get(length, "long"))}
    return out.select(*[pick.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, pos, line, o.k IS NOT NULL AND l.doc_id > o.owner AS gone FROM l LEFT JOIN o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
