"""Line dedup: lines whose normalised form is in many documents are dropped everywhere.

Lines are exploded and hashed (128 bits); a document counts once for each of its keys; a first
aggregation sums map-side, so a line that a third of the documents hold is
a few rows after it.  Only hashes and positions move for that.  The frequent keys are broadcast where they are few, and else
copied to several tasks each, so no task gets all places of one line.  The positions to be
dropped then meet the documents (of more than a few, by a shuffle that carries each text once), whose remaining lines are put together in order.

Only DataFrame functions are used.

Cases: null and empty text are one empty line; empty keys are never dropped; every
row is a document, so a repeated row counts again (and gets the same result);
null doc_id is a value like any other; very long texts: memory of a few times the text;
an empty table gives an empty result.  Line feeds alone part lines, so "\\r\\n" leaves
a "\\r" at the end, which the key ignores and the text keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisand.llm.shared import SPACES, ascii_lower, finished, looked_up, row_key, staged

#: Documents in which a key must be found for its lines to go.
MIN_DOCS = 10
#: Documents with lines to be dropped up to which their positions are broadcast.
FEW = 10_000


def split_lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased.  Text of ASCII only can take the faster lower()."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def dropped_positions(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """k1, k2, drop: for each row with lines to be dropped (see row_key), their positions from 0."""
    hashed = F.transform(
        F.transform(split_lines(F.col("text")), line_key),
        lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(3), k).alias("h2"))),
    )
    lines = staged(docs.select(*row_key("doc_id", "text"), hashed.alias("keys")), "line-keys")
    once = lines.select(F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null")
    frequent = once.groupBy("key.h1", "key.h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    frequent = staged(frequent.select("h1", "h2"), "frequent-lines")
    places = lines.select("k1", "k2", F.posexplode("keys").alias("pos", "key")).filter("key is not null").select("k1", "k2", "pos", "key.h1", "key.h2")
    return looked_up(places, frequent, ["h1", "h2"], "inner", F.col("k1")).groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"))


def _thinned(docs: DataFrame, min_docs: int) -> DataFrame:
    """doc (a struct of the row but for its text, whatever its columns are called), n_lines, n_dropped and text, the remaining lines."""
    others = F.struct(*[f"`{c}`" for c in docs.columns if c != "text"])
    keyed = docs.select(others.alias("doc"), F.col("text").alias("_text"), *row_key("doc_id", "text"))
    df = looked_up(keyed, finished("dropped-lines", lambda: dropped_positions(docs, min_docs)), ["k1", "k2"], "left", most=FEW)
    df = df.withColumn("_lines", split_lines(F.col("_text"))).withColumn("_drop", F.coalesce("drop", F.array().cast("array<int>")))
    df = df.withColumn("_keep", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop"))
    kept = F.when(F.size("_drop") == 0, F.coalesce("_text", F.lit(""))).otherwise(
        F.array_join(F.transform("_keep", lambda i: F.coalesce(F.get("_lines", i), F.get("_lines", i))), "\n")
    )
    return df.select("doc", F.size("_lines").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"), kept.alias("text"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, lang, source, n_lines, n_dropped and the remaining text of every row."""
    return _thinned(docs.select("doc_id", "lang", "source", "text"), min_docs).select("doc.doc_id", "doc.lang", "doc.source", "n_lines", "n_dropped", "text")


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, all their columns, with the remaining text."""
    return _thinned(docs, min_docs).select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
