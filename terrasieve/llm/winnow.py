"""Document fingerprints by winnowing, with Spark column expressions only.

Tokens are runs of up to 8 characters between ASCII white space (longer words are cut from
their start), so that a text without spaces has tokens too. Every token ends a k-gram of
``GRAM`` tokens (the first ones reach back before the text), hashed from the hashes of its
tokens as the window rolls on. Of every ``WINDOW`` grams in a row, and of the shorter windows at
the start, the least hash is kept, the rightmost of equal ones. Two texts that share
``WINDOW + GRAM - 1`` tokens in a row share a kept hash; the positions say where.

A hash and its position are held in one integer: 36 bits of hash, then the position counted
down from the greatest, so that the minimum of integers is the rightmost least hash.

Null text counts as empty: no tokens, fingerprint ``""``. The likeness of two fingerprints is
the Jaccard index of their hash sets; 1 if both are empty. Rows with a null ``doc_id`` come
after all others, each followed by the first document. Of repeated ids the least text stands for
the next document; each repeated row has its own result. An empty table gives an empty result.
Columns besides ``doc_id`` and ``text`` are ignored. Texts are taken whole; one has
``PLACES`` tokens at most, as a position has 27 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_ranges, let, texts

GRAM = 3
WINDOW = 5
TOKEN = r"[^\x20\x09-\x0D]{1,8}"
PLACES = 2**27  # tokens of a text at most


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept hashes with positions, one integer each, in the order of the text."""

    def keys(h: Column) -> Column:
        def key(_: Column, i: Column) -> Column:
            g = F.xxhash64(*[F.coalesce(F.get(h, i - k), F.lit(0)) for k in range(gram)])
            return F.shiftleft(F.shiftrightunsigned(g, 28), 27).bitwiseOR((F.lit(PLACES - 1) - i).cast("long"))

        return F.transform(h, key)

    def least(k: Column) -> Column:
        return F.array_distinct(F.transform(k, lambda x, i: F.least(x, *[F.get(k, i - d) for d in range(1, window)])))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: let(keys(h), least))


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda k: F.shiftright(k, 27)))


def positions(kept: Column) -> Column:
    return F.transform(kept, lambda k: (F.lit(PLACES - 1) - k.bitwiseAND(F.lit(PLACES - 1))).cast("int"))


def told(kept: Column) -> Column:
    """``hash@position`` of each kept gram, comma-joined."""
    one = lambda k: F.concat_ws("@", F.lower(F.hex(F.shiftright(k, 27))), F.lit(PLACES - 1) - k.bitwiseAND(F.lit(PLACES - 1)))
    return F.array_join(F.transform(kept, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, fingerprint, hashes, positions`` of every row."""
    kept = texts(docs).select("doc_id", winnow(F.col("text"), gram, window).alias("kept"))
    return kept.select("doc_id", told(F.col("kept")).alias("fingerprint"), F.transform("kept", lambda k: F.shiftright(k, 27)).alias("hashes"), positions(F.col("kept")).alias("positions"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text`` of every row. Texts are shuffled once, by ranges of ids that
    hold about as many rows each; within a range the next text is the next row's, and only the
    first text of each range goes to the range before it."""
    own = texts(docs)
    number, following, least = id_ranges(own.select("doc_id"))
    in_range = Window.partitionBy("range").orderBy("doc_id", "text")
    same_id = Window.partitionBy("range", "doc_id").orderBy("text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = own.where("doc_id is not null").withColumn("range", number)
    placed = placed.select("*", F.lead("text").over(in_range).alias("after"), F.lag("doc_id").over(in_range).isNull().alias("leads"))
    placed = placed.withColumn("after", F.last("after").over(same_id))
    leads = placed.where("leads").select(F.col("range").alias("following"), F.col("text").alias("next_text"))
    last = placed.where("after is null").join(following, "range").join(leads, "following")
    pairs = placed.where("after is not null").select("doc_id", "text", F.col("after").alias("next_text")).unionByName(last.select("doc_id", "text", "next_text"))
    # One row, by the aggregate; without any id a text follows itself.
    first = own.where(F.col("doc_id") == least).agg(F.min("text").alias("next_text"))
    rest = own.where("doc_id is null").join(F.broadcast(first), F.lit(True), "left").select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))
    return pairs.unionByName(rest)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter replaced by the
    start of the next document."""
    pairs = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = pairs.select("doc_id", "n_chars", "text", edited.alias("edited"), "next_text")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow(F.col("text")).alias("a"), winnow(F.col("edited")).alias("b"), hashes(winnow(F.col("next_text"))).alias("c"))
    rows = rows.select("*", hashes(F.col("a")).alias("ha"), hashes(F.col("b")).alias("hb"))
    return rows.select("doc_id", "n_chars", "edited_sha256", told(F.col("a")).alias("fingerprint"), told(F.col("b")).alias("edited_fingerprint"), likeness(F.col("ha"), F.col("hb")).alias("near_edited"), likeness(F.col("ha"), F.col("c")).alias("near_next"))
