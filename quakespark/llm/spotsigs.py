"""Document fingerprints by SpotSigs.

A spot is a common word (an anchor) and the chain of the CHAIN content words
that follow it, other common words skipped, within REACH words. A document's
signature is the set of its spots' hashes. It follows the running text and
not lists, menus or marks, which have few anchors. Signatures fall into
partitions by set length, each a factor 1 / THRESHOLD wide, so that partners
are in the same or the next partition, and pairs farther apart are not near
without a look at their sets. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import settle
from quakespark.llm.line_dedup import let

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an the of and to in is that was for it with as on be by at from are this or not have he she they "
    "der die das und ist von mit den dem ein eine im zu auf nicht sich des für als auch es an "
    "le la les des et est de un une en que qui dans pour du pas sur il au avec ce "
    "el los las y es un una por con para se del no lo su al más como"
).split()
CHAIN, REACH = 2, 16
THRESHOLD = 0.8
#: Ranges of identifiers for the next document: about so many rows each.
RANGE_ROWS, MOST_RANGES = 4000, 10_000

_WORDS = r"[^\p{L}\p{N}]+"


def _lookup(words: list[str]):
    """A test whether a string is one of the words: a table by CRC-32 in which no two of them meet."""
    size = 1 << 10
    while len({zlib.crc32(w.encode()) % size for w in words}) < len(words):
        size += 1
    slots: list[str] = [""] * size
    for w in words:
        slots[zlib.crc32(w.encode()) % size] = w
    table = F.array(*[F.lit(w) for w in slots])
    return lambda w: F.get(table, (F.crc32(w.cast("binary")) % size).cast("int")) == w


def signature(text: Column, anchors=ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The sorted set of spot hashes of a text (array of longs).

    Where a text has no spot, each of its words is an anchor; where it has no
    words, it is one spot of its own, or none if empty. So different texts
    may share a signature, but equal ones always do.
    """
    common = _lookup(list(dict.fromkeys(anchors)))

    def spots(words: Column) -> Column:
        # Common words become empty, once for each word, so that chains are found without looking them up again.
        def marked(content: Column) -> Column:
            def at(i: Column) -> Column:
                ahead = F.filter(F.slice(content, i + 1, reach), lambda w: w != "")
                return F.when(F.size(ahead) >= chain, F.xxhash64(F.element_at(words, i), F.array_join(F.slice(ahead, 1, chain), " ")))

            places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(content, i) == "")
            return F.filter(F.transform(places, at), lambda h: h.isNotNull())

        return let(F.transform(words, lambda w: F.when(common(w), F.lit("")).otherwise(w)), marked)

    def pairs(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.xxhash64(w, F.coalesce(F.get(words, i + 1), F.lit(""))))

    def whole(words: Column) -> Column:
        found = F.when(F.size(words) > 0, spots(words)).otherwise(F.array().cast("array<bigint>"))
        return let(found, lambda s: F.when(F.size(s) > 0, s).when(F.size(words) > 0, pairs(words)).when(text != "", F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>")))

    words = F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")
    return F.array_sort(F.array_distinct(let(words, whole)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signatures; 1 for two empty ones. 0 without a look where one is empty."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(common, lambda c: c / (either - c)))


def printed(sig: Column) -> Column:
    """A signature as text: its hashes in hexadecimal, joined by commas."""
    return F.array_join(F.transform(sig, lambda h: F.lower(F.hex(h))), ",")


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Partition of a signature by its length: lengths up to a factor 1 / threshold apart are in the same or the next one."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold))).cast("int")


def is_near(a: Column, b: Column, like: Column, threshold: float = THRESHOLD) -> Column:
    """Whether two signatures reach the threshold; only partners in the same or neighbouring length partitions are compared."""
    apart = F.abs(length_partition(F.size(a), threshold) - length_partition(F.size(b), threshold))
    return F.when(apart > 1, False).otherwise(like >= threshold)


def _ranges(keys: DataFrame, rows: int) -> list[int]:
    """Lower bounds of ranges of about ``rows`` keys: at most MOST_RANGES longs come to the driver."""
    n = keys.count()
    parts = max(1, min(MOST_RANGES, math.ceil(n / rows)))
    if not n or parts == 1:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return sorted(set(keys.agg(F.percentile_approx("key", shares, 20 * parts)).first()[0]))


def _place(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, found in two steps: a block of bounds, then within it."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    below = lambda edges: F.size(F.filter(edges, lambda b: b <= key))
    return let(below(firsts), lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + below(F.element_at(inner, k))))


def ordered(docs: DataFrame, rows: int = RANGE_ROWS) -> tuple[DataFrame, object]:
    """(id, text, place, guest, key), and the window in which the next row of a row follows it.

    Rows are dealt by ranges of identifiers, so no task orders all of them.
    Each range also gets, as guests, the first rows of the next range (the
    last range: of the first one). A null identifier comes before all others;
    rows that repeat an identifier follow each other in order of their texts.
    """
    keyed = docs.withColumn("key", F.coalesce("id", F.lit(-(1 << 63)).cast("long")))
    bounds = _ranges(keyed.select("key"), rows)
    placed = keyed.withColumn("place", _place(F.col("key"), bounds)).withColumn("guest", F.lit(False))
    around = Window.orderBy("place")  # at most MOST_RANGES rows
    firsts = placed.groupBy("place").agg(F.min("key").alias("key"))
    homes = settle(firsts.select("key", F.coalesce(F.lag("place").over(around), F.max("place").over(Window.partitionBy())).alias("home")), "homes")
    guests = placed.join(F.broadcast(homes), "key").select("id", "text", "key", F.col("home").alias("place"), F.lit(True).alias("guest"))
    order = Window.partitionBy("place").orderBy("guest", "key", "text")
    return placed.select("id", "text", "key", "place", "guest").unionByName(guests), order


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each input row, with its own, its edited text's and the next document's likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, length_partition, edited_is_near, next_is_near
    (these two at THRESHOLD). The edited text has its last n_chars // 2 code
    points replaced by as many first ones of the next document (see ordered),
    or all it has. Null text counts as empty; an empty text's fingerprint is
    empty, and two of those are alike (1). A single row is its own next. Extra
    columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    dealt, order = ordered(slim, rows)
    half = F.floor(F.char_length("text") / 2).cast("int")
    follow = dealt.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    edit = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.substring(F.col("next_text"), F.lit(1), half))
    signed = follow.withColumn("edited", edit).select("id", "key", "place", "guest", "text", "edited", signature(F.col("text")).alias("sig"), signature(F.col("edited")).alias("edited_sig"))
    found = signed.withColumn("next_sig", F.lead("sig").over(order)).where("not guest")
    found = found.withColumns({"near_edited": likeness(F.col("sig"), F.col("edited_sig")), "near_next": likeness(F.col("sig"), F.col("next_sig"))})
    return found.select(
        F.col("id").alias(id_col),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sig")).alias("fingerprint"),
        printed(F.col("edited_sig")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        length_partition(F.size("sig")).alias("length_partition"),
        is_near(F.col("sig"), F.col("edited_sig"), F.col("near_edited")).alias("edited_is_near"),
        is_near(F.col("sig"), F.col("next_sig"), F.col("near_next")).alias("next_is_near"),
    )
