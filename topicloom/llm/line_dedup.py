"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line's words are what white space parts, lower-cased. A line goes if an earlier line has the same words, or if an
earlier line has words at an edit distance of one (a word put in, left out or replaced) and the longer of the two has at
least ``min_words`` words. Earlier means: of a smaller doc_id, or of the same and further up. Blank lines stay.

1. Lines are reduced to 128-bit hashes of their words; the earliest line of each hash stands for its copies.
2. An edit leaves the first or the second half of a line as it was. Only lines that share a half with another one go on.
3. These emit their neighbourhood: hashes of the words with the k-th left out, and of the words with a gap before the
   k-th, at n steps for a line of n words. Lines that replace one word by another meet in the former, a line and one with a word more meet in both kinds. All lines
   of one key are within the bound of each other, so the earliest of a key settles the others; no pairs are written out.
4. Each line is compared with the earliest lines of all keys it met, word by word, before it goes.

Keys are counted by aggregation and joined back, so a key that a third of all lines have is pre-aggregated, and its rows
can be split. A null text stays null; rows equal in doc_id and text are treated alike (those of one doc_id are told apart
by 64 bits of their texts' hashes: n of them collide with a probability of n**2 / 2**65); rows without a doc_id come last.
Only doc_id and text are read by ``deduplicated``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: Words that the longer of two lines must have for an edit between them to be overlooked, if not said otherwise.
MIN_WORDS = 8
_LAST = 2**63 - 1
_WHITE = " \t\r\x0b\x0c"


def _key() -> list[F.Column]:
    """d, h: doc_id with null last, and 64 bits of the text's hash, which tell rows of one doc_id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("h")]


def _raw_lines(docs: DataFrame) -> DataFrame:
    """A row for each line, in lower case, with its place in the text. odd: the text has other white space than single
    spaces and line ends."""
    text = F.col("text")
    odd = text.contains("  ")
    for c in _WHITE[1:]:
        odd = odd | text.contains(c)
    # what is said of a text comes first, for what stands beside an explode is computed for each of its rows
    texts = docs.where("text IS NOT NULL").select(*_key(), odd.alias("odd"), F.lower(text).alias("text"))
    return texts.select("d", "h", "odd", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _normal() -> F.Column:
    """A line's words, parted by single spaces."""
    return F.btrim(F.when(F.col("odd"), F.regexp_replace("line", "[ \\t\\r\\x0B\\x0C]+", " ")).otherwise(F.col("line")))


def _halves(min_words: int) -> list[F.Column]:
    """Hashes of the halves that a line shares with a line one edit away: two from the front, two from the back.

    Two lines of which the shorter has m words share the first m // 2 words or the last m - m // 2.
    """
    front, front_less = "n div 2", "(n - 1) div 2"
    back, back_less = f"n - {front}", f"n - 1 - {front_less}"

    def part(side: str, size: str, other: str = "-1") -> F.Column:
        sign = "" if side == "front" else "-"
        return F.expr(f"CASE WHEN n >= {min_words - 1} AND {size} != {other} THEN xxhash64('{side}', {size}, substring_index(line, ' ', {sign}cast({size} AS int))) END")

    return [part("front", front).alias("f1"), part("front", front_less, front).alias("f2"), part("back", back).alias("b1"), part("back", back_less, back).alias("b2")]


def _first_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """The earliest line of each sequence of words, with the hashes of its halves."""
    lines = lines.select("d", "h", "pos", _normal().alias("line")).where("line <> ''")
    hashed = lines.select("d", "h", "pos", F.expr("octet_length(line) - octet_length(replace(line, ' ', '')) + 1").alias("n"), "line")
    hashed = hashed.select("d", "h", "pos", "n", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), *_halves(min_words))
    found = hashed.groupBy("k1", "k2").agg(F.min(F.struct("d", "h", "pos")).alias("p"), *[F.first(c).alias(c) for c in ("n", "f1", "f2", "b1", "b2")])
    return found.select("p.d", "p.h", "p.pos", "k1", "n", "f1", "f2", "b1", "b2")


def _sharing(first: DataFrame, min_words: int) -> DataFrame:
    """(d, h, pos, front, back): lines that share a half with another line, and which."""
    # a line of n words and one of n + 1 may have halves of one length, so the keys carry the length and not n
    keys = first.where(F.col("n") >= min_words - 1).select("d", "h", "pos", F.explode(F.array(*[F.struct(F.lit(c[0] == "f").alias("front"), F.col(c).alias("half")) for c in ("f1", "f2", "b1", "b2")])).alias("e")).select("d", "h", "pos", "e.front", "e.half").where("half IS NOT NULL")
    shared = keys.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    return keys.join(shared, "half", "left_semi").groupBy("d", "h", "pos").agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("back"))


#: Bits of the filter by which lines are picked out again: eight for each, within these powers of two; at most 1,048,576
#: rows of 64, whatever the input.
_FILTER_BITS = (23, 26)


def _picked(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """(d, h, pos, n, front, back, w): the words of the lines that are in wanted (d, h, pos, front, back). A filter of
    bounded size goes to every task first and passes all wanted lines and, up to eight million of them, few others, so
    that little text is shuffled beside theirs."""
    low, high = _FILTER_BITS
    size = min(high, max(low, (8 * wanted.count()).bit_length()))
    spot = F.pmod(F.xxhash64("d", "h", "pos"), F.lit(1 << size))
    bit = F.expr("shiftleft(1L, cast(spot & 63 AS int))")
    bits = wanted.select(spot.alias("spot")).select(F.shiftright("spot", 6).alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    marked = raw.withColumn("spot", spot).withColumn("place", F.shiftright("spot", 6)).join(F.broadcast(bits), "place")
    marked = marked.where(F.col("bits").bitwiseAND(bit) != 0)
    words = marked.select("d", "h", "pos", F.split(_normal(), " ").alias("w")).join(wanted, ["d", "h", "pos"]).dropDuplicates(["d", "h", "pos"])  # of repeated rows
    return words.select("d", "h", "pos", F.size("w").alias("n"), "front", "back", "w")


def _neighbourhood(picked: DataFrame, min_words: int) -> DataFrame:
    """(d, h, at, key): each line with a gap before its place-th word, and with that word left out. ``at`` is 64 bits: the
    line's pos, the place, and whether a word is left out.

    Words before and after a place are hashed as exclusive ors of what each word and its distance from the line's
    beginning or end give. Those add up along the line, so a line of n words costs n steps.
    """
    ends = F.aggregate(F.transform("w", lambda x, i: F.xxhash64(F.col("n") - i, x)), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h))
    words = picked.withColumn("ends", ends).select("d", "h", "pos", "n", "front", "back", "ends", F.posexplode("w").alias("j", "word"))
    before = Window.partitionBy("d", "h", "pos").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda h: F.coalesce(F.bit_xor(h).over(before), F.lit(0).cast("long"))
    words = words.withColumn("hs", F.xxhash64(F.col("n") - F.col("j"), "word")).withColumn("pre", so_far(F.xxhash64("j", "word"))).withColumn("post", F.col("ends").bitwiseXOR(so_far(F.col("hs"))))
    place, n = F.col("j") + 1, F.col("n")
    # an equal front half leaves the edit behind it, an equal back half before it; places near the middle are in both
    near = lambda i: (F.col("front") & (i >= F.expr("(n - 1) div 2"))) | (F.col("back") & (i <= F.expr("n div 2") + 2))
    at = lambda i, out: F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR((i * 2 + out).cast("long"))
    entry = lambda ok, i, out, pre, post: F.when(ok & near(i), F.struct(at(i, out).alias("at"), F.xxhash64(i, pre, post).alias("key")))
    less = F.col("post").bitwiseXOR(F.col("hs"))
    entries = F.array(
        entry(F.lit(True), place, 0, F.col("pre"), F.col("post")),
        entry(n >= min_words, place, 1, F.col("pre"), less),
        entry(place == n, place + 1, 0, F.col("pre").bitwiseXOR(F.xxhash64("j", "word")), F.lit(0).cast("long")),
    )
    return words.select("d", "h", F.explode(entries).alias("e")).where("e IS NOT NULL").select("d", "h", "e.at", "e.key")


def _near(raw: DataFrame, first: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(d, h, pos) of first lines that an earlier line is one edit away from; all that a line met are compared with it."""
    sharing = scratch.stage(_sharing(first, min_words), "sharing")
    picked = scratch.stage(_picked(raw, sharing), "picked")
    keys = _neighbourhood(picked, min_words)
    earliest = keys.groupBy("key").agg(F.min(F.struct("d", "h", "at")).alias("e"), F.count("*").alias("lines")).where("lines > 1").select("key", "e")
    met = keys.join(earliest, "key").select("d", "h", F.shiftright("at", 32).cast("int").alias("pos"), "at", F.col("e.d").alias("e_d"), F.col("e.h").alias("e_h"), F.shiftright("e.at", 32).cast("int").alias("e_pos"), F.col("e.at").alias("e_at"))
    met = met.where("struct(e_d, e_h, e_pos) < struct(d, h, pos)")
    words = picked.select("d", "h", "pos", "w")
    met = met.join(words, ["d", "h", "pos"]).join(words.select(F.col("d").alias("e_d"), F.col("h").alias("e_h"), F.col("pos").alias("e_pos"), F.col("w").alias("e_w")), ["e_d", "e_h", "e_pos"])
    place = lambda at: F.shiftright(F.col(at).bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    less = lambda w, at: F.concat(F.slice(w, F.lit(1), place(at) - 1), F.slice(w, place(at) + F.col(at).bitwiseAND(F.lit(1)).cast("int"), F.size(w)))
    return met.where(less("w", "at") == less("e_w", "e_at")).select("d", "h", "pos").distinct()


def _kept_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, h, kept) of each row's key in docs: places of the lines kept that aren't blank."""
    scratch = Scratch(docs.sparkSession, "lines")
    raw = _raw_lines(docs)
    first = scratch.stage(_first_lines(raw, min_words), "first")
    near = scratch.stage(_near(raw, first, scratch, min_words), "near")
    scratch.drop("sharing", "picked")
    kept = first.select("d", "h", "pos").join(near, ["d", "h", "pos"], "left_anti")
    return kept.groupBy("d", "h").agg(F.collect_list("pos").alias("kept"))


def _of_kept(text: str) -> tuple[F.Column, F.Column, F.Column]:
    """Of a text and ``kept``: how many lines aren't blank, how many of those are kept, and the text of kept and blank
    lines."""
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    white = F.lit(_WHITE)

    def left(lines):
        blank = F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, white) == "", i)), lambda i: i.isNotNull())
        at = F.array_sort(F.concat(kept, blank))
        full = (F.size(lines) - F.size(blank)).cast("long")
        return F.struct(full.alias("n_lines"), F.array_join(F.transform(at, lambda p: F.element_at(lines, p + 1)), "\n").alias("text"))

    found = F.transform(F.array(F.split(text, "\n", -1)), left)[0]  # so that the text is split once
    some = F.col(text).isNotNull()
    zero = F.lit(0).cast("long")
    return F.when(some, found["n_lines"]).otherwise(zero), F.when(some, F.size(kept).cast("long")).otherwise(zero), F.when(some, found["text"])


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with all their columns; ``text`` loses the lines that go."""
    rows = docs.select(*_key(), F.struct("*").alias("row")).join(_kept_lines(docs, min_words), ["d", "h"], "left")
    return rows.select(*[(_of_kept("row.text")[2] if name == "text" else F.col("row")[name]).alias(name) for name in docs.columns])


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_kept, text) of each row of docs (doc_id, text): lines that aren't blank, those of them that
    are kept, and the text of kept and blank lines."""
    rows = docs.select(*_key(), "doc_id", "text").join(_kept_lines(docs, min_words), ["d", "h"], "left")
    n_lines, n_kept, text = _of_kept("text")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), n_lines.alias("n_lines"), n_kept.alias("n_kept"), text.alias("text"))
