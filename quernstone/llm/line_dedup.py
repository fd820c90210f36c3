"""Line deduplication as an exact set-similarity join, in DataFrame functions only.

A line is the set of its white-space words. Lines of equal sets form a class; classes are numbered in the order of their
first places. Two classes match at a Jaccard similarity of 0.8 or more; a line goes if a line of its own or a matching
class comes before it (by key, then line number).

Words are ordered by rarity: occurrences are counted over the whole corpus in 2 ** 21 hash buckets, whose logarithms
reach the tasks as one scalar subquery of fixed size. Any order that depends on the word alone makes the prefix filter
exact, so a bucket that several words share costs candidates, never matches.

One match is enough for a class, so crowds seldom meet as all pairs. First each class is held against the earliest
classes of each crowded word of its prefix: minima by word, linear in the lines. The nearest of them are verified on the
words themselves, and classes that this settles are only looked at by others from then on. The others meet every earlier
class at the first of each run of common words of the prefix; length, position and parity filters drop meetings inside
the join, and what is left is verified. A hot word is refined to pairs of words: two classes whose first common word it
is share a second word in prefixes that are one word longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import dropped, written

RARITY_LOG2, SEEN_LOG2, HOT_LOG2 = 21, 24, 9
#: Classes that make a word crowded; words from which a line has a second parity, and up to which two parities tell
#: enough for a match to be taken for likely.
CROWD, WIDE, SURE = 16, 96, 250
#: Earliest classes of a crowded word, one from each part of its classes, and likely matches of a class that are verified.
PARTS, GUESSES = 2, 4
LONG = 250
_LEVEL_SHIFT = 57
_MASK = (1 << _LEVEL_SHIFT) - 1
_OTHER_SPACE = "\t\x0b\f\r"


def words(line: Column) -> Column:
    """Words of a line of lines(), where a space is the only white space."""
    return F.array_remove(F.split(line, " "), "")


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, tx (a hash of the whole text, which tells rows of one key apart) and text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(whole).alias("tx"), whole.alias("text"))


def lines(texts: DataFrame) -> DataFrame:
    """id, tx, at, line: every line of marked() texts that has words, with a space for any white space."""
    whole = F.when(F.col("text").rlike(f"[{_OTHER_SPACE}]"), F.translate("text", _OTHER_SPACE, "    ")).otherwise(F.col("text"))
    rows = texts.select("id", "tx", F.posexplode(F.split(whole, "\n")).alias("at", "line"))
    return rows.where(F.trim("line") != "")


def bucket(h: Column, log2: int) -> Column:
    return F.shiftrightunsigned(h, 64 - log2).cast("int")


def sketch(values: DataFrame, log2: int) -> Column:
    """The largest v of each bucket b as one array<tinyint>, 0 where there is none: a scalar of fixed size."""
    every = values.sparkSession.range(1 << log2).select(F.col("id").cast("int").alias("b"), F.lit(0).alias("v"))
    filled = values.select("b", "v").union(every).groupBy("b").agg(F.max("v").cast("tinyint").alias("v"))
    parts = filled.groupBy(F.shiftright("b", 11).alias("g")).agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("e"))
    parts = parts.select("g", F.transform("e", lambda x: x["v"]).alias("e"))
    return parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("g", "e"))), lambda x: x["e"])).alias("levels")).scalar()


def seen(values: DataFrame, least: int = 1) -> Column:
    """Whether a hash h was seen `least` times in values, by buckets of a bitmap of fixed size: a function of h."""
    word = 1 << (SEEN_LOG2 - 6)
    counts = values.select(bucket(F.col("h"), SEEN_LOG2).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bits = counts.select(F.shiftright("b", 6).alias("g"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63))).alias("v"))
    every = values.sparkSession.range(word).select(F.col("id").cast("int").alias("g"), F.lit(0).cast("long").alias("v"))
    filled = bits.union(every).groupBy("g").agg(F.bit_or("v").alias("v"))
    parts = filled.groupBy(F.shiftright("g", 9).alias("p")).agg(F.sort_array(F.collect_list(F.struct("g", "v"))).alias("e"))
    parts = parts.select("p", F.transform("e", lambda x: x["v"]).alias("e"))
    bitmap = parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("p", "e"))), lambda x: x["e"])).alias("bits")).scalar()
    at = lambda h: bucket(h, SEEN_LOG2)
    return lambda h: F.getbit(F.get(bitmap, F.shiftright(at(h), 6)), at(h).bitwiseAND(F.lit(63))) == 1


def rarity(found: DataFrame) -> Column:
    """For each bucket of words twice the logarithm of how often they occur."""
    counts = found.select(F.explode(words(F.col("line"))).alias("w")).select(bucket(F.xxhash64("w"), RARITY_LOG2).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    return sketch(counts.select("b", F.least(F.floor(2 * F.log2("n")), F.lit(63)).cast("int").alias("v")), RARITY_LOG2)


def _parity(hashes: Column) -> Column:
    flip = lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))
    return F.aggregate(hashes, F.lit(0).cast("long"), flip)


def keyed(found: DataFrame, levels: Column) -> DataFrame:
    """id, tx, at, n (distinct words), k1 (64 bits of the set), sig, sig2 and lead: the prefix for 0.8 and one more.

    lead has the rarest words as numbers: 0 for a word that occurs once only, so that no two lines can share it, and
    negative numbers for hot words, which may occur more than 2 ** HOT_LOG2 times. Bit b of sig is the parity of the
    words with hash b modulo 64, so two sets differ in at least as many words as their sigs in bits. sig2 is the same
    for every second word, in lines of more than WIDE words.
    """
    hashes = F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)))
    # the scalar stands beside the lambda here; the optimizer moves it inside, where each line reads it in place
    rows = found.select("id", "tx", "at", hashes.alias("h"), levels.alias("levels"))
    # never null, so that the array has plain numbers
    packed = lambda h: F.shiftleft(F.coalesce(F.get("levels", bucket(h, RARITY_LOG2)), F.lit(0)).cast("long"), _LEVEL_SHIFT).bitwiseOR(h.bitwiseAND(F.lit(_MASK)))
    rows = rows.select("id", "tx", "at", F.sort_array(F.transform("h", packed)).alias("s"))
    half = F.filter("s", lambda x: x.bitwiseAND(F.lit(64)) != 0)
    rows = rows.select("id", "tx", "at", F.size("s").alias("n"), F.xxhash64("s").alias("k1"), _parity(F.col("s")).alias("sig"), F.when(F.size("s") > WIDE, _parity(half)).otherwise(F.lit(0).cast("long")).alias("sig2"), "s")
    mark = lambda x: F.hash(x).bitwiseAND(F.lit((1 << 30) - 1)) + 1
    lead = lambda x: F.when(x <= _MASK, F.lit(0)).when(F.shiftright(x, _LEVEL_SHIFT) > 2 * HOT_LOG2, -mark(x)).otherwise(mark(x))
    short = F.transform(F.slice("s", F.lit(1), prefix(F.col("n")) + 1), lead)
    return rows.select("id", "tx", "at", "n", "k1", "sig", "sig2", F.when(F.col("n") > 3, short).otherwise(F.array().cast("array<int>")).alias("lead"))


def prefix(n: Column) -> Column:
    """n - ceil(0.8 n) + 1."""
    return n - F.expr("(4 * n + 4) div 5").cast("int") + 1


def overlap(a: Column, b: Column) -> Column:
    """The least number of shared words of sets of these sizes at a Jaccard similarity of 0.8: ceil(4 (a + b) / 9)."""
    return F.floor((F.lit(4) * (a + b) + 8) / 9)


def near(a: str, b: str) -> tuple[Column, Column]:
    """Of two classes: whether lengths and parities allow a match, and by how many bits the parities differ."""
    c = lambda side, name: F.col(f"{side}.{name}")
    na, nb = c(a, "n"), c(b, "n")
    most = na + nb - 2 * overlap(na, nb)
    d = F.bit_count(c(a, "sig").bitwiseXOR(c(b, "sig")))
    x2 = c(a, "sig2").bitwiseXOR(c(b, "sig2"))
    wide = F.when((na > WIDE) & (nb > WIDE), F.bit_count(x2) + F.bit_count(x2.bitwiseXOR(c(a, "sig").bitwiseXOR(c(b, "sig"))))).otherwise(d)
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (d <= most) & (wide <= most), wide


def meetings(classes: DataFrame, asks: Column) -> DataFrame:
    """code, n, sig, sig2, pos, w, b1, b2: where each class can meet others. code is 2 cid, and 1 more for a class that
    asks for earlier classes: one column, so that both sides of the join are the same rows and move once.

    Two similar classes have a first common word, inside both prefixes. If it is not hot they meet on it. If it is hot
    they share a second, later word inside prefixes longer by one, and meet on both words. Classes of more than
    0.8 LONG words also meet on the hot word alone, since pairs of words would be too many for those beyond LONG.
    b1 and b2 are the words of lead before the first and before the second word, 0 if there is none or none between.
    """
    p, n = prefix(F.col("n")), F.col("n")
    none = F.array().cast("array<struct<pos:int,w:bigint,b1:int,b2:int>>")
    before = lambda at, any_: F.when(any_, F.get("lead", at)).otherwise(F.lit(0)).alias
    place = lambda i, w, j, any_: F.struct(i.alias("pos"), w.alias("w"), before(i - 1, i > 0)("b1"), before(j, any_)("b2"))
    both = lambda w, s: F.shiftleft(w.cast("long"), 32).bitwiseOR(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    # words after a hot one are hot, so lead[i + 1 + j] is the second word of number j
    second = lambda w, i: F.transform(F.slice("lead", i + 2, F.size("lead")), lambda s, j: place(i, both(w, s), i + j, j > 0))
    alone = lambda w, i: F.array(place(i, w.cast("long"), i, F.lit(False)))
    hot = lambda w, i: F.concat(F.when(n <= LONG, second(w, i)).otherwise(none), F.when(5 * n > 4 * LONG, alone(w, i)).otherwise(none))
    places = F.transform("lead", lambda w, i: F.when((i >= p) | (w == 0), none).when(w > 0, alone(w, i)).otherwise(hot(w, i)))
    own = ["code", "n", "sig", "sig2"]
    coded = classes.where(F.size("lead") > 0).withColumn("code", 2 * F.col("cid") + asks.cast("long"))
    return coded.select(*own, F.explode(F.flatten(places)).alias("m")).select(*own, "m.pos", "m.w", "m.b1", "m.b2")


def met(places: DataFrame) -> DataFrame:
    """cid, y: for the classes of meetings() that ask, the earlier classes y that they meet and that pass the length,
    position and parity filters. The smaller class of a pair needs the shorter prefix for an overlap of 8/9 only.

    Near copies share many words of their prefixes. They meet at the first of a run of common words only: where the words
    before are equal too, both classes have a place for those, earlier in both, which passes whatever this one passes."""
    a, b = places.alias("a"), places.alias("b")
    na, nb, pa, pb = F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos")
    short = F.when(na <= nb, pa <= na - overlap(na, na)).otherwise(pb <= nb - overlap(nb, nb))
    near_places = short & (F.least(na - pa, nb - pb) >= overlap(na, nb))
    # an even code, of a class that does not ask, becomes 0 here, and no code is below
    before = F.col("b.code") < F.col("a.code") * F.col("a.code").bitwiseAND(F.lit(1))
    again = lambda c: (F.col(f"a.{c}") != 0) & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    found = a.join(b, (F.col("a.w") == F.col("b.w")) & before & ~again("b1") & ~again("b2") & near_places & near("a", "b")[0])
    return found.select(F.shiftright("a.code", 1).alias("cid"), F.shiftright("b.code", 1).alias("y"))


def earliest(classes: DataFrame, scratch: list) -> DataFrame:
    """cid, y: for each class the GUESSES nearest among the earliest classes that have a crowded word of its prefix, if
    parities, or for long lines the rare words, say that they match. A word is crowded if CROWD classes have it: words
    of fewer are left to met(). PARTS rows of a word for each task move, however many classes share it."""
    own = ["cid", "n", "sig", "sig2"]
    rows = classes.where(F.size("lead") > 0).select(*own, F.explode(F.array_distinct(F.array_remove(F.slice("lead", F.lit(1), prefix(F.col("n"))), 0))).alias("w"))
    part = lambda i: F.min(F.when(F.pmod(F.xxhash64("cid"), F.lit(PARTS)) == i, F.col("cid")))
    firsts = rows.groupBy("w").agg(F.array(*[part(i) for i in range(PARTS)]).alias("y"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= CROWD)
    firsts = firsts.select("w", F.explode("y").alias("y")).where(F.col("y").isNotNull())
    firsts = written(firsts.join(classes.select(F.col("cid").alias("y"), *own[1:]), "y").withColumnRenamed("y", "cid"), "firsts", scratch)
    rows = rows.where(seen(firsts.select(F.xxhash64("w").alias("h")))(F.xxhash64("w")))
    likely, wide = near("a", "b")
    pairs = rows.alias("a").join(firsts.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("b.cid") < F.col("a.cid")) & likely)
    nearest = F.slice(F.sort_array(F.collect_set(F.struct(wide.alias("d"), F.col("b.cid").alias("y")))), 1, GUESSES)
    best = pairs.groupBy("a.cid", "a.n").agg(nearest.alias("m")).select("cid", "n", F.explode("m.y").alias("y"))
    sure = best.where(F.col("n") <= SURE).select("cid", "y")
    long = best.where(F.col("n") > SURE).join(classes.select("cid", "lead"), "cid").join(classes.select(F.col("cid").alias("y"), F.col("lead").alias("other")), "y")
    return sure.unionByName(long.where(2 * F.size(F.array_intersect("lead", "other")) > F.size(F.array_distinct("lead"))).select("cid", "y"))


def matching(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: list) -> DataFrame:
    """cid of the pairs (cid, y) whose lines have a Jaccard similarity of 0.8, from the words themselves, and whose
    places are not the same."""
    place = F.struct("id", "at", "tx")
    wanted = pairs.select("cid").union(pairs.select("y")).distinct()
    reps = written(classes.join(wanted, "cid").select("cid", "first", F.xxhash64("first").alias("h")), "reps", scratch)
    # only documents that may have the place of a wanted class are split, and only lines that may be at one are moved
    maybe, inside = seen(reps.select("h")), seen(reps.select(F.xxhash64("first.id", "first.tx").alias("h")))
    texts = lines(docs.where(inside(F.xxhash64("id", "tx")))).where(maybe(F.xxhash64(place))).select(place.alias("p"), F.xxhash64(place).alias("h"), "line")
    sets = texts.join(reps, "h").where(F.col("p").eqNullSafe(F.col("first"))).select("cid", "line", F.struct("p.id", "p.at").alias("p")).dropDuplicates(["cid"])
    sets = written(sets, "sets", scratch)
    x, y = sets.select("cid", F.col("line").alias("x"), F.col("p").alias("px")), sets.select(F.col("cid").alias("y"), F.col("line").alias("z"), F.col("p").alias("py"))
    both = [F.array_distinct(words(F.col(c))) for c in "xz"]
    alike = 9 * F.size(F.array_intersect(*both)) >= 4 * (F.size(both[0]) + F.size(both[1]))
    return pairs.join(x, "cid").join(y, "y").where((F.col("py") < F.col("px")) & alike).select("cid").distinct()


def repeated(classes: DataFrame, docs: DataFrame, scratch: list) -> DataFrame:
    """cid of the classes that an earlier class matches.

    The likely match of a class among the earliest is verified first. Classes that have none, or whose likely match is
    none after all, are then held against every earlier class they meet, so no match is lost.
    """
    likely = written(earliest(classes, scratch), "likely", scratch)
    settled = written(matching(likely, classes, docs, scratch), "settled", scratch)
    asking = classes.join(settled.withColumn("done", F.lit(True)), "cid", "left")
    rest = written(met(meetings(asking, F.col("done").isNull())).distinct(), "rest", scratch)
    return settled.union(matching(rest, classes, docs, scratch))


def line_limits(docs: DataFrame, key: str, text: str, scratch: list) -> tuple[DataFrame, DataFrame]:
    """All lines by class key, and for classes that lose lines whether all go or all but the first place."""
    texts = marked(docs, key, text)
    found = lines(texts)
    rows = written(keyed(found, rarity(found)), "lines", scratch)
    place = F.struct("id", "at", "tx")
    classes = rows.groupBy("k1", "sig", "sig2", "n").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("lead").alias("lead"))
    classes = written(classes.orderBy("first").withColumn("cid", F.monotonically_increasing_id()), "classes", scratch)
    gone = repeated(classes, texts, scratch).withColumn("all", F.lit(True))
    limits = classes.select("cid", "k1", "sig", "n", "copies", "first").join(gone, "cid", "left").where((F.col("copies") > 1) | F.col("all"))
    limits = limits.select("k1", "sig", "n", F.struct("first.id", "first.at").alias("first"), F.coalesce("all", F.lit(False)).alias("all"))
    return rows, written(limits, "limits", scratch)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = True) -> DataFrame:
    """docs with the later matching lines taken out of its text, followed by n_lines and n_removed; no row goes.

    Without counts the columns are those of docs.

    Defined cases: a null text stays null and has no lines, an empty text has one; lines without words always stay and
    match nothing; a line of three words or fewer matches equal sets only; a line may have any length and is compared in
    full; of lines at one place (rows that repeat a key) none is later than the other; a null key comes before all
    others; an empty table gives an empty result. Columns named n_lines or n_removed are replaced, others stay.
    """
    scratch: list = []
    rows, limits = line_limits(docs, key, text, scratch)
    held = seen(limits.select(F.col("k1").alias("h")))
    gone = rows.select("id", "tx", "at", "k1", "sig", "n").where(held(F.col("k1"))).join(limits, ["k1", "sig", "n"])
    gone = gone.where(F.col("all") | (F.struct("id", "at") > F.col("first"))).groupBy("id", "tx").agg(F.collect_set("at").alias("gone_at"))
    gone = written(gone.select(F.struct("id", "tx").alias("gone_from"), "gone_at", F.xxhash64("id", "tx").alias("h")), "gone")
    dropped(docs.sparkSession, scratch)
    made = ("n_lines", "n_removed") if counts else ()
    others = [c for c in docs.columns if c not in (text, *made)] or [key]
    whole = F.col(f"`{text}`")
    mark = F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("tx"))
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), mark.alias("mark"), whole.alias("text")).withColumn("h", F.xxhash64("mark.id", "mark.tx"))
    # documents that surely lose no line stay where they are
    maybe = seen(gone.select("h"))(F.col("h"))
    joined = frame.where(maybe).join(gone.withColumnRenamed("h", "g"), (F.col("h") == F.col("g")) & F.col("mark").eqNullSafe(F.col("gone_from")), "left").select("row", "text", "gone_at")
    joined = joined.unionByName(frame.where(~maybe).select("row", "text", F.lit(None).cast("array<int>").alias("gone_at")))
    # a column of its own, read twice: inside the lambda the text would be split again for each line
    joined = joined.withColumn("parts", F.when(F.col("gone_at").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone_at"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    shown = {text: F.when(F.col("gone_at").isNull(), F.col("text")).otherwise(rest)}
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    shown["n_lines"] = F.coalesce(breaks + 1, F.lit(0)).cast("long")
    shown["n_removed"] = F.coalesce(F.size("gone_at"), F.lit(0)).cast("long")
    wanted = [c for c in docs.columns if c not in made]
    return joined.select(*[(shown[c] if c == text else F.col(f"row.`{c}`")).alias(c) for c in wanted], *[shown[c].alias(c) for c in made])


ORACLE = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, list_sort(list_distinct(list_filter(regexp_split_to_array(parts[i], '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS toks
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)),
c AS (SELECT toks, len(toks) AS n, min(row(doc_id, pos)) AS head, row_number() OVER (ORDER BY toks) AS cid FROM l WHERE len(toks) > 0 GROUP BY toks),
t AS (SELECT cid, n, unnest(toks) AS w FROM c WHERE n > 3),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT cid, n, w FROM (SELECT cid, n, t.w, row_number() OVER (PARTITION BY cid ORDER BY df, t.w) AS r FROM t JOIN f ON t.w = f.w) WHERE r <= n - ((4 * n + 4) // 5) + 1),
k AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM p a JOIN p b ON a.w = b.w AND a.cid <> b.cid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
m AS (SELECT k.a AS cid, min(y.head) AS f FROM k JOIN c x ON k.a = x.cid JOIN c y ON k.b = y.cid WHERE 9 * len(list_intersect(x.toks, y.toks)) >= 4 * (x.n + y.n) GROUP BY k.a),
z AS (SELECT c.toks, CASE WHEN m.f < c.head THEN m.f ELSE c.head END AS lim FROM c LEFT JOIN m ON c.cid = m.cid),
g AS (SELECT l.doc_id, list(l.pos) AS gone FROM l JOIN z ON l.toks = z.toks WHERE row(l.doc_id, l.pos) > z.lim GROUP BY l.doc_id)
SELECT s.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
  coalesce(len(parts), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed
FROM s LEFT JOIN g ON s.doc_id = g.doc_id
"""
