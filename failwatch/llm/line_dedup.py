"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its sequence of words (split at spaces). A line is dropped when an earlier line, by
(doc_id, line number), is the same sequence or, where the shorter of the two has at least
``MIN_WORDS`` words, at most ``EDITS`` = 1 word insertion, deletion or substitution away. That
earlier line may itself be dropped, so of a chain of near lines the earliest stays.

1. Every line becomes a narrow row of hashes, written once. Equal lines are grouped by two
   64-bit hashes; the earliest stands for them.
2. One edit cannot touch both the first and the last ``SIDE`` words, nor both halves of a
   line, so lines that share neither with another line of fitting length have no neighbour and
   go no further. This loses nothing, and only the other lines are fetched.
3. Those emit all deletion variants as hashed keys: the hash of the line without word i, and
   the hash of the line itself. Two lines are one substitution apart when they share (length,
   i, hash without i), one deletion apart when a variant of one is the other. The hashes come
   from a running exclusive or over the words, so a variant is not hashed word by word.
4. Each key keeps the earliest line only; no pairs are formed within a key. Each line is
   checked word by word against the earliest neighbour found, then dropped.

Edge cases: blank lines stay. A null text has no lines and stays null; a document that loses
all its non-blank lines is removed, other documents stay. Rows with a null doc_id come first in
the order. Rows that repeat a doc_id are ordered by their text, equal ones count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.storage import materialize, remove

MIN_WORDS = 10
SIDE = MIN_WORDS // 2
EDITS = 1
#: Lines of more words get their variants row by row instead of in one array.
ARRAY_WORDS = 4096


#: Stands for a null doc_id, so that ids are joined by plain equality and null comes first.
NO_ID = -(2**63)


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def line_hashes(documents: DataFrame) -> DataFrame:
    """doc, text_hash, line_no, n, two hashes and two side hashes of every line that is not blank."""
    lines = documents.select(
        _doc(), F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    ).select("doc", "text_hash", "line_no", _words(F.col("line")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    return lines.select(
        "doc", "text_hash", "line_no",
        F.xxhash64("words").alias("hash_a"),
        F.xxhash64(F.lit(1), "words").alias("hash_b"),
        F.when(n >= MIN_WORDS, F.xxhash64(F.slice("words", 1, SIDE))).alias("head"),
        F.when(n >= MIN_WORDS, F.xxhash64(F.lit(2), F.slice("words", -SIDE, SIDE))).alias("tail"),
    )


def _place() -> Column:
    return F.struct("doc", "text_hash", "line_no")


def _fetch(documents: DataFrame, places: DataFrame) -> DataFrame:
    """place and words of the lines at ``places``."""
    wanted = places.select("place.*").groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("wanted"))
    texts = documents.select(_doc(), F.xxhash64("text").alias("text_hash"), "text")
    lines = texts.join(wanted, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"]).select(
        "doc", "text_hash", "wanted", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.where(F.array_contains("wanted", F.col("line_no"))).select(_place().alias("place"), _words(F.col("line")).alias("words"))


def _fitting(lines: DataFrame) -> DataFrame:
    """Lines that share their first or last half with another, as of the shorter one's length."""
    def halves(shorter: Column) -> list[Column]:
        half = F.floor(shorter / 2).cast("int")
        back = shorter - half
        return [
            F.when(shorter >= MIN_WORDS, F.xxhash64(shorter, F.slice("words", F.lit(1), half))),
            F.when(shorter >= MIN_WORDS, F.xxhash64(-shorter, F.slice("words", F.size("words") - back + 1, back))),
        ]

    n = F.size("words")
    keyed = lines.select("ord", F.explode(F.array(*halves(n), *halves(n - 1))).alias("half")).where("half is not null")
    shared = keyed.groupBy("half").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high")
    return lines.join(keyed.join(shared, "half", "left_semi"), "ord", "left_semi")


def _without(words: str) -> Column:
    """For every i the hash of the words without word i, and last that of all words."""
    # A word's hash at its own place, and at the place it has when an earlier word goes.
    both = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, i).alias("stay"), F.xxhash64(w, i - 1).alias("move")))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        both,
        F.struct(zero.alias("stay"), zero.alias("move"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct(
            acc["stay"].bitwiseXOR(x["stay"]).alias("stay"),
            acc["move"].bitwiseXOR(x["move"]).alias("move"),
            F.array_append(acc["out"], acc["stay"].bitwiseXOR(acc["move"]).bitwiseXOR(x["move"])).alias("out"),
        ),
        lambda acc: F.array_append(F.transform(acc["out"], lambda x: x.bitwiseXOR(acc["move"])), acc["stay"]),
    )


def _variants(lines: DataFrame) -> DataFrame:
    """key, kind (0 the line itself, 1 without a word, for a deletion, 2 for a substitution) and ord."""
    n = F.size("words")
    short = lines.where(n <= ARRAY_WORDS).select("ord", n.alias("n"), F.posexplode(_without("words")).alias("i", "hash"))
    word = lines.where(n > ARRAY_WORDS).select("ord", n.alias("n"), F.posexplode("words").alias("i", "word"))
    word = word.withColumn("stay", F.xxhash64("word", "i")).withColumn("move", F.xxhash64("word", F.col("i") - 1)).drop("word")
    up_to = Window.partitionBy("ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.partitionBy("ord").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = word.withColumn("before", F.bit_xor("stay").over(up_to)).withColumn("behind", F.bit_xor("move").over(from_here))
    gone = F.col("before").bitwiseXOR(F.col("stay")).bitwiseXOR(F.col("behind")).bitwiseXOR(F.col("move"))
    long = word.select("ord", "n", "i", gone.alias("hash")).union(
        word.where(F.col("i") == F.col("n") - 1).select("ord", "n", "n", "before")
    )
    options = F.when(F.col("i") == F.col("n"), F.array(F.struct(F.xxhash64("n", "hash").alias("key"), F.lit(0).alias("kind")))).otherwise(
        F.array(
            F.struct(F.xxhash64(F.col("n") - 1, "hash").alias("key"), F.lit(1).alias("kind")),
            F.struct(F.xxhash64("n", "i", "hash").alias("key"), F.lit(2).alias("kind")),
        )
    )
    return short.union(long).select("ord", "n", F.inline(options)).where((F.col("kind") != 1) | (F.col("n") > MIN_WORDS)).drop("n")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word edit apart."""
    def apart(x, y):
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), lambda d: d))

    n, m = F.size(a), F.size(b)
    longer, shorter = F.when(n >= m, a).otherwise(b), F.when(n >= m, b).otherwise(a)
    # Equal words from the front, then from the back.
    differ = F.zip_with(longer, shorter, lambda p, q: ~p.eqNullSafe(q))
    front = F.array_position(differ, True) - 1
    rest = F.slice(longer, (front + 2).cast("int"), F.size(longer))
    other = F.slice(shorter, (front + 1).cast("int"), F.greatest(F.size(shorter), F.lit(1)))
    return F.when(n == m, apart(a, b) <= EDITS).when(F.abs(n - m) == 1, rest == other).otherwise(False)


def _near_lines(documents: DataFrame, first: DataFrame) -> DataFrame:
    """hash_a, hash_b and ``earlier``, the place of an earlier line one edit away."""
    sides = first.where("head is not null").select("hash_a", "hash_b", F.explode(F.array("head", "tail")).alias("side"))
    shared = sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").select("side")
    close = first.join(sides.join(shared, "side", "left_semi"), ["hash_a", "hash_b"], "left_semi").select("hash_a", "hash_b", "place")
    # Written in the order of the lines, so the row numbers are in that order.
    ordered = _fetch(documents, close).orderBy("place").withColumn("ord", F.monotonically_increasing_id())
    fetched = materialize(ordered, "lines")
    lines = materialize(_fitting(fetched), "near-lines")
    keys = materialize(_variants(lines), "variants")
    shared = keys.groupBy("key").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high")
    kept = materialize(keys.join(shared, "key", "left_semi"), "shared-variants")
    least = kept.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.col("ord"))).alias("whole"),
        F.min(F.when(F.col("kind") == 1, F.col("ord"))).alias("shorter"),
        F.min(F.when(F.col("kind") == 2, F.col("ord"))).alias("swapped"),
    )
    earlier = F.when(F.col("kind") == 0, F.col("shorter")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("swapped"))
    found = kept.join(least, "key").select("ord", earlier.alias("earlier")).where("earlier < ord").distinct()
    mine = lines.select("ord", F.col("place").alias("mine"), F.col("words").alias("words_a"))
    theirs = lines.select(F.col("ord").alias("earlier"), F.col("place").alias("theirs"), F.col("words").alias("words_b"))
    checked = found.join(mine, "ord").join(theirs, "earlier").where(_one_edit(F.col("words_a"), F.col("words_b")))
    near = materialize(checked.groupBy(F.col("mine").alias("place")).agg(F.min("theirs").alias("earlier")), "near")
    remove(fetched, lines, keys, kept)
    return near


def duplicate_lines(documents: DataFrame) -> DataFrame:
    """doc, text_hash, line_no of every dropped line, and doc and line number of an earlier one."""
    hashed = materialize(line_hashes(documents), "line-hashes")
    first = hashed.groupBy("hash_a", "hash_b").agg(
        F.min(_place()).alias("place"), F.max("head").alias("head"), F.max("tail").alias("tail"), F.count("*").alias("copies")
    )
    first = materialize(first, "distinct-lines")
    near = _near_lines(documents, first)
    # A line goes when it is not the first of its own copies, or that first one has a neighbour.
    repeated = first.join(near, "place", "left").where("copies > 1 or earlier is not null")
    repeated = materialize(repeated.select("hash_a", "hash_b", F.least("earlier", "place").alias("first")), "repeated")
    remove(first, near)
    gone = hashed.select("hash_a", "hash_b", _place().alias("mine")).join(repeated, ["hash_a", "hash_b"]).where("first < mine")
    return gone.select("mine.*", F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_line_no"))


def line_report(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, first_doc_id and first_line_no of every dropped line.

    first_* is an earlier line that equals it or is one edit away."""
    ids = [F.nullif(F.col(c), F.lit(NO_ID)).alias(name) for c, name in (("doc", "doc_id"), ("first_doc", "first_doc_id"))]
    return duplicate_lines(documents).select(ids[0], "line_no", ids[1], "first_line_no")


def _cleaned(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as c0, c1, ..., so clashing names do no harm, new_text, n_lines and n_dropped."""
    gone = (
        duplicate_lines(documents)
        .groupBy("doc", "text_hash")
        .agg(F.array_sort(F.collect_set("line_no")).alias("gone_lines"))
    )
    rows = documents.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
        _doc(), F.xxhash64("text").alias("text_hash"), F.col("text").alias("old_text"),
    )
    lines = F.split("old_text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone_lines", i))
    joined = rows.join(gone, ["doc", "text_hash"], "left").select(
        *[f"c{i}" for i in range(len(columns))],
        F.when(F.col("gone_lines").isNull(), F.col("old_text")).otherwise(F.array_join(kept, "\n")).alias("new_text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone_lines"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    return joined.where((F.col("n_dropped") == 0) | (F.trim(F.translate("new_text", "\n", " ")) != ""))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """doc_id, the cleaned text, n_lines before and n_dropped."""
    return _cleaned(documents, ["doc_id"]).select(F.col("c0").alias("doc_id"), F.col("new_text").alias("text"), "n_lines", "n_dropped")


def clean_documents(documents: DataFrame) -> DataFrame:
    """All columns of the documents with the text cleaned and n_chars, if there, counted anew."""
    def column(i: int, name: str) -> Column:
        if name == "text":
            return F.col("new_text")
        if name == "n_chars":
            return F.when(F.col("n_dropped") > 0, F.length("new_text")).otherwise(F.col(f"c{i}")).cast(documents.schema[name].dataType)
        return F.col(f"c{i}")

    return _cleaned(documents, documents.columns).select(*[column(i, c).alias(c) for i, c in enumerate(documents.columns)])
