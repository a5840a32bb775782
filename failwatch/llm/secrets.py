"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

1. Base patterns give spans by themselves: values assigned to a telling name, access key ids and
   long lower-case hexadecimal runs. A fourth pattern only proposes: long runs with a digit, an
   upper-case and a lower-case letter.
2. Matches come with the text between them, whose lengths add up to their places; texts stay where
   they are and only the rows of matches move.
3. Every value is reduced to a hash and counted over the corpus by distinct repositories (documents)
   and distinct owners (sources): one row per (hash, owner, document) first, so a value that a third
   of all documents hold is spread, then sums on the map side.
4. A value that more than ``MOST_OWNERS`` owners hold is a widely copied example. Others look
   live. Base spans stay either way and carry the verdict; proposed runs are reported where they
   look live and overlap no base span.

Offsets count code points, ends are exclusive. A span of an assignment covers name and value.

Edge cases: a null text is empty; a document without spans has the hash of the empty string; a
null doc_id is a document of its own, a null source an owner; repeated rows are one document
for the counts and one row each in the result; rows that share a doc_id and differ in text are
kept apart; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from failwatch.storage import materialize

#: Base patterns, their value's group and the least length of that value; fixed by the definition.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: Runs that are reported only where they look live.
LIVE = r"[A-Za-z0-9+/_-]{20,}"
LIVE_HAS = ("[0-9]", "[A-Z]", "[a-z]")
#: A value of more owners than this is a copied example.
MOST_OWNERS = 2
_KINDS = [*BASE, "live"]
#: Stands for a null doc_id, so that ids are joined by plain equality.
_NO_ID = -(2**63)
_KEY = ["doc", "text_hash"]


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash")]


def _screened(kind: str, pattern: str, least: int) -> str:
    """The pattern whose matches are all long enough, where it finds exactly those of the plain one.

    A run of one class is matched whole, so a bound on its length drops the short ones only. An
    assignment that fails still uses up its text, so its bound is applied afterwards."""
    return {"access": rf"AKIA[A-Z0-9]{{{least - 4},}}", "hex": rf"[0-9a-f]{{{least},}}"}.get(kind, pattern)


def _matches(kind: str, pattern: str, group: int) -> Column:
    """Structs of (kind_no, i, characters since the last match, characters of this one, value)."""
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    between = F.split("text", pattern, -1)
    told = F.transform(
        F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("w"), value.alias("v")),
        lambda x, i: F.struct(
            F.lit(_KINDS.index(kind)).alias("kind_no"), i.alias("i"), F.length(x["b"]).cast("bigint").alias("gap"),
            F.length(x["w"]).cast("bigint").alias("size"), x["v"].alias("value"),
        ),
    )
    return F.when(F.col("text").rlike(pattern), told).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<kind_no:int,i:int,gap:bigint,size:bigint,value:string>>")


def found_spans(documents: DataFrame) -> DataFrame:
    """doc, text_hash, owner, kind_no, start, end, value_hash of all matches that are long enough."""
    tried = [(kind, _screened(kind, p, least), group) for kind, (p, group, least) in BASE.items()]
    arrays = [_matches(*t) for t in [*tried, ("live", LIVE, 0)]]
    rows = documents.select(*_key(), F.coalesce("source", F.lit("")).alias("owner"), F.inline(F.concat(*arrays)))
    rows = rows.dropDuplicates([*_KEY, "owner", "kind_no", "i"])
    order = Window.partitionBy(*_KEY, "owner", "kind_no").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    least = F.lit(0)
    for kind, (_, _, n) in BASE.items():
        least = F.when(F.col("kind_no") == _KINDS.index(kind), n).otherwise(least)
    live = F.lit(True)
    for has in LIVE_HAS:
        live = live & F.col("value").rlike(has)
    rows = rows.where((F.length("value") >= least) & ((F.col("kind_no") < len(BASE)) | live))
    return rows.select(*_KEY, "owner", "kind_no", "start", "end", F.sha2("value", 256).alias("value_hash"))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners: in how many documents of how many owners a value stands."""
    each = found.select("value_hash", "owner", *_KEY).distinct()
    by_owner = each.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def secret_spans(documents: DataFrame) -> DataFrame:
    """doc, text_hash, kind, start, end, value_hash, n_repos, n_owners and live of all spans."""
    found = materialize(found_spans(documents), "matches")
    # The same text of two owners has the same spans.
    spans = found.drop("owner").distinct().join(ownership(found), "value_hash")
    spans = spans.withColumn("live", F.col("n_owners") <= MOST_OWNERS)
    base = F.col("kind_no") < len(BASE)
    order = Window.partitionBy(*_KEY).orderBy("start", "kind_no")
    before, after = (order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing))
    told = (
        spans.withColumn("until", F.max(F.when(base, F.col("end"))).over(before))
        .withColumn("from", F.min(F.when(base, F.col("start"))).over(after))
    )
    apart = (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("from", F.col("end")) >= F.col("end"))
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    return told.where(base | (F.col("live") & apart)).select(
        *_KEY, kinds[F.col("kind_no")].alias("kind"), "kind_no", "start", "end", "value_hash", "n_repos", "n_owners", "live"
    )


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_live of every document."""
    spans = secret_spans(documents)
    place = F.struct("start", "kind_no", F.concat_ws(":", "kind", "start", "end").alias("span"))
    base = F.col("kind_no") < len(BASE)
    told = spans.groupBy(*_KEY).agg(
        *[F.sum((F.col("kind") == kind).cast("bigint")).alias(f"n_{kind}") for kind in BASE],
        F.array_sort(F.collect_list(F.when(base, place))).alias("base"),
        F.array_sort(F.collect_list(place)).alias("all"),
        F.sum(F.col("live").cast("bigint")).alias("n_live"),
    )
    told = told.select(
        *_KEY, *[f"n_{kind}" for kind in BASE], "n_live",
        F.array_join(F.col("base.span"), ",").alias("base"), F.array_join(F.col("all.span"), ",").alias("spans"),
    )
    rows = documents.select("doc_id", *_key()).join(told, _KEY, "left")
    none = F.lit("")
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )
