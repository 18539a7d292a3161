"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions.

Candidates are found by pattern in whole texts.  How many repositories and
owners carry the same value decides what a candidate is: a value that many
owners carry, or that one owner has put into many repositories, is an example
that was copied around; any other value of one owner looks live.  Base
patterns stay in the result either way; opaque tokens, which are too common to
be reported as such, are added where their value looks live.  Masking goes
further: it replaces every opaque token that does not count as copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

# The base patterns and least lengths, kinds in the order of the digest.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# Maximal runs that are long enough: the same matches as the open patterns with short ones dropped.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Longer than any word, with a digit, a capital and a small letter.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}"
KINDS = ["assign", "access", "hex", "opaque"]
# Owners, or repositories of however few owners, from which on a value counts as a copied example.
COPIED, WIDESPREAD = 3, 5


def copied(s: Column) -> Column:
    """Is a span's value a copied example?"""
    return (s["owners"] >= COPIED) | (s["repos"] >= WIDESPREAD)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """``array<struct<start, kind, end, value>>`` of the leftmost, non-overlapping matches, in code points.

    Texts between the matches and the matches themselves take turns, so their
    lengths give the places.  ``least``: shortest value that is kept.
    """
    p = F.lit(pattern)
    hits, values = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    kind_of = "array<struct<start:bigint,kind:int,end:bigint,value:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["value"]).alias("value"))
        kept = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(kept, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).cast(kind_of).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind_of).alias("out"))
    found = F.aggregate(zipped, start, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind_of))


def candidates(text: Column) -> Column:
    """All spans of a text by start, then kind."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(spans(t, ASSIGN, 0, 2, ASSIGN_LEAST), spans(t, ACCESS, 1), spans(t, HEX, 2), spans(t, OPAQUE, 3)))


def ownership(hits: DataFrame) -> DataFrame:
    """``value, owners, repos`` from ``hits (value, owner, repo)``, combined before each shuffle.

    A null owner or repository counts as one of its own.
    """
    named = hits.select("value", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))
    per_owner = named.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.count("one").alias("repos"))
    return per_owner.groupBy("value").agg(F.count("owner").alias("owners"), F.sum("repos").alias("repos"))


def standing(seen: DataFrame, opaque: int) -> DataFrame:
    """``row, kept`` of the stored table ``seen (row, owner, repo, found)``: the spans that stand, each with its owners and repositories.

    Base spans always stand; opaque tokens where at most ``opaque`` owners
    carry the value and it is no copied example.
    """
    hits = seen.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    stands = (F.col("kind") < 3) | ((F.col("owners") <= opaque) & (F.col("repos") < WIDESPREAD))
    return (hits.join(ownership(hits), "value").filter(stands)
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repos"))).alias("kept")))


def judged(docs: DataFrame, owner: Column, repo: Column, opaque: int = 1) -> DataFrame:
    """One row per document: ``row, doc_id, found`` and ``kept``, see ``standing``.  ``row`` numbers the rows, so repeated documents keep theirs."""
    seen = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", owner.cast("string").alias("owner"),
                              repo.cast("string").alias("repo"), candidates(F.col("text")).alias("found")))
    return seen.join(standing(seen, opaque), "row", "left").select("row", "doc_id", "found", "kept")


def digest(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def scanned(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """Counts and digests of the base spans, all spans, and how many look live or copied.

    A null text is empty and has no spans; a null id stays null; a null owner
    or repository counts as one of its own.  Repeated rows each keep a row.
    """
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    kept = F.coalesce("kept", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:bigint,owners:bigint,repos:bigint>>"))
    return judged(docs, owner, repo).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(base), 256).alias("base_sha256"),
        digest(kept).alias("spans"), F.size(F.filter(kept, lambda s: (s["owners"] == 1) & ~copied(s))).cast("bigint").alias("n_live"),
        F.size(F.filter(kept, copied)).cast("bigint").alias("n_copied"))


def masked(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """The documents with standing spans replaced: ``[EXAMPLE]`` for copied examples, ``[SECRET]`` for all others.

    An opaque token is left only where it counts as a copied example.
    Overlapping spans are replaced as one.  Columns stay as they are, whatever
    their names; ``n_chars`` follows the text.  Null texts stay null.  The
    patterns run once; only documents with a candidate are shuffled.
    """
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    seen = stored(docs.select(row.alias("doc"), F.monotonically_increasing_id().alias("row"), owner.cast("string").alias("owner"),
                              repo.cast("string").alias("repo"), candidates(F.col("text")).alias("found")))
    hit = F.size("found") > 0
    kept = standing(seen.filter(hit).select("row", "owner", "repo", "found"), COPIED - 1)
    some = seen.filter(hit).select("row", "doc", F.col("doc.text").alias("text")).join(kept, "row", "left")
    some = some.withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:bigint,owners:bigint,repos:bigint>>")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(copied(s), F.lit("[EXAMPLE]")).otherwise(F.lit("[SECRET]"))
        grown = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int")),
                         F.when(s["start"] >= acc["at"], mark).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown.alias("out"))

    text = F.aggregate("kept", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    changed = some.select("doc", text.alias("text"))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    changed = changed.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in cols])
    return seen.filter(~hit).select(*[F.col("doc")[c].alias(c) for c in cols]).unionByName(changed)
