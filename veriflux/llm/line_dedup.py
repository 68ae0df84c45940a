"""Line dedup by deletion neighbourhoods, in DataFrame functions alone.

A line (trimmed) that isn't blank goes when an earlier line, by (doc_id, line number),
anywhere in the table equals it or, both being of at least ``min_chars`` characters, is
within one edit (insert, delete or substitute a character) of it; the earliest stays.

1. Distinct lines, by 128 bits of hash, with the position of the first.
2. Pruning, without loss: with one edit, the first or the second half of the shorter
   line is whole in the longer. Each distinct line gives the hashes of its halves, as the
   shorter and as the longer of two; only lines that share a half go on. The same holds
   for what is left of them, so the rest is halved ``LEVELS`` times more, and each time
   those go on that share the half as well.
3. Deletion neighbourhood of the rest: all variants with one character deleted,
   as hashed keys beside what is shared. Lines of one length that become equal without
   the same position are one substitution apart, whichever two of a key's group they are,
   so each is held against the earliest alone. A line and one that is a character longer
   meet where the longer's variant is the shorter itself, of which there is one.
4. The edit distance of each line and the earlier one it met is verified on their texts.

Lines that share a key are combined by partial aggregates, and a key may be shared by any
number of them; the joins with these aggregates are of the kind whose skewed partitions
Spark splits. A line emits as many variants as it has characters, twice, at the very most;
no pairs within a group are made.

Defined cases: null texts stay null; an empty text and blank lines stay; a text all of
whose lines go becomes empty; rows with a null ``doc_id`` come first; rows that share an
id are told apart by a hash of their texts, and if their texts are equal as well they
count as one, so neither's lines are copies of the other's; an empty table gives no rows;
all columns are handed on, and names may clash, but for that of ``count``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MIN_CHARS = 20
#: How often the rest of a line is halved after the first time, and how long a rest is not halved any more.
LEVELS, SHORT = 4, 4
#: Bits of the filter that is broadcast (4 MB), and of one of Spark's bitmaps.
FILTER_BITS, MAP_BITS = 1 << 25, 1 << 15


def _split(base: Column, side: str, body: Column) -> tuple[Column, Column]:
    """What a line shares with another if the edit is in its other half, and what is left: of the shorter line's ``base`` characters the first half (P) or the second (S) is shared."""
    a = F.floor(base / 2).cast("int")
    if side == "P":
        return F.substring(body, F.lit(1), a), F.substring(body, a + 1, F.length(body))
    return F.substring(body, F.length(body) - (base - a) + 1, base - a), F.substring(body, F.lit(1), F.length(body) - (base - a))


def _lines(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    rows = rows.select("doc", "copy", "line", F.expr(r"trim(BOTH ' \t\r' FROM raw)").alias("body")).filter(F.length("body") > 0)
    return rows.withColumns({"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit("second"), "body")})


def _distinct(lines: DataFrame, min_chars: int) -> DataFrame:
    n = F.length("body")
    keys = []
    for kind in range(4):
        base, side = n - (kind // 2), "PS"[kind % 2]
        keys.append(F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(side), base, _split(base, side, F.col("body"))[0]).alias("key")))
    rows = lines.select("h1", "h2", "doc", "copy", "line", n.alias("n"), F.when(n >= min_chars, F.array(*keys)).alias("keys"))
    return rows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "copy", "line")).alias("first"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``h1`` may be among those of ``wanted``: a filter of ``FILTER_BITS`` bits at most, broadcast whatever its fill, thins out what is shuffled next."""
    place = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    bucket, bit = (place(F.col("h1")) / MAP_BITS).cast("int"), place(F.col("h1")) % MAP_BITS
    maps = wanted.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.expr(f"substring(_map, cast(pmod(h1, {MAP_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(h1, 8) as int))")) != 0
    return rows.withColumn("_bucket", bucket).join(F.broadcast(maps), "_bucket").filter(hit).drop("_bucket", "_map")


def _sharing(rows: DataFrame) -> DataFrame:
    """``rows`` (key, longer, ...) whose key a line of its length or of the other kind has too, with the numbers of both kinds."""
    groups = rows.groupBy("key").agg(F.count_if(~F.col("longer")).alias("shorts"), F.count_if("longer").alias("longs"))
    groups = groups.filter("shorts > 1 or (shorts > 0 and longs > 0)")
    return checkpointed(rows.join(groups, "key").filter("not longer or shorts > 0"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (h1, h2, first, longer, key, rest) twice, with half of the rest made part of the key."""
    base = F.length("rest") - F.col("longer").cast("int")
    parts = [F.struct(F.xxhash64("key", F.lit(side), base, shared).alias("key"), left.alias("rest")) for side in "PS" for shared, left in [_split(base, side, F.col("rest"))]]
    parts = F.when(base > SHORT, F.array(*parts)).otherwise(F.array(F.struct("key", "rest")))
    return rows.select("h1", "h2", "first", "longer", F.explode(parts).alias("part")).select("h1", "h2", "first", "longer", "part.key", "part.rest")


def _variants(rows: DataFrame) -> DataFrame:
    """me, longer, k, cut: the hashed variants of each row's rest."""
    shorter = lambda p: F.concat(F.substring(F.col("rest"), F.lit(1), p - 1), F.substring(F.col("rest"), p + 1, F.length("rest")))
    places = F.when(F.length("rest") > 0, F.sequence(F.lit(1), F.length("rest")))
    same = F.when(~F.col("longer") & (F.col("shorts") > 1), F.transform(places, lambda p: F.xxhash64(F.col("key"), F.lit("same"), p, shorter(p))))
    cut = F.when(F.col("longer"), F.transform(places, lambda p: F.xxhash64(F.col("key"), F.lit("cut"), shorter(p)))).when(F.col("longs") > 0, F.array(F.xxhash64(F.col("key"), F.lit("cut"), F.col("rest"))))
    none = F.array().cast("array<bigint>")
    keyed = F.concat(F.transform(F.coalesce(same, none), lambda k: F.struct(k.alias("k"), F.lit(False).alias("cut"))), F.transform(F.array_distinct(F.coalesce(cut, none)), lambda k: F.struct(k.alias("k"), F.lit(True).alias("cut"))))
    out = rows.select(F.struct("first", "h1", "h2").alias("me"), "longer", F.explode(keyed).alias("v"))
    return checkpointed(out.select("me", "longer", F.col("v.k").alias("k"), F.col("v.cut").alias("cut")))


def _near(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier one within one edit."""
    halves = distinct.select("h1", "h2", "first", "n", F.explode("keys").alias("k"))
    met = _sharing(halves.select("h1", "h2", "first", "n", (F.col("k.kind") >= 2).alias("longer"), (F.col("k.kind") % 2 == 0).alias("ahead"), "k.key"))
    wanted = met.select("h1", "h2", "first").distinct()
    texts = among(lines, wanted).select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), "doc", "copy", "line", "body")
    at = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("copy") == F.col("first.copy")) & (F.col("line") == F.col("first.line"))
    texts = texts.join(wanted, (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & at)
    texts = checkpointed(texts.groupBy(F.col("t1").alias("h1"), F.col("t2").alias("h2")).agg(F.first("body").alias("body")))

    base = F.col("n") - F.col("longer").cast("int")
    rest = F.when(F.col("ahead"), _split(base, "P", F.col("body"))[1]).otherwise(_split(base, "S", F.col("body"))[1])
    rows = met.join(texts, ["h1", "h2"]).select("h1", "h2", "first", "longer", "key", rest.alias("rest"))
    for _ in range(LEVELS):
        rows = _sharing(_halved(rows))
    variants = _variants(rows)
    least = variants.groupBy("k").agg(F.min(F.when(~F.col("longer"), F.col("me"))).alias("short"), F.min(F.when(F.col("longer"), F.col("me"))).alias("long"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    other = F.when(F.col("cut") & ~F.col("longer"), F.col("long")).otherwise(F.col("short"))
    pairs = variants.join(least, "k").select("me", other.alias("other")).filter("other < me").distinct()
    pairs = pairs.select("me.h1", "me.h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    pairs = pairs.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("body").alias("earlier")), ["o1", "o2"])
    return pairs.filter(F.levenshtein("body", "earlier", 1).between(0, 1)).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The lines that go: doc, copy (a hash of the text), line (their numbers from 0), kind ('copy' of an earlier line, or 'near')."""
    lines = _lines(docs)
    distinct = checkpointed(_distinct(lines, min_chars))
    near = checkpointed(_near(lines, distinct)).withColumn("near", F.lit(True))
    marked = distinct.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").filter("times > 1 or near")
    marked = checkpointed(marked)  # read anew, it is dealt out for the join, and Spark can split a line's many copies
    at = lines.select("doc", "copy", "line", "h1", "h2").join(marked, ["h1", "h2"])
    later = F.struct("doc", "copy", "line") > F.col("first")
    return at.filter(F.col("near") | later).select("doc", "copy", "line", F.when(F.col("near"), "near").otherwise("copy").alias("kind"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1, count: str | None = "_lines_dropped") -> DataFrame:
    """``docs`` without the dropped lines, all columns kept; ``n_chars``, if there, follows the text. Adds ``count``, if asked for."""
    if max_edits != 1:
        raise ValueError("the half-line pruning holds for one edit")
    names = [c for c in docs.columns if c != count]
    own = {c: f"c{i}" for i, c in enumerate(names)}  # names that can't clash
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*own.values())
    doc, text = F.col(own["doc_id"]).cast("long"), F.col(own["text"])
    gone = dropped_lines(docs, min_chars).groupBy(F.col("doc").alias("gone_doc"), F.col("copy").alias("gone_copy")).agg(F.collect_set("line").alias("gone"))
    out = rows.join(gone, doc.eqNullSafe(F.col("gone_doc")) & (F.xxhash64(text.cast("string")) == F.col("gone_copy")), "left")
    left = F.concat_ws("\n", F.filter(F.split(text.cast("string"), "\n"), lambda x, i: ~F.array_contains("gone", i)))
    changed = F.col("gone").isNotNull()
    values = {own["text"]: F.when(changed, left).otherwise(text)}
    if "n_chars" in own:
        values[own["n_chars"]] = F.when(changed, F.length(left).cast("long")).otherwise(F.col(own["n_chars"]).cast("long"))
    dropped = F.when(changed, F.size("gone")).otherwise(0).cast("int")
    return out.select(*[values.get(c, F.col(c)).alias(name) for name, c in own.items()], *([dropped.alias(count)] if count else []))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, trim(unnest(ls), chr(32) || chr(9) || chr(13)) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), b AS (
  SELECT doc_id, line, body FROM l WHERE length(body) > 0
), f AS (
  SELECT body, min((doc_id, line)) AS pos, length(body) AS n FROM b GROUP BY body
), k AS (
  SELECT body, pos, n, base, 'P' || left(body, base // 2) AS half FROM f, (VALUES (0), (1)) v(d), LATERAL (SELECT n - d AS base) WHERE n >= 20
  UNION ALL
  SELECT body, pos, n, base, 'S' || right(body, base - base // 2) AS half FROM f, (VALUES (0), (1)) v(d), LATERAL (SELECT n - d AS base) WHERE n >= 20
), near AS (
  SELECT DISTINCT x.body FROM k x JOIN k y ON x.base = y.base AND x.half = y.half AND y.pos < x.pos
  WHERE levenshtein(x.body, y.body) <= 1
), gone AS (
  SELECT b.doc_id, b.line FROM b JOIN f USING (body) LEFT JOIN near ON near.body = b.body
  WHERE near.body IS NOT NULL OR (b.doc_id, b.line) > f.pos
), g AS (
  SELECT doc_id, list(line) AS lines FROM gone GROUP BY 1
)
SELECT d.doc_id,
  CASE WHEN g.lines IS NULL THEN d.text
    ELSE array_to_string([x FOR x, i IN string_split(d.text, chr(10)) IF NOT list_contains(g.lines, i - 1)], chr(10)) END AS text,
  coalesce(len(g.lines), 0) AS lines_dropped
FROM documents d LEFT JOIN g USING (doc_id)
"""
