"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (assignments, access keys, long hex) stand on their own. Weak parts - account identifiers, random-looking
strings and endpoints - mean little alone; they are reported only where complementary parts co-occur in one scope:
an identifier or an endpoint near a secret, a random-looking string near an identifier or endpoint.
Positions come from splitting a text at the matches: a match starts after the lengths of all gaps and matches before it.
The interval join is a range frame of `scope` code points about each part within its document, so a part meets only what
can lie in its scope, and no pairs are made.

Null text counts as empty: no spans. Every row is scanned by itself, repeated rows and null ids too. Very long texts are
scanned whole; parts that start at one place are ordered by kind. Carried columns go through as one struct, so their names
clash with none. Distances in a scope are those of starts: a part right behind a longer one than the scope stays unlinked.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a shorter run can hold no longer one, so this equals matching all runs and dropping short ones
# Weak parts.
ACCOUNT = r"""(?i:access[_-]?key(?:[_-]?id)?|client[_-]?id|account[_-]?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
RANDOM = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/=_-]*[0-9])(?=[A-Za-z0-9+/=_-]*[A-Z])(?=[A-Za-z0-9+/=_-]*[a-z])[A-Za-z0-9+/=_-]{20,}"
ENDPOINT = r"""(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}"""
#: Kinds in the order used for ties; roles: i identifier, s secret, e endpoint.
KINDS = ("assign", "access", "hex", "account", "random", "endpoint")
ROLES = ("s", "i", "s", "i", "s", "e")
BASE = 3
SCOPE = 200


def _parts(kind: int, body: Column, pattern: str, group: Column | None = None) -> Column:
    """One struct for each match: kind, the gap before it, its length, and whether it counts."""
    hits = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    gaps = F.split(body, pattern, -1)
    ok = (lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= 6) if kind == 0 else (lambda m: F.length(m) >= 20) if kind == 1 else (lambda m: F.lit(True))
    one = lambda g, m: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("len"), ok(m).alias("ok"))
    found = F.filter(F.zip_with(gaps, hits, one), lambda x: x["len"].isNotNull())
    return F.when(body.rlike(pattern), F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok"))))


def scan(docs: DataFrame, carry: list[str], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """`row`, a struct of the columns `carry`, and `found`: an array of structs (start, kind, end) of all spans, in order; one row a document.

    The carried columns go with the first row of a document alone, so that a text crosses the one shuffle once.
    """
    none = "array<struct<kind:int,at:int,gap:int,len:int,ok:boolean>>"
    patterns = (ASSIGN, ACCESS, HEX, ACCOUNT, RANDOM, ENDPOINT)
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    keyed = body.select(F.monotonically_increasing_id().alias("uid"), "row", F.concat(*[F.coalesce(_parts(k, F.col("body"), p), F.array().cast(none)) for k, p in enumerate(patterns)]).alias("parts"))
    header = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok")).cast("struct<kind:int,at:int,gap:int,len:int,ok:boolean>"))
    rows = keyed.select("uid", "row", F.explode(F.concat(header, "parts")).alias("p")).select("uid", F.when(F.col("p.kind") == -1, F.col("row")).alias("row"), "p.*").repartition("uid")
    before = W.partitionBy("uid", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("len")).over(before).cast("long")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok")
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("kind") + 1)
    placed = placed.withColumn("role", F.when(F.col("kind") >= 0, role))
    near = W.partitionBy("uid").orderBy("start").rangeBetween(-scope, scope)
    has = lambda r: F.max(F.when(F.col("role") == r, True)).over(near)
    # a weak part inside a base span adds nothing
    held = F.max(F.when(F.col("kind").between(0, BASE - 1), F.col("end"))).over(W.partitionBy("uid").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1))
    linked = placed.select("uid", "row", "kind", "start", "end", "role", has("i").alias("i"), has("s").alias("s"), has("e").alias("e"), held.alias("held"))
    weak = ((F.col("role") == "i") & F.col("s").isNotNull()) | ((F.col("role") == "s") & (F.col("i").isNotNull() | F.col("e").isNotNull())) | ((F.col("role") == "e") & F.col("s").isNotNull())
    keep = F.col("kind").between(0, BASE - 1) | ((F.col("kind") >= BASE) & weak & (F.coalesce("held", F.lit(-1)) < F.col("end")))
    span = F.struct("start", "kind", "end")
    out = linked.groupBy("uid").agg(F.max_by("row", F.col("row").isNotNull()).alias("row"), F.sort_array(F.collect_list(F.when(keep, span))).alias("found"))
    return out.select("row", "found")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as text."""
    found = scan(docs.select("doc_id", "text"), ["doc_id"], scope=scope).select("row.doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < BASE)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every reported span of the text replaced by `mask`; overlapping spans become one."""
    found = scan(docs, docs.columns, scope=scope)
    names = [c for c in docs.columns]
    whole = found.select("row", F.col("found").alias("spans"))
    # runs of overlapping spans: a span opens one when it starts at or after the furthest end so far
    far = F.transform("spans", lambda x, i: F.coalesce(F.array_max(F.transform(F.slice("spans", F.lit(1), i), lambda y: y["end"])), F.lit(0).cast("long")))
    far = whole.withColumn("far", far)
    opens = F.filter(F.transform("spans", lambda x, i: F.when(x["start"] >= F.get("far", i), F.struct(x["start"].alias("start"), i.alias("i")))), lambda x: x.isNotNull())
    runs = far.withColumn("opens", opens)
    cut = runs.withColumn("cuts", F.transform("opens", lambda x, j: F.struct(x["start"].alias("start"), F.coalesce(F.get("far", F.get("opens", j + 1)["i"]), F.array_max(F.transform("spans", lambda y: y["end"]))).alias("end"))))
    body = F.col("row.text")
    piece = F.transform("cuts", lambda x, j: F.concat(body.substr((F.coalesce(F.get("cuts", j - 1)["end"], F.lit(0).cast("long")) + 1).cast("int"), (x["start"] - F.coalesce(F.get("cuts", j - 1)["end"], F.lit(0).cast("long"))).cast("int")), F.lit(mask)))
    tail = body.substr((F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length(body))
    text = F.when(F.size("cuts") > 0, F.concat(F.array_join(piece, ""), tail)).otherwise(body)
    return cut.withColumn("_text", text).select(*[F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
