"""Secret scans: base patterns by position, and credential parts that count only together.

Every document is scanned in one pass of built-in expressions: a pattern's matches come from ``regexp_extract_all`` and
their places from the lengths of what ``split`` leaves between them. Weak parts (short assigned values, account names,
endpoints) go to a narrow table and are linked by an interval join: parts are bucketed by scope, each bucket is reduced
to its first and last place for each class, and a weak part meets at most three buckets of a class. A part that lacks its
complement within the scope is no finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_merge, stored, whole

# The base patterns and the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

#: Parts that alone prove nothing.
ACCOUNT = r"""((?i:client_?id|account|username|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"[a-z]{2,12}://[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?"
WEAK_VALUE = 6

#: Code points between the starts of parts that belong together.
SCOPE = 200

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "weak_account", "weak_secret", "endpoint")

#: Matches of a text whose places are summed at once.
BLOCK = 256

_SPAN = "array<struct<start:int,kind:int,end:int,value:int>>"


def _let(value: Column, body) -> Column:
    """body(value), which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hits(text: Column, pattern: str, kind: int, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end, length of the group), in code points.

    Lengths of what lies between and of the matches are summed in blocks, then blocks by their sums: an appended list is
    copied, and so no list grows beyond a block or the number of blocks.
    """
    p = F.lit(pattern)

    def measured(hits: Column) -> Column:
        pieces = F.slice(F.split(text, p, -1), F.lit(1), F.size(hits))
        value = lambda hit: F.length(F.regexp_extract(hit, pattern, group)) if group else F.length(hit)
        return F.zip_with(pieces, hits, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"), value(b).alias("value")))

    def blocks(all_: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.transform(at, lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))

    def placed(block: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["size"]
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(block, F.struct(first.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    def firsts(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        total = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        step = lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(parts, start, step, lambda acc: acc["out"])

    def listed(all_: Column) -> Column:
        several = _let(blocks(all_), lambda parts: F.flatten(F.zip_with(parts, firsts(parts), placed)))
        return F.when(F.size(all_) <= BLOCK, placed(all_, F.lit(0))).otherwise(several)

    hits = F.regexp_extract_all(text, p, F.lit(0))
    return _let(_let(hits, measured), listed)


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns ``keep`` with arrays base and weak, and key: the text's digest where there are weak parts."""
    text = F.col("__text")
    assigns = _when(text.rlike("[:=]") & text.rlike(ASSIGN), _hits(text, ASSIGN, 0, 2))
    found = docs.select(*[F.col(f"`{c}`") for c in keep], whole(F.col(f"`{text_col}`")).alias("__text")).select(
        *[F.col(f"`{c}`") for c in keep],
        text,
        assigns.alias("__assign"),
        _when(F.contains(text, F.lit("AKIA")), _hits(text, ACCESS, 1)).alias("__access"),
        _when(text.rlike(HEX), _hits(text, HEX, 2)).alias("__hex"),
        _when(text.rlike("[:=]") & text.rlike(ACCOUNT), _hits(text, ACCOUNT, 3)).alias("__account"),
        _when(F.contains(text, F.lit("://")), _hits(text, ENDPOINT, 5)).alias("__endpoint"),
    )
    strong = F.filter("__assign", lambda x: x["value"] >= ASSIGN_VALUE)
    short = F.filter("__assign", lambda x: (x["value"] >= WEAK_VALUE) & (x["value"] < ASSIGN_VALUE))
    short = F.transform(short, lambda x: x.withField("kind", F.lit(4)))
    weak = F.concat("__account", short, "__endpoint")
    return found.select(
        *[F.col(f"`{c}`") for c in keep],
        F.concat(strong, "__access", "__hex").alias("base"),
        weak.alias("weak"),
        F.when(F.size(weak) > 0, F.unhex(F.sha2(text, 256))).alias("key"),
    )


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts that have their complement within the scope: key, linked (array of spans).

    An account needs a secret, a short secret needs an identifier, an endpoint needs both. Distances are between starts.
    """
    own = found.where("key is not null").groupBy("key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    parts = own.select("key", F.explode(F.concat("base", "weak")).alias("part"))
    kind, start = F.col("part.kind"), F.col("part.start")
    role = F.when(kind.isin(1, 3), "id").when(kind.isin(0, 2, 4), "secret").otherwise("endpoint")
    parts = parts.select("key", "part", start.alias("start"), role.alias("role"), F.floor(start / scope).alias("bucket"))
    edges = (
        parts.where("role <> 'endpoint'")
        .groupBy("key", "bucket")
        .pivot("role", ["id", "secret"])
        .agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    )
    weak = parts.where(F.col("part.kind") >= 3)
    near = weak.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    met = near.join(edges, ["key", "bucket"])
    within = lambda c: F.max(
        F.coalesce((F.abs(F.col(f"{c}_lo") - F.col("start")) <= scope) | (F.abs(F.col(f"{c}_hi") - F.col("start")) <= scope), F.lit(False))
    )
    seen = met.groupBy("key", "part").agg(F.max("role").alias("role"), within("id").alias("id"), within("secret").alias("secret"))
    real = F.when(F.col("role") == "id", F.col("secret")).when(F.col("role") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return seen.where(real).groupBy("key").agg(F.collect_list("part").alias("linked"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    label = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), label), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, base, linked.

    base holds the base spans and linked the weak parts that were linked, as structs (start, kind, end, value). Null text
    counts as empty; an empty text has no spans and the digest of the empty text. Equal texts have equal spans.
    """
    found = stored(scan(docs.withColumnRenamed(id_col, "__id"), text_col, ("__id",)), "secrets")
    none = F.array().cast(_SPAN)
    linked = stored(link_parts(found, scope), "linked")
    met = found.where("key is not null").join(small_or_merge(linked), "key", "left").withColumn("linked", F.coalesce("linked", none))
    rows = met.unionByName(found.where("key is null").withColumn("linked", none))  # most rows: they need no join
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        F.col("__id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
        "base",
        "linked",
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every span replaced by ``mark``; spans that overlap or touch are masked once. Columns stay as they are.

    Findings are keyed by the text's digest. They are few against the documents: counted, then broadcast if small.
    A null text stays null. n_chars, if there, is set anew where a text changed.
    """
    columns = docs.columns
    found = scan(docs, text_col, (text_col,)).where("size(base) > 0 or size(weak) > 0")
    keyed = found.withColumn("key", F.unhex(F.sha2(F.col(f"`{text_col}`"), 256))).select("key", "base", "weak")
    found = stored(keyed.groupBy("key").agg(F.first("base").alias("base"), F.first("weak").alias("weak")), "secrets")
    spans = found.join(small_or_merge(stored(link_parts(found.where("size(weak) > 0"), scope), "linked")), "key", "left")
    spans = spans.select(F.col("key").alias("__key"), F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN)))).alias("__spans"))
    spans = stored(spans.where("size(__spans) > 0"), "masks")
    text = F.col(f"`{text_col}`")
    joined = docs.withColumn("__key", F.unhex(F.sha2(text, 256))).join(small_or_merge(spans), "__key", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.concat(text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        out = F.when((x["start"] <= acc["at"]) & (acc["at"] > 0), acc["out"]).otherwise(F.concat(acc["out"], gap))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    new = F.when(F.col("__spans").isNotNull(), masked).otherwise(text)
    out = joined.withColumn("__new", new)
    count = F.when(F.col("__spans").isNotNull(), F.length("__new").cast("long"))
    put = {text_col: F.col("__new")} | ({"n_chars": F.coalesce(count, F.col("n_chars"))} if "n_chars" in columns else {})
    return out.select(*[put[c].alias(c) if c in put else F.col(f"`{c}`") for c in columns])
