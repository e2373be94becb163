"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Candidates are found by pattern in every whole text. Only hashes of their values leave the scan. A value that
occurs with many distinct owners and repositories is a widely copied example; one that few owners have, and
that looks like a real credential, is live. Both verdicts become spans of their own beside the base spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authscope.llm.common import ROW_ID, by_row, materialize, numbered, picked, position, with_row_id

#: kind: (pattern, group of the value, least characters of the value). The value always ends the match.
PATTERNS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Kinds in the order that breaks ties of start: the base kinds, then the method's verdicts.
KINDS = (*PATTERNS, "live", "example")
#: Words of a placeholder, wherever they stand, and runs that random values may hold by chance.
WORDS, RUNS = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]", r"(?i)x{4,}|0{4,}|1234567|abcdef"


@dataclass(frozen=True)
class Ownership:
    """A value is an example with more than this many owners or repositories, or if it doesn't look live: fewer distinct
    characters, no digit although it isn't the value of an assignment, a placeholder's words, or runs such as xxxx that
    make up at least half of it."""

    max_owners: int = 3
    max_repositories: int = 6
    min_distinct_characters: int = 8


def _value(assigned: bool, p: Ownership):
    """Value -> its length, hash and whether it looks live."""

    def made(v: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(v, ""))) >= p.min_distinct_characters
        plain = v.rlike(WORDS) | (2 * F.length(F.regexp_replace(v, RUNS, "")) <= F.length(v))
        return F.struct(F.length(v).alias("chars"), F.sha2(v, 256).alias("hash"), (varied & (F.lit(assigned) | v.rlike("[0-9]")) & ~plain).alias("looks_live"))

    return made


def _hits(text: Column, p: Ownership) -> Column:
    """Array of (kind, gaps, hits): lengths of what stands between matches, and the matches in order."""
    found = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        found.append(
            F.when(
                text.rlike(pattern),
                F.struct(
                    F.lit(k).alias("kind"),
                    F.lit(least).alias("least"),
                    F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
                    F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("matches"),
                    F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), _value(group == 2, p)).alias("values"),
                ),
            )
        )
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def located(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate that is long enough: keys, kind, start, end, value_start, hash, looks_live, owner, repository."""
    flat = found.select(*keys, "owner", "repository", F.explode("hits").alias("h")).select(
        *keys, "owner", "repository", F.col("h.kind").alias("kind"), F.col("h.least").alias("least"),
        F.posexplode(F.arrays_zip(F.slice("h.gaps", F.lit(1), F.size("h.matches")).alias("gap"), F.col("h.matches").alias("chars"), F.col("h.values").alias("value"))).alias("at", "m"),
    )
    so_far = Window.partitionBy(*keys, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.chars")).over(so_far)
    placed = flat.select(*keys, "owner", "repository", "kind", "least", "m", end.alias("end"))
    return placed.filter(F.col("m.value.chars") >= F.col("least")).select(
        *keys, "owner", "repository", "kind", (F.col("end") - F.col("m.chars")).alias("start"), "end",
        (F.col("end") - F.col("m.value.chars")).alias("value_start"), F.col("m.value.hash").alias("hash"), F.col("m.value.looks_live").alias("looks_live"),
    )


def ownership(spans: DataFrame, p: Ownership = Ownership()) -> DataFrame:
    """(hash, owners, repositories): distinct ones over the whole corpus; null counts as one owner or repository."""
    seen = spans.select("hash", F.struct("owner").alias("owner"), F.struct("owner", "repository").alias("repository")).distinct()
    return seen.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories"))


def judged(spans: DataFrame, p: Ownership = Ownership()) -> DataFrame:
    """located() with `verdict`: live or example."""
    counts = ownership(spans, p)
    live = F.col("looks_live") & (F.col("owners") <= p.max_owners) & (F.col("repositories") <= p.max_repositories)
    return spans.join(counts, "hash").withColumn("verdict", F.when(live, F.lit("live")).otherwise(F.lit("example")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", owner: str | Column = "source", repository: str | Column = "lang", text: str = "text", p: Ownership = Ownership()) -> DataFrame:
    """Per row of docs: key, found (sorted array of kind, start, end) with base and method spans.

    Offsets are code points, ends exclusive. Null and empty texts have no span. Null or repeated keys: rows of their
    own. owner and repository are columns, by name or as an expression; by default a document's source owns it and its
    language there is the repository. Empty table: empty result. Other columns are ignored, whatever they are called.
    """
    rows = picked(docs, _key=key, owner=owner, repository=repository, body=text).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows.select("_row", "_key", "owner", "repository", _hits(F.coalesce(F.col("body"), F.lit("")), p).alias("hits")), "secrets")
    keys = ["_row", "_key"]
    spans = judged(located(rows, keys), p)
    base = F.struct("start", "kind", "end")
    verdict = F.struct(F.col("value_start").alias("start"), F.when(F.col("verdict") == "live", 3).otherwise(4).alias("kind"), "end")
    by_row = spans.select(*keys, F.explode(F.array(base, verdict)).alias("span")).groupBy(*keys).agg(F.sort_array(F.array_distinct(F.collect_list("span"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    quiet = rows.filter(F.size("hits") == 0).select("_key", none.alias("found"))
    loud = rows.filter(F.size("hits") > 0).select(*keys).join(by_row.withColumnRenamed("_key", "_k"), "_row", "left")
    return quiet.unionByName(loud.select("_key", F.coalesce("found", none).alias("found"))).toDF(key, "found")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, base digest and span text of scan()'s rows."""
    base = F.filter("found", lambda s: s["kind"] < len(PATTERNS))
    of_kind = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(PATTERNS)]
    return scanned.select(key, *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, owner: str | Column = "source", repository: str | Column = "lang", text: str = "text", mark: str = "[SECRET]", p: Ownership = Ownership()) -> DataFrame:
    """docs with live values replaced by `mark`; widely copied examples stay. Columns and rows stay as they are.

    Every text is scanned once; what was found meets its rows by row identity. Null texts stay null; the other cases as
    for scan().
    """
    who = {"owner": owner, "repository": repository}
    made = {n: c for n, c in who.items() if isinstance(c, Column)}
    rows = with_row_id(docs.select("*", *made.values()).toDF(*numbered(docs).columns, *made), "redact")
    rows = rows.toDF(*numbered(docs).columns, *made, *ROW_ID).withColumns({n: F.col(f"c{position(docs, c)}") for n, c in who.items() if n not in made})
    text, keys = f"c{position(docs, text)}", list(ROW_ID)
    hits = rows.select(*keys, "owner", "repository", _hits(F.coalesce(F.col(text), F.lit("")), p).alias("hits"))
    found = materialize(hits.filter(F.size("hits") > 0), "secrets")
    live = judged(located(found, keys), p).filter("verdict = 'live'")
    cuts = live.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.col("value_start").alias("start"), "end"))).alias("cuts"))
    cuts = materialize(cuts, "cuts", found)
    body = F.col(text)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
        F.struct(
            x["end"].alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.substring(body, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).alias("out"),
        )
    )
    clean = F.aggregate("cuts", state, step, lambda s: F.concat(s["out"], F.substring(body, (s["at"] + 1).cast("int"), F.length(body))))
    marked = by_row(rows, cuts, "left").withColumn(text, F.when(F.col("cuts").isNull(), body).otherwise(clean))
    return marked.select(*numbered(docs).columns).toDF(*docs.columns)
