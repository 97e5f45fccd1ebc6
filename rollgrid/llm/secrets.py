"""Secrets in texts, and how the values they show are spread over repositories and owners.

``find`` locates the base spans (assignments, access keys, hexadecimal runs) and further candidates: long runs that mix
letters and digits. ``spread`` counts, for the hash of every value in the whole corpus, its different texts, repositories
and owners. A value that many owners, repositories or texts carry is a copied example; so is one that does not look like a
credential, wherever it stands. What is left is live; further candidates become spans if they are live and of one owner
only. ``scan`` joins both, gives the counts with every span, and ``redact`` masks what was found.

Everything is a column function or a join. A value that many documents carry is counted with partial sums, first per
repository and owner, then per value, and only rows with candidates take part in the join on values, which Spark splits
where one value is frequent.

Defined cases: a null text is empty; a null repository or owner counts as one unnamed repository or owner; rows equal in
id, text, repository and owner get equal results; an empty table gives no rows; result columns replace columns of the
same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.llm import rows

# The base patterns. Letters of the names in either case are spelled out, ASCII only.
NAMES = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: A run below the least length fails whole, so asking for that length finds the same spans.
ACCESS_LONG, HEX_LONG = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_VALUE = 12
#: Further candidates: runs of this length at least, with a letter and this many digits.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
LEAST_DIGITS, LEAST_DIFFERENT = 4, 10
#: From so many owners, repositories or different texts on, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS, EXAMPLE_TEXTS = 3, 6, 25

KINDS = ("assign", "access", "hex", "owned")


def spans(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """Spans of all matches whose value has ``least`` characters: array of (start, kind, end, value), in code points.

    The positions come from the pieces between the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(found.alias("hit"), values.alias("value"), gaps.alias("gap"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))
        more = F.when(F.length(part["value"]) >= least, F.array(span)).otherwise(none)
        return F.struct(end.alias("at"), F.concat(state["spans"], more).alias("spans"))

    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _credential_like(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]+", ""))
    different = F.size(F.array_distinct(F.split(value, "")))
    return (digits >= LEAST_DIGITS) & value.rlike("[A-Za-z]") & (different >= LEAST_DIFFERENT)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (spans by start and kind) and ``extra`` (candidates that overlap no base span)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(
        spans(text, ASSIGN, 0, 2, LEAST_VALUE), spans(text, ACCESS_LONG, 1, 0, 0), spans(text, HEX_LONG, 2, 0, 0)))
    clear = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = docs.withColumn("base", base)
    extra = F.filter(spans(text, CANDIDATE, 3, 0, 0), lambda s: _credential_like(s["value"]) & clear(s))
    return found.withColumn("extra", extra)


def values(found: DataFrame, repo: list[str], owner: list[str]) -> DataFrame:
    """Each row's different value hashes, with its repository, owner and text."""
    return found.where((F.size("base") > 0) | (F.size("extra") > 0)).select(
        "row_hash", F.xxhash64(*repo).alias("repo"), F.xxhash64(*owner).alias("owner"), F.xxhash64("text").alias("text_hash"),
        F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: F.xxhash64(s["value"])))).alias("value_hash"))


def spread(shown: DataFrame) -> DataFrame:
    """Different texts, repositories and owners of every value hash, each counted from partial sums."""
    texts = shown.select("value_hash", "owner", "repo", "text_hash").distinct()
    count = lambda of: texts.select("value_hash", of).distinct().groupBy("value_hash").agg(F.count("*").alias(f"{of}s"))
    return count("text_hash").withColumnRenamed("text_hashs", "texts").join(count("repo"), "value_hash").join(count("owner"), "value_hash")


def _joined(of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repo: list[str] = ["source", "lang"], owner: list[str] = ["source"],
         example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, example_texts: int = EXAMPLE_TEXTS) -> DataFrame:
    """``docs`` with ``base`` and ``found``: all spans, each with the owners, repositories and texts of its value and a verdict.

    A base span stays whatever its verdict, ``live`` or ``example``; a further candidate is a span only if live and of one owner.
    """
    docs = docs.drop("base", "extra", "found", "row_hash", "counts")
    identity = F.xxhash64(F.col("doc_id"), F.col("text"), *[F.col(c) for c in dict.fromkeys(repo + owner)])
    found = find(docs).withColumn("row_hash", identity)
    shown = rows.written(values(found, repo, owner), "secret-values")
    entry = F.struct("value_hash", F.struct("owners", "repos", "texts").alias("counts"))
    of_row = shown.select("row_hash", "value_hash").distinct().join(rows.written(spread(shown), "secret-spread"), "value_hash")
    of_row = of_row.groupBy("row_hash").agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))  # the values of one text
    out = found.join(rows.written(of_row, "secret-counts"), "row_hash", "left").drop("row_hash")

    def judged(s: Column) -> Column:
        n = F.element_at("counts", F.xxhash64(s["value"]))
        copied = (n["owners"] >= example_owners) | (n["repos"] >= example_repos) | (n["texts"] >= example_texts)
        return F.struct(
            *[s[c].alias(c) for c in ("start", "kind", "end", "value")], *[n[c].alias(c) for c in ("owners", "repos", "texts")],
            F.when(copied | ~_credential_like(s["value"]), "example").otherwise("live").alias("verdict"))

    spans_ = F.transform(F.array_sort(F.concat("base", "extra")), judged)
    stays = lambda s: (s["kind"] < len(KINDS) - 1) | ((s["verdict"] == "live") & (s["owners"] == 1))
    return out.withColumn("found", F.filter(spans_, stays)).drop("extra", "counts")


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their hash, all spans, and the verdicts."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    verdict = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        verdict("live").alias("n_live"), verdict("example").alias("n_example"))


def redact(scanned: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The scanned rows with every span of ``text`` masked; overlapping spans become one mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = lambda frm, to: F.substring(text, frm + 1, to - frm)

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        piece = F.when(fresh, F.concat(cut(state["at"], span["start"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    masked = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda s: F.concat(s["out"], cut(s["at"], F.length(text))))
    return scanned.withColumn("text", F.when(F.size("found") > 0, masked).otherwise(F.col("text")))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, all secrets masked and ``n_chars`` (if there) of masked texts counted anew."""
    out = redact(scan(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
