"""Secrets by corpus-wide ownership frequency (operator 5), with DataFrame functions only.

Every credential-like match is a candidate. Its hash is counted over the whole
corpus: in how many repositories (by default documents) and by how many owners
(by default sources) it stands. A value that many owners hold, or that stands in
many repositories, be they one owner's, is a copied
example; another that one owner alone holds and that looks live (mixed
characters, no placeholder word) is that owner's credential. The three base
kinds are always reported; the wider kind adds a span only for a value judged live.

Counting takes distinct (hash, owner) pairs first, merged in the map tasks, so a
value copied into a third of all rows costs one row per task and owner; the
verdicts meet the candidates by an ordinary join on the hash.

Rows: null and empty text have no spans; a null source is one owner; a null
doc_id is one repository; repeated rows are reported each and count once as
repository and owner; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import common
from churnlens.llm.spans import Kind, add_spans, joined, labelled, masked

ASSIGN = Kind(
    "assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", 1,
    lambda m, g: F.length(g) >= 8)
# a run that is too short holds no other match, so the bound can stand in the pattern
ACCESS = Kind("access", r"AKIA[A-Z0-9]{12,}+")
HEX = Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+")
BASE = [ASSIGN, ACCESS, HEX]
# Token prefixes that services publish, and further names of credentials
WIDER = Kind(
    "live",
    r"(?<![A-Za-z0-9_])(?:gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}"
    r"|[rs]k_live_[A-Za-z0-9]{16,}+|glpat-[A-Za-z0-9_-]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"
    r"|[A-Za-z0-9_]*?(?i:pwd|passphrase|private_?key|access_?key|auth_?key|credentials?)[\"']?\x20*+[:=]\x20*+[\"']?"
    r"[A-Za-z0-9+/_.=-]{8,}+)")
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|your[_-]|xxxx|dummy|redacted|1234567|<|\*\*\*"
MARK = "[SECRET]"


def looks_live(value: Column) -> Column:
    """No placeholder word, at least 8 different characters, letters and digits both."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return ~value.rlike(PLACEHOLDER) & (different >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _value(s: Column, name: str) -> Column:
    """What is hashed: the credential without the name it is assigned to."""
    if name in ("assign", "live"):
        return F.regexp_replace(s, r"^[A-Za-z0-9_]+[\"']?\x20*+[:=]\x20*+[\"']?", "")
    return s


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", row: Column | None = None) -> DataFrame:
    """_row (new numbers unless given), doc_id, repository, owner and the span arrays of all kinds; no text."""
    row = F.monotonically_increasing_id() if row is None else row
    df = docs.select(row.alias("_row"), F.col("doc_id"), F.col("text"),
                     F.col(repository).cast("string").alias("_repository"), F.col(owner).cast("string").alias("_owner"))
    df = add_spans(df, "text", [*BASE, WIDER])
    return common.stored(df.drop("text"), "secret-spans")


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per match: _row, kind, start, end, hash, live, and its repository and owner."""
    def of(name: str) -> Column:
        return F.transform(F.col(f"_spans_{name}"), lambda s: F.struct(
            F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            _value(s["value"], name).alias("value")))
    every = F.concat(*[of(k.name) for k in [*BASE, WIDER]])
    each = scanned.select("_row", "_repository", "_owner", F.explode(every).alias("c"))
    return each.select("_row", "_repository", "_owner", "c.kind", "c.start", "c.end",
                       F.sha2("c.value", 256).alias("hash"), looks_live(F.col("c.value")).alias("live"))


def ownership(found: DataFrame, most_owners: int = 1, copied_from: int = 3, copied_in: int = 10) -> DataFrame:
    """hash, n_repositories, n_owners, verdict: live, copied, or unclear, from the whole corpus."""
    none = F.lit("\u0000")
    by_owner = found.groupBy("hash", F.coalesce("_owner", none).alias("o")).agg(F.max("live").alias("live"))
    owners = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.max("live").alias("live"))
    by_repo = found.groupBy("hash", F.coalesce("_repository", none).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    repos = by_repo.groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"))
    verdict = (F.when((F.col("n_owners") >= copied_from) | (F.col("n_repositories") >= copied_in), "copied")
               .when((F.col("n_owners") <= most_owners) & F.col("live"), "live").otherwise("unclear"))
    return owners.join(repos, "hash").select("hash", "n_repositories", "n_owners", verdict.alias("verdict"))


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source",
                 row: Column | None = None, **limits) -> DataFrame:
    """One row per document: span arrays, n_live, n_copied, and ``added``: wider spans judged live."""
    scanned = scan(docs, repository, owner, row)
    found = candidates(scanned)
    judged = found.join(ownership(found, **limits), "hash")
    wider = F.when((F.col("kind") == WIDER.name) & (F.col("verdict") == "live"),
                   F.struct("start", F.lit(len(BASE)).alias("no"), "end", "kind"))
    per_row = judged.groupBy("_row").agg(
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"),
        F.count(F.when(F.col("verdict") == "copied", 1)).alias("n_copied"), F.collect_list(wider).alias("added"))
    return scanned.join(per_row, "_row", "left")


def _masked_at(text: Column, spans: Column) -> Column:
    """The text with the spans (sorted, start and end) replaced by MARK; spans that overlap share one."""
    def step(a: Column, s: Column) -> Column:
        apart = F.size(a["out"]).eqNullSafe(0) | (s["start"] >= a["at"])
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(MARK))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(apart, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text) - a["at"])))


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with base secrets and live wider ones replaced by MARK; columns as given.

    Wider ones are masked where they stand, so copied ones in the same document stay; a base secret
    that overlaps one goes with it.
    """
    rows = common.nested(docs, "secret-rows")
    both = F.concat(labelled([k.name for k in BASE]), "added")
    places = F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    name = common.free_name(docs, "key")
    judged = find_secrets(rows.select("doc.*", F.col("key").alias(name)), row=F.col(name), **options).where(F.size("added") > 0).select(
        F.col("_row").alias("key"), F.sort_array(places).alias("places"))
    df = rows.join(common.stored(judged, "secret-places"), "key", "left")
    df = df.withColumn("new", F.when(F.col("places").isNotNull(), _masked_at(F.col("doc.text"), F.col("places")))
                       .otherwise(F.col("doc.text")))
    for kind in BASE:
        df = df.withColumn("new", F.when(F.col("new").rlike(kind.pattern), masked(F.col("new"), kind, MARK))
                           .otherwise(F.col("new")))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        same = F.col("new").eqNullSafe(F.col("doc.text"))
        changed["n_chars"] = F.when(same, F.col("doc.n_chars")).otherwise(
            F.length("new").cast(dict(docs.dtypes)["n_chars"]))
    return common.unnested(df, docs, **changed)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    base = labelled([k.name for k in BASE])
    added = F.coalesce("added", F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>"))
    counts = [F.size(f"_spans_{k.name}").cast("bigint").alias(f"n_{k.name}") for k in BASE]
    return found.withColumns({"_base": base, "_all": F.sort_array(F.concat(base, added))}).select(
        "doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"))
