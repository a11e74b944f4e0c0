"""Secret scans by corpus-wide ownership frequency.

Candidates are strings that look like credentials. Their hashes are counted over distinct owners and repositories of the
whole corpus: one that many owners or many repositories hold is an example that was copied, one that a single owner
holds in few repositories and that looks random is probably live. Such values become spans of kind `live` beside the base spans. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.functions.barrier import once
from seekwell.llm.matches import NO_PLACES, places
from seekwell.session import materialize

#: The base kinds in order, with their patterns, the group that holds the value and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED_CHARACTERS = 12
KINDS = ("assign", "access", "hex", "live")
#: Strings outside the base kinds that may be credentials: long runs of letters and digits.
GENERIC = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
#: A value held by more owners or by more repositories than this is a copied example; a few copies of a document aren't.
MOST_OWNERS, MOST_REPOSITORIES = 1, 16
#: A value that holds more than this fraction's share of all candidates is joined by broadcast.
HOT = 1024
_COUNTS = ("n_owners", "n_repositories")
#: Live-looking: letters and digits both, this many different characters, and none of the usual stand-ins.
LEAST_CHARACTERS = 8
STAND_IN = r"(?i)example|sample|dummy|change|placeholder|your|xxxx|1234567|0000000"


def live_looking(value: Column) -> Column:
    return (
        value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS)
        & ~value.rlike(STAND_IN)
    )


def _candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """uid, id, owner and an array of spans (kind, start, end, value's start, value's hash or null)."""
    owner = F.col(owner_col) if owner_col in docs.columns else F.lit(None)
    df = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    none = F.array().cast(NO_PLACES)
    text = F.col("text")
    df = once(df, "assign", places(text, ASSIGN, 2))
    df = once(df, "access", F.when(F.contains(text, F.lit("AKIA")), places(text, ACCESS)).otherwise(none))
    df = once(df, "hex", places(text, HEX))
    df = once(df, "live", places(text, GENERIC))

    def spans(kind: str, found: Column) -> Column:
        def span(x: Column) -> Column:
            # The value is the tail of an assignment and the whole of any other match.
            value = x["value"]
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                x["start"].alias("start"),
                x["end"].alias("end"),
                (x["end"] - F.length(value)).alias("from"),
                F.when(live_looking(value), F.sha2(F.encode(value, "UTF-8"), 256)).alias("hash"),
            )

        return F.transform(found, span)

    long_enough = F.filter("assign", lambda x: F.length(x["value"]) >= ASSIGNED_CHARACTERS)
    every = F.concat(
        spans("assign", long_enough),
        spans("access", F.col("access")),
        spans("hex", F.col("hex")),
        F.filter(spans("live", F.col("live")), lambda s: s["hash"].isNotNull()),
    )
    return df.select("uid", "id", "owner", every.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_rows) from rows of (hash, owner, repository), in steps that combine before each
    shuffle, so a value copied everywhere arrives as a row per owner."""
    single = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("rows"))
    per_owner = single.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.sum("rows").alias("n_rows"))


def _with_counts(valued: DataFrame, counts: DataFrame) -> DataFrame:
    """`valued` with the counts of each row's hash. A hash that holds more than one row in HOT is one of at most HOT
    such, so these counts are broadcast and no task gets all rows of a copied example; the others meet by shuffling."""
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    frequent = F.col("n_rows") * HOT > total
    hot = F.broadcast(counts.where(frequent).select("hash", *_COUNTS))
    rest = valued.join(hot, "hash", "left_anti").join(counts.where(~frequent).select("hash", *_COUNTS), "hash")
    return valued.join(hot, "hash").unionByName(rest)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples.

    `spans` joins kind:start:end by start, then kind in the order of KINDS; `base_sha256` hashes those of the base
    kinds. n_examples counts places of live-looking values that more than
    MOST_OWNERS owners or MOST_REPOSITORIES repositories hold. A document is a repository
    unless a column names it; a missing or null owner counts as one owner. A null or empty text has no spans. Repeated
    rows and ids, and null ids, stay separate rows; equal places of several kinds are listed in the order of KINDS. An
    empty table gives no rows. No other column of `docs` is read, so names can't clash.
    """
    repository = repository_col or id_col
    read = materialize(_candidates(docs, id_col, text_col, owner_col) if repository == id_col else _with_repository(docs, id_col, text_col, owner_col, repository))
    repo = F.col("repository") if repository != id_col else F.col("id")
    valued = read.select("uid", "owner", repo.cast("string").alias("repository"), F.explode("spans").alias("s")).where("s.hash IS NOT NULL")
    counts = materialize(ownership(valued.select(F.col("s.hash").alias("hash"), "owner", "repository")))
    known = _with_counts(valued.select("uid", "s", F.col("s.hash").alias("hash")), counts)
    own = (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_REPOSITORIES)
    live = F.struct(F.col("s.from").alias("start"), F.lit(KINDS.index("live")).alias("kind"), F.col("s.end").alias("end"))
    per_doc = known.groupBy("uid").agg(  # at most the spans of one text
        F.collect_set(F.when(own, live)).alias("live"), F.size(F.collect_set(F.when(~own, live))).alias("n_examples")
    )
    df = read.join(per_doc, "uid", "left")
    base = F.array_sort(
        F.transform(
            F.filter("spans", lambda s: s["kind"] < KINDS.index("live")),
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
        )
    )
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    live_spans = F.coalesce("live", none)
    return df.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat(base, live_spans))).alias("spans"),
        F.size(live_spans).cast("bigint").alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).cast("bigint").alias("n_examples"),
    )


def _with_repository(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """Candidates with a repository column: the id travels in a struct with it, so both survive the projection."""
    joined = docs.withColumn("__both", F.struct(F.col(id_col).alias("id"), F.col(repository_col).alias("repository")))
    found = _candidates(joined, "__both", text_col, owner_col)
    return found.select("uid", F.col("id.id").alias("id"), F.col("id.repository").alias("repository"), "owner", "spans")
