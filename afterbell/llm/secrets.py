"""Operator 2: secrets in texts, told apart by how many owners share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afterbell.functions.exprs import starts_of
from afterbell.llm.common import materialize

#: Fixed values of the contract: kind, pattern, group that is measured, least characters of that group.
KINDS = (
    (
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    ("access", "(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", "([0-9a-f]{16,})", 1, 16),
)
#: Words of documentation samples; a value that holds one of them is not live-looking.
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234|test"
#: Tasks over which the rows of one value are spread when they meet its counts.
SPREAD = 16
#: Least different characters of a live-looking value.
LEAST_DISTINCT = 8


def find_matches(rows: DataFrame) -> DataFrame:
    """``rows`` with a column for each kind: its matches with code point positions, from the pieces between matches and the matches themselves.

    A kind's value is its group, which for group 1 is the whole match. The arrays are columns of their own before they are walked: inside a lambda an expression is worked out anew for each element.
    """
    text = F.col("_text")
    rows = rows.withColumns({f"_some_{kind}": text.rlike(pattern) for kind, pattern, *_ in KINDS})
    found = {}
    for kind, pattern, group, _ in KINDS:
        for part, what in (("own", F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), ("before", F.split(text, pattern, -1)), ("value", F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))):
            if part != "value" or group > 1:
                found[f"_{part}_{kind}"] = F.when(F.col(f"_some_{kind}"), what)
    rows = rows.withColumns(found).withColumns({f"_value_{kind}": F.col(f"_own_{kind}") for kind, _, group, _ in KINDS if group == 1})
    rows = rows.drop(*[f"_some_{kind}" for kind, *_ in KINDS])
    sized = rows.drop("_text").withColumns(
        {f"_{part}_{kind}": F.transform(f"_{part}_{kind}", F.length) for kind, *_ in KINDS for part in ("own", "before")}
    ).withColumns({f"_before_{kind}": F.slice(f"_before_{kind}", 1, F.size(f"_own_{kind}")) for kind, *_ in KINDS})
    both = sized.withColumns({f"_both_{kind}": F.zip_with(f"_before_{kind}", f"_own_{kind}", lambda p, w: p + w) for kind, *_ in KINDS})
    placed = both.withColumns({f"_both_{kind}": starts_of(F.col(f"_both_{kind}")) for kind, *_ in KINDS})
    out = placed
    for rank, (kind, _, _, least) in enumerate(KINDS):
        parts = F.arrays_zip(*[F.col(f"_{part}_{kind}").alias(part) for part in ("both", "before", "own", "value")])
        start = lambda x: x["both"] + x["before"]
        spans = F.transform(
            F.filter(parts, lambda x: F.length(x["value"]) >= least),
            lambda x: F.struct(start(x).alias("start"), F.lit(rank).alias("rank"), (start(x) + x["own"]).alias("end"), x["value"].alias("value")),
        )
        out = out.withColumn(kind, F.coalesce(spans, F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")))
    return out.drop(*[f"_{part}_{kind}" for kind, *_ in KINDS for part in ("both", "before", "own", "value")])


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = 1,
    max_repos: int = 10,
) -> DataFrame:
    """Find candidate secrets in every whole text and judge each by its corpus-wide ownership.

    Candidates are hashed; hashes are counted by distinct repositories and owners over the whole
    corpus in three steps with map-side sums, so a value copied into a third of all rows costs a
    partial sum per task; its rows then meet the counts in ``SPREAD`` places. A value is ``live`` if it looks live (a digit, enough different
    characters, no placeholder word) and has at most ``max_owners`` owners and ``max_repos``
    repositories; ``example`` if it passes these numbers; else ``other``.

    Returns one row per input row: ``id_col``, n_assign, n_access, n_hex, base (span strings of the
    three kinds), found (all candidates with start, end, class, owners, repos), n_live, n_example,
    spans (base spans plus ``live`` spans). Defined cases: null text is empty; a null owner or
    repository counts as one unknown owner or repository; repeated rows are separate rows; an empty
    table gives an empty result; further columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("_doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("_repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
    )
    found = materialize(
        find_matches(rows).select(
            F.monotonically_increasing_id().alias("_row"),
            "_doc",
            "_repo",
            "_owner",
            *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in KINDS],
            F.expr(
                "transform(array_sort(concat(assign, access, hex)), m -> named_struct('start', m.start, 'rank', m.rank, 'end', m.end, "
                "'hash', unhex(md5(m.value)), 'looks_live', m.value rlike '[0-9]' and not lower(m.value) rlike '" + PLACEHOLDER + "' "
                f"and size(array_distinct(split(m.value, ''))) >= {LEAST_DISTINCT}))"
            ).alias("_candidates"),
        ),
        "secrets",
    )
    candidates = found.select("_row", "_repo", "_owner", F.explode("_candidates").alias("c")).select("_row", "_repo", "_owner", "c.*")
    shared = (
        candidates.groupBy("hash", "_owner", "_repo")
        .agg(F.lit(1).alias("_one"))
        .groupBy("hash", "_owner")
        .agg(F.count("*").alias("repos"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    few = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    spread = F.pmod(F.xxhash64("_row"), F.lit(SPREAD))
    places = shared.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    judged = (
        candidates.withColumn("_place", spread)
        .join(places, ["hash", "_place"])
        .withColumn("class", F.when(~few, "example").when(F.col("looks_live"), "live").otherwise("other"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "class", "owners", "repos"))).alias("found"))
    )
    names = "element_at(array(" + ", ".join(f"'{k[0]}'" for k in KINDS) + ", 'live'), m.rank + 1)"
    joined = found.join(judged, "_row", "left").withColumn(
        "found", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,class:string,owners:bigint,repos:bigint>>)"))
    )
    # distinct as strings: among structs it would compare all pairs
    spans = f"array_distinct(transform(array_sort({{}}), m -> concat({names}, ':', m.start, ':', m.end)))"
    bare = "transform(found, m -> named_struct('start', m.start, 'rank', m.rank, 'end', m.end))"
    live = f"transform(filter(found, m -> m.class = 'live'), m -> named_struct('start', m.start, 'rank', {len(KINDS)}, 'end', m.end))"
    return joined.select(
        F.col("_doc").alias(id_col),
        *[f"n_{k[0]}" for k in KINDS],
        F.expr(spans.format(bare)).alias("base"),
        "found",
        F.expr("cast(size(filter(found, m -> m.class = 'live')) as bigint)").alias("n_live"),
        F.expr("cast(size(filter(found, m -> m.class = 'example')) as bigint)").alias("n_example"),
        F.expr(spans.format(f"concat({bare}, {live})")).alias("spans"),
    )


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the contract, from the rows of :func:`scan_secrets`."""
    return found.select(
        id_col,
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
        "n_live",
        "n_example",
    )
