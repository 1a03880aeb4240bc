"""Merging of the same posting seen by several sources.

The rule is sequential: in scan order, a posting that matches one already kept is a copy of
the first such posting, else it is kept.  The result of that scan is computed here without
scanning:

1. Postings equal in all compared fields form one *profile*; a profile behaves like its
   first member, so any number of exact copies costs one aggregation.
2. Similar profiles are found by joining on rare pieces of company and title
   (``blocking``), never by pairing a whole block.
3. A posting is kept once no earlier match of it is kept or open, and a copy once an earlier
   match is kept.  Rounds of joins apply this until nothing is open.  Every decision depends
   on earlier postings only, so the rounds end with the scan's result.

Where near copies crowd one bucket, "leaders" (postings that are first in all their buckets,
hence surely kept) first absorb their copies with one comparison each, so a crowd of n near
copies costs n comparisons and not n squared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import rules as R
from jobloom.functions.similarity import reaches, tokens
from jobloom.functions.text import block_key, is_unstated, normalize_text
from jobloom.operators.blocking import described, lengths_allow, rare_pieces, text_key
from jobloom.session import picked, saved

COMPARED = ["company_name", "job_title", "salary", "level"]
CROWDED = 50  # pairs per bucket entry above which leaders go first


@dataclass(frozen=True)
class MatchRule:
    threshold: float = 0.9
    use_characters: bool = True
    fold_tone_marks: bool = False


def source_rank(sources: Sequence[str]) -> Column:
    """Position in the list; unlisted sources come after all listed ones."""
    at = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    return F.when(at > 0, at).otherwise(len(sources) + 1)


# ---- 1. order and profiles --------------------------------------------------------------

def comparable(df: DataFrame, rule: MatchRule) -> DataFrame:
    """Normalised compared fields; salary and level are null where not stated."""
    def field(c):
        return F.when(~is_unstated(c, fold=rule.fold_tone_marks), normalize_text(c))

    company, title = normalize_text("company_name"), normalize_text("job_title")
    out = df.select(
        "*", company.alias("c"), title.alias("t"), field("salary").alias("s"), field("level").alias("l"))
    key = F.unhex(F.md5(F.concat_ws("\x01", "c", "t", F.coalesce("s", F.lit("\x02")), F.coalesce("l", F.lit("\x02")))))
    return out.withColumns({"block": block_key("c"), "profile": key})


def _ranked(postings: DataFrame, master: DataFrame | None, sources: Sequence[str],
            rule: MatchRule) -> tuple[DataFrame, DataFrame]:
    """(postings in scan order, compared fields of every posting by row); texts stay where they were written."""
    columns = ["job_url", "source", "created_at", *COMPARED]
    rows = postings.select(*columns).withColumn("existing", F.lit(False))
    if master is not None:
        rows = rows.unionByName(master.select(*columns).withColumn("existing", F.lit(True)))
    order = [F.col("existing").desc(), F.when(F.col("existing"), 0).otherwise(source_rank(sources)),
             F.when(~F.col("existing"), F.col("source")), F.col("created_at").asc_nulls_first(), F.col("job_url")]
    # A range sort reads its input twice, so whole texts are normalised before it.
    known = saved(comparable(rows, rule).select(
        "job_url", "source", "created_at", "existing", "c", "t", "s", "l", "block", "profile", text_key("t").alias("t_key"),
        F.monotonically_increasing_id().alias("row")))
    # After a range sort these ids grow in sort order across partitions.
    slim = known.select("job_url", "source", "created_at", "existing", "block", "profile")
    ranked = slim.orderBy(*order).withColumn("rank", F.monotonically_increasing_id())
    texts = known.select("row", "profile", "c", "t", "s", "l", "t_key")
    return ranked.select("rank", "job_url", "source", "existing", "block", "profile"), texts


def _with_shared_url(rows: DataFrame) -> DataFrame:
    """``shared``: the URL where postings of different profiles in a block have it, else ''.

    Only such URLs can decide anything that the profiles do not decide already.
    """
    keyed = rows.filter(F.col("job_url") != "")
    shared = (keyed.groupBy("block", "job_url").agg(F.min("profile").alias("a"), F.max("profile").alias("b"))
              .filter(F.col("a") != F.col("b")).select("block", "job_url", F.lit(True).alias("_hit")))
    out = rows.join(shared, ["block", "job_url"], "left")
    return out.withColumn("shared", F.when(F.col("_hit"), F.col("job_url")).otherwise("")).drop("_hit")


def _nodes(rows: DataFrame) -> DataFrame:
    """One node per (profile, shared URL), named by the rank of its first posting."""
    return rows.groupBy("profile", "shared", "block").agg(
        F.min("rank").alias("node"),
        F.min_by("job_url", "rank").alias("url"), F.min_by("source", "rank").alias("src"),
        F.max("existing").alias("existing"))


# ---- 2. matching profiles ---------------------------------------------------------------

def _where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by a condition with a Python ratio in it, evaluated as a column of its own."""
    return df.withColumn("_hit", condition).filter("_hit").drop("_hit")


def _similar_companies(companies: DataFrame, rule: MatchRule) -> DataFrame:
    """Directed pairs (c, near) of different but similar company names in one block."""
    known = saved(described(companies.select("c", "block").distinct(), "c", rule.threshold, rule.use_characters))
    keyed = rare_pieces(known).join(known.select("c", "block", "key"), "key")
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.piece") == F.col("b.piece"))
                   & (F.col("a.c") < F.col("b.c"))
                   & lengths_allow(F.col("a.len"), F.col("b.len"), F.col("a.words"), F.col("b.words"),
                                   rule.threshold, rule.use_characters))
    pairs = pairs.select(F.col("a.c").alias("x"), F.col("b.c").alias("y")).distinct()
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("x").alias("c"), F.col("y").alias("near")),
        F.struct(F.col("y").alias("c"), F.col("x").alias("near")))))
    return _where(both, reaches("c", "near", rule.threshold, rule.use_characters))


def _entries(profiles: DataFrame, texts: DataFrame, rule: MatchRule) -> DataFrame:
    """Bucket entries of profiles: under their own company (``own``) and, to look for
    candidates only, under similar ones."""
    slim = profiles.select("profile", "c", F.col("t_key").alias("key"), "row", "first", "last", F.lit(True).alias("own"))
    near = _similar_companies(profiles, rule)
    other = slim.join(near, "c").select("profile", F.col("near").alias("c"), "key", "row", "first", "last", F.lit(False).alias("own"))
    every = saved(slim.unionByName(other))
    # a title can only meet another one under a company that several profiles come to
    several = every.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    every = saved(every.join(several, "c", "left_semi"))
    one = every.groupBy("key").agg(F.min("row").alias("row"))
    titles = saved(described(picked(texts, one).select("t"), "t", rule.threshold, rule.use_characters).drop("t"))
    return every.drop("row").join(rare_pieces(titles), "key").drop("key")


def _same_bucket(later: DataFrame, earlier: DataFrame, rule: MatchRule, *more: Column) -> DataFrame:
    """Pairs (profile, candidate) that share a bucket, the candidate being earlier."""
    a, b = later.alias("a"), earlier.alias("b")
    on = ((F.col("a.c") == F.col("b.c")) & (F.col("a.piece") == F.col("b.piece"))
          & (F.col("a.profile") != F.col("b.profile")) & (F.col("b.first") < F.col("a.last"))
          & lengths_allow(F.col("a.len"), F.col("b.len"), F.col("a.words"), F.col("b.words"),
                          rule.threshold, rule.use_characters))
    for condition in more:
        on = on & condition
    return a.join(b, on).select(F.col("a.profile").alias("profile"), F.col("b.profile").alias("candidate")).distinct()


def _field_reaches(a: Column, b: Column, rule: MatchRule) -> Column:
    both_unstated, one_unstated = a.isNull() & b.isNull(), a.isNull() | b.isNull()
    return (F.when(both_unstated, 1.0 >= rule.threshold).when(one_unstated, 0.5 >= rule.threshold)
            .otherwise(F.coalesce(reaches(a, b, rule.threshold, rule.use_characters), F.lit(False))))


def _matching(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, rule: MatchRule) -> DataFrame:
    """Pairs whose title and (salary or level) match; the companies match by bucket."""
    fields = profiles.select("profile", "s", "l", "t_key", "row")
    second = fields.select(*[F.col(x).alias(y) for x, y in zip(fields.columns, ("candidate", "s2", "l2", "t2_key", "row2"))])
    col = F.col
    either = _field_reaches(col("s"), col("s2"), rule) | _field_reaches(col("l"), col("l2"), rule)
    # few beside the texts, which the planner cannot know before
    asked = saved(_where(pairs.join(fields, "profile").join(second, "candidate"), either).select(
        "profile", "candidate", "row", "row2", (col("t_key") == col("t2_key")).alias("same")))
    different = asked.where("NOT same").select("row", "row2").distinct()
    some = picked(texts, different.select("row").unionByName(different.select(col("row2").alias("row")))).select("row", "t")
    joined = different.join(some, "row").join(some.select(col("row").alias("row2"), col("t").alias("t2")), "row2")
    titled = _where(joined, reaches("t", "t2", rule.threshold, rule.use_characters)).select("row", "row2", F.lit(True).alias("alike"))
    # texts of one key are the same text, whatever the threshold
    return asked.where("same").select("profile", "candidate").unionByName(
        asked.where("NOT same").join(titled, ["row", "row2"]).select("profile", "candidate"))


def _profiles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Profiles with the ranks of their first and last node, most have one node, and the row of their text."""
    brief = texts.drop("t").dropDuplicates(["profile"])
    return nodes.groupBy("profile").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.first("block").alias("block")).join(brief, "profile")


def _crowding(own: DataFrame) -> float:
    """Pairs per entry if every bucket were paired: tells whether leaders pay off."""
    sizes = own.groupBy("c", "piece").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs, entries = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("n")).first()
    return (pairs or 0.0) / max(entries or 0.0, 1.0)


def _leaders(nodes: DataFrame, profiles: DataFrame, texts: DataFrame, own: DataFrame, every: DataFrame, rule: MatchRule,
             crowded: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(leaders, absorbed, matches) found before full pairing, or None if not crowded.

    A leader has no earlier undecided posting in any bucket and matched no earlier leader,
    so the scan keeps it; what matches it later is absorbed.  Two kinds of profiles are
    left to the general rounds: those sharing a URL with another profile are neither
    leaders nor absorbed, and those of the master are never absorbed.
    """
    if _crowding(own) <= crowded:
        return None
    spark = profiles.sparkSession
    shared = saved(nodes.filter(F.col("shared") != "").select("profile").distinct())
    pinned = saved(nodes.filter((F.col("shared") != "") | F.col("existing")).select("profile").distinct())
    leaders = spark.createDataFrame([], "profile binary")
    absorbed = spark.createDataFrame([], "profile binary, at bigint")
    matches = spark.createDataFrame([], "profile binary, candidate binary")
    while True:  # every round decides at least one posting
        decided = leaders.unionByName(absorbed.select("profile"))
        live_own = own.join(decided, "profile", "left_anti")
        live = every.join(decided, "profile", "left_anti")
        heads = live_own.groupBy("c", "piece").agg(F.min("first").alias("head"))
        earliest = live.join(heads, ["c", "piece"], "left").groupBy("profile").agg(
            F.min("head").alias("head"), F.min("first").alias("first"))
        new = saved(earliest.filter(F.coalesce(F.col("head") >= F.col("first"), F.lit(True)))
                     .select("profile", "first").join(shared, "profile", "left_anti"))
        if new.isEmpty():
            break
        pairs = _same_bucket(live, live_own.join(new.select("profile"), "profile", "left_semi"), rule)
        found = saved(_matching(pairs, profiles, texts, rule))
        at = new.select(F.col("profile").alias("candidate"), F.col("first").alias("at"))
        gone = (found.join(pinned, "profile", "left_anti").join(at, "candidate")
                .groupBy("profile").agg(F.min("at").alias("at")))
        leaders = saved(leaders.unionByName(new.select("profile")))
        absorbed = saved(absorbed.unionByName(gone))
        matches = matches.unionByName(found)
        rest = own.join(leaders.unionByName(absorbed.select("profile")), "profile", "left_anti")
        if _crowding(rest) <= crowded:
            break
    return leaders, absorbed, matches


def all_edges(nodes: DataFrame, texts: DataFrame, rule: MatchRule) -> DataFrame:
    """All (profile, candidate) matches, the candidate being earlier; in a crowd of n near copies that is n squared."""
    profiles = saved(_profiles(nodes, texts))
    every = saved(_entries(profiles, texts, rule))
    return _matching(_same_bucket(every, every.filter("own"), rule), profiles, texts, rule)


def match_edges(nodes: DataFrame, texts: DataFrame, rule: MatchRule, crowded: float = CROWDED) -> DataFrame:
    """The (profile, candidate) matches that can decide or name a copy; the decisions are the same with more."""
    profiles = saved(_profiles(nodes, texts))
    every = saved(_entries(profiles, texts, rule))
    own = every.filter("own")
    found = _leaders(nodes, profiles, texts, own, every, rule, crowded)
    if found is None:
        return _matching(_same_bucket(every, own, rule), profiles, texts, rule)
    leaders, absorbed, matches = found
    # Leaders have no earlier match beyond those found.  An absorbed profile can still
    # belong to a posting kept before its leader, but is no candidate itself.
    later = every.join(leaders, "profile", "left_anti").join(absorbed, "profile", "left")
    earlier = own.join(absorbed.select("profile"), "profile", "left_anti")
    before_leader = F.coalesce(F.col("b.first") < F.col("a.at"), F.lit(True))
    return _matching(_same_bucket(later, earlier, rule, before_leader), profiles, texts, rule).unionByName(matches)


# ---- 3. the scan's decisions ------------------------------------------------------------

def _neighbourhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node the first kept and the first open posting among its matches and itself."""
    first_kept = F.min(F.when(F.col("state") == "kept", F.col("node"))).alias("kept")
    first_open = F.min(F.when(F.col("state") == "open", F.col("node"))).alias("open")
    hubs = nodes.groupBy("profile").agg(first_kept, first_open)
    around = edges.join(hubs.withColumnRenamed("profile", "candidate"), "candidate").select("profile", "kept", "open")
    by_profile = hubs.unionByName(around).groupBy("profile").agg(
        F.min("kept").alias("p_kept"), F.min("open").alias("p_open"))
    by_url = (nodes.filter(F.col("shared") != "").groupBy("block", "shared")
              .agg(first_kept.alias("u_kept"), first_open.alias("u_open")))
    out = nodes.join(by_profile, "profile").join(by_url, ["block", "shared"], "left")
    return out.withColumns({"first_kept": F.least("p_kept", "u_kept"), "first_open": F.least("p_open", "u_open")}).drop(
        "p_kept", "p_open", "u_kept", "u_open")


def _step(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes after deciding every open one that the present states decide."""
    seen = _neighbourhood(nodes, edges)
    copy = F.coalesce(F.col("first_kept") < F.col("node"), F.lit(False))
    alone = F.col("first_open") >= F.col("node")
    state = (F.when(F.col("state") != "open", F.col("state")).when(copy, "copy").when(alone, "kept").otherwise("open"))
    return seen.select("node", "profile", "block", "shared", state.alias("state"))


def _decide(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Decide every node; nodes without any match are kept without joining the rounds."""
    busy = (edges.select("profile").unionByName(edges.select(F.col("candidate").alias("profile")))
            .unionByName(nodes.filter(F.col("shared") != "").select("profile")).distinct())
    slim = nodes.select("node", "profile", "block", "shared",
                        F.when(F.col("existing"), "kept").otherwise("open").alias("state"))
    active = saved(slim.join(busy, "profile", "left_semi"))
    while not active.filter(F.col("state") == "open").isEmpty():
        active = saved(_step(active, edges))
    linked = _neighbourhood(active, edges).select("node", "state", F.col("first_kept").alias("link"))
    return nodes.join(linked, "node", "left").withColumns({
        "state": F.coalesce("state", F.lit("kept")), "link": F.coalesce("link", "node")})


def resolve(postings: DataFrame, master: DataFrame | None = None, sources: Sequence[str] = R.SOURCES,
            rule: MatchRule = MatchRule(), crowded: float = CROWDED) -> DataFrame:
    """Status of every posting: ``kept``, ``duplicate`` (with the posting it copies) or
    ``existing`` (a row of ``master``, kept whatever it matches).

    Columns: rank, job_url, source, status, kept_url, kept_source.
    """
    ranked, texts = _ranked(postings, master, sources, rule)
    rows = _with_shared_url(saved(ranked))
    nodes = saved(_nodes(rows))
    edges = saved(match_edges(nodes, texts, rule, crowded))
    decided = _decide(nodes, edges).select("node", "profile", "shared", "block", "state", "link", "url", "src")
    kept = decided.select(F.col("node").alias("link"), F.col("url").alias("kept_url"), F.col("src").alias("kept_source"))
    named = decided.join(kept, "link").select("profile", "shared", "block", "node", "state", "kept_url", "kept_source")
    first = (F.col("rank") == F.col("node")) & (F.col("state") == "kept")
    status = F.when(F.col("existing"), "existing").when(first, "kept").otherwise("duplicate")
    copy = F.col("status") == "duplicate"
    return (
        rows.join(named, ["profile", "shared", "block"])
        .withColumn("status", status)
        .select("rank", "job_url", "source", "status", F.when(copy, F.col("kept_url")).alias("kept_url"),
                F.when(copy, F.col("kept_source")).alias("kept_source"))
    )


# ---- what follows from the decisions ----------------------------------------------------

def link_duplicates(decisions: DataFrame) -> DataFrame:
    """(kept_url, source, job_url) of every copy, without repeats and without self links."""
    return (decisions.filter((F.col("status") == "duplicate") & ~F.col("job_url").eqNullSafe(F.col("kept_url")))
            .select("kept_url", "source", "job_url").distinct())


def attach_links(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Put all links of a posting into ``extra_info.duplicate_sources``, beside those it has."""
    listed = "array<struct<source:string,job_url:string>>"
    found = links.groupBy(F.col("kept_url").alias("_url")).agg(
        F.array_sort(F.collect_list(F.struct("source", "job_url"))).alias("_links"))
    out = postings.join(found, F.col("job_url") == F.col("_url"), "left")
    given = "extra_info" in postings.columns
    before = F.col("extra_info.duplicate_sources") if given else F.lit(None).cast(listed)
    attrs = F.col("extra_info.attrs") if given else F.lit(None).cast("map<string,string>")
    merged = F.coalesce(F.array_sort(F.array_union(F.coalesce(before, F.array().cast(listed)), F.col("_links"))), before)
    return out.withColumn("extra_info", F.struct(merged.alias("duplicate_sources"), attrs.alias("attrs"))).drop("_url", "_links")


def new_postings(postings: DataFrame, decisions: DataFrame) -> DataFrame:
    """The postings to add to the master: those kept, by (source, URL)."""
    kept = decisions.filter(F.col("status") == "kept").select("source", "job_url")
    return postings.join(kept, ["source", "job_url"], "left_semi")


def sync(postings: DataFrame, master: DataFrame, sources: Sequence[str] = R.SOURCES,
         rule: MatchRule = MatchRule()) -> tuple[DataFrame, DataFrame]:
    """(master after the run, report): postings are resolved against the master, the new ones appended,
    and links to copies written to stored and new postings alike."""
    decisions = saved(resolve(postings, master, sources, rule))
    links = saved(link_duplicates(decisions))
    stored = attach_links(master, links)
    fresh = attach_links(new_postings(postings, decisions), links)
    return stored.unionByName(fresh, allowMissingColumns=True), sync_report(decisions)


def sync_report(decisions: DataFrame) -> DataFrame:
    """Per source and in total: postings read, new and duplicate; total's source is null."""
    read = decisions.filter(F.col("status") != "existing")
    return read.rollup("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "kept").alias("new"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate"))


def block_report(postings: DataFrame) -> DataFrame:
    """Size of every block and the pairs a full comparison of it would take."""
    sizes = postings.groupBy(block_key(normalize_text("company_name")).alias("block")).agg(
        F.count(F.lit(1)).alias("postings"))
    return sizes.withColumn("pairs", F.expr("postings * (postings - 1) div 2"))
