"""Look-ups in summaries, roll-ups and claims, and the backlog of every pipeline stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scalars import ancestors, normal_claim, parent_scope, scope_depth

#: The stages in order.
STAGES = ("ingest", "chunk", "embed", "ner", "re", "entity_embed", "resolve", "communities", "naming")


def session_summary(summaries: DataFrame, project_id: str, session_id: str, model: str) -> DataFrame:
    """The summary of one session by a model; no row means not summarised."""
    return summaries.where((F.col("project_id") == project_id) & (F.col("session_id") == session_id) & (F.col("model") == model))


def rollup_summary(rollups: DataFrame, scope: str, grain: str, bucket: str, *, strategy: str | None = None, model: str | None = None) -> DataFrame:
    """The roll-up summaries of a scope, grain and bucket, of one strategy or model where given."""
    found = rollups.where((F.col("scope") == scope) & (F.col("grain") == grain) & (F.col("bucket") == bucket))
    for column, wanted in (("strategy", strategy), ("model", model)):
        found = found if wanted is None else found.where(F.col(column) == wanted)
    return found


def scope_children(scopes: DataFrame, scope: str, active: DataFrame | None = None) -> DataFrame:
    """(scope, depth): the scopes right below one, from the projects' scopes, of the active projects where given."""
    rows = scopes if active is None else scopes.join(active.select("project_id"), "project_id", "left_semi")
    chain = rows.select(F.explode(ancestors(F.col("scope"))).alias("scope")).distinct()
    return chain.where(parent_scope(F.col("scope")) == scope).select("scope", scope_depth(F.col("scope")).alias("depth"))


def project_scope(scopes: DataFrame, project_id: str) -> DataFrame:
    """(scope, ancestors) of a project, the root first."""
    return scopes.where(F.col("project_id") == project_id).select("scope", ancestors(F.col("scope")).alias("ancestors"))


def variants(rollups: DataFrame) -> DataFrame:
    """(strategy, model): the kinds of roll-up summaries there are."""
    return rollups.select("strategy", "model").distinct()


def claim_models(rollup: DataFrame) -> DataFrame:
    return rollup.select("model").distinct()


def session_claim_models(claims: DataFrame, failures: DataFrame, project_id: str, session_id: str) -> DataFrame:
    """(model): the models that found claims in a session or failed on it."""
    own = (F.col("project_id") == project_id) & (F.col("session_id") == session_id)
    return claims.where(own).select("model").unionByName(failures.where(own).select("model")).distinct()


def session_claims(claims: DataFrame, tags: DataFrame, names: DataFrame, project_id: str, session_id: str) -> DataFrame:
    """(lens, claim, cluster_id, cluster_name) of one session's claims; null without a cluster or a name.

    ``tags`` are the fine clusters (lens, claim, cluster_id) of normalised claims, ``names`` their (lens, cluster_id, name).
    """
    own = claims.where((F.col("project_id") == project_id) & (F.col("session_id") == session_id))
    keyed = own.select("lens", F.col("claim").alias("text"), normal_claim(F.col("claim")).alias("claim"))
    titles = names.select("lens", "cluster_id", F.col("name").alias("cluster_name"))
    found = keyed.join(tags.select("lens", "claim", "cluster_id"), ["lens", "claim"], "left").join(titles, ["lens", "cluster_id"], "left")
    return found.select("lens", F.col("text").alias("claim"), "cluster_id", "cluster_name")


def claim_buckets(rollup: DataFrame, scope: str, since: str | None = None) -> DataFrame:
    """(bucket, n_claims, total) of a scope's claim roll-up, from a bucket on where given."""
    rows = rollup.where(F.col("scope") == scope)
    rows = rows if since is None else rows.where(F.col("bucket") >= since)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_claims"), F.sum("n_sessions").alias("total"))


def failed_sessions(failures: DataFrame, buckets: DataFrame, scopes: DataFrame, scope: str, bucket: str | None = None) -> DataFrame:
    """(project_id, session_id): the failed sessions below a scope, of one bucket where given, with the project that a link back needs."""
    placed = failures.select("project_id", "session_id").distinct().join(buckets, ["project_id", "session_id"])
    placed = placed if bucket is None else placed.where(F.col("bucket") == bucket)
    below = scopes.where(F.array_contains(ancestors(F.col("scope")), scope)).select("project_id")
    return placed.join(below, "project_id", "left_semi").select("project_id", "session_id")


def session_projects(leaves: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, project_id) of every session that roll-up leaves (session_ids) name."""
    named = leaves.select(F.explode(F.from_json("session_ids", "array<string>")).alias("session_id")).distinct()
    return sessions.select("session_id", "project_id").distinct().join(named, "session_id", "left_semi")


def pipeline_stages(tables: dict[str, DataFrame], resolution: float = 1.0) -> DataFrame:
    """(nth, stage, eligible, done, pending, pct) of the nine stages, done no more than eligible, 0 % of nothing.

    ``tables``: files and source_files; events (event_id, msg_kind, message_content); chunks (event_id); vectors; ner_log, re_log;
    entities (name); entity_vectors; entity_clusters; communities (resolution, node, community); labels (resolution). Communities are
    those of ``resolution``, or of the least one where it is missing; they are built as a whole, so all of them are done.
    """
    one = F.count(F.lit(1))
    rows = lambda name: tables[name].agg(one.alias("n"))
    human = tables["events"].where("msg_kind = 'human' AND message_content <> ''").select("event_id")
    chunked = human.join(tables["chunks"].select("event_id").distinct(), "event_id", "left_semi").agg(one.alias("n"))
    least = F.min(F.struct((F.col("resolution") != resolution).alias("other"), "resolution"))["resolution"]
    # one row
    shown = F.broadcast(tables["communities"].agg(least.alias("resolution")))
    groups = tables["communities"].join(shown, "resolution")
    nodes = groups.agg(F.countDistinct("node").alias("n"))
    counts = {
        "ingest": (rows("files"), rows("source_files")),
        "chunk": (human.agg(one.alias("n")), chunked),
        "embed": (rows("chunks"), rows("vectors")),
        "ner": (rows("chunks"), rows("ner_log")),
        "re": (rows("chunks"), rows("re_log")),
        "entity_embed": (tables["entities"].agg(F.countDistinct("name").alias("n")), rows("entity_vectors")),
        "resolve": (rows("entity_vectors"), rows("entity_clusters")),
        "communities": (nodes, nodes),
        "naming": (groups.agg(F.countDistinct("community").alias("n")), tables["labels"].join(shown, "resolution").agg(one.alias("n"))),
    }
    sides = [d.select(F.lit(n).alias("nth"), F.lit(s).alias("stage"), F.lit(side).alias("side"), "n") for n, s in enumerate(STAGES) for side, d in zip(("eligible", "done"), counts[s], strict=True)]
    both = reduce(DataFrame.unionByName, sides).groupBy("nth", "stage").pivot("side", ["eligible", "done"]).agg(F.first("n"))
    done = F.least("done", "eligible")
    share = F.round(F.coalesce(F.try_divide(done * 100.0, F.col("eligible")), F.lit(0.0)), 1)
    return both.select("nth", "stage", "eligible", done.alias("done"), (F.col("eligible") - done).alias("pending"), share.alias("pct"))
