"""Claim taxonomies: concepts and their vectors, layers of clusters for each lens, names, roll-ups with cluster tags."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.model_output import cluster_name
from tracelake.functions.scalars import content_hash, normal_claim
from tracelake.operators.claims import LEAST_CONCEPTS, NAMED_FROM, claim_rollup, select_layers, session_buckets
from tracelake.operators.search import cosine_distance, embed, hashing_embedder
from tracelake.sources.scratch import settled

#: Clusters of the finest layer at most: their centres are all that the driver and every task hold.
MOST_CLUSTERS = 1024
#: Concepts less alike their cluster's centre than this are noise.
LEAST_STRENGTH = 0.05
SEED = 42

#: Vectors (concept, embedding) of one lens to labels (concept, layer, cluster_id, strength), the finest layer 0, and each layer's persistence.
Clusterer = Callable[[DataFrame], tuple[DataFrame, list[float]]]
#: A lens and the members' texts, the most frequent first, to a model's reply with a name.
Namer = Callable[[str, list[str]], str]

_LABELS = "concept string, layer int, cluster_id int, strength double"


@dataclass(frozen=True)
class Taxonomy:
    """``membership`` (lens, concept, layer, cluster_id, strength), ``clusters`` (lens, layer, cluster_id, parent_id, n_concepts) and
    ``meta`` (lens, n_layers, fine_layer, coarse_layer, used_singleton, n_concepts); cluster -1 is noise."""

    membership: DataFrame
    clusters: DataFrame
    meta: DataFrame


def concepts(claims: DataFrame) -> DataFrame:
    """(lens, concept): the different normalised claims of each lens; empty ones are none."""
    return claims.select("lens", normal_claim(F.col("claim")).alias("concept")).where("lens IS NOT NULL AND concept <> ''").distinct()


def concept_vectors(claims: DataFrame, embedder=hashing_embedder) -> DataFrame:
    """(concept, lens, embedding): each different concept is embedded once, whatever the number of its claims and lenses."""
    found = concepts(claims)
    return found.join(embed(found.select("concept").distinct(), "concept", "concept", embedder), "concept")


def singletons(vectors: DataFrame) -> tuple[DataFrame, list[float]]:
    """One layer in which every concept is its own cluster, numbered by name. For fewer than ``LEAST_CONCEPTS`` rows."""
    nth = F.row_number().over(W.orderBy("concept")) - 1
    return vectors.select("concept", F.lit(0).alias("layer"), nth.alias("cluster_id"), F.lit(1.0).alias("strength")), [0.0]


def k_means_layers(vectors: DataFrame) -> tuple[DataFrame, list[float]]:
    """Layers by k-means under cosine distance, from the root of the number of concepts down by quarters to 2 or 3 clusters.

    Strength is the cosine to the own centre, persistence a layer's mean silhouette. Vectors of length 0 and members
    below ``LEAST_STRENGTH`` are noise.
    """
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = settled(vectors.select("concept", "embedding", norm.alias("norm")), "vectors")
    points = rows.where("norm > 0").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    k = max(2, min(MOST_CLUSTERS, round(points.count() ** 0.5)))
    labels, persistence = [rows.limit(0).select("concept", F.lit(0).alias("layer"), F.lit(0).alias("cluster_id"), F.lit(0.0).alias("strength"))], []
    while True:
        model = KMeans(k=k, seed=SEED, distanceMeasure="cosine").fit(points)
        placed = model.transform(points)
        centres = rows.sparkSession.createDataFrame([(n, c.tolist()) for n, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
        strength = F.round(1 - cosine_distance(F.col("embedding"), F.col("centre")), 6)
        # at most MOST_CLUSTERS rows
        near = placed.join(F.broadcast(centres), "prediction").select("concept", "prediction", strength.alias("strength"))
        layer = len(persistence)
        kept = F.when(F.col("strength") >= LEAST_STRENGTH, F.col("prediction")).otherwise(-1)
        silent = rows.where("norm = 0").select("concept", F.lit(-1).alias("cluster_id"), F.lit(0.0).alias("strength"))
        labels.append(near.select("concept", kept.alias("cluster_id"), "strength").unionByName(silent).withColumn("layer", F.lit(layer)))
        several = placed.select("prediction").distinct().limit(2).count() > 1
        persistence.append(float(ClusteringEvaluator(distanceMeasure="cosine").evaluate(placed)) if several else 0.0)
        if k <= 3:
            break
        k = max(2, k // 4)
    return settled(reduce(DataFrame.unionByName, labels), "labels"), persistence


def parents(membership: DataFrame) -> DataFrame:
    """(lens, layer, cluster_id, parent_id): the cluster of the next layer that holds most of a cluster's concepts, ties to the least; noise has none."""
    real = membership.where("cluster_id >= 0")
    above = real.select("lens", "concept", (F.col("layer") - 1).alias("layer"), F.col("cluster_id").alias("parent_id"))
    counts = real.join(above, ["lens", "concept", "layer"]).groupBy("lens", "layer", "cluster_id", "parent_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("lens", "layer", "cluster_id").agg(F.min_by("parent_id", F.struct((-F.col("n")).alias("n"), "parent_id")).alias("parent_id"))


def cluster_claims(claims: DataFrame, embedder=hashing_embedder, clusterer: Clusterer = k_means_layers) -> Taxonomy:
    """The taxonomy of all claims (lens, claim), lens by lens; a lens of fewer than ``LEAST_CONCEPTS`` concepts is one layer of singletons."""
    found = settled(concept_vectors(claims, embedder), "concepts")
    made, meta = [], []
    # one row for each lens
    for lens, n in found.groupBy("lens").count().orderBy("lens").collect():
        own = found.where(F.col("lens") == lens).drop("lens")
        labels, persistence = singletons(own) if n < LEAST_CONCEPTS else clusterer(own)
        coarse, fine = select_layers(len(persistence), persistence)
        made.append(labels.select(F.lit(lens).alias("lens"), "concept", F.col("layer").cast("int"), F.col("cluster_id").cast("int"), F.col("strength").cast("double")))
        meta.append((lens, len(persistence), fine, coarse, n < LEAST_CONCEPTS, n))
    spark = found.sparkSession
    none = spark.createDataFrame([], f"lens string, {_LABELS}")
    membership = settled(reduce(DataFrame.unionByName, made, none), "membership")
    sizes = membership.groupBy("lens", "layer", "cluster_id").agg(F.count(F.lit(1)).alias("n_concepts"))
    clusters = sizes.join(parents(membership), ["lens", "layer", "cluster_id"], "left").select("lens", "layer", "cluster_id", "parent_id", "n_concepts")
    return Taxonomy(membership, clusters, spark.createDataFrame(meta, "lens string, n_layers int, fine_layer int, coarse_layer int, used_singleton boolean, n_concepts long"))


def frequent_words(lens: str, texts: list[str]) -> str:
    """The offline stand-in for a naming model: the three most frequent words of the members, as a model would reply."""
    words = Counter(w for t in texts for w in dict.fromkeys(t.lower().split()))
    return json.dumps({"name": " ".join(sorted(words, key=lambda w: (-words[w], w))[:3])})


def name_clusters(taxonomy: Taxonomy, claims: DataFrame, namer: Namer = frequent_words, known: DataFrame | None = None) -> DataFrame:
    """(lens, layer, cluster_id, name, source_hash, fresh) of the fine and coarse clusters but noise, from their most frequent texts.

    A cluster of ``known`` with the same texts keeps its name; a reply without a name fails.
    """
    key = ["lens", "layer", "cluster_id"]
    shown = taxonomy.meta.select("lens", F.explode(F.array_distinct(F.array("fine_layer", "coarse_layer"))).alias("layer"))
    # one row for each lens and layer
    members = taxonomy.membership.where("cluster_id >= 0").join(F.broadcast(shown), ["lens", "layer"]).select(*key, "concept")
    counts = claims.groupBy("lens", normal_claim(F.col("claim")).alias("concept"), "claim").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "claim"))
    most = members.join(counts, ["lens", "concept"]).withColumn("rank", rank).where(F.col("rank") <= NAMED_FROM)
    grouped = most.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "claim"))).alias("rows")).withColumn("texts", F.transform("rows", lambda r: r["claim"]))
    hashed = settled(grouped.select(*key, "texts", content_hash(F.array_sort("texts")).alias("source_hash")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [cluster_name(namer(lens, texts)) for lens, texts in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in range(3)), pa.array(names, pa.string()), batch.column(4)], [*key, "name", "source_hash"])

    same = [*key, "source_hash"]
    new = hashed if known is None else hashed.join(known.select(*same), same, "left_anti").select(*hashed.columns)
    named = new.mapInArrow(run, "lens string, layer int, cluster_id int, name string, source_hash string").withColumn("fresh", F.lit(True))
    if known is None:
        return named
    return named.unionByName(known.join(hashed.select(*same), same, "left_semi").select(*key, "name", "source_hash", F.lit(False).alias("fresh")))


def fine_tags(taxonomy: Taxonomy) -> DataFrame:
    """(lens, claim, cluster_id): the fine cluster of each normalised claim."""
    fine = taxonomy.meta.select("lens", F.col("fine_layer").alias("layer"))
    return taxonomy.membership.join(F.broadcast(fine), ["lens", "layer"]).select("lens", F.col("concept").alias("claim"), "cluster_id")


def tagged(rollup: DataFrame, tags: DataFrame) -> DataFrame:
    """Roll-up leaves with the ``cluster_id`` of their claim; -1 where the taxonomy doesn't have it."""
    return rollup.join(tags.select("lens", "claim", "cluster_id"), ["lens", "claim"], "left").fillna(-1, ["cluster_id"])


def tree_leaves(leaves: DataFrame, taxonomy: Taxonomy, names: DataFrame) -> DataFrame:
    """Tagged leaves (lens, claim, cluster_id, session_ids) as rows of ``claims.cluster_tree``: names of the fine cluster and of its coarse one, null for noise.

    The fine cluster's coarse one holds most of its concepts; where both layers are one, it is the same.
    """
    layers = F.broadcast(taxonomy.meta.select("lens", "fine_layer", "coarse_layer"))
    real = taxonomy.membership.where("cluster_id >= 0").join(layers, "lens")
    fine = real.where("layer = fine_layer").select("lens", "concept", F.col("cluster_id").alias("fine_id"))
    coarse = real.where("layer = coarse_layer").select("lens", "concept", "coarse_layer", F.col("cluster_id").alias("coarse_id"))
    counts = fine.join(coarse, ["lens", "concept"]).groupBy("lens", "fine_id", "coarse_layer", "coarse_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("lens", "fine_id", "coarse_layer").agg(F.min_by("coarse_id", F.struct((-F.col("n")).alias("n"), "coarse_id")).alias("coarse_id"))
    coarse_names = names.select("lens", F.col("layer").alias("coarse_layer"), F.col("cluster_id").alias("coarse_id"), F.col("name").alias("coarse"))
    fine_names = names.join(layers, "lens").where("layer = fine_layer").select("lens", F.col("cluster_id").alias("fine_id"), F.col("name").alias("fine"))
    above = best.join(coarse_names, ["lens", "coarse_layer", "coarse_id"], "left").select("lens", "fine_id", "coarse")
    titled = fine_names.join(above, ["lens", "fine_id"], "left").withColumnRenamed("fine_id", "cluster_id")
    return leaves.join(titled, ["lens", "cluster_id"], "left").select("lens", "coarse", "fine", "claim", F.from_json("session_ids", "array<string>").alias("sessions"))


def claim_pipeline(claims: DataFrame, events: DataFrame, scopes: DataFrame, *, grains: tuple[str, ...] = ("day", "week", "month"), embedder=hashing_embedder, clusterer: Clusterer = k_means_layers, namer: Namer = frequent_words, known: DataFrame | None = None) -> tuple[Taxonomy, DataFrame, DataFrame]:
    """Embed, cluster, name, roll up: the taxonomy, its names, and the tagged roll-ups of every grain with their ``grain``."""
    taxonomy = cluster_claims(claims, embedder, clusterer)
    names = settled(name_clusters(taxonomy, claims, namer, known), "names")
    tags = fine_tags(taxonomy)
    made = [tagged(claim_rollup(claims, session_buckets(events, grain), scopes), tags).withColumn("grain", F.lit(grain)) for grain in grains]
    return taxonomy, names, reduce(DataFrame.unionByName, made)
