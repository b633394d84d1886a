"""Co-occurrence and the knowledge graph of a topic, as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.aggregates import document_frequency


def presence(df: DataFrame, terms: list[str], text: Column) -> DataFrame:
    """One row per document: the array of the terms it contains."""
    low = F.lower(text)
    return df.select(F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms])).alias("terms"))


def cooccurrence(df: DataFrame, pairs: list[tuple[str, str]], text: Column) -> DataFrame:
    """a, b, n_a, n_b, n_both, jaccard for the given term pairs: one pass over the documents, one row of sums."""
    low = F.lower(text)
    terms = list(dict.fromkeys(t for p in pairs for t in p))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n_a long, n_b long, n_both long, jaccard double")
    has = df.select(*[low.contains(t.lower()).alias(f"t{i}") for i, t in enumerate(terms)])
    at = {t: i for i, t in enumerate(terms)}
    one = [F.count_if(F.col(f"t{i}")).alias(f"n{i}") for i in range(len(terms))]
    two = [F.count_if(F.col(f"t{at[a]}") & F.col(f"t{at[b]}")).alias(f"p{j}") for j, (a, b) in enumerate(pairs)]
    sums = has.agg(*one, *two)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{at[a]}").alias("n_a"), F.col(f"n{at[b]}").alias("n_b"), F.col(f"p{j}").alias("n_both")) for j, (a, b) in enumerate(pairs)])
    out = sums.select(F.inline(rows))
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return out.withColumn("jaccard", F.when(union > 0, F.col("n_both") / union).otherwise(F.lit(0.0)))


def graph_nodes(df: DataFrame, topic: str, keywords: list[str], related: list[str], title: Column, content: Column) -> DataFrame:
    """label, type, size, importance, document_count."""
    keywords = [k for k in dict.fromkeys(keywords) if k != topic]
    related = [r for r in dict.fromkeys(related) if r != topic and r not in keywords][:10]
    n = df.agg(F.count("*").alias("n"))
    main = n.select(F.lit(topic).alias("label"), F.lit("main_topic").alias("type"), F.lit(30.0).alias("size"), F.lit(1.0).alias("importance"), F.col("n").alias("document_count"))
    if not keywords + related:
        return main
    counts = document_frequency(df, keywords + related, title, content).crossJoin(F.broadcast(n.withColumnRenamed("n", "docs")))  # one row
    is_key = F.col("term").isin(keywords) if keywords else F.lit(False)
    weight = F.when(is_key, 0.8).otherwise(F.least(F.lit(0.7), F.col("n") / F.col("docs") * 2))
    rest = counts.filter(is_key | (F.col("n") >= 2)).select(
        F.col("term").alias("label"), F.when(is_key, "keyword").otherwise("related_topic").alias("type"), F.when(is_key, 20.0).otherwise(15 + weight * 10).alias("size"),
        weight.alias("importance"), F.col("n").alias("document_count"),
    )
    return main.unionByName(rest)


#: Least Jaccard, base width and width factor of each kind of edge.
EDGES = {"keyword_relation": (0.1, 2.0, 3.0), "topic_relation": (0.05, 1.0, 4.0), "keyword_keyword_relation": (0.2, 1.0, 2.0)}


def graph_edges(df: DataFrame, topic: str, keywords: list[str], related: list[str], text: Column) -> DataFrame:
    """source, target, type, weight, width of the pairs above their threshold."""
    keywords = [k for k in dict.fromkeys(keywords) if k != topic]
    related = [r for r in dict.fromkeys(related) if r != topic and r not in keywords][:10]
    pairs = [(topic, k) for k in keywords] + [(topic, r) for r in related] + [(a, b) for i, a in enumerate(keywords) for b in keywords[i + 1 :]]
    is_topic, is_key = F.col("a") == topic, F.col("b").isin(keywords) if keywords else F.lit(False)
    kind = F.when(is_topic & is_key, "keyword_relation").when(is_topic, "topic_relation").otherwise("keyword_keyword_relation")
    e = cooccurrence(df, pairs, text).withColumn("type", kind)
    pick = lambda j: F.element_at(F.create_map(*[x for k, v in EDGES.items() for x in (F.lit(k), F.lit(v[j]))]), F.col("type"))
    e = e.filter(F.col("jaccard") > pick(0))
    return e.select(F.col("a").alias("source"), F.col("b").alias("target"), "type", F.col("jaccard").alias("weight"), (pick(1) + F.col("jaccard") * pick(2)).alias("width"))


def graph_clusters(nodes: DataFrame) -> DataFrame:
    """cluster, members: keywords; related topics above 0.5; related topics from 0.2 to 0.5."""
    i = F.col("importance")
    c = F.when(F.col("type") == "keyword", "keywords").when((F.col("type") == "related_topic") & (i > 0.5), "high_relevance").when((F.col("type") == "related_topic") & (i >= 0.2), "medium_relevance")
    return nodes.withColumn("cluster", c).filter("cluster is not null").groupBy("cluster").agg(F.sort_array(F.collect_list("label")).alias("members"))
