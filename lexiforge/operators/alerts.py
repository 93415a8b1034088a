"""Topic alerts: topic and document scores, thresholds, matches, topic upkeep."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.search import top_per


def score_join(topics: DataFrame, feed: DataFrame, score: Column, threshold: Column, name: str = "score", *, block: int = 4096) -> DataFrame:
    """Every topic with every feed row that reaches its threshold: a theta join, which has no key to deal rows by.

    Topics go to the tasks of the feed in blocks of about `block` rows, by a hash, so what is broadcast is bounded however many
    topics there are; the feed is gone through once for each block and stays where it is, and pairs below the threshold are
    never written.
    """
    parts, out = max(1, -(-topics.count() // block)), None
    for p in range(parts):
        some = topics if parts == 1 else topics.where(F.pmod(F.xxhash64(*topics.columns), F.lit(parts)) == p)
        pairs = feed.join(F.broadcast(some), score >= threshold).select(*topics.columns, *feed.columns, score.alias(name))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def lexical_hits(topics: DataFrame, feed: DataFrame, topic_key: str, terms: str, key: str, title: str, body: str) -> DataFrame:
    """Rows (topic_key, key, w, n): one for each word that a topic of n words and a document share, 1 in its title and 0.7 in its
    body alone. No aggregate, so feed may be a stream."""
    asked = topics.select(topic_key, F.size(F.array_distinct(terms)).alias("n"), F.explode(F.array_distinct(terms)).alias("term"))
    told = lambda words, w: F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    said = feed.select(key, F.explode(F.concat(told(F.array_distinct(title), 1.0), told(F.array_except(body, title), 0.7))).alias("t")).select(key, "t.term", "t.w")
    return said.join(asked, "term").select(topic_key, key, "w", "n")


def lexical_scores(topics: DataFrame, feed: DataFrame, topic_key: str, terms: str, key: str, title: str, body: str) -> DataFrame:
    """Rows (topic_key, key, score): (title hits + 0.7 * body-only hits) / terms, at most 1, rounded half even to 4 places;
    only pairs that share a term. terms, title and body are arrays of keywords."""
    hits = lexical_hits(topics, feed, topic_key, terms, key, title, body)
    return hits.groupBy(topic_key, key, "n").agg(F.sum("w").alias("w")).select(topic_key, key, F.bround(F.least(F.lit(1.0), F.col("w") / F.col("n")), 4).alias("score"))


def match(scores: DataFrame, topics: DataFrame, seen: DataFrame, subscription: str, topic_key: str, key: str, limit: int, default: float) -> DataFrame:
    """Per subscription at most `limit` new documents: scores at or above the topic's own threshold or the default, the best
    topic of each document (the first by key on a tie), none already seen, by score and then document."""
    rows = scores.join(topics.select(topic_key, subscription, "min_score"), topic_key).where(F.col("score") >= F.coalesce("min_score", F.lit(default)))
    fresh = rows.join(seen.select(subscription, key).distinct(), [subscription, key], "left_anti")
    best = top_per(fresh, [subscription, key], [F.desc("score"), F.asc(topic_key)], 1, "_n").drop("_n")
    return top_per(best, [subscription], [F.desc("score"), F.asc(key)], limit)


def raised_thresholds(dismissed: DataFrame, keys: list[str], old: Column) -> DataFrame:
    """After dismissals a topic's threshold is the greater of the old one and the dismissed score plus 0.01."""
    return dismissed.groupBy(*keys).agg(F.max("score").alias("_s")).select(*keys, F.greatest(old, F.col("_s") + 0.01).alias("threshold"))


def mark_read(alerts: DataFrame, chosen: Column, now: Column) -> DataFrame:
    """read_at set once."""
    return alerts.withColumn("read_at", F.when(chosen, F.coalesce("read_at", now)).otherwise(F.col("read_at")))


def theme_counts(questions: DataFrame, by: str, text: str, themes: DataFrame) -> DataFrame:
    """Rows (by, label, hits, rank): how often each theme's pattern stands in the questions of a group; themes has label,
    pattern and position, by which ties are broken."""
    pairs = questions.select(by, text).join(F.broadcast(themes), F.expr(f"regexp_count({text}, pattern) > 0"))  # a fixed list of themes
    hits = pairs.groupBy(by, "label", "position").agg(F.sum(F.expr(f"regexp_count({text}, pattern)")).alias("hits"))
    return top_per(hits, [by], [F.desc("hits"), F.asc("position")], 1 << 30).drop("position")


def new_labels(existing: DataFrame, suggested: DataFrame, by: str, label: str) -> DataFrame:
    """Suggestions whose label the subscription never had, removed ones included; one row for each label."""
    norm = F.lower(F.trim(F.col(label)))
    had = existing.select(by, norm.alias("_k")).distinct()
    return suggested.withColumn("_k", norm).where("_k <> ''").join(had, [by, "_k"], "left_anti").dropDuplicates([by, "_k"]).drop("_k")


def finalize_topics(topics: DataFrame, by: str, label: str, order: str, most: int = 4, *, query: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """First `most` topics with a label, repeats of a label apart from case dropped, those that exist (by, label) too; labels are cut
    to 80 characters, queries to 300; a topic without a query is searched for by its label."""
    from lexiforge.functions.text import clip

    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = topics.withColumn(label, clip(label, 80))
    if query is not None:
        rows = rows.withColumn(query, F.coalesce(F.nullif(clip(query, 300), F.lit("")), F.col(label)))
    rows = rows.withColumn("_k", key(F.col(label))).where("_k <> ''")
    if existing is not None:
        rows = rows.join(existing.select(by, key(F.col(label)).alias("_k")).distinct(), [by, "_k"], "left_anti")
    first = top_per(rows, [by, "_k"], [F.asc(order)], 1, "_n").drop("_n", "_k")
    return top_per(first, [by], [F.asc(order)], most)


def delete_topics(topics: DataFrame, chosen: DataFrame, key: str, now: Column) -> DataFrame:
    """Topics after the chosen ones are deleted: one that a user wrote goes, an automatic one stays as a tombstone with
    deleted_at, so that its label never comes back."""
    marked = topics.join(chosen.select(key, F.lit(True).alias("_gone")).distinct(), key, "left")
    kept = marked.where(F.col("_gone").isNull() | (F.col("origin") == "AUTO"))
    return kept.withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*topics.columns)


def dismiss(alerts: DataFrame, topics: DataFrame, chosen: Column, now: Column, *, default: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Alerts and topics after a dismissal: the chosen alerts are hidden (dismissed_at set once), and their topics' thresholds
    rise to the dismissed score plus 0.01 where that is more."""
    hidden = alerts.withColumn("dismissed_at", F.when(chosen, F.coalesce("dismissed_at", now)).otherwise(F.col("dismissed_at")))
    raised = alerts.where(chosen).groupBy("topic_id").agg((F.max("score") + 0.01).alias("_s"))
    after = topics.join(raised, "topic_id", "left").withColumn("min_score", F.when(F.col("_s").isNotNull(), F.greatest(F.coalesce("min_score", F.lit(default)), F.col("_s"))).otherwise(F.col("min_score")))
    return hidden, after.select(*topics.columns)


def match_with(feed: DataFrame, embedding: Callable[[], DataFrame], lexical: Callable[[], DataFrame], vector: str = "embedding") -> tuple[str, DataFrame]:
    """The matcher's name and its scores: by embeddings only if the feed has rows and every one has a vector, else by words."""
    n, without = feed.agg(F.count("*"), F.count_if(F.col(vector).isNull() | (F.size(vector) <= 0))).first()
    return ("embedding", embedding()) if n and not without else ("lexical", lexical())


def select_diverse(pool: DataFrame, buckets: dict[str, tuple[tuple[str, ...], str | None]], total: int, per_source: int, *, thrice: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the pool with bucket and place: for each bucket in turn up to ceil(total / buckets) rows, its sources taking
    turns, each giving its next row by `rank` that fits: an id and a title (first 70 folded characters) not taken yet, the
    bucket's pattern in the folded title, and no source over per_source rows in all (three times that for those in thrice).

    pool: id, source, title, rank. What is taken depends on all that was taken before, so the choice is made in one call, over
    the first candidates only: of each source and bucket those rows by rank that could be reached, which is at most the rows
    that all buckets may take plus one for each title.
    """
    from lexiforge.functions.text import fold

    named = pool.withColumn("_t", fold("title")).withColumn("_key", F.substring("_t", 1, 70))
    unique, near = top_per(named, ["id"], [F.asc("rank")], 1, "_i").drop("_i"), None
    for name, (sources, pattern) in buckets.items():
        fits = unique.where(F.col("source").isin(*sources))
        fits = fits.where(F.col("_t").rlike(pattern)) if pattern else fits
        fits = top_per(fits, ["source", "_key"], [F.asc("rank"), F.asc("id")], 1, "_k")
        part = top_per(fits, ["source"], [F.asc("rank"), F.asc("id")], 2 * total, "_n").withColumn("_bucket", F.lit(name))
        near = part if near is None else near.unionByName(part)
    quota, order = -(-total // len(buckets)), list(buckets)

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rank", "id"], kind="stable")
        ids, titles, given, out = set(), set(), {}, []
        for name in order:
            lines = {s: iter(f[(f["_bucket"] == name) & (f["source"] == s)].to_dict("records")) for s in buckets[name][0]}
            taken, open_ = 0, list(lines)
            while taken < quota and open_:
                for s in list(open_):
                    if taken >= quota:
                        break
                    for r in lines[s]:
                        if r["id"] in ids or r["_key"] in titles or given.get(s, 0) >= per_source * (3 if s in thrice else 1):
                            continue
                        ids.add(r["id"])
                        titles.add(r["_key"])
                        given[s] = given.get(s, 0) + 1
                        out.append((r["id"], name))
                        taken += 1
                        break
                    else:
                        open_.remove(s)
        out = out[:total]
        return pd.DataFrame({"id": pd.Series([i for i, _ in out], dtype=f["id"].dtype), "bucket": [b for _, b in out], "place": range(1, len(out) + 1)})

    kind = pool.schema["id"].dataType.simpleString()
    small = near.select("id", "source", "rank", "_key", "_bucket")  # at most 2 * total rows for each source of a bucket
    chosen = small.groupBy().applyInPandas(choose, f"id {kind}, bucket string, place int")
    return pool.join(F.broadcast(chosen), "id")  # total rows
