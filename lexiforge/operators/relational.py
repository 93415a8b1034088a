"""Relational operators of the service tables: versions, reconciliation, cascades, pages, histories, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.operators.search import top_per
from lexiforge.store import materialize


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key with the greatest order columns, by one aggregate with a map-side step and no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def mismatches(left: DataFrame, right: DataFrame, key: str, check: str) -> DataFrame:
    """Keys of a one-to-one join that fail: only on one side, or with another value of the check column."""
    both = left.select(key, F.col(check).alias("_l"), F.lit(True).alias("_left")).join(right.select(key, F.col(check).alias("_r"), F.lit(True).alias("_right")), key, "full_outer")
    code = F.when(F.col("_left").isNull(), "MISSING_LEFT").when(F.col("_right").isNull(), "MISSING_RIGHT").when(~F.col("_l").eqNullSafe(F.col("_r")), "DIFFERENT")
    return both.select(key, code.alias("issue")).where("issue is not null")


def join_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", check: str = "text_sha256") -> DataFrame:
    """Chunks with their vectors, one to one. Fails if a side lacks a key, a text hash differs, a key repeats, or the vectors
    are of more than one length, model or kind (mock). vectors: key, check, embedding, model, mock."""
    twice = chunks.select(key).unionByName(vectors.select(key)).groupBy(key).count().where("count > 2")
    wrong = mismatches(chunks, vectors, key, check).select(key, "issue").unionByName(twice.select(key, F.lit("REPEATED").alias("issue"))).limit(5).collect()
    if wrong:
        raise ValueError("chunks and vectors differ: " + ", ".join(f"{r[key]} {r['issue']}" for r in wrong))
    kinds = vectors.agg(*[F.countDistinct(c).alias(n) for n, c in (("lengths", F.size("embedding")), ("models", F.col("model")), ("kinds", F.col("mock")))]).first()
    if max(kinds) > 1:
        raise ValueError(f"the vectors are of {kinds['lengths']} lengths, {kinds['models']} models and {kinds['kinds']} kinds")
    return chunks.join(vectors.drop(check), key)


def reconcile(expected: DataFrame, actual: DataFrame, key: str, scope: DataFrame | None = None) -> DataFrame:
    """Rows (key, state): `missing` are expected and absent, `stale` present and not expected. A scope of keys limits what
    may be stale to itself."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    stale = a.join(e, key, "left_anti")
    if scope is not None:
        stale = stale.join(scope.select(key), key, "left_semi")
    return e.join(a, key, "left_anti").select(key, F.lit("missing").alias("state")).unionByName(stale.select(key, F.lit("stale").alias("state")))


def merge_versions(server: DataFrame, local: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both sides by key; where both have one the higher version, the server's on a tie."""
    cols = [c for c in server.columns if c != key]
    s, m = server.select(key, F.struct(*cols).alias("_s")), local.select(key, F.struct(*cols).alias("_l"))
    row = F.when(F.col("_s").isNull() | (F.col("_l").isNotNull() & (F.col(f"_l.{version}") > F.col(f"_s.{version}"))), F.col("_l")).otherwise(F.col("_s"))
    return s.join(m, key, "full_outer").select(key, row.alias("_r")).select(key, "_r.*")


def merge_turns(server: DataFrame, local: DataFrame, key: str, version: str, request: str, order: str, pending: Column) -> DataFrame:
    """merge_versions of a chat's turns, with the local ones that are not sent yet: a local row that waits is kept if no server
    row has its request id, and a server row that answers one takes its place in the order."""
    waiting = local.where(pending)
    merged = merge_versions(server, local.where(~pending), key, version)
    place = waiting.groupBy(request).agg(F.min(order).alias("_place"))
    merged = merged.join(place, request, "left").withColumn(order, F.coalesce("_place", order)).drop("_place").select(*server.columns)
    return merged.unionByName(waiting.join(server.where(F.col(request).isNotNull()).select(request).distinct(), request, "left_anti").select(*server.columns))


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to add: one of each key, none that target has."""
    return rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with its rows of those keys replaced."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def cascade(children: DataFrame, live_parents: DataFrame, parent: str, key: str, *, delete: bool) -> DataFrame:
    """Children after their parents are gone: removed, or kept with a null parent."""
    live = live_parents.select(F.col(key).alias("_live")).distinct()
    if delete:
        return children.join(live, children[parent] == live["_live"], "left_semi").unionByName(children.where(F.col(parent).isNull()))
    return children.join(live, children[parent] == live["_live"], "left").withColumn(parent, F.when(F.col("_live").isNotNull(), F.col(parent))).drop("_live")


def with_defaults(keys: DataFrame, settings: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """One row for each key with its settings, or the defaults where there is no row or no value."""
    return keys.join(settings.select(key, *defaults), key, "left").select(*keys.columns, *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()])


def settings_view(subscriptions: DataFrame, settings: DataFrame, topics: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """One row for each subscription: its settings or the defaults, and its topics that are not removed, oldest first, as
    structs of topic_id, label and origin. topics: key, topic_id, label, origin, removed, created_at."""
    active = topics.where(~F.coalesce("removed", F.lit(False)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "topic_id", "label", "origin"))), lambda t: F.struct(t["topic_id"].alias("topic_id"), t["label"].alias("label"), t["origin"].alias("origin")))
    lists = active.groupBy(key).agg(listed.alias("topics"))
    none = F.array().cast(lists.schema["topics"].dataType)
    return with_defaults(subscriptions, settings, key, defaults).join(lists, key, "left").withColumn("topics", F.coalesce("topics", none))


def update_from(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """target with the column taken from the source row of its key, where there is one."""
    s = source.select(key, F.col(column).alias("_new"))
    return target.join(s, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def bridge(refs: DataFrame, owner: str, identity: list[str], id_: Column) -> tuple[DataFrame, DataFrame]:
    """Find-or-create: one row for each identity with its id, and rows (owner, id, position) in first-use order."""
    things = refs.select(*identity).distinct().withColumn("id", id_)
    links = refs.join(things, identity).groupBy(owner, "id").agg(F.min("position").alias("_first"))
    return things, links.withColumn("position", F.row_number().over(W.partitionBy(owner).orderBy("_first", "id"))).drop("_first")


def children_of(parents: DataFrame, children: DataFrame, key: str, child: str, order: Column) -> DataFrame:
    """Every parent with the array of its children, in descending order; an empty one if it has none."""
    lists = children.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(child).alias("c"))), asc=False), lambda x: x["c"]).alias("children"))
    empty = F.array().cast(lists.schema["children"].dataType)
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", empty))


def unread_counts(alerts: DataFrame, group: str, sub: str) -> DataFrame:
    """Unread rows by group, by sub-group and in all, in one pass: rows (group, sub, n) with null for `any`."""
    keys = alerts.select(F.col(group).alias("g"), F.col(sub).alias("s"))
    return keys.groupingSets([["g"], ["s"], []], "g", "s").agg(F.count("*").alias("n"))


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return top_per(df, keys, [F.asc(order)], 1, "_n").drop("_n")


def renumber(df: DataFrame, by: str, item: str, order: str) -> DataFrame:
    """Rows with a label S1, S2 ... of their item, numbered by first use inside `by`."""
    uses = df.groupBy(by, item).agg(F.min(order).alias("_first"))
    labels = uses.withColumn("label", F.concat(F.lit("S"), F.row_number().over(W.partitionBy(by).orderBy("_first", item)))).drop("_first")
    return df.join(labels, [by, item])


def page(df: DataFrame, by: str, order: list[Column], limit: int, start: int | None = None, focus: Column | None = None) -> DataFrame:
    """One page of each group: rows with place (from 0), has_previous and has_next. start defaults to a third of a page
    before the first row where focus holds, or 0, and is kept inside the group."""
    w = W.partitionBy(by)
    rows = df.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.lit(start) if start is not None else F.coalesce(F.min(F.when(focus, F.col("place"))).over(w) - limit // 3, F.lit(0)) if focus is not None else F.lit(0)
    at = F.greatest(F.lit(0), F.least(at, F.col("_n") - 1))
    rows = rows.withColumn("_at", at).where((F.col("place") >= F.col("_at")) & (F.col("place") < F.col("_at") + limit))
    return rows.withColumn("has_previous", F.col("_at") > 0).withColumn("has_next", F.col("_at") + limit < F.col("_n")).drop("_at", "_n")


def history_window(turns: DataFrame, by: str, order: str, role: str, n: int, *, opener: str = "user") -> DataFrame:
    """The last n messages of each conversation from the first one of the opener's on."""
    last = top_per(turns, [by], [F.desc(order)], n, "_n").drop("_n")
    first = F.min(F.when(F.col(role) == opener, F.col(order))).over(W.partitionBy(by))
    return last.withColumn("_first", first).where(F.col(order) >= F.col("_first")).drop("_first")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in the order of the whole table, from 1. Rows are dealt out by ranges of the order and
    numbered inside each; ranges get the number of rows before them, found over one row a range."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # one row a partition
    placed = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_at") + F.col("_before")).cast("int").alias(name))


def newest_groups(df: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """Rows with the place of their group, groups ordered by their newest member."""
    groups = df.groupBy(by).agg(F.max(ts).alias("_newest"))
    return df.join(numbered(groups, [F.desc("_newest"), F.asc(by)], "group_place").drop("_newest"), by)


def close_ties(df: DataFrame, by: str, subject: str, score: str, *, least: float, ratio: float, most: int = 3) -> DataFrame:
    """The 2 to `most` best subjects of a question that lie within ratio of the top one, or none: best row per subject, the
    top one at least `least`, the others at least the greater of `least` and top * ratio."""
    best = df.groupBy(by, subject).agg(F.max(score).alias(score))
    w = W.partitionBy(by)
    near = best.withColumn("_top", F.max(score).over(w)).where((F.col("_top") >= least) & (F.col(score) >= F.greatest(F.lit(least), F.col("_top") * ratio))).drop("_top")
    return top_per(near, [by], [F.desc(score), F.asc(subject)], most).withColumn("_n", F.count("*").over(w)).where("_n >= 2").drop("_n")


def clarification_choices(items: DataFrame, by: str, *, least: float, ratio: float, most: int = 3) -> DataFrame:
    """Rows (by, rank, document_id, label) of what a question may have meant: none, or the best item of each of 2 to `most` subjects.

    items: by, subject, document_id, label, score, multiple_projects. An item without a subject is one of its document; the
    first by document of equal items stands for a subject. A question about several projects is never asked back. A label
    that an earlier choice has gets the end of its document's id.
    """
    rows = items.where(~F.coalesce("multiple_projects", F.lit(False))).withColumn("_s", F.coalesce(F.nullif("subject", F.lit("")), F.col("document_id").cast("string")))
    best = top_per(rows, [by, "_s"], [F.desc("score"), F.asc("document_id")], 1, "_n").drop("_n")
    tied = close_ties(best, by, "_s", "score", least=least, ratio=ratio, most=most).select(by, "_s", "rank")
    w = W.partitionBy(by, "label").orderBy("rank")
    again = F.concat(F.substring("label", 1, 100), F.lit(" ("), F.right(F.col("document_id").cast("string"), F.lit(6)), F.lit(")"))
    return best.join(tied, [by, "_s"]).withColumn("_k", F.row_number().over(w)).select(by, "rank", "document_id", F.when(F.col("_k") > 1, again).otherwise(F.col("label")).alias("label"))


def keep_chosen(evidence: DataFrame, by: str, chosen: DataFrame) -> DataFrame:
    """Evidence (by, subject, label, ...) of the subjects that carry the label chosen in a follow-up (by, chosen); all of a
    question's where it chose nothing, or a label that no evidence has."""
    named = evidence.join(chosen.where("chosen is not null").dropDuplicates([by]), by).where(F.col("label") == F.col("chosen")).select(by, F.col("subject").alias("_s")).distinct()
    inside = evidence.alias("e").join(named.alias("n"), (F.col(f"e.{by}") == F.col(f"n.{by}")) & F.col("e.subject").eqNullSafe(F.col("n._s")), "left_semi")
    return inside.unionByName(evidence.join(named.select(by).distinct(), by, "left_anti").select(*evidence.columns))


def previous(turns: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """turns with prev_<column> of the turn before, null for the first: what a reply may refer to."""
    w = W.partitionBy(by).orderBy(order)
    return turns.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def needs_refresh(asked: DataFrame, refreshed: DataFrame, by: str, at: str) -> DataFrame:
    """Keys whose newest question is later than their last refresh, or that have questions and never had one."""
    newest, last = asked.groupBy(by).agg(F.max(at).alias("_asked")), refreshed.groupBy(by).agg(F.max(at).alias("_done"))
    return newest.join(last, by, "left").where("_asked is not null and (_done is null or _asked > _done)").select(by)


def auto_names(prompts: DataFrame, by: str, order: str, prompt: str, *, most: int = 50) -> DataFrame:
    """Rows (by, prompt, name): the first prompt of each chat, and the name it gives one that has none yet: squeezed and cut."""
    first = prompts.groupBy(by).agg(F.min_by(prompt, order).alias("prompt"))
    squeezed = F.regexp_replace(F.trim("prompt"), r"\s+", " ")
    return first.select(by, "prompt", F.when(F.length(squeezed) <= most, squeezed).otherwise(F.rtrim(F.substring(squeezed, 1, most))).alias("name"))


def turn_messages(turns: DataFrame, by: str, order: str) -> DataFrame:
    """Rows (by, order, part, role, content, sources): a stored turn as the message of its prompt, unless that is empty, and that of
    its answer with its sources (title, link, outdated).

    turns: by, order, prompt, text, flags, citations (document_id, title, url, outdated; null where no reply was kept),
    documents (title, link). A reply flagged OUTDATED_SOURCES whose citations say nothing themselves marks them all. A source
    without a title has its document's id, or Source.
    """
    none = "array<struct<title:string,link:string,outdated:boolean>>"
    every = F.coalesce(F.array_contains("flags", "OUTDATED_SOURCES"), F.lit(False)) & F.forall("citations", lambda c: c["outdated"].isNull())
    named = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("Source"))
    cited = F.transform("citations", lambda c: F.struct(named(c["title"], c["document_id"]).alias("title"), F.coalesce(c["url"], F.lit("")).alias("link"), (F.coalesce(c["outdated"], F.lit(False)) | every).alias("outdated")))
    stored = F.transform("documents", lambda d: F.struct(named(d["title"]).alias("title"), F.coalesce(d["link"], F.lit("")).alias("link"), F.lit(False).alias("outdated")))
    sources = F.coalesce(cited, stored, F.array().cast(none)).cast(none)
    asked = F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("prompt").alias("content"), F.array().cast(none).alias("sources"))
    answered = F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("content"), sources.alias("sources"))
    both = F.when(F.coalesce(F.length("prompt") > 0, F.lit(False)), F.array(asked, answered)).otherwise(F.array(answered))
    return turns.select(by, order, F.explode(both).alias("m")).select(by, order, "m.*")


def signature(df: DataFrame, by: str, order: str, *parts: str) -> DataFrame:
    """One SHA-256 of each group's ordered list of parts: equal lists, equal signatures."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, *parts))), lambda x: F.concat_ws(":", *[F.coalesce(x[p].cast("string"), F.lit("")) for p in parts]))
    return df.groupBy(by).agg(F.sha2(F.array_join(lists, "\n"), 256).alias("signature"))


def request_conflicts(requests: DataFrame, request: str, *payload: str) -> DataFrame:
    """Request ids under which more than one payload was sent."""
    return requests.where(F.col(request).isNotNull()).groupBy(request).agg(F.countDistinct(F.struct(*payload)).alias("payloads")).where("payloads > 1")


def status_counts(df: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])


def run_status(consistent: Column, errors: Column, problems: Column) -> Column:
    return F.when(~consistent | (errors > 0), "FAILED").when(problems > 0, "PARTIAL_SUCCESS").otherwise("SUCCESS")


def nearest_ranks(df: DataFrame, by: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """Rows (by, and a column for each percent): the element at place ceil(q * n / 100) of a group's values in order, the first for
    none; nulls do not count, groups without a value have nulls, and without `by` there is one row.

    Exact and spread out: equal values of a group are counted together before they move, the counts are dealt out by ranges of
    (group, value), and each range finds the places inside it from the counts of the ranges before it, so a group may hold
    all rows and no task holds more than a range.
    """
    keys = [f"_g{i}" for i in range(len(by))] or ["_all"]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(1).alias("_all")]
    counted = df.select(*named, F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    dealt = materialize(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "value-ranges")
    some = dealt.where("_v is not null")
    parts = some.groupBy("_part", *keys).agg(F.sum("_n").alias("_in"))  # one row a range, and one a group more
    before = parts.select("_part", F.struct(*keys).alias("_key"), (F.sum("_in").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_in")).alias("_before"), F.sum("_in").over(W.partitionBy(*keys)).alias("_total"))
    upto = F.sum("_n").over(W.partitionBy("_part", *keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    placed = some.select("_part", F.struct(*keys).alias("_key"), "_v", "_n", upto.alias("_upto")).alias("a").join(before.alias("b"), (F.col("a._part") == F.col("b._part")) & F.col("a._key").eqNullSafe(F.col("b._key")))
    last = F.col("_before") + F.col("_upto")

    def at(q: int) -> Column:
        place = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_total") * q / 100))
        return F.max(F.when((last - F.col("_n") < place) & (place <= last), F.col("_v")))

    found = placed.groupBy(F.col("a._key").alias("_key")).agg(*[at(q).alias(name) for name, q in percents.items()])
    if not by:
        return found.drop("_key").unionByName(dealt.sparkSession.range(1).select(*[F.lit(None).cast(df.schema[value].dataType).alias(n) for n in percents])).agg(*[F.max(n).alias(n) for n in percents])
    groups = dealt.select(F.struct(*keys).alias("_key")).distinct()
    out = groups.alias("g").join(found.alias("f"), F.col("g._key").eqNullSafe(F.col("f._key")), "left")
    return out.select(*[F.col(f"g._key.{k}").alias(b) for b, k in zip(by, keys)], *percents)
