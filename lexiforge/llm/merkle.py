"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import table
from lexiforge.store import materialize

#: A leaf ends after a word whose CRC-32 is a multiple of LEAF; a section ends after a paragraph whose digest begins with 0.
LEAF = 6
#: Leaf marks that a printed fingerprint holds at most, and hex digits of a mark.
MARKS, MARK = 256, 6


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _leaves(paragraph: Column) -> Column:
    """A paragraph cut into runs of words; where it is cut follows from the words, so a change moves no cut but its own."""
    words = F.transform(F.split(paragraph, " ", -1), lambda w: F.concat(w, F.when(F.crc32(w.cast("binary")) % LEAF == 0, F.lit("\n")).otherwise(F.lit(" "))))
    return _let(F.array_join(words, ""), lambda s: F.split(F.substring(s, F.lit(1), F.length(s) - 1), "\n", -1))


def tree(text: Column) -> Column:
    """The tree of a text: struct (root, sections, paragraphs).

    Paragraphs are lines. A paragraph's leaves are runs of about six words; a leaf's digest is SHA-256 of its text, a
    paragraph's of its leaves' digests, a section's of its paragraphs' digests, the root of the sections'. sections holds
    structs (h, n: how many paragraphs), paragraphs structs (h, leaves: structs (h, n: code points)). A section is a run of
    paragraphs that ends with one whose digest begins with 0, so a line put in changes one section. Null counts as the empty
    text, which is one empty paragraph.
    """
    made = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.transform(_leaves(p), lambda x: F.struct(F.sha2(x, 256).alias("h"), F.length(x).alias("n"))))
    paragraphs = F.transform(made, lambda ls: F.struct(F.sha2(F.array_join(F.transform(ls, lambda x: x["h"]), ""), 256).alias("h"), ls.alias("leaves")))

    def above(ps: Column) -> Column:
        listed = F.array_join(F.transform(ps, lambda p: F.concat(p["h"], F.when(F.substring(p["h"], 1, 1) == "0", F.lit("|")).otherwise(F.lit(",")))), "")
        runs = _let(listed, lambda s: F.split(F.substring(s, F.lit(1), F.length(s) - 1), r"\|", -1))
        sections = F.transform(runs, lambda r: F.struct(F.sha2(r, 256).alias("h"), F.floor((F.length(r) + 1) / 65).cast("int").alias("n")))
        return _let(sections, lambda ss: F.struct(F.sha2(F.array_join(F.transform(ss, lambda x: x["h"]), ""), 256).alias("root"), ss.alias("sections"), ps.alias("paragraphs")))

    return _let(paragraphs, above)


def fingerprint(tree_: Column) -> Column:
    """A tree printed as `root-leaves-marks`: the root, the number of distinct leaves, and the first digits of the 256 smallest
    leaf digests. The root tests equality, the marks likeness; the print has 1,620 characters at most, however long the text."""
    leaves = F.array_distinct(F.flatten(F.transform(tree_["paragraphs"], lambda p: F.transform(p["leaves"], lambda x: F.substring(x["h"], 1, 16)))))
    return _let(
        F.array_sort(leaves), lambda d: F.concat_ws("-", tree_["root"], F.size(d).cast("string"), F.array_join(F.transform(F.slice(d, 1, MARKS), lambda x: F.substring(x, 1, MARK)), ""))
    )


def likeness(a: Column, b: Column) -> Column:
    """How much two printed trees have in common, 0 to 1: 1 if the roots are equal, else the leaves they share over the leaves
    of the larger tree. Null if either is null.

    Of trees of up to 256 distinct leaves the share is exact (but for equal 24-bit marks); of larger ones it is estimated from
    the 256 smallest marks of both together, to about 0.04.
    """

    def parts(x: Column) -> Column:
        return _let(F.split(x, "-"), lambda p: F.struct(p[1].cast("double").alias("n"), F.regexp_extract_all(p[2], F.lit(f"[0-9a-f]{{{MARK}}}"), F.lit(0)).alias("m")))

    def share(p: Column) -> Column:
        x, y = p["x"], p["y"]
        both = F.array_intersect(x["m"], y["m"])
        joint = F.slice(F.array_sort(F.array_union(x["m"], y["m"])), 1, MARKS)
        jaccard = F.size(F.array_intersect(joint, both)) / F.greatest(F.size(joint), F.lit(1))
        guess = jaccard / (1 + jaccard) * (x["n"] + y["n"])
        known = F.when((x["n"] <= MARKS) & (y["n"] <= MARKS), F.size(both).cast("double")).otherwise(guess)
        return F.least(known / F.greatest(x["n"], y["n"], F.lit(1.0)), F.lit(1.0))

    same = F.substring_index(a, "-", 1) == F.substring_index(b, "-", 1)
    return F.when(same, 1.0).when(a.isNotNull() & b.isNotNull(), _let(F.struct(parts(a).alias("x"), parts(b).alias("y")), share))


def _common_front(a: Column, b: Column) -> Column:
    """How many children stand alike at the front of two lists of nodes."""
    differ = F.zip_with(F.transform(a, lambda x: x["h"]), F.transform(b, lambda x: x["h"]), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _length(paragraph: Column) -> Column:
    """Code points of a paragraph, the space or line break after each of its leaves included."""
    return F.aggregate(paragraph["leaves"], F.lit(0), lambda n, x: n + x["n"] + 1)


def _front(a: Column, b: Column) -> Column:
    """Code points at the front of tree a that tree b has as well, to the first leaf that differs.

    Only the branch that differs is gone down: the first differing section, in it the first differing paragraph, in it the
    first differing leaf.
    """

    def down(k: Column) -> Column:
        # equal sections hold equal paragraphs, so both trees go on at the same paragraph
        first = F.aggregate(F.slice(a["sections"], F.lit(1), k), F.lit(0), lambda n, x: n + x["n"])

        def in_section(at: Column) -> Column:
            pa, pb = (F.slice(t["paragraphs"], at + 1, F.coalesce(F.try_element_at(t["sections"], k + 1)["n"], F.lit(0))) for t in (a, b))

            def in_paragraph(j: Column) -> Column:
                before = F.aggregate(F.slice(a["paragraphs"], F.lit(1), at + j), F.lit(0), lambda n, p: n + _length(p))
                la, lb = (F.coalesce(F.try_element_at(p, j + 1)["leaves"], F.array().cast("array<struct<h:string,n:int>>")) for p in (pa, pb))
                ended = lambda k: F.when((k > 0) & (k == F.least(F.size(la), F.size(lb))), 1).otherwise(0)  # noqa: E731  # one paragraph ends here, the other goes on
                return _let(_common_front(la, lb), lambda k: before + F.aggregate(F.slice(la, F.lit(1), k), F.lit(0), lambda n, x: n + x["n"] + 1) - ended(k))

            return _let(_common_front(pa, pb), in_paragraph)

        return _let(first, in_section)

    return _let(_common_front(a["sections"], b["sections"]), down)


def _reversed(t: Column) -> Column:
    turned = F.transform(F.reverse(t["paragraphs"]), lambda p: F.struct(p["h"].alias("h"), F.reverse(p["leaves"]).alias("leaves")))
    return F.struct(t["root"].alias("root"), F.reverse(t["sections"]).alias("sections"), turned.alias("paragraphs"))


def edit_place(a: Column, b: Column) -> Column:
    """Where tree b differs from tree a: struct (start, stop) of code points of a's text, from the first differing leaf to the
    end of the last one; null if the roots are equal. Text put in between two leaves has start = stop."""
    n, of_b = (F.aggregate(t["paragraphs"], F.lit(0), lambda k, p: k + _length(p)) - 1 for t in (a, b))

    def place(x: Column) -> Column:
        front = F.least(x["front"], x["n"], x["m"])  # the last leaf has no space or line break after it
        stop = x["n"] - F.least(x["back"], x["n"] - front, x["m"] - front)
        return F.struct(front.alias("start"), stop.alias("stop"))

    sides = F.struct(_front(a, b).alias("front"), _front(_reversed(a), _reversed(b)).alias("back"), n.alias("n"), of_b.alias("m"))
    return F.when(a["root"] != b["root"], _let(sides, place))


def edited_tail(text: Column, patch: Column) -> Column:
    """The text without its last quarter of code points (rounded down), and the patch after it."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 4).cast("int")), patch)


def with_neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, text, tree, fingerprint, patch, next_fingerprint): each document with what it takes from the next one by id.

    A document is a pair of id and text (null: empty), its id of any type with an order; its next one is the first above it by
    id, then by hash of the text, null ids first, and the first of all after the last. Rows that repeat a document have the
    same next one and all come back. patch is the next document's first floor(n/4) code points, n being this one's. The order
    is found over ids and lengths alone, in ranges of ids whose ends are joined by one row a range; texts are then moved once,
    by hashes of id and text, and each sends its patch and fingerprint to the one before it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = rows.select(F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    # both sides of the last join start from these columns dealt out by k and h: Spark moves the texts once for both
    rows = named.select("k", "h", "text")
    ids = named.groupBy("doc_id", "k", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies"))
    ids = materialize(ids.repartitionByRange("doc_id", "h").withColumn("part", F.spark_partition_id()), "order")
    me = F.struct("k", "h", "n")
    ends = ids.groupBy("part").agg(F.max(F.struct("doc_id", "h", "k", "n")).alias("e")).select("part", F.struct("e.k", "e.h", "e.n").alias("last"))
    everything = W.partitionBy().orderBy("part")
    ends = materialize(
        ends.select(
            "part",
            F.coalesce(F.lag("last").over(everything), F.last("last").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"),
        ),
        "ends",
    )
    inside = W.partitionBy("part").orderBy("doc_id", "h")
    order = ids.join(F.broadcast(ends), "part").select("k", "h", "doc_id", "copies", F.coalesce(F.lag(me).over(inside), "before").alias("p"))  # one row a partition
    order = materialize(order.select("k", "h", "doc_id", "copies", F.col("p.k").alias("pk"), F.col("p.h").alias("ph"), F.floor(F.col("p.n") / 4).cast("int").alias("take")), "previous")
    mine = rows.repartition("k", "h").join(order, ["k", "h"]).withColumn("copy", F.row_number().over(W.partitionBy("k", "h").orderBy("k"))).where("copy = 1")
    printed = mine.withColumn("tree", tree(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("tree")))
    sent = printed.select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.expr("substring(text, 1, take)").alias("patch"), F.col("fingerprint").alias("next_fingerprint"))
    out = printed.join(sent, ["k", "h"]).select("doc_id", "text", "tree", "fingerprint", "patch", "next_fingerprint", "copies")
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_neighbours(table(spark, sf_dir, "documents")).withColumn("edited", edited_tail(F.col("text"), F.col("patch"))).withColumn("edited_tree", tree(F.col("edited")))
    prints = pairs.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"), "next_fingerprint", edit_place(F.col("tree"), F.col("edited_tree")).alias("edit"),
    )
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("edit.start").alias("edit_start"), F.col("edit.stop").alias("edit_stop"),
    )


QUERIES = {"op7_merkle": op7_merkle}
ORACLES: dict[str, str] = {}
