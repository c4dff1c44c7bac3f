"""Document fingerprints: a Merkle tree over sections and paragraphs, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, let, range_bounds

#: A section ends after an empty line, a paragraph after a line break; both keep their line breaks.
SECTION_END = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH_END = r"(?<=\n)(?=[^\n])"
#: Atoms of a paragraph are what its spaces part. One of more than LONG characters ends where the characters around say
#: so, wherever they stand: after a character of a script without spaces, and in a long run after a vowel or digit.
LONG = 24
ATOM_END = r"(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])(?=\S)|(?<=[aeiouAEIOU0-9])(?<=\S{25})(?=\S)"
ROWS_PER_BUCKET = 1_000


def _node(kind: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), content).cast("binary"), 256)


def _cut(text: Column, mark: str, pattern: str) -> Column:
    """text split by a pattern that matches only where it has the mark."""
    return F.when(F.contains(text, F.lit(mark)), F.split(text, pattern, -1)).otherwise(F.array(text))


def _leaves(paragraph: Column) -> Column:
    """64-bit hashes of a paragraph's finest branches: every two atoms in a row, so an edit changes those around it only;
    none for an empty paragraph."""
    fine = lambda w: F.when(F.length(w) > LONG, F.split(w, ATOM_END, -1)).otherwise(F.array(w))
    atoms = lambda words: F.when(F.exists(words, lambda w: F.length(w) > LONG), F.flatten(F.transform(words, fine))).otherwise(words)
    # The last atom is in the pair before it, unless it is the only one.
    pairs = lambda a: F.slice(F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 1))), F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    leaves = let(let(F.split(paragraph, " ", -1), atoms), pairs)
    return F.when(F.length(paragraph) > 0, leaves).otherwise(F.array().cast("array<bigint>"))


def tree(text: Column) -> Column:
    """struct(root, sections): per section its hash, its paragraphs' hashes and their leaves.

    A leaf is a 64-bit hash of two atoms. The other nodes are SHA-256 in hex: a paragraph's covers its characters and
    its leaves, a section's its paragraphs' hashes, the root the sections' hashes; each kind of node has its own
    prefix. So equal texts have equal roots and unequal texts have unequal ones.
    """

    def paragraph(p: Column) -> Column:
        return let(_leaves(p), lambda x: F.struct(_node("p", F.concat(p, F.lit(":"), F.xxhash64(x).cast("string"))).alias("hash"), x.alias("leaves")))

    def section(s: Column) -> Column:
        hashes = lambda p: F.transform(p, lambda x: x["hash"])
        made = lambda p: F.struct(_node("s", F.array_join(hashes(p), "")).alias("hash"), hashes(p).alias("paragraphs"), F.flatten(F.transform(p, lambda x: x["leaves"])).alias("leaves"))
        return let(F.transform(_cut(s, "\n", PARAGRAPH_END), paragraph), made)

    root = lambda s: F.struct(_node("d", F.array_join(F.transform(s, lambda x: x["hash"]), "")).alias("root"), s.alias("sections"))
    return let(F.transform(_cut(text, "\n\n", SECTION_END), section), root)


def branches(tree: Column) -> Column:
    """A tree's leaves in order."""
    return F.flatten(F.transform(tree["sections"], lambda s: s["leaves"]))


def pieces(text: Column) -> Column:
    """The leaves of a text's tree in order; none for an empty text."""
    return branches(tree(text))


def differing_branches(a: Column, b: Column) -> Column:
    """Where two trees differ: (section, paragraph) positions, from 0, whose hashes are not the same in both.

    Equal roots give an empty array at once; only sections with unequal hashes are descended into.
    """
    missing = lambda x: F.coalesce(x, F.array().cast("array<string>"))

    def inside(i: Column) -> Column:
        p, q = F.get(a["sections"], i), F.get(b["sections"], i)
        p_in, q_in = missing(p["paragraphs"]), missing(q["paragraphs"])
        at = F.sequence(F.lit(0), F.greatest(F.size(p_in), F.size(q_in)) - 1)
        differ = F.filter(at, lambda j: ~F.get(p_in, j).eqNullSafe(F.get(q_in, j)))
        return F.when(p["hash"].eqNullSafe(q["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.transform(differ, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        )

    every = F.sequence(F.lit(0), F.greatest(F.size(a["sections"]), F.size(b["sections"])) - 1)
    none = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.when(a["root"] == b["root"], none).otherwise(F.flatten(F.transform(every, inside)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of leaves as sets: 2 |A and B| / (|A| + |B|); 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(2 * both / (every + both))


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each document's doc_id and text (null: empty) and its tree, with those of the next one in ascending doc_id.

    After the last comes the first; rows without a doc_id come last; ties go by a hash of the text. One shuffle moves
    each text once to its range bucket; the first row of a bucket also goes to the bucket before it, where only its
    predecessor uses it, so no window spans more than one bucket.
    """
    bounds = range_bounds(docs, "doc_id", rows_per_bucket)
    last = max(0, len(bounds) - 1)
    key = F.col("doc_id")
    own = F.when(key.isNull(), F.lit(last)).otherwise(bucket_of(key, bounds)).cast("int")
    place = lambda bucket, lent: F.struct(bucket.cast("int").alias("bucket"), F.lit(lent).alias("lent"))
    before = F.when(own == 0, F.lit(last)).otherwise(own - 1)
    leads = key.isin(bounds) if last == 0 else key == F.get(F.lit(bounds), own)
    leads = F.coalesce(leads, F.lit(not bounds))
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.when(leads, F.array(place(own, False), place(before, True))).otherwise(F.array(place(own, False)))).alias("p"))
    placed = placed.select("doc_id", "text", "p.bucket", "p.lent").repartition("bucket").withColumn("tree", tree(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("lent", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    ahead = F.lead(F.struct("text", "tree")).over(w)
    return placed.withColumn("next", ahead).filter(~F.col("lent")).select("doc_id", "text", "tree", F.col("next.text").alias("next_text"), F.col("next.tree").alias("next_tree"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last floor(n_chars / 2) code points are replaced
    by the first as many (or all) of the next document's.

    Reads doc_id and text (null: empty). Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint
    (the trees' roots), near_edited and near_next (likeness of the tree's leaves to the edited and to the next text's),
    first_edit (section and paragraph of the first differing branch; null if the edit changes nothing).
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return (
        with_next(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
        .withColumn("edited_tree", tree(F.col("edited")))
        .withColumn("leaves", branches(F.col("tree")))
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            F.col("tree.root").alias("fingerprint"),
            F.col("edited_tree.root").alias("edited_fingerprint"),
            likeness(F.col("leaves"), branches(F.col("edited_tree"))).alias("near_edited"),
            likeness(F.col("leaves"), branches(F.col("next_tree"))).alias("near_next"),
            F.get(differing_branches(F.col("tree"), F.col("edited_tree")), 0).alias("first_edit"),
        )
    )
