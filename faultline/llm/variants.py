"""Spelling variants by a dictionary of trie-node pairs.

Words stand in a trie, their reversals in a second one, and every node of both has an integer. A
word is then a list of pairs (prefix node, suffix node): the pair around a skipped code point, for
each of its code points, and the pair around each gap between them. Two words of one length that
differ in one code point share a skip pair; a word that lacks one code point of another has a gap
pair that is a skip pair of the longer one. No other words share pairs, so integers are compared
once and every match is exact. Of equal code points in a row only the first is matched with gaps:
skipping another gives the same shorter word. So each near word meets its partner in one pair.

Nodes are numbered without gathering the words: they are sorted by ranges, each task walks its own
with a stack of nodes, and the few nodes that a range shares with the one before are mapped to the
latter's numbers. A range sends one row to the driver and receives one: its first and last word with
its path, so the driver holds at most ranges x longest word numbers.

One pair holds at most one gap and as many skips as there are letters, hence no group is hot, and a
word of any length costs two numbers per code point. Near words are counted within the pair; pairs of
words are not written out.

Null and empty texts have no words; a null doc_id is empty text in the hash; repeated rows count again.
Extra columns are ignored. Words are distinct; repeated or null words of a given table are not allowed.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm import common
from faultline.session import cut_lineage

#: UTF-8 sequences that are neither ASCII nor a letter from U+00C0 to U+00FF.
_FOREIGN = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
#: Everything that no letter holds becomes a space; continuation bytes here belong to letters.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))

GAP, SKIP, FIRST_SKIP = 0, 1, 2


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case."""
    return _FOREIGN.sub(b" ", text.lower()).translate(_LETTERS).split()


def dropped(run: bytes, h: int) -> bytes:
    """The run without the code point that the hash picks."""
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def count_words(docs: DataFrame, every: int = 199, shortest: int = 6, fewest: int = 5) -> DataFrame:
    """word, n: words of at least `shortest` code points that occur `fewest` times or more.

    Where `every` divides crc32("<doc_id>:<run>"), the run loses one code point.
    """
    def count(batch: pa.RecordBatch) -> dict:
        found: Counter[bytes] = Counter()
        ids = batch.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, common.utf8(batch.column("text"))):
            seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
            for run, n in Counter(runs(text)).items():
                # A code point takes one byte at least.
                if len(run) < shortest:
                    continue
                h = zlib.crc32(run, seed)
                if h % every == 0:
                    run = dropped(run, h)
                found[run] += n
        kept = [(w, n) for w, n in found.items() if len(w) >= shortest]
        return {"word": [w.decode() for w, _ in kept], "n": [n for _, n in kept]}

    counted = common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), count, "word string, n long")
    return counted.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def trie_paths(words: DataFrame, column: str) -> DataFrame:
    """Adds `path`, the node numbers of all prefixes of the word, from the root on.

    Equal prefixes have equal numbers in the whole table. Numbers of whole words rise with the words.
    """
    spark = words.sparkSession
    target = words.select(
        "*", F.lit(0).cast("int").alias("range"), F.array().cast("array<long>").alias("path")
    ).limit(0).schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, stack, used = "", [], 0
        for batch in batches:
            paths = []
            for word in batch.column(column).to_pylist():
                shared = len(os.path.commonprefix([before, word]))
                # No node is known before the first word of the range, the root included.
                stack = stack[: shared + 1]
                stack = stack + [used + i for i in range(len(stack), len(word) + 1)]
                used += len(word) + 1
                before = word
                paths.append(stack)
            columns = [*batch.columns, pa.array([part] * len(paths), pa.int32()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "range", "path"])

    walked = cut_lineage(
        words.repartitionByRange(column).sortWithinPartitions(column).mapInArrow(walk, target), "trie"
    )
    ends = walked.groupBy("range").agg(
        F.min(column).alias("first"), F.max(column).alias("last"), F.max_by("path", column).alias("path"),
        F.sum(F.length(column) + 1).alias("used"),
    )
    moved, base, last, path = [], 0, None, []
    for row in sorted(ends.collect(), key=lambda r: r["first"]):
        known = [] if last is None else path[: len(os.path.commonprefix([last, row["first"]])) + 1]
        moved.append((row["range"], base, known))
        # Up to its length, local numbers are the nodes of the range's first word, by depth.
        path = [known[x] if x < len(known) else base + x for x in row["path"]]
        last, base = row["last"], base + row["used"]
    moves = spark.createDataFrame(moved, "range int, base long, known array<long>")
    number = F.transform(
        "path",
        lambda x: F.coalesce(F.get("known", F.least(x, F.size("known")).cast("int")), F.col("base") + x),
    )
    # One row for each range of the sort.
    return walked.join(F.broadcast(moves), "range").select(*words.columns, number.alias("path"))


def node_pairs(words: DataFrame) -> DataFrame:
    """id, n, prefix, suffix, role: all node pairs of all words. Ids rise with the words."""
    forward = trie_paths(words.select("word", "n"), "word")
    backward = trie_paths(words.select(F.reverse("word").alias("drow")), "drow")
    both = forward.join(backward.select(F.reverse("drow").alias("word"), F.col("path").alias("back")), "word")
    size = F.size("path")
    letters = F.split("word", "")

    def pair(i, role):
        skipped = F.when(role == GAP, 0).otherwise(1)
        return F.struct(
            F.get("path", i).alias("prefix"), F.get("back", size - 1 - skipped - i).alias("suffix"), role.alias("role")
        )

    def skip(i):
        same = F.coalesce(F.get("letters", i) == F.get("letters", i - 1), F.lit(False))
        return pair(i, F.when(same & (i > 0), SKIP).otherwise(FIRST_SKIP))

    positions = F.sequence(F.lit(0), size - 1)
    gaps = F.transform(positions, lambda i: pair(i, F.lit(GAP)))
    skips = F.transform(F.slice(positions, 1, size - 1), skip)
    return both.withColumn("letters", letters).select(
        "word", "n", F.element_at("path", -1).alias("id"), F.concat(gaps, skips).alias("pairs")
    )


def near_words(pairs: DataFrame) -> DataFrame:
    """id, n_near, best (n, minus id): how many near words a word has, and the most frequent of them."""
    rows = pairs.select("id", "n", F.inline("pairs"))
    group = Window.partitionBy("prefix", "suffix").orderBy(F.desc("n"), "id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    own = F.struct("n", (-F.col("id")).alias("minus"))
    is_gap, is_skip, is_first = F.col("role") == GAP, F.col("role") != GAP, F.col("role") == FIRST_SKIP
    met = rows.select(
        "id", "role",
        F.sum(is_skip.cast("int")).over(group).alias("skips"),
        F.sum(is_first.cast("int")).over(group).alias("firsts"),
        F.first(F.when(is_gap, own), ignorenulls=True).over(group).alias("gap"),
        F.first(F.when(is_skip, own), ignorenulls=True).over(group).alias("top"),
        F.nth_value(F.when(is_skip, own), 2, ignoreNulls=True).over(group).alias("second"),
        F.first(F.when(is_first, own), ignorenulls=True).over(group).alias("top_first"),
    )
    other = F.when(F.col("top.minus") == -F.col("id"), F.col("second")).otherwise(F.col("top"))
    gap = F.when(is_first, F.col("gap"))
    near = F.when(is_gap, F.col("firsts")).otherwise(F.col("skips") - 1 + gap.isNotNull().cast("int"))
    best = F.when(is_gap, F.col("top_first")).otherwise(F.greatest(other, gap))
    return met.select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max("best").alias("best")
    )


def last_targets(links: DataFrame) -> DataFrame:
    """id, last: where the links (id, to) of a forest end, by doubling their length every round."""
    links = cut_lineage(links.select("id", "to"), "links")
    while True:
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        grown = cut_lineage(links.join(ahead, "to", "left").select("id", F.coalesce("further", "to").alias("to"), "further"), "links")
        if grown.where("further is not null").isEmpty():
            return grown.select("id", F.col("to").alias("last"))
        links = grown.select("id", "to")


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct words with their counts.

    A word's form is its most frequent near word (ties: the smallest), if that is `factor` times as
    frequent; its root is where forms lead. Counts rise by the factor, so chains are short.
    """
    pairs = cut_lineage(node_pairs(words), "pairs")
    near = cut_lineage(near_words(pairs), "near")
    known = pairs.select("id", "word", "n")
    common_enough = F.col("best.n") >= factor * F.col("n")
    judged = cut_lineage(known.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common_enough, -F.col("best.minus")).alias("to"),
        F.when(common_enough, F.col("best.n")).alias("form_n"),
    ), "judged")
    links = judged.where("to is not null")
    ends = links.select("id", "to").join(last_targets(links), "id")
    forms = known.select(F.col("id").alias("to"), F.col("word").alias("form"))
    roots = known.select(F.col("id").alias("last"), F.col("word").alias("root"))
    named = ends.join(forms, "to").join(roots, "last").select("id", "form", "root")
    return judged.join(named, "id", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
