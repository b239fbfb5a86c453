"""Exact Jaccard join of documents by their distinct word 4-grams, and its connected components.

A document's set holds 64-bit hashes of its shingles; equal sets are one node, so copies enter the
join once.  Shingles are ordered by how often they occur (counted in a table of fixed size), rarest
first, and two sets that reach the threshold share a shingle of their prefixes.  The prefixes make
index lists.

* Every set of a list is first compared with the list's leader alone, so a list costs as many
  comparisons as it has sets.  The leader is the set in which the list's shingle comes earliest: the
  one with the fewest shingles of its own, as the original of edited copies is.  Sets linked to one
  leader are answered by that: they are one component, and no pair among them is looked at again.
* What can be missing are links between different components of a list.  Its entries are cut into
  blocks by size and position; two blocks whose positions leave too few common shingles are skipped
  as a whole.  Known similarities to the leader rule out further pairs, since Jaccard distance obeys
  the triangle inequality.  The pairs that are left are compared exactly.

Before sets are compared, counts of their shingles in 256 bins bound what they can share.

So no link is lost, and no group of copies is expanded into its pairs.  Lists are streamed in sorted
order, however long.

Null, blank and empty texts have empty sets, which link with nothing.  Texts under four words have
one shingle, the whole sequence.  Rows are nodes of their own: rows with one ``doc_id`` and other texts
are not linked by the id.  A null ``doc_id`` is ignored as a component's name unless all its ids are
null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import stored, unused, with_text
from fleetspeed.llm.words import SMALL_BLOCK, mix, ngrams, u64, word_blocks


@dataclass(frozen=True)
class Join:
    shingle: int = 4
    percent: int = 85  # least 100 * intersection / union
    count_bits: int = 18  # slots of the frequency table: 2 ** count_bits
    position_block: int = 16  # positions of an index list that are skipped together


def needed(join: Join, both: Column) -> Column:
    """Least intersection of two sets whose sizes add up to ``both``."""
    part = 100 + join.percent
    return F.floor((both * join.percent + part - 1) / part)


def document_sets(column: pa.Array, join: Join) -> Iterator[tuple[int, np.ndarray]]:
    """Row and distinct shingle hashes, sorted, of every text."""
    for words in word_blocks(column, block=SMALL_BLOCK):
        grams, at = ngrams(words, join.shingle)
        bounds = np.searchsorted(at, words.first)
        for row in range(words.rows):
            count = words.first[row + 1] - words.first[row]
            if count >= join.shingle:
                yield words.row + row, np.unique(grams[bounds[row] : bounds[row + 1]])
            elif count:
                own = words.hash[words.first[row] : words.first[row + 1]]
                whole = np.zeros(1, u64) + u64(count)
                for h in own:
                    whole = whole * u64(0xC2B2AE3D27D4EB4F) + h
                yield words.row + row, mix(whole)
            else:
                yield words.row + row, np.zeros(0, u64)


def node_of(tokens: np.ndarray) -> int:
    """A set's name: a hash of its elements and their number."""
    total = mix(tokens ^ u64(0x5851F42D4C957F2D)).sum(dtype=u64) + u64(len(tokens))
    return int(mix(np.array([total], u64)).view(np.int64)[0])


def _slot(tokens: np.ndarray, join: Join) -> np.ndarray:
    return (tokens >> u64(64 - join.count_bits)).astype(np.int64)


def _sketch(tokens: np.ndarray) -> bytes | None:
    """How many shingles fall into each of 256 bins; none for sets with a full bin."""
    bins = np.bincount((tokens >> u64(8) & u64(255)).astype(np.int64), minlength=256)
    return bins.astype(np.uint8).tobytes() if bins.max() < 256 else None


def _signed(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, node = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        sketches = [None] * len(batch)
        for row, tokens in document_sets(batch["text"], join):
            n[row], node[row], sketches[row] = len(tokens), node_of(tokens), _sketch(tokens)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n), pa.array(node), pa.array(sketches, pa.binary())], ["doc_id", "n", "node", "sketch"]
        )


def _counted(batches: Iterator[pa.RecordBatch], join: Join) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << join.count_bits, np.int64)
    for batch in batches:
        for words in word_blocks(batch["text"]):
            grams, _ = ngrams(words, join.shingle)
            table += np.bincount(_slot(grams, join), minlength=len(table))
    slots = np.flatnonzero(table)
    for low in range(0, len(slots), 1 << 16):
        part = slots[low : low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], ["slot", "n"])


def shingle_counts(texts: DataFrame, join: Join) -> np.ndarray:
    """Occurrences by slot over all documents."""
    rows = (
        texts.select("text")
        .mapInArrow(lambda batches: _counted(batches, join), "slot long, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most 2 ** count_bits rows
    )
    counts = np.zeros(1 << join.count_bits, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, join: Join) -> Iterator[pa.RecordBatch]:
    """(shingle, node, size and position) of each set's prefix in the order of rising counts."""
    for batch in batches:
        tokens, nodes, places = [], [], []
        for _, own in document_sets(batch["text"], join):
            n = len(own)
            if not n:
                continue
            length = n - -(-n * join.percent // 100) + 1
            keys = counts[_slot(own, join)]
            if length < n:
                low = np.flatnonzero(keys <= np.partition(keys, length - 1)[length - 1])
            else:
                low = np.arange(n)
            order = low[np.lexsort((own[low], keys[low]))][:length]
            tokens.append(own[order])
            nodes.append(np.full(length, node_of(own)))
            places.append((np.int64(n) << 31) | np.arange(length))
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, nodes, places)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.view(np.int64)) for c in columns], ["token", "node", "place"]
        )


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the lists with two nodes or more, each with its list's first entry.

    The rows come sorted by token, position and node; only the open list's first entry is kept meanwhile.
    """
    names = ["token", "node", "place", "leader", "leader_place"]
    token = leader = place = None  # first entry of the open list
    told = True  # whether that entry was already given out
    for batch in batches:
        t, n, p = (batch[k].to_numpy() for k in ("token", "node", "place"))
        if not len(t):
            continue
        if token is not None:
            t, n, p = np.append(token, t), np.append(leader, n), np.append(place, p)
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        head = np.repeat(starts, np.diff(np.append(starts, len(t))))
        other = n != n[head]
        shared = np.zeros(len(t), bool)
        shared[head[other]] = True
        out = other.copy()
        out[1:] &= n[1:] != n[:-1]  # repeated entries of one set
        out[starts] = shared[starts]
        if token is not None and told:
            out[0] = False
        pick = np.flatnonzero(out)
        if len(pick):
            h = head[pick]
            columns = (t[pick], n[pick], p[pick], n[h], p[h])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        last = starts[-1]
        carried = token is not None and last == 0
        told = bool(shared[last]) or (told and carried)
        token, leader, place = t[last], n[last], p[last]


def index_lists(texts: DataFrame, counts, join: Join) -> DataFrame:
    """Prefix entries of all lists that two nodes or more share."""
    prefixes = texts.select("text").mapInArrow(
        lambda batches: _prefixes(batches, counts.value, join), "token long, node long, place long"
    )
    schema = "token long, node long, place long, leader long, leader_place long"
    low = (1 << 31) - 1

    def unpacked(name: str, size: str, at: str) -> list[Column]:
        value = F.col(name)
        return [F.shiftright(value, 31).alias(size), value.bitwiseAND(F.lit(low)).alias(at)]

    return (
        prefixes.repartition("token")
        .sortWithinPartitions("token", F.col("place").bitwiseAND(F.lit(low)), "node")
        .mapInArrow(_led, schema)
        .select(
            "token", "node", *unpacked("place", "n", "at"), "leader", *unpacked("leader_place", "leader_n", "leader_at")
        )
    )


def _may_link(join: Join, n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Length and positional filter for two sets that share a shingle at the given positions."""
    fits = (n * 100 >= other_n * join.percent) & (other_n * 100 >= n * join.percent)
    return fits & (F.least(n - at, other_n - other_at) >= needed(join, n + other_n))


def _wanted_sets(batches: Iterator[pa.RecordBatch], table: np.ndarray, join: Join) -> Iterator[pa.RecordBatch]:
    mask = len(table) - 1
    for batch in batches:
        nodes, sets = [], []
        for _, tokens in document_sets(batch["text"], join):
            if len(tokens) and table[(node := node_of(tokens)) & mask]:
                nodes.append(node)
                sets.append(tokens.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"]
        )


def _slot_table(nodes: DataFrame) -> np.ndarray:
    """A table of at most 2 ** 24 slots in which every node's slot is set; others pass by chance only."""
    bits = min(max(int(nodes.count() * 16).bit_length(), 10), 24)
    slots = nodes.select(F.col("node").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")).distinct().toArrow()
    table = np.zeros(1 << bits, bool)
    table[slots["slot"].to_numpy()] = True
    return table


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most shingles two sets can share, by their sketches; null where one has none."""
    for batch in batches:
        known = np.array(batch["mine"].is_valid()) & np.array(batch["theirs"].is_valid())
        rows = batch.filter(pa.array(known))
        mine, theirs = (
            np.frombuffer(b"".join(rows[k].to_pylist()), np.uint8).reshape(-1, 256) for k in ("mine", "theirs")
        )
        bound = np.zeros(len(batch), np.int64)
        bound[known] = np.minimum(mine, theirs).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch["node"], batch["other"], pa.array(bound, mask=~known), batch["both"]], ["node", "other", "bound", "both"]
        )


def compared(spark: SparkSession, texts: DataFrame, signed: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs with the size of their intersection (``common``) and of both sets, and whether it is ``exact``.

    Where the sketches show that a pair can't link, ``common`` is what it can have at most.
    """
    nodes = pairs.select("node").union(pairs.select(F.col("other").alias("node"))).distinct()
    sketches = signed.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    bounded = (
        pairs.join(sketches.select("node", F.col("n").alias("my_n"), F.col("sketch").alias("mine")), "node")
        .join(sketches.select(F.col("node").alias("other"), F.col("n").alias("their_n"), F.col("sketch").alias("theirs")), "other")
        .select("node", "other", "mine", "theirs", (F.col("my_n") + F.col("their_n")).alias("both"))
        .mapInArrow(_bounded, "node long, other long, bound long, both long")
    )
    bounded = stored(spark, bounded, "bounded-pairs")
    hopeless = F.coalesce(F.col("bound") < needed(join, F.col("both")), F.lit(False))
    ruled_out = bounded.where(hopeless).select("node", "other", F.col("bound").alias("common"), "both", F.lit(False).alias("exact"))
    counted = verified(spark, texts, bounded.where(~hopeless).select("node", "other"), join)
    return counted.withColumn("exact", F.lit(True)).union(ruled_out)


def verified(spark: SparkSession, texts: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs (``node``, ``other``) with the size of their intersection and of both sets."""
    nodes = pairs.select("node").union(pairs.select(F.col("other").alias("node"))).distinct()
    shared = spark.sparkContext.broadcast(_slot_table(nodes))
    # Both joins read one shuffle of the sets, dealt by node.
    sets = (
        texts.select("text")
        .mapInArrow(lambda batches: _wanted_sets(batches, shared.value, join), "node long, tokens array<long>")
        .join(nodes, "node", "left_semi")
        .groupBy("node")
        .agg(F.first("tokens").alias("tokens"))
    )
    return (
        pairs.join(sets.select("node", F.col("tokens").alias("mine")), "node")
        .join(sets.select(F.col("node").alias("other"), F.col("tokens").alias("theirs")), "other")
        .select(
            "node",
            "other",
            F.size(F.array_intersect("mine", "theirs")).cast("long").alias("common"),
            (F.size("mine") + F.size("theirs")).cast("long").alias("both"),
        )
    )


def linked(join: Join) -> Column:
    return F.col("common") >= needed(join, F.col("both"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, of all nodes in ``links`` (``node``, ``other``)."""
    edges = stored(
        spark, links.select("node", "other").union(links.select("other", "node")).distinct(), "component-edges"
    )
    labels = stored(
        spark, edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "component-labels"
    )
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("other"), F.col("component").alias("_near")), "other")
            .groupBy("node")
            .agg(F.min("_near").alias("_near"))
        )
        step = labels.join(near, "node").select("node", "component", F.least("component", "_near").alias("_new"))
        # Labels are nodes: follow the label's own label as well.
        beyond = labels.select(F.col("node").alias("_new"), F.col("component").alias("_beyond"))
        new = stored(
            spark,
            step.join(beyond, "_new", "left").select(
                "node", F.least("_new", "_beyond").alias("component"), (F.least("_new", "_beyond") < F.col("component")).alias("_moved")
            ),
            "component-labels",
        )
        if not new.where("_moved").head(1):
            return new.select("node", "component")
        labels = new.select("node", "component")


def _remaining_pairs(lists: DataFrame, groups: DataFrame, similar: DataFrame, join: Join) -> DataFrame:
    """Pairs of different components that share a list and that no filter rules out."""
    least = 1 - F.col("common") / (F.col("both") - F.col("common"))
    known = similar.select(
        "node", F.col("other").alias("leader"), least.alias("far"), F.when(F.col("exact"), least).otherwise(1.0).alias("farthest")
    )
    # Pairs with the leader have been compared, so only the others of a list are looked at.
    entries = (
        lists.where(F.col("node") != F.col("leader"))
        .select("token", "node", "n", "at", "leader")
        .join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    mixed = (
        entries.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("token")
    )
    step = float(np.log(100 / join.percent)) * (1 + 1e-9)
    entries = (
        entries.join(mixed, "token")
        .join(known, ["node", "leader"], "left")
        .withColumn("far", F.coalesce("far", F.lit(0.0)))
        .withColumn("farthest", F.coalesce("farthest", F.lit(1.0)))
        .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step))
        .withColumn("stretch", F.floor(F.col("at") / join.position_block))
    )
    block = ["token", "band", "stretch"]
    blocks = entries.groupBy(*block).agg(
        F.min("n").alias("least_n"), F.max(F.col("n") - F.col("at")).alias("most_left"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    )
    # Sets that may link differ by one band of sizes at most.
    left = blocks.select("token", *(F.col(c).alias(f"a_{c}") for c in blocks.columns[1:])).withColumn(
        "near", F.explode(F.array(F.col("a_band"), F.col("a_band") + 1))
    )
    right = blocks.select("token", *(F.col(c).alias(f"b_{c}") for c in blocks.columns[1:])).withColumn("near", F.col("b_band"))
    block_pairs = left.join(right, ["token", "near"]).where(
        ((F.col("a_band") < F.col("b_band")) | (F.col("a_stretch") <= F.col("b_stretch")))
        & ((F.col("a_low") != F.col("b_high")) | (F.col("a_high") != F.col("b_low")))
        & (F.least("a_most_left", "b_most_left") >= needed(join, F.col("a_least_n") + F.col("b_least_n")))
    )
    columns = ["node", "n", "at", "component", "far", "farthest"]

    def side(name: str) -> DataFrame:
        return entries.select(
            "token",
            F.col("band").alias(f"{name}_band"),
            F.col("stretch").alias(f"{name}_stretch"),
            *(F.col(c).alias(f"{name}_{c}") for c in columns),
        )

    distance = F.lit((100 - join.percent) / 100 + 1e-9)
    pairs = (
        block_pairs.select("token", "a_band", "a_stretch", "b_band", "b_stretch")
        .join(side("a"), ["token", "a_band", "a_stretch"])
        .join(side("b"), ["token", "b_band", "b_stretch"])
        .where(
            (F.col("a_component") != F.col("b_component"))
            & _may_link(join, F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at"))
            & (F.col("a_far") - F.col("b_farthest") <= distance)
            & (F.col("b_far") - F.col("a_farthest") <= distance)
        )
    )
    return pairs.select(F.least("a_node", "b_node").alias("node"), F.greatest("a_node", "b_node").alias("other")).distinct()


def node_components(spark: SparkSession, texts: DataFrame, signed: DataFrame, join: Join) -> DataFrame:
    """``node`` and ``component`` of all nodes that link with another node."""
    counts = spark.sparkContext.broadcast(shingle_counts(texts, join))  # 2 ** count_bits numbers
    lists = stored(spark, index_lists(texts, counts, join), "join-lists")
    with_leader = (
        lists.where(F.col("node") != F.col("leader"))
        .where(_may_link(join, F.col("n"), F.col("at"), F.col("leader_n"), F.col("leader_at")))
        .select("node", F.col("leader").alias("other"))
        .distinct()
    )
    with_leader = stored(spark, with_leader, "leader-pairs")
    similar = stored(spark, compared(spark, texts, signed, with_leader, join), "leader-links")
    links = similar.where(linked(join)).select("node", "other")
    groups = components(spark, links)
    remaining = stored(spark, _remaining_pairs(lists, groups, similar, join), "remaining-pairs")
    more = stored(spark, compared(spark, texts, signed, remaining, join).where(linked(join)), "remaining-links")
    if not more.head(1):
        return groups
    return components(spark, links.union(more.select("node", "other")))


def classes(spark: SparkSession, docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, the set's ``node`` and the component's least node of every row."""
    texts = with_text(docs)
    schema = "doc_id long, n long, node long, sketch binary"
    signed = stored(spark, texts.mapInArrow(lambda b: _signed(b, join), schema), "join-nodes")
    groups = node_components(spark, texts, signed.where("n > 0").select("node", "n", "sketch"), join)
    signed = signed.drop("sketch")
    named = signed.where("n > 0").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    full = named.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "node", "component")
    empty = signed.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "node", F.col("node").alias("component")
    )
    return full.union(empty)


def keep_one(spark: SparkSession, docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One document of each component, that with the smallest ``doc_id``, with its columns as they are.

    Of several rows with that id one set stays, and of repeated rows one row.  Documents with empty
    sets all stay.
    """
    found = stored(spark, classes(spark, docs, join).where("n_shingles > 0"), "join-classes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first")
    keepers = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_node"))
    rows = found.groupBy(F.col("doc_id").alias("_own"), F.col("node").alias("_own_node")).agg(F.count("*").alias("_rows"))
    keepers = stored(
        spark,
        keepers.join(rows, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_node") == F.col("_own_node"))).select(
            "_id", "_node", "_rows"
        ),
        "join-keepers",
    )
    size, node = unused(docs, "_n"), unused(docs, "_set")

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = next(_signed(iter([batch.select(["doc_id", "text"])]), join))
            columns = [*batch.columns, extra["n"], extra["node"]]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, size, node])

    none = F.lit(0).cast("long")
    rows = docs.mapInArrow(with_node, docs.select("*", none.alias(size), none.alias(node)).schema)
    same = rows["doc_id"].cast("long").eqNullSafe(keepers["_id"]) & (rows[node] == keepers["_node"])
    joined = rows.join(keepers, same, "left").where((F.col(size) == 0) | F.col("_rows").isNotNull())
    if not keepers.where("_rows > 1").head(1):
        return joined.select(*docs.columns)
    repeated = F.coalesce(F.col("_rows") > 1, F.lit(False))
    kept = [*docs.columns, size, node]
    single = joined.where(~repeated).select(*docs.columns)
    one = joined.where(repeated).select(*kept).dropDuplicates(["doc_id", node]).select(*docs.columns)
    return single.union(one)
