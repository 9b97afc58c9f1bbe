"""Prefix trie of conversations by truncation peeling.

1. *Paths.*  Every turn is reduced to a digest and a word count.  The turns of a conversation, sorted, are streamed
   once to give each prefix a key that hangs on all turns up to it.
2. *Tails.*  From the first key that no other conversation has, a conversation is alone to its end; these nodes follow from the
   conversation itself.  It enters the peeling at its deepest shared node, with the tail as one child.
3. *Peeling.*  From the greatest shared depth down, conversations that enter at a depth join the nodes left over from the depth
   below; equal paths are grouped, which finds the nodes and sums them up at once.  Then the last turn is stripped and the rows go on.

Each depth is one aggregation of distinct nodes, combined map-side, and is written to the shared folder; a first turn or a whole
conversation that a third of all have is summed before it is shuffled.  There are as many rounds as the deepest node that two conversations share.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrywork.llm.frames import rows_of, written
from ferrywork.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
KEY_BYTES, CHUNK_IDS = 16, 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1)``, digest, words`` of each turn; null role or text is empty, a null turn comes first.

    Rows of equal ``turn`` stand in the order of their digests.  Rows without ``conv_id`` belong to no conversation and go.
    Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, KEY_BYTES).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "words")


def spliced(turns: DataFrame, heads: int = 20, most: int = 4) -> DataFrame:
    """``turns`` with the first ``h`` of each conversation replaced by those of the one whose id is the multiple of ``heads`` before it.

    ``h`` is the crc32 of the decimal ``conv_id`` modulo ``most``.  Where the other conversation has fewer, all of it is taken; where it is not there, nothing.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    own = turns.where((F.col("conv_id") % heads == 0) | (F.col("place") > h)).select("conv_id", F.lit(1).alias("part"), "place", "digest", "words")
    takers = turns.where("place = 1").where(F.col("conv_id") % heads != 0)
    takers = takers.select(F.col("conv_id").alias("taker"), (F.col("conv_id") - F.col("conv_id") % heads).alias("conv_id"), h.alias("h"))
    first = turns.where((F.col("conv_id") % heads == 0) & (F.col("place") < most))
    taken = first.join(takers, "conv_id").where("place <= h").select(F.col("taker").alias("conv_id"), F.lit(0).alias("part"), "place", "digest", "words")
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    return own.union(taken).select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "words")


def _chained(batches):
    """Prefix keys of sorted turns: each is the digest of the key before it and its own turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("words", pa.int64())])
    now, key = None, b""
    for batch in batches:
        keys = []
        for conv, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist()):
            if conv != now:
                now, key = conv, b""
            key = hashlib.sha256(key + digest).digest()[:KEY_BYTES]
            keys.append(key)
        yield rows_of(schema, [batch.column("conv_id"), batch.column("place"), keys, batch.column("words")])


def _listed(batches):
    """Sorted ``key, conv_id`` to chunks of comma-joined ids of one key."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    now, ids, done = None, [], []
    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (key != now or len(ids) == CHUNK_IDS):
                done.append((now, ids[0], ",".join(map(str, ids))))
                ids = []
            now = key
            ids.append(conv)
        if done:
            yield rows_of(schema, list(zip(*done)))
            done = []
    if ids:
        yield rows_of(schema, [[now], [ids[0]], [",".join(map(str, ids))]])


def _hashed(batches):
    """Sorted chunks to one digest per key; a key's chunks pass one by one."""
    schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])
    now, digest, done = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if digest is None or key != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield rows_of(schema, list(zip(*done)))
            done = []
    if digest is not None:
        yield rows_of(schema, [[now], [digest.hexdigest()]])


def _ends(ended: DataFrame) -> DataFrame:
    """``key, ends``: SHA-256 of the comma-joined ids of ``key, conv_id``, ascending.

    Ids are dealt by range and joined into chunks there, so that a key with very many ids brings few rows to the task that hashes it.
    """
    chunks = ended.repartitionByRange("conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_listed, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


def prefix_trie(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns`` (``conv_id, place, digest, words``), with the columns of ``NODE_DDL``.

    ``conv_ids`` names all conversations, also those without turns; these end at the root.  A node is named by its smallest member and its depth; the
    root's parent is null.  ``n_leaves`` and ``saved_tokens`` (words that every member but one repeats) cover the node's subtree.  Without conversations there are no
    nodes.  Turns of conversations that are not in ``conv_ids`` must not occur; repeated ids in it count once.
    """
    spark = turns.sparkSession
    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    paths = written(sorted_turns.mapInArrow(_chained, "conv_id long, depth long, key binary, words long"), "paths")
    shared = paths.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    steps = paths.join(shared, "key", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "words"))).alias("steps"))
    lengths = paths.groupBy("conv_id").agg(F.max("depth").alias("length"))
    convs = conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(lengths, "conv_id", "left").join(steps, "conv_id", "left")
    path = F.coalesce(F.transform("steps", lambda s: F.struct(s["key"].alias("key"), s["words"].alias("words"))), F.expr("cast(array() AS array<struct<key: binary, words: bigint>>)"))
    convs = convs.select("conv_id", F.coalesce("length", F.lit(0)).alias("length"), path.alias("path")).withColumn("shared", F.size("path").cast("long"))
    place = scratch_path(spark, "conversations")
    convs.write.partitionBy("shared").parquet(place)
    schema = "conv_id long, length long, path array<struct<key: binary, words: long>>, shared long"
    convs = spark.read.schema(schema).parquet(place)
    deepest = convs.agg(F.max("shared")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], NODE_DDL)
    last = F.coalesce(F.try_element_at("path", F.lit(-1))["key"], F.unhex(F.lit("")))

    levels, below = [], None
    for depth in range(deepest, -1, -1):
        tail = (F.col("length") > depth).cast("long")
        rows = convs.where(F.col("shared") == depth)
        rows = rows.select("path", "conv_id", F.lit(1).cast("long").alias("n_convs"), tail.alias("children"), tail.alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if below is not None:
            rows = rows.union(below.select(F.slice("path", 1, depth), "conv_id", "n_convs", F.lit(1).cast("long"), "leaves", "saved"))
        nodes = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "children", "leaves", "saved")])
        own_words = F.try_element_at("path", F.lit(depth))["words"] if depth else F.lit(0)
        below = written(nodes.withColumns({
            "leaves": F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long"),
            "saved": F.col("saved") + (F.col("n_convs") - 1) * own_words,
            "key": last,
            "up": (F.try_element_at("path", F.lit(depth - 1))["key"] if depth > 1 else F.unhex(F.lit(""))) if depth else F.lit(None).cast("binary"),
            "depth": F.lit(depth).cast("long"),
        }), "level")
        levels.append(below)

    columns = ["key", "up", "conv_id", "depth", "n_convs", "children", "leaves", "saved"]
    nodes = levels[0].select(*columns)
    for level in levels[1:]:
        nodes = nodes.union(level.select(*columns))
    ends = _ends(convs.where("length = shared").select(last.alias("key"), "conv_id"))
    nodes_ends = nodes.join(ends, "key", "left").select(*columns, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"))
    # Tails: one node for each depth beyond the shared one; the topmost hangs on a shared node, the others on the conversation itself.
    tails = convs.where("length > shared").select(last.alias("up"), "conv_id", "length", "shared")
    tops = tails.select(
        "up", "conv_id", (F.col("shared") + 1).alias("depth"), F.lit(1).cast("long").alias("n_convs"), (F.col("length") > F.col("shared") + 1).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(F.col("length") == F.col("shared") + 1, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends"),
    )
    named = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    hung = nodes_ends.drop("key").select(*tops.columns).union(tops).join(named, "up", "left")
    hung = hung.select("conv_id", "depth", "parent", "n_convs", "children", "leaves", "saved", "ends")
    deep = paths.select("conv_id", "depth").join(tails.select("conv_id", "length", "shared"), "conv_id").where("depth > shared + 1")
    deep = deep.select(
        "conv_id", "depth", F.col("conv_id").alias("parent"), F.lit(1).cast("long").alias("n_convs"), (F.col("length") > F.col("depth")).cast("long").alias("children"),
        F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
        F.when(F.col("length") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends"),
    )
    return hung.union(deep).toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand: ``prefix_trie`` of their numbered turns."""
    turns = numbered_turns(conversations)
    return prefix_trie(turns, turns.select("conv_id"))


def spliced_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations after :func:`spliced`; a conversation that is left without turns is a member of the root."""
    turns = numbered_turns(conversations)
    turns = written(turns, "turns")
    return prefix_trie(spliced(turns), turns.select("conv_id"))
