"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns, cut into blocks of ``BLOCK`` turns.  A block's digest
and those of the blocks before it name the sequence of turns up to the block's end, so
conversations are grouped block by block without looking at single turns.  Where one block
is all that follows a sequence, its turns are nodes as they come.  Only where siblings
diverge are turn boundaries refined, and there over one row for each different block, not
for each conversation.

A turn's key is two 64-bit hashes of its depth and of the SHA-256 of its role and text; a
sequence's key is the exclusive or of its turns' keys, kept as 128 bits, so it is a running
figure of the conversation.  Subtree figures need no walk over levels: every node counts
once, in the row of its smallest member, whose own blocks are the way to the root.

Conversations may be very long: turns are numbered in chunks, and running figures go over
segments of ``SEGMENT`` blocks first and over one row for each segment then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqnet.plans.lineage import cut
from seqnet.plans.ordering import neighbours, with_chunks

#: Turns of a block, blocks of a segment, and numbered turns that share one row of their conversation.
BLOCK, SEGMENT, STRETCH = 4, 1024, 4096
#: Fixed values of the rebuilding: conversations that share a start, and most turns that they share, plus one.
FAMILY, STARTS = 5, 9
#: A node with more children than this, and than a hundred-thousandth of all nodes, is joined by broadcast: at most 100 000 such nodes.
HOT_CHILDREN, HOT_SHARE = 4096, 100_000
#: Bytes of conversation ids that are put together before they are sent on.
IDS_BYTES = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(talk: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, bytes``: turns numbered from 1 per conversation.

    Null turns come first; turns of equal number come by their digest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = talk.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    chunked = with_chunks(turns, ["conv_id"], ["turn", "digest"])
    numbered = neighbours(chunked, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "digest")
    return numbered.select("conv_id", "pos", "digest", "bytes")


def start_of(conv: str) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % STARTS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, length``) and their turns (``conv_id, length, depth, digest, bytes``).

    The first turns come from the family's first conversation, the others are its own.
    """
    sizes = cut(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))).df
    bases = sizes.select(F.col("conv_id").alias("base"), F.least("own", F.lit(STARTS)).alias("there"))
    start = start_of("conv_id")
    convs = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "start": start}).join(bases, "base", "left")
    convs = convs.withColumn("head", F.least("start", F.coalesce("there", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("start"), F.lit(0)))).df
    # A conversation of very many turns has a row for each stretch of them.
    spread = convs.select("conv_id", "head", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {STRETCH}"))).alias("stretch"))
    own = turns.filter(F.col("pos") > start).withColumn("stretch", F.expr(f"pos div {STRETCH}")).join(spread, ["conv_id", "stretch"])
    own = own.select("conv_id", "length", (F.col("pos") - start + F.col("head")).alias("depth"), "digest", "bytes")
    first = turns.filter(F.col("pos") < STARTS).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    taken = convs.filter("head > 0").select("base", "conv_id", "length", "head").join(first, "base").filter("depth <= head")
    return convs.select("conv_id", "length"), own.unionByName(taken.select(own.columns))


def blocks_of(turns: DataFrame) -> DataFrame:
    """``conv_id, length, seg, k, turns, px, py, ex, ey``: each block with the keys of the sequences before it and up to its end."""
    depth, digest = F.col("depth"), F.col("digest")
    keyed = turns.withColumns({"a": F.xxhash64(depth, digest), "b": F.xxhash64(digest, depth), "k": F.expr(f"(depth - 1) div {BLOCK}")})
    keyed = keyed.withColumn("seg", F.expr(f"k div {SEGMENT}")).repartition("conv_id", "seg")
    turn = F.struct("depth", "a", "b", "bytes")
    blocks = keyed.groupBy("conv_id", "seg", "k").agg(
        F.max("length").alias("length"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"), F.sort_array(F.collect_list(turn)).alias("turns")
    )
    upto = Window.partitionBy("conv_id", "seg").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    blocks = cut(blocks.withColumns({"ex": F.bit_xor("x").over(upto), "ey": F.bit_xor("y").over(upto)})).df
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several segments have any key to carry over.
    long = blocks.filter(F.col("length") > BLOCK * SEGMENT)
    carried = long.groupBy("conv_id", "seg").agg(F.bit_xor("x").alias("_x"), F.bit_xor("y").alias("_y"))
    carried = carried.select("conv_id", "seg", F.bit_xor("_x").over(before).alias("_x"), F.bit_xor("_y").over(before).alias("_y"))
    out = blocks.join(carried.filter("_x is not null"), ["conv_id", "seg"], "left")
    for side in "xy":
        out = out.withColumn(f"e{side}", F.col(f"e{side}").bitwiseXOR(F.coalesce(f"_{side}", F.lit(0))))
        out = out.withColumn(f"p{side}", F.col(f"e{side}").bitwiseXOR(F.col(side)))
    return cut(out.select("conv_id", "length", "seg", "k", "turns", "px", "py", "ex", "ey")).df


def classes_of(blocks: DataFrame) -> DataFrame:
    """``px, py, ex, ey, k, conv, n, turns, lone``: each different sequence of blocks once.

    ``n`` counts the conversations that go through, ``conv`` is the smallest; ``lone`` marks
    the one block that follows a sequence where no other does.
    """
    counts = blocks.groupBy("ex", "ey").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.min("k").alias("k"))
    counts = counts.select(F.col("conv").alias("conv_id"), "k", "n")
    classes = cut(blocks.join(counts, ["conv_id", "k"]).select("px", "py", "ex", "ey", "k", F.col("conv_id").alias("conv"), "n", "turns")).df
    alone = classes.groupBy("px", "py").agg(F.count(F.lit(1)).alias("_n"), F.min("ex").alias("ex"), F.min("ey").alias("ey")).filter("_n = 1")
    marked = classes.join(alone.select("ex", "ey", F.lit(True).alias("_lone")), ["ex", "ey"], "left")
    return cut(marked.withColumn("lone", F.coalesce("_lone", F.lit(False))).drop("_lone")).df


def turn_rows(classes: DataFrame, *more: str) -> DataFrame:
    """One row for each turn of a class: the keys of the sequences that end with it and before it."""

    def key(side: str, turn: str, upto: str) -> str:
        return f"aggregate(slice(turns, 1, {upto}), p{side}, (key, t) -> key ^ t.{turn})"

    ends = ", ".join(
        f"'{name}', {key(side, turn, upto)}" for name, side, turn, upto in (("nx", "x", "a", "j"), ("ny", "y", "b", "j"), ("ux", "x", "a", "j - 1"), ("uy", "y", "b", "j - 1"))
    )
    each = F.expr(f"transform(sequence(1, size(turns)), j -> named_struct('j', j, 'depth', turns[j - 1].depth, 'bytes', turns[j - 1].bytes, {ends}))")
    return classes.select("conv", "n", "lone", *more, F.inline(each))


def nodes_of(classes: DataFrame, convs: DataFrame) -> DataFrame:
    """``nx, ny, ux, uy, depth, conv_id, n_convs, n_children, value`` of every node, the root included.

    ``value`` is what the node saves by itself.  Turns are compared only where blocks diverge.
    """
    rows = turn_rows(classes)
    as_is = rows.filter("lone").select("nx", "ny", "ux", "uy", "depth", F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"), "bytes")
    same = [F.min(c).alias(c) for c in ("ux", "uy", "depth")]
    refined = rows.filter("not lone").groupBy("nx", "ny").agg(*same, F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(zero.alias("nx"), zero.alias("ny"), none.alias("ux"), none.alias("uy"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"))
    nodes = cut(as_is.unionByName(refined).unionByName(root)).df
    children = nodes.filter("depth > 0").groupBy(F.col("ux").alias("nx"), F.col("uy").alias("ny")).agg(F.count(F.lit(1)).alias("n_children"))
    found = nodes.join(children, ["nx", "ny"], "left").na.fill(0, ["n_children"])
    return found.withColumn("value", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes")


def later(blocks: DataFrame, owned: DataFrame) -> DataFrame:
    """``ex, ey, after, leaves`` of each class: over its members, the value owned in later blocks, and the leaves owned at all."""
    rows = blocks.select("conv_id", "length", "seg", "k", "ex", "ey").join(owned.select("conv_id", "k", "total", "leaf"), ["conv_id", "k"], "left")
    rows = rows.na.fill(0, ["total", "leaf"])
    down = Window.partitionBy("conv_id", "seg").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(rows.withColumns({"after": F.sum("total").over(down) - F.col("total"), "leaves": F.sum("leaf").over(down)})).df
    behind = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.filter(F.col("length") > BLOCK * SEGMENT).groupBy("conv_id", "seg").agg(F.sum("total").alias("_t"), F.sum("leaf").alias("_l"))
    carried = carried.select("conv_id", "seg", F.sum("_t").over(behind).alias("_t"), F.sum("_l").over(behind).alias("_l"))
    rows = rows.join(carried.filter("_t is not null"), ["conv_id", "seg"], "left").na.fill(0, ["_t", "_l"])
    return rows.groupBy("ex", "ey").agg(F.sum(F.col("after") + F.col("_t")).alias("after"), F.sum(F.col("leaves") + F.col("_l")).alias("leaves"))


def subtrees(nodes: DataFrame, classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``nx, ny, n_leaves, saved_tokens`` of every node below the root."""
    mine = F.struct(((F.col("depth") - 1) % BLOCK + 1).alias("j"), F.col("value").alias("v"))
    owned = nodes.filter("depth > 0").groupBy("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("k")).agg(
        F.collect_list(mine).alias("own"), F.sum("value").alias("total"), F.count_if(F.col("n_children") == 0).alias("leaf")
    )
    owned = cut(owned).df
    given = classes.join(later(blocks, owned), ["ex", "ey"]).join(owned.select(F.col("conv_id").alias("conv"), "k", "own"), ["conv", "k"], "left")
    rows = turn_rows(given, "after", "leaves", "own")
    below = F.expr("after + coalesce(aggregate(filter(own, o -> o.j >= j), 0L, (sum, o) -> sum + o.v), 0L)")
    rows = rows.select("lone", "nx", "ny", F.col("leaves").alias("n_leaves"), below.alias("saved_tokens"))
    refined = rows.filter("not lone").groupBy("nx", "ny").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return rows.filter("lone").drop("lone").unionByName(refined)


def end_digests(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``nx, ny, ends_sha256`` of every node that conversations end at.

    Ids are put together in sorted stretches first, wherever a node's stretch happens to be
    cut; the digest then reads a node's stretches one after the other.
    """
    ended = blocks.filter(F.col("k") == F.expr(f"(length - 1) div {BLOCK}")).select(F.col("ex").alias("nx"), F.col("ey").alias("ny"), "conv_id")
    zero = F.lit(0).cast("long")
    ended = ended.unionByName(convs.filter("length = 0").select(zero.alias("nx"), zero.alias("ny"), "conv_id"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for x, y, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if node != (x, y) or size >= IDS_BYTES:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = (x, y), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["nx", "ny", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, first, ",".join(ids))], names=["nx", "ny", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for x, y, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if node == (x, y):
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256()
                state.update(ids.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["nx", "ny", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], names=["nx", "ny", "ends_sha256"])

    sorted_ = ended.repartitionByRange("nx", "ny", "conv_id").sortWithinPartitions("nx", "ny", "conv_id")
    stretches = sorted_.mapInArrow(joined, "nx bigint, ny bigint, first bigint, ids string")
    return stretches.repartition("nx", "ny").sortWithinPartitions("nx", "ny", "first").mapInArrow(digested, "nx bigint, ny bigint, ends_sha256 string")


def with_parents(nodes: DataFrame, rows: int) -> DataFrame:
    """``nodes`` with ``parent_conv_id``; parents of very many children are sent to all tasks."""
    parents = nodes.filter("n_children > 0").select(F.col("nx").alias("ux"), F.col("ny").alias("uy"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.filter(F.col("n_children") > max(HOT_CHILDREN, rows // HOT_SHARE)).drop("n_children"))
    near = nodes.join(hot, ["ux", "uy"])
    rest = nodes.join(hot.select("ux", "uy"), ["ux", "uy"], "left_anti").join(parents.drop("n_children"), ["ux", "uy"], "left")
    return near.unionByName(rest)


def prefix_trie(talk: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    ``talk`` has ``conv_id, turn, role, text``.  Null roles and texts are empty ones, null turns
    come first, and turns of equal number come by the SHA-256 of their role and text, so that
    repeated rows are repeated turns.  Rows without ``conv_id`` belong to no conversation.  A
    negative id's family is counted towards zero.  An empty table gives an empty result; other
    columns are ignored.
    """
    turns = cut(numbered_turns(talk)).df
    convs, rows = rebuilt(turns)
    blocks = blocks_of(rows)
    classes = classes_of(blocks)
    nodes = cut(nodes_of(classes, convs), value=F.sum("value"), leaves=F.count_if(F.col("n_children") == 0))
    below = subtrees(nodes.df, classes, blocks)
    found = with_parents(nodes.df, nodes.rows).join(below, ["nx", "ny"], "left").join(end_digests(blocks, convs), ["nx", "ny"], "left")
    top = F.col("depth") == 0
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.when(top, F.lit(nodes["leaves"] or 0)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        F.when(top, F.lit(nodes["value"] or 0)).otherwise(F.col("saved_tokens")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def oracle() -> str:
    """The result of ``prefix_trie``, with every sequence of turns written out as a list."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    eight = step
    for _ in range(7):
        eight = f"list_transform([{eight}], lambda c: {step})[1]"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: ord(d)::BIGINT)), "
        f"lambda acc, d: list_transform([xor(acc, d)], lambda c: {eight})[1]))"
    )
    return f"""
        WITH own AS (
            SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
                sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        starts AS (SELECT c, turns, {crc} % {STARTS} AS h FROM own),
        rebuilt AS (
            SELECT a.c AS c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
            FROM starts a LEFT JOIN own b ON b.c = a.c - a.c % {FAMILY}
        ),
        members AS (SELECT c, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
        nodes AS (
            SELECT d, path, min(c) AS c, count(*) AS n, coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends)), sha256('')) AS ends,
                CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].text) END AS value
            FROM members GROUP BY d, path
        ),
        children AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
        counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, path)),
        above AS (SELECT path[1:up] AS path, up AS d, value, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM counted)),
        sums AS (SELECT d, path, count(*) FILTER (n_children = 0) AS n_leaves, sum(value) AS saved FROM above GROUP BY d, path)
        SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.n_children AS n_children, n_leaves,
            CAST(saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
        FROM counted a JOIN sums USING (d, path) LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.path = a.path[1:a.d - 1]
    """
