"""A trie of rebuilt conversations, from fingerprints that are combined and never from rebuilt texts.

A conversation is rebuilt from the head of its base and its own later turns. The fingerprint of a
sequence of turns is an element (n, x) of a monoid: n turns, and a polynomial hash x modulo 2^127 - 1.
(n, x)(m, y) = (n + m, x B^m + y) is that of both in a row, and the first factor can be divided out
again. So three kinds of stored products are enough: those of heads, and of whole prefixes of
conversations as given. The fingerprint of a rebuilt prefix is base head times own stretch, with
the own stretch as quotient of two stored prefixes.

Every turn of a rebuilt conversation is a row (conversation, depth, fingerprint, reference); the
reference is the content address (SHA-256) of a turn. Rows of one depth and fingerprint form a
node. That they are equal is proved by induction: all rows of a group must have one reference,
which with the fingerprint fixes the fingerprint before it, and no two different turns may have
one reference. If a group fails, everything is done anew with another base B.

A figure of a subtree is a sum over its members of what each has from that depth on, counting a
node at its smallest member only. So no row meets its ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from auditflow.llm._store import keep

PRIME = 2**127 - 1
#: Heads are taken from the conversation whose id is the next lower multiple of this.
FAMILY = 20
#: A head has fewer turns than this.
LONGEST_HEAD = 4
#: Turns of a conversation, or identifiers of a node, that are gathered together.
BLOCK = 1 << 12


def _base(attempt: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {attempt}".encode()).digest()[:15], "big")


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _number(x: bytes | None) -> int:
    return int.from_bytes(x or b"", "big")


def _text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _reference():
    """Content address of a turn; the length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")), 256))


def same_references(turns: DataFrame) -> bool:
    """Whether no two different turns (role, text) have one reference."""
    return turns.select("role", "text").distinct().groupBy(_reference().alias("ref")).count().where("count > 1").isEmpty()


def stored_prefixes(turns: DataFrame, attempt: int) -> DataFrame:
    """(conv_id, pos, x, ref, words) of every turn: its place from 1, and the product of the turns up to it.

    Turns are sorted in ranges of (conversation, turn, reference), so that a conversation of any
    length is cut, too. Products are taken inside a range first. Those of earlier ranges are
    put before them afterwards; at most one conversation per range has any.
    """
    base = _base(attempt)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n, x = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            ids, ns, xs = batch.column(0).to_pylist(), [], []
            for i, ref in zip(ids, batch.column(1).to_pylist()):
                if i != conv:
                    conv, n, x = i, 0, 0
                n, x = n + 1, (x * base + _number(ref[:16])) % PRIME
                ns.append(n)
                xs.append(_bytes(x))
            made = [pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(ns, pa.int64()), pa.array(xs, pa.binary()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(made, names=["part", "conv_id", "n", "x", "ref", "words"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, xs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, earlier in enumerate(batch.column(5).to_pylist()):
                if earlier:
                    n, x = 0, 0
                    for e in earlier:
                        n, x = n + e["n"], (x * pow(base, e["n"], PRIME) + _number(e["x"])) % PRIME
                    xs[i] = _bytes((x * pow(base, ns[i], PRIME) + _number(xs[i])) % PRIME)
                    ns[i] += n
            made = [batch.column(0), pa.array(ns, pa.int64()), pa.array(xs, pa.binary()), batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(made, names=["conv_id", "pos", "x", "ref", "words"])

    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    named = keep(turns.select("conv_id", "turn", _reference().alias("ref"), words.alias("words")), "named-turns")
    # Equal rows are interchangeable, so a spread behind all other keys lets ranges part them.
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "ref"]
    ranged = named.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*keys, "spread").sortWithinPartitions(*keys)
    cut = ranged.select("conv_id", "ref", "words").mapInArrow(inside, "part int, conv_id long, n long, x binary, ref binary, words long")
    cut = keep(cut, "turns")
    ends = cut.groupBy("conv_id", "part").agg(F.max(F.struct("n", "x")).alias("last"))
    parts = W.partitionBy("conv_id")
    ends = ends.withColumn("parts", F.count(F.lit(1)).over(parts)).where("parts > 1")
    ends = ends.withColumn("earlier", F.collect_list("last").over(parts.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ends = keep(ends.select("conv_id", "part", "earlier"), "cut-conversations")
    all_turns = cut.join(ends, ["conv_id", "part"], "left").select("conv_id", "n", "x", "ref", "words", "earlier")
    return keep(all_turns.mapInArrow(joined, "conv_id long, pos long, x binary, ref binary, words long"), "prefixes")


def _own_head():
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST_HEAD


def rebuilt_prefixes(prefixes: DataFrame, attempt: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, x, ref, words, turns) of all rebuilt prefixes, and (conv_id, turns) of all conversations.

    A prefix inside the head has the product stored for the base. A later one has the head's, times
    the quotient of two products of the conversation itself.
    """
    base = _base(attempt)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, skipped, xs = (batch.column(c).to_pylist() for c in ("x_head", "x_own", "x"))
            for i, n in enumerate(batch.column("n").to_pylist()):
                if heads[i] != skipped[i]:
                    # x_head B^n + (x - x_own B^n): the own head is divided out, the base's put there instead.
                    xs[i] = _bytes((_number(xs[i]) + (_number(heads[i]) - _number(skipped[i])) * pow(base, n, PRIME)) % PRIME)
            made = [batch.column("conv_id"), batch.column("depth"), pa.array(xs, pa.binary()), *(batch.column(c) for c in ("ref", "words", "turns"))]
            yield pa.RecordBatch.from_arrays(made, names=["conv_id", "depth", "x", "ref", "words", "turns"])

    h = _own_head()
    own = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max(F.when(F.col("pos") == h, F.col("x"))).alias("x_own"))
    heads = prefixes.where((F.col("pos") < LONGEST_HEAD) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "x", "ref", "words"))).alias("head"))  # three at most
    found = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h.cast("int")), F.array().cast("array<struct<pos: bigint, x: binary, ref: binary, words: bigint>>"))
    found = found.select("conv_id", h.alias("h"), "n", "x_own", head.alias("head"))
    b = F.size("head").cast("long")
    convs = keep(found.withColumn("turns", b + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))), "conversations")

    late = convs.where("n > h").select("conv_id", "h", b.alias("b"), F.get("head", F.size("head") - 1)["x"].alias("x_head"), "x_own", "turns")
    later = prefixes.join(late, "conv_id").where("pos > h").withColumn("n", F.col("pos") - F.col("h")).withColumn("depth", F.col("b") + F.col("n"))
    schema = "conv_id long, depth long, x binary, ref binary, words long, turns long"
    later = later.select("conv_id", "depth", "n", "x_head", "x_own", "x", "ref", "words", "turns").mapInArrow(combined, schema)
    early = convs.select("conv_id", "turns", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.x", "t.ref", "t.words", "turns")
    return keep(early.unionByName(later), "rebuilt"), convs.select("conv_id", "turns")


def _subtree_sums(members: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, child, leaves, saved): each member's figures from its depth on.

    ``parent`` is the node before in the same conversation, ``child`` whether the next one is the
    conversation's own. Conversations are taken in blocks of depths, each with a neighbour of the
    blocks beside it, and what later blocks hold is added to each.
    """
    here = F.col("depth").cast("long")
    block, place = F.floor(here / BLOCK), here % BLOCK
    beside = F.array(F.when((place == 0) & (block > 0), block - 1), F.when(place == BLOCK - 1, block + 1))
    seen = members.withColumn("home", block).withColumn("block", F.explode(F.concat(F.array(block), F.array_compact(beside))))
    ghost = F.col("block") != F.col("home")
    seen = seen.withColumn("leaf", F.when(ghost, 0).otherwise(F.col("leaf"))).withColumn("gain", F.when(ghost, 0).otherwise(F.col("gain")))
    deep_first = W.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())
    upto = deep_first.rowsBetween(W.unboundedPreceding, 0)
    seen = seen.select(
        "conv_id", "depth", "block", "home", "node", F.lead("node").over(deep_first).alias("parent"), F.coalesce(F.lag("own").over(deep_first), F.lit(0)).alias("child"),
        F.sum("leaf").over(upto).alias("leaves"), F.sum("gain").over(upto).alias("saved"),
    ).where("block = home")
    blocks = members.where(F.col("turns") >= BLOCK).groupBy("conv_id", block.alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
    behind = W.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = keep(blocks.select("conv_id", "block", F.sum("leaf").over(behind).alias("leaf"), F.sum("gain").over(behind).alias("gain")), "later-blocks")
    more = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("leaf", "gain")}
    return seen.join(blocks, ["conv_id", "block"], "left").select(
        "conv_id", "depth", "node", "parent", "child", (F.col("leaves") + more["leaf"]).alias("leaves"), (F.col("saved") + more["gain"]).alias("saved")
    )


def _ends(last: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of the identifiers that end at each node.

    Ranges of identifiers are joined side by side; a node's ranges are hashed one after the other,
    as its digest needs, in a stream that holds one range at a time.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["depth", "node", "ends_sha256"])

        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if (depth, node) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield flush()
            done = []
        if at is not None:
            done.append((*at, state.hexdigest()))
            yield flush()

    grouped = last.groupBy("depth", "node", F.shiftright("conv_id", 12).alias("ids_block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    listed = grouped.select("depth", "node", "ids_block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ordered = listed.repartition("depth", "node").sortWithinPartitions("depth", "node", "ids_block")
    return ordered.select("depth", "node", "ids").mapInArrow(digests, "depth long, node long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", attempts: int = 3
) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt from the first h turns of conversation c - c % 20 (fewer if it has
    fewer, none if there is none) and its own turns after its first h; h is the CRC-32 of its
    decimal identifier modulo 4. A node is a sequence of turns that rebuilt conversations (its
    members) begin with, known by its depth and its smallest member; the root has depth 0.
    ``n_leaves`` counts the childless nodes in its subtree (itself included), ``saved_tokens`` adds up
    (n_convs - 1) times the words of the last text over it, and ``ends_sha256`` is the digest of the
    identifiers that end at the node.

    Turns are in order of turn (null first), then of their SHA-256, so ties have one order; rows
    repeated as a whole are turns of their own. Null roles and texts are empty texts. Rows without a
    conversation are left out. Only the four columns named are read; an empty table gives no node.
    """
    turns = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), _text(role_col).alias("role"), _text(text_col).alias("text")
    ).where("conv_id is not null")
    if not same_references(turns):
        raise ValueError("two different turns have one SHA-256 digest")
    for attempt in range(attempts):
        rebuilt, convs = rebuilt_prefixes(stored_prefixes(turns, attempt), attempt)
        groups = rebuilt.groupBy("depth", "x", "ref").agg(F.min("conv_id").alias("node"), F.max("turns").alias("deepest"))
        groups = groups.groupBy("depth", "x").agg(F.min("node").alias("node"), F.max("deepest").alias("deepest"), F.count(F.lit(1)).alias("refs"))
        groups = keep(groups, "groups")
        if groups.where("refs > 1").isEmpty():
            break
    else:
        raise ValueError("fingerprints of different prefixes collided with every base")

    total = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    placed = rebuilt.join(groups.select("depth", "x", "node", "deepest"), ["depth", "x"])
    own = F.col("conv_id") == F.col("node")
    members = keep(
        placed.select(
            "conv_id", "depth", "node", "turns", own.cast("int").alias("own"), (own & (F.col("deepest") == F.col("depth"))).cast("long").alias("leaf"),
            F.when(own, F.lit(0).cast("long")).otherwise(F.col("words")).alias("gain"),
        ),
        "members",
    )
    sums = _subtree_sums(members).groupBy("depth", F.col("node").alias("conv_id")).agg(
        F.max(F.when(F.col("conv_id") == F.col("node"), F.col("parent"))).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum("child").cast("long").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    sums = keep(sums.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(total["least"]).cast("long"))), "nodes")
    root = sums.where("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0).cast("long")).alias("saved_tokens"),
    )
    root = root.select(
        F.lit(0).cast("long").alias("depth"), F.lit(total["least"]).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(total["n"]).alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
    ).where("n_convs > 0")
    last = members.where("depth = turns").select("depth", "node", "conv_id")
    turnless = convs.where("turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(total["least"]).cast("long").alias("node"), "conv_id")
    ends = keep(_ends(last.unionByName(turnless)).withColumnRenamed("node", "conv_id"), "ends")
    return sums.unionByName(root).join(ends, ["depth", "conv_id"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
