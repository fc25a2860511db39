"""A Merkle manifest of a documents table: a digest per row, a tree per source, one root over the sources, and for every
row the proof that leads from its digest to the root, tried on a row that may have been tampered with.

A tree is worked on in superblocks of 3^5 (`block`) neighbouring nodes. Upwards, each superblock is reduced to one
node, and the nodes of superblocks are the leaves of the next, much smaller table, till one is left per source and then
one for all. Downwards, a superblock is cogrouped with the one row that holds the siblings above it; that task reduces
the superblock again, puts both parts of the proofs together and folds them. No task holds more than one superblock, a
hot source has many of them, and texts never move: only digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: The fields of a leaf in their order, and the nodes in a run.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
#: Levels that one superblock covers.
BLOCK_LEVELS = 5

NODES = "key string, pos bigint, total bigint, digest binary"
PATHS = "key string, pos bigint, top binary, path binary"
PROVEN = "doc_id bigint, no_id boolean, leaf binary, subroot binary, proof binary, proof_sha256 string, folded binary"


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its length in bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, text: Column) -> Column:
    """The digest of a row of documents with the given text, as 32 bytes."""
    values = [text if name == "text" else docs[name] for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _hashed(parts: Sequence[bytes]) -> bytes:
    """The digest over digests, which count as lower-case hex text."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def depth(total: int) -> int:
    """Levels from `total` nodes to one."""
    levels = 0
    while RUN**levels < total:
        levels += 1
    return levels


def _levels(digests: list[bytes], total: int, block: int) -> list[list[bytes]]:
    """The nodes of a superblock level by level, itself first; `total` is the number of nodes of its whole table."""
    levels = [digests]
    for _ in range(min(block, depth(total))):
        nodes = levels[-1]
        levels.append([_hashed(nodes[i : i + RUN]) for i in range(0, len(nodes), RUN)])
    return levels


# A path is, for each level, the place in the run, the number of siblings, and the siblings.
def _path(levels: list[list[bytes]], place: int) -> bytes:
    out = []
    for nodes in levels[:-1]:
        start = place - place % RUN
        others = nodes[start:place] + nodes[place + 1 : start + RUN]
        out += [bytes((place - start, len(others))), *others]
        place //= RUN
    return b"".join(out)


def _steps(path: bytes):
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        at += 2
        yield place, [path[at + 32 * i : at + 32 * i + 32] for i in range(n)]
        at += 32 * n


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and the siblings of a path lead to."""
    for place, others in _steps(path):
        digest = _hashed([*others[:place], digest, *others[place:]])
    return digest


def siblings(path: bytes) -> list[str]:
    """The siblings of a path from the leaf to the root, as hex text."""
    return [other.hex() for _, others in _steps(path) for other in others]


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `key`, and added `pos`, their place among those of the key in the order, and `total`, their number.

    A range sort puts them in order; places follow from counts per range and key, of which there are no more than
    ranges and keys together."""
    rows = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    rows = saved(rows.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "key", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("total"),
    )
    return rows.join(counts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift"))


def _block(block: int) -> Column:
    """The superblock of a node."""
    return F.expr(f"pos div {RUN**block}").alias("block")


def _reduced(nodes: DataFrame, block: int) -> DataFrame:
    """One node per superblock of (key, pos, total, digest)."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        key, pos, total = rows["key"].iloc[0], int(rows["pos"].iloc[0]), int(rows["total"].iloc[0])
        top = _levels([bytes(x) for x in rows["digest"]], total, block)[-1][0]
        span = RUN**block
        return pd.DataFrame({"key": [key], "pos": [pos // span], "total": [-(-total // span)], "digest": [top]})

    return nodes.select("key", "pos", "total", "digest").groupBy("key", _block(block)).applyInPandas(reduce, NODES)


def _tables(nodes: DataFrame, block: int) -> list[DataFrame]:
    """The nodes, then those of their superblocks, and so on; the last table has one row per key."""
    tables = [nodes]
    largest = nodes.agg(F.max("total")).first()[0] or 0  # one number
    while largest > 1:
        tables.append(saved(_reduced(tables[-1], block), "merkle-nodes"))
        largest = -(-largest // RUN**block)
    return tables


def _downwards(nodes: DataFrame, above: DataFrame, block: int) -> DataFrame:
    """The paths (key, pos, top, path) of nodes, from those of their superblocks."""

    def join(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = _levels([bytes(x) for x in rows["digest"]], int(rows["total"].iloc[0]), block)
        rest = bytes(outer["path"].iloc[0])
        paths = [_path(levels, i) + rest for i in range(len(rows))]
        return pd.DataFrame({"key": rows["key"], "pos": rows["pos"], "top": outer["top"].iloc[0], "path": paths})

    left = nodes.select("key", "pos", "total", "digest").groupBy("key", _block(block))
    return left.cogroup(above.groupBy("key", F.col("pos").alias("block"))).applyInPandas(join, PATHS)


def _paths(tables: list[DataFrame], tops: DataFrame, block: int) -> DataFrame:
    """The paths of the nodes of the first table; `tops` holds those of the last."""
    paths = tops
    for nodes in reversed(tables[:-1]):
        paths = saved(_downwards(nodes, paths, block), "merkle-paths")
    return paths


def proven(docs: DataFrame, altered: Column | None = None, block: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest of documents (doc_id, text, lang, source, n_chars): per row doc_id, leaf, subroot (the root of its
    source), proof (places and siblings up to the root; see `siblings` and `fold`) and the hash of its siblings, folded (the root that the row leads
    to with the text `altered`, null standing for an unchanged one) and root, all but doc_id as bytes.

    Nulls are values of their own in every column; a null source is a source and the first, a null doc_id the first of
    its source. Rows that repeat a doc_id are ordered by their leaves, equal rows have equal leaves and stand next to
    each other. Empty and very long texts are hashed like others, in the row where they are. No rows: no result. Further
    columns, whatever their names, are left out.
    """
    text = docs["text"]
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        # null first, then by bytes
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("key"),
        leaf(docs, text).alias("digest"),
        (leaf(docs, F.coalesce(altered, text)) if altered is not None else F.lit(None).cast("binary")).alias("other"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = _placed(saved(rows, "merkle-leaves"), "doc_id", "digest", "place")
    trees = _tables(rows, block)
    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "digest")
    subroots = _placed(subroots, "source")
    upper = _tables(subroots, block)
    tops = upper[-1].select("key", "pos", F.col("digest").alias("top"), F.lit(b"").alias("path"))
    outer = _paths(upper, tops, block).alias("p").join(subroots.alias("s"), "pos")
    outer = outer.select(F.col("source").alias("key"), F.lit(0).cast("bigint").alias("pos"), F.col("digest").alias("top"), "path")
    roots = upper[-1].select(F.col("digest").alias("root")).collect()  # one row at most
    root = bytes(roots[0]["root"]) if roots else b""

    def finish(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        digests = [bytes(x) for x in rows["digest"]]
        levels = _levels(digests, int(rows["total"].iloc[0]), block)
        rest = bytes(outer["path"].iloc[0])
        paths = [_path(levels, i) + rest for i in range(len(rows))]
        found = [d if o is None else bytes(o) for d, o in zip(digests, rows["other"], strict=True)]
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"], "no_id": rows["no_id"], "leaf": digests, "subroot": outer["top"].iloc[0],
                "proof": paths, "proof_sha256": [hashlib.sha256("".join(siblings(p)).encode()).hexdigest() for p in paths],
                "folded": [fold(d, p) for d, p in zip(found, paths, strict=True)],
            }
        )

    # pandas has no null among whole numbers
    leaves = rows.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        "key", "pos", "total", "digest", "other",
    )
    # With a single level of superblocks the leaves' own rows are the last table.
    blocks = _paths(trees[1:], outer, block) if len(trees) > 1 else outer
    done = leaves.groupBy("key", _block(block)).cogroup(blocks.groupBy("key", F.col("pos").alias("block")))
    done = done.applyInPandas(finish, PROVEN)
    return done.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id").withColumn("root", F.lit(root))


def manifest(docs: DataFrame, block: int = BLOCK_LEVELS) -> DataFrame:
    """Per row its leaf, subroot, root, the digest of its proof, and the root it leads to after a trial of tampering:
    rows with an even crc32 of their doc_id lose the line ends of their texts."""
    even = F.crc32(docs["doc_id"].cast("bigint").cast("string")) % 2 == 0
    f = proven(docs, F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))), block)
    leaf, subroot, root, folded = (F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded"))
    return f.select(
        "doc_id", leaf.alias("leaf"), subroot.alias("subroot"), root.alias("root"), "proof_sha256",
        folded.alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
