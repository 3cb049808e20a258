"""Sharding by a hierarchical weighted hash tree; only DataFrame functions run here.

A tree is ``{region: {rack: {shard: weight}}}``. A row descends region, rack and shard; at each level the child with the
smallest ``-ln(u) / weight`` wins, where ``u`` is a hash of the row's key and the child's name, so each child gets its share
and a changed weight moves rows only to or from the changed child. Rows move only inside subtrees whose weights change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import ranked

Tree = dict[str, dict[str, dict[int, float]]]


def balanced_tree(shards: int, base: int = 8) -> Tree:
    """Tree of ``shards`` equal shards: the first ``base`` two to a rack and two racks to a region, later ones as regions of their own.

    A later shard is a new child of the root, so adding it moves rows only into it.
    """
    tree: Tree = {}
    for shard in range(shards):
        region, rack = (f"region{shard // 4}", f"rack{shard // 2}") if shard < base else (f"region-{shard}", f"rack-{shard}")
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(keys: list[Column], level: str, children: dict) -> Column:
    """Name of the child drawn with odds in proportion to the weights."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    scored = []
    for name, node in children.items():
        u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(f"{level}:{name}")), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        scored.append(F.struct((-F.ln(u) / F.lit(_weight(node))).alias("score"), F.lit(name).alias("child")))
    return F.least(*scored)["child"]


def _pick(parent: str, cases: dict[str, Column]) -> Column:
    out = None
    for name, drawn in cases.items():
        out = F.when(F.col(parent) == name, drawn) if out is None else out.when(F.col(parent) == name, drawn)
    return out


def descend(df: DataFrame, tree: Tree, keys: list[str], prefix: str = "") -> DataFrame:
    """Add ``region``, ``rack`` and ``shard`` of the tree (names take ``prefix``) for rows with the given key columns."""
    cols = [F.col(k) for k in keys]
    region, rack, shard = (f"{prefix}{x}" for x in ("region", "rack", "shard"))
    racks = {r: _draw(cols, f"rack of {r}", kids) for r, kids in tree.items()}
    shards = {k: _draw(cols, f"shard of {k}", kids) for kids in tree.values() for k, kids in kids.items()}
    return df.withColumn(region, _draw(cols, "region", tree)).withColumn(rack, _pick(region, racks)).withColumn(shard, _pick(rack, shards).cast("int"))


def shard_rows(df: DataFrame, tree: Tree, grown: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row of ``df`` in a shard of ``tree`` and of ``grown``, with a slot inside the shard.

    Returns ``<key>, size, text_crc32, region, rack, shard, slot, grown_shard``. ``size`` is the number of UTF-8 bytes plus 1
    (null text: 1, checksum of the empty text). Rows with a null key are placed by their text. Slots of a shard run from 0
    without gaps in order of key, checksum and size; repeated rows get slots of their own. Other columns are ignored.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(plain) + 1).cast("long").alias("size"),
        F.crc32(plain.cast("binary")).alias("text_crc32"),
    ).withColumns({"by": F.coalesce(F.col("key").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))})
    placed = descend(descend(rows, tree, ["by"]), grown, ["by"], "grown_").drop("by", "grown_region", "grown_rack")
    slots = ranked(placed, ["shard"], ["key", "text_crc32", "size"], "slot")
    return slots.select(F.col("key").alias(key), "size", "text_crc32", "region", "rack", "shard", "slot", "grown_shard")
