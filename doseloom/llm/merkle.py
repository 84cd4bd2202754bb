"""Merkle manifest of a dataset, proved by octopus multiproofs.

Each row is a leaf: ``H`` of its fields, and ``H`` is the lower-case hex sha256 of what it is given, digests
as hex text. In each source the leaves ascend by ``doc_id``, and every ``ARITY`` consecutive nodes (fewer in
the last run, even one) become their ``H`` until one is left, the source's subroot. Subroots in order
of their source go on to the root in the same way.

* Leaves are sorted by range and numbered by counts of the sorted pieces, so a source that holds a third of
  all rows is many pieces. A piece of ``ARITY ** DEPTH`` neighbours is folded in one go, ``DEPTH`` levels at a time, and only
  its top goes on: a round for each factor of 729 in the longest source.
* A leaf partition is up to ``_LOT`` wanted rows that lie side by side in the sorted order. It works out the
  coordinates (tree, level, index) that the paths of all its leaves need and that follow from none of them: the
  octopus of their siblings, which is what they share, once. One join brings these nodes to it; it derives the shared
  interiors, up to subroot and root, and expands the proof of every leaf from them.

A proof lists a leaf's siblings (the other nodes of its run) level by level, left to right, through subroot to root.
``shape`` says for each level the place in the run and the run's size, which is all that folding needs.

Defined results: a null field is ``-`` in the leaf; a null source is a source of its own before all others, a null
``doc_id`` comes before all others of its source and is never tampered with; rows that repeat an id are ordered by their leaves, and
rows that repeat all fields are leaves of their own; null, empty and very long texts are fields like any other; an
empty table has no leaves, no root and no rows; columns other than ``doc_id, source, lang, n_chars, text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseloom.llm.tables import saved

ARITY = 3
DEPTH = 6
_PIECE = ARITY ** DEPTH
_LOT = 1 << 15
_TOP = "r"  # the tree over the subroots; a source's tree is "" for null, else "s" and its name
_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("width", pa.int64()), ("digest", pa.binary())])
_NODE_SQL = "tree string, level int, idx long, width long, digest binary"
_WANTED = pa.schema([("lot", pa.int64()), ("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64())])
_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                    ("proof", pa.list_(pa.string())), ("shape", pa.string()), ("proof_sha256", pa.string()),
                    ("folded_root", pa.string())])
_PROOF_SQL = ("doc_id long, leaf string, subroot string, root string, proof array<string>, shape string, "
              "proof_sha256 string, folded_root string")


def digest(*parts: bytes) -> bytes:
    """``H``: hex sha256 of the parts one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row of documents with this text."""
    own = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text]
    return F.unhex(F.sha2(F.concat(*map(_field, own)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, leaf, changed, tie``; ``changed`` is the leaf of a row that is tampered with, else null.

    Where 2 divides the crc32 of the decimal ``doc_id``, tampering deletes the text's line feeds.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    odd = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return docs.select(doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),
                       leaf(text).alias("leaf"), F.when(odd, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("changed")) \
        .withColumn("tie", F.monotonically_increasing_id())


def _numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with ``at`` (place in the sorted table), ``idx`` in their ``tree`` and the tree's ``width``.

    Counts of the sorted pieces say where each piece begins, so only piece counts meet in a window.
    """
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ranged = saved(ranged.withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    part = F.shiftright("at", 33)
    pieces = ranged.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("_tree")
    ahead = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = saved(pieces.select("_tree", "_part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"),
                                 F.sum("n").over(own).alias("width")), "leaf-pieces")
    return ranged.join(pieces, (F.col(tree) == F.col("_tree")) & (part == F.col("_part"))) \
        .withColumn("idx", F.col("at") + F.col("shift")).drop("_tree", "_part", "shift")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes over each piece of neighbours, level by level; rows come sorted by tree and index."""
    out: dict[str, list] = {f.name: [] for f in _NODE}

    def close(tree: str, level: int, first: int, width: int, line: list[bytes]) -> None:
        for _ in range(DEPTH):
            if width == 1:
                return
            line = [digest(*line[k:k + ARITY]) for k in range(0, len(line), ARITY)]
            level, first, width = level + 1, first // ARITY, -(-width // ARITY)
            out["tree"] += [tree] * len(line)
            out["level"] += [level] * len(line)
            out["idx"] += range(first, first + len(line))
            out["width"] += [width] * len(line)
            out["digest"] += [bytes.fromhex(d.decode()) for d in line]

    here, line = None, []
    for batch in batches:
        for tree, level, idx, width, own in zip(*(batch.column(f.name).to_pylist() for f in _NODE)):
            if here is None or (tree, idx // _PIECE) != (here[0], here[2] // _PIECE):
                if here:
                    close(*here, line)
                here, line = (tree, level, idx, width), []
            line.append(own.hex().encode())
        if len(out["idx"]) > _LOT:
            yield pa.RecordBatch.from_pydict(out, schema=_NODE)
            out.update({f.name: [] for f in _NODE})
    if here:
        close(*here, line)
    yield pa.RecordBatch.from_pydict(out, schema=_NODE)


def _tree_nodes(base: DataFrame) -> DataFrame:
    """All nodes over the level-0 rows of ``base``, these included."""
    nodes, open_rows, depth = base, base.where("width > 1"), 0
    while not open_rows.isEmpty():
        rows = open_rows.withColumn("piece", F.floor(F.col("idx") / _PIECE)).repartition("tree", "piece")
        made = saved(rows.sortWithinPartitions("tree", "idx").drop("piece").mapInArrow(_folded, _NODE_SQL), "tree-nodes")
        nodes, depth = nodes.unionByName(made), depth + DEPTH
        open_rows = made.where((F.col("width") > 1) & (F.col("level") == depth))
    return nodes


@dataclass
class Manifest:
    """``rows``: the numbered leaves with the place of their tree; ``nodes``: every node of all trees."""

    rows: DataFrame
    nodes: DataFrame

    def root(self) -> str | None:
        found = self.nodes.where(f"tree = '{_TOP}' and width = 1").select(F.lower(F.hex("digest"))).first()
        return found[0] if found else None


def manifest(docs: DataFrame) -> Manifest:
    rows = saved(_numbered(saved(leaves(docs), "leaves"), "tree", "doc_id", "leaf", "tie").drop("tie"), "numbered-leaves")
    base = rows.select("tree", F.lit(0).alias("level"), "idx", "width", F.col("leaf").alias("digest"))
    nodes = _tree_nodes(base)
    subroots = nodes.where("width = 1").select(F.lit(_TOP).alias("top"), "tree", "digest")
    tops = saved(_numbered(subroots, "top", "tree"), "subroots")
    top = tops.select(F.col("top").alias("tree"), F.lit(0).alias("level"), "idx", "width", "digest")
    place = tops.select("tree", F.col("idx").alias("tree_idx"), F.col("width").alias("trees"))
    return Manifest(rows.join(place, "tree"), nodes.unionByName(_tree_nodes(top)))


def octopus(indexes: list[int], width: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) that the paths of these leaves need and that follow from none of them."""
    missing, known, level = [], sorted(set(indexes)), 0
    while width > 1:
        have, runs = set(known), sorted({i // ARITY for i in known})
        missing += [(level, i) for r in runs for i in range(r * ARITY, min(width, (r + 1) * ARITY)) if i not in have]
        known, width, level = runs, -(-width // ARITY), level + 1
    return missing


def _by_tree(table: pa.Table) -> dict[tuple[str, int], list[int]]:
    found: dict[tuple[str, int], list[int]] = {}
    for tree, width, idx in zip(*(table.column(c).to_pylist() for c in ("tree", "width", "idx"))):
        found.setdefault((tree, width), []).append(idx)
    return found


def _missing(table: pa.Table) -> pa.Table:
    """The octopus of one leaf partition, of its trees and of the tree over the subroots."""
    lot, places = table.column("lot")[0].as_py(), sorted(set(table.column("tree_idx").to_pylist()))
    want = [(tree, *at) for (tree, width), own in _by_tree(table).items() for at in octopus(own, width)]
    want += [(_TOP, *at) for at in octopus(places, table.column("trees")[0].as_py())]
    trees, levels, idx = zip(*want) if want else ([], [], [])
    return pa.table([[lot] * len(want), trees, levels, idx], schema=_WANTED)


class _Tree:
    """What a leaf partition knows of one tree: its own and the fetched nodes, and the interiors that follow."""

    def __init__(self, width: int, known: list[dict[int, bytes]]):
        self.levels, self.widths = known, [width]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // ARITY))
        known += [{} for _ in range(len(self.widths) - len(known))]
        for level, wide in enumerate(self.widths[:-1]):
            for run in {i // ARITY for i in known[level]}:  # the octopus makes each of them whole
                known[level + 1][run] = digest(*[known[level][i] for i in self._run(run, wide)])
        self.root = known[-1][0]
        self._above: dict[tuple[int, int], tuple[tuple[bytes, ...], str]] = {}

    @staticmethod
    def _run(run: int, wide: int) -> range:
        return range(run * ARITY, min(wide, (run + 1) * ARITY))

    def proof(self, idx: int, level: int = 0) -> tuple[tuple[bytes, ...], str]:
        """Siblings and shape from a node to the tree's root; neighbours share what lies above their run."""
        if level == len(self.widths) - 1:
            return (), ""
        if (found := self._above.get((level, idx))) is None:
            run = self._run(idx // ARITY, self.widths[level])
            above, shape = self.proof(idx // ARITY, level + 1)
            found = (*[self.levels[level][i] for i in run if i != idx], *above), f"{idx % ARITY}{len(run)}{shape}"
            if level:
                self._above[level, idx] = found
        return found


def fold(start: bytes, proof: list[bytes] | tuple[bytes, ...], shape: str) -> bytes:
    """The root that a leaf and its proof lead to."""
    node, at = start, 0
    for k in range(0, len(shape), 2):
        place, size = int(shape[k]), int(shape[k + 1])
        node = digest(*proof[at:at + place], node, *proof[at + place:at + size - 1])
        at += size - 1
    return node


def _expanded(with_proofs: bool):
    def expand(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        """The proofs of one leaf partition from its leaves and the nodes it fetched."""
        out: dict[str, list] = {f.name: [] for f in _PROOF}
        if not rows.num_rows:
            return pa.table(out, schema=_PROOF)
        known: dict[str, list[dict[int, bytes]]] = {}

        def note(tree: str, level: int, idx: int, own: bytes) -> None:
            levels = known.setdefault(tree, [])
            levels += [{} for _ in range(level + 1 - len(levels))]
            levels[level][idx] = own.hex().encode()

        for node in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
            note(*node)
        col = {c: rows.column(c).to_pylist() for c in ("doc_id", "tree", "idx", "width", "leaf", "changed", "tree_idx", "trees")}
        for tree, idx, own in zip(col["tree"], col["idx"], col["leaf"]):
            note(tree, 0, idx, own)
        trees = {t: _Tree(w, known[t]) for t, w in dict(zip(col["tree"], col["width"])).items()}
        for t, place in dict(zip(col["tree"], col["tree_idx"])).items():
            note(_TOP, 0, place, bytes.fromhex(trees[t].root.decode()))
        top = _Tree(col["trees"][0], known[_TOP])
        for doc_id, tree, idx, place, own, changed in zip(*(col[c] for c in ("doc_id", "tree", "idx", "tree_idx", "leaf", "changed"))):
            (below, shape), (above, rest) = trees[tree].proof(idx), top.proof(place)
            proof, shape = below + above, shape + rest
            out["doc_id"].append(doc_id)
            out["leaf"].append(own.hex())
            out["subroot"].append(trees[tree].root.decode())
            out["root"].append(top.root.decode())
            out["proof"].append([p.decode() for p in proof] if with_proofs else None)
            out["shape"].append(shape)
            out["proof_sha256"].append(digest(*proof).decode())
            out["folded_root"].append(fold((changed or own).hex().encode(), proof, shape).decode())
        return pa.table(out, schema=_PROOF)
    return expand


def proofs(tree: Manifest, wanted: DataFrame | None = None, with_proofs: bool = True) -> DataFrame:
    """One row per leaf, or per leaf of the ``doc_id`` values in ``wanted``.

    ``doc_id, leaf, subroot, root, proof, shape, proof_sha256, folded_root, verified``; ``folded_root`` starts
    from the tampered leaf where there is one, and ``verified`` says whether it meets the root.
    """
    rows = tree.rows
    if wanted is not None:
        ids = wanted.select(F.col("doc_id").cast("long").alias("_id")).distinct()
        rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    lot = F.shiftright("at", 33) * F.lit(1 << 18) + F.floor(F.col("at") % (1 << 33) / _LOT)
    rows = saved(rows.withColumn("lot", lot.cast("long")).select(
        "lot", "doc_id", "tree", "idx", "width", "leaf", "changed", "tree_idx", "trees"), "wanted-leaves")
    want = rows.select("lot", "tree", "idx", "width", "tree_idx", "trees").groupBy("lot") \
        .applyInArrow(_missing, "lot long, tree string, level int, idx long")
    fetched = saved(want, "octopus").join(tree.nodes.drop("width"), ["tree", "level", "idx"])
    out = rows.groupBy("lot").cogroup(fetched.groupBy("lot")).applyInArrow(_expanded(with_proofs), _PROOF_SQL)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proved(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    return proofs(manifest(docs), with_proofs=False) \
        .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
