"""A Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves of one language,
in order of their ids, are the lowest level of a tree; every two neighbours become the digest of both,
a last one by itself the digest of it alone, until one node is left. The languages' roots, in order of
the language, form a tree by the same rule, whose root stands for the whole table.

Nodes are labelled by level and place. A sweep takes them in order of their labels; a priority queue
delivers each digest to the parent. A second sweep runs through the labels backwards; there the queue
delivers to each child the proof of its parent behind the step of its sibling. Between blocks of
``2**HEIGHT`` nodes the queue is external: staged tables sorted by label (``sweeps``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesloom.llm.common import id_hash
from seriesloom.llm.sweeps import in_order, numbered, sweep
from seriesloom.sources.panels import stage

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Steps of a proof: a node without sibling, a sibling to the left, a sibling to the right.
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
DIGEST = 32


def digest_of(parts: list[bytes]) -> bytes:
    """Digest of digests, each written as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row's fields, each as its length in bytes, a colon and its value, or ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def upward(digests: list[bytes], first: int, size: int, height: int) -> list[tuple[int, int, bytes]]:
    """Nodes ``(level, place, digest)`` of a block in order of their labels.

    ``first`` is the place of the first digest among the ``size`` of its level. A level of one node is the root.
    """
    queue = [(0, first + i, 0, d) for i, d in enumerate(digests)]
    heapify(queue)
    nodes = []
    while queue:
        level, place, _, digest = heappop(queue)
        delivered = [digest]
        while queue and queue[0][:2] == (level, place):
            delivered.append(heappop(queue)[3])
        digest = digest_of(delivered) if level else delivered[0]
        nodes.append((level, place, digest))
        if level < height and (size - 1) >> level:
            heappush(queue, (level + 1, place >> 1, place & 1, digest))
    return nodes


def downward(nodes: list[tuple[int, int, bytes]], proof: bytes) -> list[bytes]:
    """Proof of every node of level 0, from that of the top node; labels in descending order."""
    digests = {node[:2]: node[2] for node in nodes}
    level, place, _ = nodes[-1]
    queue = [(-level, -place, proof)]
    proofs = []
    while queue:
        level, place, own = heappop(queue)
        level, place = -level, -place
        if not level:
            proofs.append(own)
            continue
        below = [(level - 1, p) for p in (2 * place, 2 * place + 1) if (level - 1, p) in digests]
        for child in below:
            if len(below) == 1:
                step = ALONE
            else:
                step = LEFT + digests[below[0]] if child == below[1] else RIGHT + digests[below[1]]
            heappush(queue, (-child[0], -child[1], step + own))
    return proofs[::-1]


def steps(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Steps of a proof from the leaf up: kind and sibling."""
    at = 0
    while at < len(proof):
        kind = proof[at : at + 1]
        size = 0 if kind == ALONE else DIGEST
        yield kind, proof[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and a proof lead to."""
    for kind, sibling in steps(proof):
        leaf = digest_of([sibling, leaf] if kind == LEFT else [leaf, sibling] if kind == RIGHT else [leaf])
    return leaf


def _tree(nodes: DataFrame, group: str, height: int, finish, name: str) -> DataFrame:
    """``sweep`` with digests as values; a state is two digests, of the group's and the whole tree's root, and a proof."""

    def combine(values: list[bytes], first: int, size: int) -> bytes:
        return upward(values, first, size, height)[-1][2]

    def split(values: list[bytes], first: int, size: int, state: bytes) -> list[bytes]:
        proofs = downward(upward(values, first, size, height), state[2 * DIGEST :])
        return [state[: 2 * DIGEST] + p for p in proofs]

    return sweep(nodes, group, height, combine, finish, split, name)


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: ``lang, doc_id, leaf, index, size, subroot, root, proof`` (digests and proof binary).

    ``index`` is the leaf's place in its language, ``size`` the leaves there, ``proof`` the steps from the
    leaf to the root (``steps``, ``fold``). Leaves ascend by doc_id, a null first; rows of one doc_id go by
    their digest, so rows that are the same in all fields may trade places. ``extra`` names further columns made
    of those of ``docs``. No rows: no rows.
    """
    made = {"leaf": leaf_of([F.col(c) for c in FIELDS])} | (extra or {})
    leaves = docs.select("lang", "doc_id", *[c.alias(n) for n, c in made.items()])
    placed = in_order(leaves, [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf")], "merkle-order")
    nodes = numbered(placed, "lang").withColumn("value", F.col("leaf"))

    def join_languages(subroots: DataFrame) -> DataFrame:
        subroots = stage(subroots, "merkle-subroots")
        order = in_order(subroots.select("lang", "value"), [F.asc_nulls_first("lang")], "merkle-languages")
        top = numbered(order.withColumn("whole", F.lit(1)), "whole")

        def root(roots: DataFrame) -> DataFrame:
            return roots.withColumn("state", F.concat("value", "value"))

        proven = _tree(top, "whole", height, root, "merkle-top")
        # the second digest of a state is the root; the first becomes the language's own
        state = F.concat("value", F.expr(f"substring(state, {DIGEST + 1})")).alias("state")
        told = proven.select(F.col("lang").alias("_lang"), state)
        return subroots.join(told, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")

    swept = _tree(nodes, "lang", height, join_languages, "merkle-leaves")
    parts = {"subroot": (1, DIGEST), "root": (DIGEST + 1, DIGEST)}
    found = [F.expr(f"substring(state, {a}, {n})").alias(c) for c, (a, n) in parts.items()]
    return swept.select("lang", "doc_id", *made, "index", "size", *found, F.expr(f"substring(state, {2 * DIGEST + 1})").alias("proof"))


def audit(proven: DataFrame, presented: str) -> DataFrame:
    """Fold the leaf in column ``presented`` along each row's proof; digests as hexadecimal text.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the digest of all siblings from the
    leaf up, the root that the presented leaf leads to, and whether that is the manifest's.
    """
    text = "string"
    made = ", ".join(f"{c} {text}" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")) + ", verified boolean"
    schema = StructType([proven.schema["doc_id"], *StructType.fromDDL(made).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, subroot, root, proof, shown = (batch.column(c).to_pylist() for c in ("leaf", "subroot", "root", "proof", presented))
            folded = [fold(a, b) for a, b in zip(shown, proof)]
            columns = [
                *([v.hex() for v in values] for values in (leaf, subroot, root)),
                [digest_of([s for _, s in steps(p)]).hex() for p in proof],
                [f.hex() for f in folded],
                [f == r for f, r in zip(folded, root)],
            ]
            arrays = [batch.column("doc_id"), *(pa.array(v, f.type) for v, f in zip(columns, list(arrow)[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return proven.select("doc_id", "leaf", "subroot", "root", "proof", presented).mapInArrow(run, schema)


def tampered_leaf() -> Column:
    """The leaf of a row whose ``n_chars`` was raised by 1 where 7 divides the hash of its id, else its own."""
    raised = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    fields = [raised if c == "n_chars" else F.col(c) for c in FIELDS]
    own = leaf_of([F.col(c) for c in FIELDS])
    return F.when((id_hash() % 7 == 0) & F.col("n_chars").isNotNull(), leaf_of(fields)).otherwise(own)


def oracle() -> str:
    """The same rows in SQL: trees level by level, proofs along each leaf's path."""
    field = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    own = " || ".join(field.format(c) for c in FIELDS)
    changed = " || ".join(field.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "(ascii(substr(doc_id::VARCHAR, i::INTEGER, 1)))"

    def tree(name: str, base: str) -> str:
        """Nodes ``g, level, place, h, n`` of trees over ``base (g, place, h, n)``."""
        return f"""{name} AS (
          SELECT g, 0 AS level, place, h, n FROM {base}
          UNION ALL
          SELECT g, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, place // 2, n)"""

    return f"""WITH RECURSIVE table8(b, c, k) AS (
          SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, {bit}, k + 1 FROM table8 WHERE k < 8),
      crc AS (SELECT list(c ORDER BY b) AS t FROM table8 WHERE k = 8),
      leaf AS (SELECT doc_id, lang, sha256({own}) AS leaf, sha256({changed}) AS changed, n_chars,
          CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: {byte}::BIGINT)),
            lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) END AS hash FROM documents, crc),
      leaves AS (SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
          count(*) OVER (PARTITION BY lang) AS n FROM leaf),
      base1 AS (SELECT g, place, leaf AS h, n FROM leaves),
      {tree('up1', 'base1')},
      sub AS (SELECT g, h, '' AS one, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM up1 WHERE n = 1),
      base2 AS (SELECT one AS g, place, h, n FROM sub),
      {tree('up2', 'base2')},
      up AS (SELECT 1 AS t, * FROM up1 UNION ALL SELECT 2, * FROM up2),
      path AS (
        SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, u.t, u.level, coalesce(b.h, '') AS sibling,
               CASE WHEN b.h IS NULL THEN 0 WHEN b.place < u.place THEN 1 ELSE 2 END AS side, l.g, l.place AS spot
        FROM leaves l JOIN sub s ON s.g = l.g JOIN (SELECT h FROM up2 WHERE n = 1) r ON true
        JOIN up u ON (u.t = 1 AND u.g = l.g AND u.place = l.place >> u.level OR u.t = 2 AND u.place = s.place >> u.level) AND u.n > 1
        LEFT JOIN up b ON b.t = u.t AND b.g = u.g AND b.level = u.level AND b.place = xor(u.place, 1)),
      proofs AS (SELECT g, spot, string_agg(sibling, '' ORDER BY t, level) AS siblings, list({{'s': sibling, 'd': side}} ORDER BY t, level) AS steps FROM path GROUP BY g, spot),
      folded AS (SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
          list_reduce(list_concat([{{'s': CASE WHEN l.hash % 7 = 0 AND l.n_chars IS NOT NULL THEN l.changed ELSE l.leaf END, 'd': 0}}], coalesce(p.steps, [])),
            lambda a, x: {{'s': sha256(CASE x.d WHEN 1 THEN x.s || a.s WHEN 2 THEN a.s || x.s ELSE a.s END), 'd': 0}}).s AS folded_root
        FROM leaves l JOIN sub s ON s.g = l.g JOIN (SELECT h FROM up2 WHERE n = 1) r ON true LEFT JOIN proofs p ON p.g = l.g AND p.spot = l.place)
      SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
