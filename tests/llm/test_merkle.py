"""The Merkle manifest against a tree built in plain Python, and against SQL."""

import hashlib
import zlib

import duckdb
import pytest

from seriesloom.llm import merkle

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root and proof of each node, as a list of (side, sibling)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            above.append(digest(*pair))
        for leaf_no, place in enumerate(at):
            other = place ^ 1
            proofs[leaf_no].append((None, "") if other >= len(nodes) else ("l" if other < place else "r", nodes[other]))
            at[leaf_no] = place // 2
        nodes = above
    return nodes[0], proofs


def plain(rows):
    out = []
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {k: sorted((r for r in rows if r["lang"] == k), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for k in langs}
    trees = [tree([leaf(r) for r in groups[k]]) for k in langs]
    root, top = tree([t[0] for t in trees])
    for (subroot, proofs), k, above in zip(trees, langs, top):
        for r, proof in zip(groups[k], proofs):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf(r, 1 if tampered else 0)
            for side, sibling in proof + above:
                h = digest(sibling, h) if side == "l" else digest(h, sibling)
            out.append((r["doc_id"], leaf(r), subroot, root, digest(*(s for _, s in proof + above)), h, h == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], NAMES + ", subroot int")


def result(frame, height):
    proven = merkle.manifest(frame, {"presented": merkle.tampered_leaf()}, height)
    return sorted((tuple(r) for r in merkle.audit(proven, "presented").collect()), key=str)


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_against_plain_trees(spark, height):
    rows = [(i, f"text {i} é🙂", "en" if i % 3 else "de", "s" if i % 2 else None, 10 * i) for i in range(47)]
    rows += [(None, None, None, None, None), (None, "x", None, "s", 3), (100, "", "", "", 0), (101, "a", "z", "b", None), (102, "lone", "x", "b", 4)]
    rows += [(7, "text 7 é🙂", "en", "s", 70), (7, "other", "en", "s", 70), (7, "text 7 é🙂", "en", "s", 70), (8, "y" * 70_000, "en", "s", 70_000)]
    frame = table(spark, rows)
    want = plain(rows_of(frame))
    assert result(frame, height) == want
    assert any(not w[6] for w in want) and any(w[6] for w in want)


def test_small_tables(spark):
    assert result(table(spark, []), 10) == []
    for n in (1, 2, 3):
        for lang in ("en", None):
            frame = table(spark, [(i, "t", lang, "s", 1) for i in range(n)])
            assert result(frame, 1) == plain(rows_of(frame))


def test_blocks_in_label_order():
    nodes = merkle.upward([bytes([i]) * 32 for i in range(5)], 8, 13, 3)
    assert [n[:2] for n in nodes] == sorted(n[:2] for n in nodes) and nodes[-1][:2] == (3, 1)
    proofs = merkle.downward(nodes, b"")
    assert all(merkle.fold(bytes([i]) * 32, p) == nodes[-1][2] for i, p in enumerate(proofs))
    assert len(list(merkle.steps(proofs[4]))) == 3


def test_query_against_plain_and_sql(spark, data):
    import __spark_entry__ as entry

    got = sorted((tuple(r) for r in entry.queries()["op12_merkle_manifest"](spark, data).collect()), key=str)
    assert got == plain(rows_of(spark.read.parquet(f"{data}/documents.parquet")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(con.execute(entry.oracle_sql()["op12_merkle_manifest"]).fetchall(), key=str) == got
