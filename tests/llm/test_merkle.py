"""The Merkle manifest against trees built level by level in memory."""

import hashlib
import random
import zlib

import pytest

from sitelore.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos string, node int, grp double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """(root, for each node its (place in the run, other nodes of the run) on every level)."""
    paths, level = [[] for _ in nodes], [(x, [i]) for i, x in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 2):
            run = level[k:k + 2]
            for j, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append((j, [run[o][0] for o in range(len(run)) if o != j]))
            above.append((sha("".join(d for d, _ in run)), sum((ms for _, ms in run), [])))
        level = above
    return level[0][0], paths


def leaf(row, add=0):
    doc_id, source, lang, n_chars, text = row
    values = doc_id, source, lang, None if n_chars is None else n_chars + add, text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute(rows):
    if not rows:
        return []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, *tree([leaf(r) for r in own])
    root, tops = tree([trees[x][1] for x in langs])
    for k, lang in enumerate(langs):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path = path + tops[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf(r, int(tampered))
            for j, others in path:
                node = sha("".join(others[:j] + [node] + others[j:]))
            out.append((r[0], leaf(r), subroot, root, sha("".join("".join(o) for _, o in path)), node, node == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


@pytest.mark.parametrize("n,levels", [(0, 2), (1, 2), (2, 12), (45, 2), (130, 3)])
def test_op12_odd_rows(spark, n, levels):
    """Null and repeated ids, null fields, several languages, blocks of blocks, clashing column names."""
    rng = random.Random(n)
    rows = [(rng.choice([None, i, i, i, -i, 2**62]), rng.choice(["a", None, ""]), rng.choice(["en", "en", "en", "de", None, "é", ""]),
             rng.choice([None, 3, 9, 2**63 - 1]), rng.choice(["x", None, "", "ü"])) for i in range(n)]
    rows += rows[:n // 5]
    df = spark.createDataFrame([(*r, "p", 1, 2.0) for r in rows], SCHEMA)
    assert result(merkle.manifest(df, levels=levels)) == brute(rows)


def test_op12_query_over_whole_table(spark):
    df = queries.table(spark, SF, "documents")
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert result(queries.op12_merkle_manifest(spark, SF)) == brute(rows)


def test_op12_witness_leads_to_the_root_and_nothing_else_does(spark):
    df = queries.table(spark, SF, "documents")
    for r in merkle.manifest(df, with_witness=True, levels=4).limit(30).collect():
        way = r.witness.split()
        assert merkle.folded(r.leaf, way) == r.root and merkle.proof(way) == r.proof_sha256
        assert merkle.folded(merkle.digest(r.leaf), way) != r.root
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_op12_append_extends_open_witnesses():
    block = merkle.Block()
    for k in range(6):
        block.append(merkle.digest(str(k)))
    assert [len(w) for w in block.witnesses] == [2, 2, 2, 2, 1, 1]  # two open subtrees: of four and of two
    root, height = block.close()
    assert height == 3 and all(merkle.folded(merkle.digest(str(k)), w) == root for k, w in enumerate(block.witnesses))
