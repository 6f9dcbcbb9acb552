"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest

from convoy.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def walked(levels, i, digest):
    proof = ""
    for level in levels[:-1]:
        run = level[i - i % 3:i - i % 3 + 3]
        proof += "".join(run[:i % 3] + run[i % 3 + 1:])
        digest = H("".join(run[:i % 3] + [digest] + run[i % 3 + 1:]))
        i //= 3
    return proof, digest


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda t: t[:3])
        trees[s] = plain_levels([t[2] for t in groups[s]])
    top = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(groups[s]):
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            proof, digest = walked(trees[s], i, plain_leaf(r, r["text"].replace("\n", "")) if cut else leaf)
            more, digest = walked(top, at, digest)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], H(proof + more), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 30, 80, 81, 82, 200])
def test_positions_follow_from_sizes(n):
    leaves = [H(str(k)) for k in range(n)]
    height = merkle.height_of(n)
    levels = plain_levels(leaves)
    assert len(levels) == height + 1
    log = merkle.append_log(leaves, height)
    assert len(log) == sum(map(len, levels))
    for level, nodes in enumerate(levels):
        assert [log[merkle.position(level, i, n)] for i in range(len(nodes))] == nodes


@pytest.mark.parametrize("n", [1, 5, 9, 27])
def test_builders_go_to_full_height(n):
    log = merkle.append_log([H(str(k)) for k in range(n)], 4)
    root = plain_levels([H(str(k)) for k in range(n)])
    top = root[-1][0]
    for _ in range(4 - (len(root) - 1)):
        top = H(top)
    assert log[-1] == top and log[merkle.position(4, 0, n)] == top


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_documents(documents):
    got = as_rows(merkle.manifest(documents))
    assert got == plain_manifest(documents.collect())
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_layers_of_many_builders(documents, monkeypatch):
    """Small builders: several layers in a tree, also in the tree over the sources."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 3)
    assert as_rows(merkle.manifest(documents.repartition(5))) == plain_manifest(documents.collect())


def test_odd_rows(odd, none):
    """Nulls, empty and long texts, repeated rows, null ids and clashing columns."""
    assert as_rows(merkle.manifest(odd)) == plain_manifest(odd.collect())
    got = merkle.manifest(none)
    assert got.count() == 0 and "verified" in got.columns


def test_one_row(odd):
    one = odd.where("doc_id = 4")
    (row,) = as_rows(merkle.manifest(one))
    assert row[1] == row[2] == row[3] and row[4] == H("") and row[6]


def test_a_change_is_found(spark, documents, tmp_path):
    """A tampered row breaks its own proof and no other; line breaks only where there are any."""
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(documents).collect()}
    for r in documents.collect():
        broken = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")
        assert got[r["doc_id"]] == (not broken)
