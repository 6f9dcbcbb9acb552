"""Sketches against plain sets of paragraphs."""

import collections
import hashlib

import numpy as np
import pytest

from convoy.llm import sketches


def plain_paragraphs(text):
    """Cut after line breaks, and after spaces whose eight bytes before hash to it, byte by byte."""
    raw, out, start = text.encode(), [], 0
    padded = b"\0" * 8 + raw
    for k, byte in enumerate(raw):
        mixed = sum(padded[k + 8 - j - 1] * int(sketches._CUT[j]) for j in range(8)) * int(sketches._CUT[8]) % 2**64
        if byte == 10 or (byte == 32 and mixed >> 61 == 0):
            out.append(raw[start:k + 1])
            start = k + 1
    return out + [raw[start:]] if start < len(raw) else out


def plain_likeness(a, b):
    x, y = (collections.Counter(plain_paragraphs(t)) for t in (a, b))
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 1.0


def plain_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_likeness(text, edited), plain_likeness(text, after)))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()), key=repr)


@pytest.mark.parametrize("rows_each", [10_000, 7])
def test_documents(documents, rows_each):
    """Whole table, in one range and in many."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sketches.edits(documents, rows_each=rows_each).cache()
    assert as_rows(got) == plain_edits(rows)
    prints = collections.defaultdict(set)
    text = dict(rows)
    for r in got.collect():
        prints[text[r.doc_id]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    means = got.selectExpr("avg(near_edited)", "avg(near_next)").first()
    assert means[0] > 0.25 and means[1] < 0.1
    got.unpersist()


def test_odd_rows(odd, none, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert as_rows(sketches.edits(odd)) == plain_edits(rows)
    assert as_rows(sketches.edits(odd, rows_each=2)) == plain_edits(rows)
    assert sketches.edits(none).count() == 0 and sketches.fingerprints(none).count() == 0
    one = spark.createDataFrame([(7, "alone in the table")], "doc_id long, text string")
    assert as_rows(sketches.edits(one)) == plain_edits([(7, "alone in the table")])
    prints = {r.doc_id: r for r in sketches.fingerprints(odd).collect() if r.doc_id}
    assert prints[3].n_paragraphs == 0 and prints[3].fingerprint == prints[4].fingerprint != prints[1].fingerprint


def test_edited_fingerprint_is_that_of_the_edited_text(spark, documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    ids = sorted(rows)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    edited = [(i, rows[i][:len(rows[i]) - len(rows[i]) // 2] + rows[after[i]][:len(rows[i]) // 2]) for i in ids]
    prints = {r.doc_id: r.fingerprint for r in sketches.fingerprints(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    assert prints == {r.doc_id: r.edited_fingerprint for r in sketches.edits(documents).collect()}


def test_peeling_recovers_the_digests_of_random_sets():
    rng = np.random.default_rng(1)
    for cells in (1, 2, 16, 64):
        sets = [np.unique(rng.integers(0, 2**63, int(rng.integers(0, 200)), dtype=np.uint64)) for _ in range(40)]
        for k in range(0, 40, 4):  # versions that differ a little, and equal ones
            sets[k + 1] = np.unique(np.append(sets[k][: len(sets[k]) - 3], rng.integers(0, 2**63, 4, dtype=np.uint64)))
            sets[k + 2] = sets[k]
        counts = np.array([len(s) for s in sets])
        old, new = np.arange(39), np.arange(1, 40)
        key, pair, sign, used = sketches.differences(np.concatenate(sets), counts, old, new, cells)
        for k in range(39):
            mine = pair == k
            assert sorted(key[mine & (sign > 0)]) == sorted(set(sets[k]) - set(sets[k + 1]))
            assert sorted(key[mine & (sign < 0)]) == sorted(set(sets[k + 1]) - set(sets[k]))
        small = [k for k in range(39) if len(set(sets[k]) ^ set(sets[k + 1])) <= 1]
        assert (used[small] == cells).all() and used.max() > 64


def test_digests_that_share_all_cells_are_compared(monkeypatch):
    monkeypatch.setattr(sketches.Sketches, "_places", lambda self, keys, owner, table: (owner * 3 + table) * self.cells)
    keys = np.arange(1, 8, dtype=np.uint64)
    key, _, sign, _ = sketches.differences(keys, np.array([4, 3]), np.array([0]), np.array([1]))
    assert sorted(zip(key.tolist(), sign.tolist())) == [(k, 1 if k < 5 else -1) for k in range(1, 8)]


def test_sums_that_pass_for_digests(monkeypatch):
    """Checks of two bits: many sums of digests fit and lie open again and again."""
    add, calls = sketches.Sketches._add, [0]

    def counted(self, *rows):
        calls[0] += 1
        assert calls[0] < 100_000, "peels without end"
        add(self, *rows)

    monkeypatch.setattr(sketches.Sketches, "_add", counted)
    monkeypatch.setattr(sketches, "checks", lambda keys: keys >> np.uint64(62))
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, int(rng.integers(0, 120)), dtype=np.uint64)) for _ in range(400)]
    key, pair, sign, _ = sketches.differences(np.concatenate(sets), np.array([len(s) for s in sets]), np.arange(399), np.arange(1, 400))
    for k in range(399):
        mine = pair == k
        assert sorted(key[mine & (sign > 0)]) == sorted(set(sets[k]) - set(sets[k + 1]))
        assert sorted(key[mine & (sign < 0)]) == sorted(set(sets[k + 1]) - set(sets[k]))


def test_changed_paragraphs_between_versions(spark):
    text = "\n".join(f"line {k} of the text" for k in range(300))
    old = [(1, text), (2, text), (3, "same"), (4, "gone"), (None, "no id"), (6, None)]
    new = [(1, text.replace("line 7 of", "line seven of")), (2, "quite another\ntext"), (3, "same"), (5, "come"), (None, "no id"), (6, "")]
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in (old, new)]
    got = {r.doc_id: r for r in sketches.changed_paragraphs(*frames).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    texts = {i: (dict(old).get(i) or "", dict(new).get(i) or "") for i in got}
    for i, r in got.items():
        a, b = (collections.Counter(plain_paragraphs(t)) for t in texts[i])
        assert (len(r.only_old), len(r.only_new)) == (sum((a - b).values()), sum((b - a).values()))
        assert r.likeness == plain_likeness(*texts[i])
    assert got[1].cells == sketches.CELLS < got[2].cells
    keys, _ = sketches.digests(["gone"])
    assert got[4].only_old == keys.view(np.int64).tolist() and got[5].only_old == []


def test_an_edit_changes_few_paragraphs():
    words = [f"w{k * 7919 % 1000}" for k in range(2000)]
    a, b = " ".join(words), " ".join(words[:1000] + ["inserted"] + words[1000:])
    keys, counts = sketches.digests([a, b])
    *_, used = sketches.differences(keys, counts, np.array([0]), np.array([1]))
    assert sketches.likeness(keys, counts, np.array([0]), np.array([1]))[0] > 0.97 and used[0] == sketches.CELLS
