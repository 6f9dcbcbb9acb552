"""Alignment of two tokenizers against plain loops over bytes."""

import bisect
import collections
import hashlib
import re

import numpy as np
import pytest

from convoy.llm import alignment
from convoy.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(A))
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def plain_tokens(coders, text):
    """Ids and bytes of both, or none."""
    tok, sp = coders
    if not text:
        return [], []
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        piece = sp.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], []
    return a, b


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain_alignment(coders, rows):
    each = []
    for doc_id, text in rows:
        a, b = (spans(x) for x in plain_tokens(coders, text))
        links, start = [], 0
        for i, s, e in a:
            while start < len(b) and b[start][2] <= s:
                start += 1
            k = start
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([], []) for _ in both]
        for side, tokens in enumerate((a, b)):
            for i, _, e in tokens:
                groups[bisect.bisect_left(both, e)][side].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        each.append((doc_id, len(a), len(b), len(both), links, ";".join(groups)))
    count = collections.Counter(p for *_, links, _ in each for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(((d, na, nb, ng, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if na else "") for d, na, nb, ng, links, g in each), key=repr)


def as_rows(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def run(df, **more):
    return alignment.align(df, tokenizer_path(A), tokenizer_path(B), **more)


def test_documents(documents, coders):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = as_rows(run(documents))
    assert got == plain_alignment(coders, rows)
    assert sum(r[3] for r in got) > 1000


TEXTS = ["a", " ", "  two  spaces ", "\n", "\n\nlines\n", "tab\tand\r\nreturn", "end <|endoftext|> of text", "<s> </s> <unk> <0x41>", "under▁line", "é́ ﬁ ①",
         "中文字符 日本語 \U0001F600\U0001F469‍\U0001F4BB", "naïve café", "x" * 300, "don't we'll I'm", "1234567 3.14", " nbsp　wide", "The quick brown fox jumps"]


def test_texts_of_all_kinds(spark, coders):
    rows = list(enumerate(TEXTS)) + [(None, "The quick"), (3, None), (3, ""), (0, "a"), (0, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_rows(run(df))
    assert got == plain_alignment(coders, rows)
    by = {r[0]: r for r in got if r[0] is not None and r[0] > 3}
    assert by[TEXTS.index("under▁line")][1:] == (0, 0, 0, 0, 0, 0, "")
    assert by[TEXTS.index("end <|endoftext|> of text")][1] > 5


def test_odd_rows(odd, none, coders):
    assert as_rows(run(odd)) == plain_alignment(coders, [(r.doc_id, r.text) for r in odd.collect()])
    assert run(none).count() == 0


def test_lanes_do_not_change_the_result(spark, coders, monkeypatch):
    """A very long text: with lanes and without, and in blocks of one document, links and cuts are the same."""
    long = ("some naïve words 中文 and 12345 more\n" * 1500)
    rows = [(1, long), (2, long), (3, "some naïve words"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    first = as_rows(run(df))
    monkeypatch.setattr(alignment, "LANE", 10**9)
    monkeypatch.setattr(alignment, "BLOCK", 1000)
    assert as_rows(run(df)) == first
    plain = {r[0]: r for r in plain_alignment(coders, rows)}
    assert all(r == plain[r[0]] for r in first) and first[0][1] > 10_000


def test_groups_spell_the_text(spark, coders):
    """The groups themselves give both id sequences back, and each group's bytes agree."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    tok, sp = coders
    for r in run(df, groups=True).where("n_a > 0").collect():
        pairs = [g.split("|") for g in r.groups.split(";")]
        assert [int(i) for a, _ in pairs for i in a.split(",")] == tok.encode(" " + TEXTS[r.doc_id], add_special_tokens=False).ids
        assert [int(i) for _, b in pairs for i in b.split(",")] == sp.encode(TEXTS[r.doc_id])


def test_merge_of_random_ends():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = (np.append(np.sort(rng.choice(n, int(rng.integers(0, n)), replace=False))[1:], n) for _ in range(2))
        a, b = a[a > 0], b[b > 0]
        la, lb, ca, cb = alignment.merge(a, b, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(a)]))
        starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        assert sorted(zip(la, lb)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]]
        assert a[ca].tolist() == b[cb].tolist() == sorted(set(a) & set(b))
