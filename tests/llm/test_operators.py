"""Each operator against a plain version, on odd rows and on an empty table."""

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash

from convoy.llm import (classifier, components, decontaminate, extraction, fmindex, htmltree, language, lines, mixing, passages,
                        quality_rules, queries, simhash, tokens)
from convoy.plans.registry import Entry

import compare
from conftest import PROSE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    rows, problem = compare.compare(spark, compare.connect(sf_dir), Entry(name, queries.QUERIES[name], queries.SQL[name], ()), sf_dir)
    assert problem is None
    assert rows == 200


# quality rules ------------------------------------------------------------------------------------------------------

def plain_counts(text):
    words = WORD.findall(text or "")
    spans = collections.defaultdict(list)
    for k in range(len(words) - 7):
        spans[tuple(words[k:k + 8])].append(k)
    hit = {k + j for places in spans.values() if len(places) > 1 for k in places for j in range(8)}
    seen = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(seen) - len(set(seen)), len(hit)


def test_rules_odd_rows(odd, none):
    got = quality_rules.judge(odd).collect()
    expected = sorted(plain_counts(r["text"]) for r in odd.collect())
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == expected
    by = {r["doc_id"]: r for r in got}
    assert by[1]["kept"] and by[6]["base_failed"] and by[4]["base_failed"] and not by[3]["kept"] and by[3]["n_words"] == 0
    assert quality_rules.judge(none).count() == 0


def test_rule_order_keeps_the_verdict(documents):
    first = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents).collect()}
    back = dict(reversed(quality_rules.rules().items()))
    assert first == {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents, checks=back, sample_rows=20).collect()}


# classifier ---------------------------------------------------------------------------------------------------------

def test_classifier_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = classifier.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 80
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_classifier_compiles_its_rules(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.fit(classifier.training_rows(documents, labels))
    assert model.rules
    names = list(classifier.features(documents["text"]))
    table = documents.select("doc_id", *[c.alias(n) for n, c in classifier.features(documents["text"]).items()]).collect()
    scores = {r["doc_id"]: r["score"] for r in classifier.scored(documents, model).collect()}
    for r in table:
        held = [w for rule, w in model.rules if all((r[n] > at) if above else (r[n] <= at) for n, above, at in rule.terms)]
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(held)))))
    assert len(names) == len(set(names))


def test_classifier_odd_rows(spark, odd, none, sf_dir):
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (None, 0), (4, None)], "doc_id long, quality int")
    got = classifier.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] == 1} == {zlib.crc32(b"1") % 3 == 1}
    assert classifier.classify(none, labels).count() == 0
    model = classifier.fit(labels.selectExpr("cast(null as string) text", "quality label"))
    kept = classifier.accepted(odd, model)
    assert kept.columns == odd.columns


# html ---------------------------------------------------------------------------------------------------------------

def test_extraction_finds_the_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in extraction.main_text(pages).collect()}
    for page in pages.collect():
        body = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        expected = " ".join(__import__("html").unescape(re.sub(r"</?b>", "", body) and re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[page["page_id"]]["text"] == expected
        assert got[page["page_id"]]["n_chars"] == len(expected)


def test_extraction_odd_pages(spark, sf_dir):
    model = extraction.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<div"), (4, "u", "a &lt; b&nbsp;c"), (5, "u", "<article><p>one<p>t<b>w</b>o<script>'</p>'</script></article>"), (5, "u", "<article><p>one<p>t<b>w</b>o</article>"), (None, "u", "<p>" * 3000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in extraction.main_text(pages, model).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, ""), (4, "a < b c"), (5, "one two"), (5, "one two"), (None, "")], key=str)
    assert extraction.main_text(pages.limit(0)).count() == 0


def test_svg_without_content_ends_in_its_tag():
    def seen(page):
        return [n.text for n in htmltree.parse(page) if not n.tag]

    assert seen("<p>one<svg class='a' />two</p><p>three</p><SVG id=\"/>\"><text>no</text></svg>four") == ["one", "two", "three", "four"]
    assert seen("<p>one<svg/>two</p>") == ["one", "two"]
    assert seen("<p>one<svg><path d='M0'/><svg/>no</svg>two</p>") == ["one", "two"]


def test_marginals_are_those_of_all_labellings():
    nodes = extraction.parse("<div><p>one two</p><nav><a>x</a></nav></div>")
    model = extraction.fit(extraction.layouts(extraction._PLAIN))
    own = []
    for found in extraction.features(nodes):
        p = 1 / (1 + np.exp(-np.clip(sum(model.weights.get(f, 0) for f in found) + model.weights["bias"], -30, 30)))
        own.append((1 - p, p))
    total = np.zeros(len(nodes))
    z = 0.0
    for mask in range(1 << len(nodes)):
        y = [mask >> k & 1 for k in range(len(nodes))]
        w = np.prod([own[k][y[k]] for k in range(len(nodes))]) * np.prod([model.pair[extraction.kind(n)][y[n.parent]][y[k]] for k, n in enumerate(nodes) if k])
        z += w
        total += w * np.array(y)
    assert model.marginals(nodes) == pytest.approx((total / z).tolist())


# tokens -------------------------------------------------------------------------------------------------------------

def test_tokens_round_trip(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = tokens.token_table(odd, path).orderBy("start").collect()
    expected = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect()))
    start = 0
    for (doc, text), r in zip(expected, got, strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_table(none, path).count() == 0


def test_encoder_equals_the_library():
    import random

    import public_tokenizers

    encode = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    rng = random.Random(3)
    parts = ["a", "Bc", " ", " ", "\n", "\t", "é", "ß,", "'s", "'t", "12", "!", ".", "\xa0", "\x85", "\x1c", "<|endoftext|>", "中", "don't", "　", "\U0001F600", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    for text, ids in zip(texts, encode(texts)):
        assert ids[:-2] == encode.whole(text), text


# language -----------------------------------------------------------------------------------------------------------

def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.001", "sf0.01"))
    got = language.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)


def test_language_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in language.classify(odd).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[9]["lang_pred"] == got[12]["lang_pred"] == "und"
    assert got[8]["held_out"] == (zlib.crc32(b"8") % 4 == 2)
    assert language.classify(none).count() == 0


def test_language_short_texts_and_rare_languages(spark):
    """A letter is enough for a learned language, and one training text for a language."""
    words = {"xx": "alpha beta gamma delta i epsilon", "yy": "omega sigma lambda kappa o theta"}
    rows = [(k, f"{words[lang]} {k % 5}", lang) for k in range(0, 400, 3) for lang in ("xx", "yy")] + [(9001, "zorbu fnarg pliwok u quemdash", "zz")]
    fold = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    rows = [(9100 + next(j for j in range(99) if not fold(9100 + j)), *r[1:]) if r[0] == 9001 else r for r in rows]
    asked = {"i": "xx", "O": "yy", "u": "zz", "中": "xx", "7 x 7": "xx", "a": "xx", "fnarg pliwok": "zz"}
    held = [(20_000 + k, t, None) for k, t in enumerate(asked)]
    df = spark.createDataFrame(rows + held, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.classify(df).collect()}
    assert {t: got[20_000 + k] for k, t in enumerate(asked)} == asked


def test_filter_has_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    model = language.build([("x", a), ("y", np.concatenate([b, a[:100]]))])
    assert (model.masks(a) & np.uint64(1)).all() and (model.masks(a[:100]) == 3).all()
    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert np.count_nonzero(model.masks(other) & np.uint64(1)) / 20000 == pytest.approx(model.chance[0], abs=0.002)


def test_filter_with_more_than_64_languages():
    texts = {f"l{k:03}": "".join(chr(0x4E00 + 40 * k + j) for j in range(40)) for k in range(130)}
    model = language.build([(name, language.grams(language.points(text))) for name, text in texts.items()])
    names, _ = language.decide(list(texts.values()), model)
    assert names == list(texts)


# lines --------------------------------------------------------------------------------------------------------------

def test_lines_odd_rows(spark, odd, none):
    got = {r["doc_id"]: r for r in lines.report(odd).collect()}
    assert got[1]["n_lines"] == 2 and got[1]["n_kept"] in (0, 1, 2)
    assert got[3]["n_lines"] == got[4]["n_lines"] == got[5]["n_lines"] == 0
    assert got[2]["removed"] == [0] and got[11]["removed"] == [0, 1] and got[8]["n_near"] == 1
    assert lines.report(none).count() == 0


def test_lines_near_equals_all_pairs(spark):
    import random

    rng = random.Random(4)
    base = [[rng.choice("abcd") for _ in range(rng.randint(4, 9))] for _ in range(40)]
    texts = []
    for words in base:
        for _ in range(3):
            w = list(words)
            k = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(k, "z"), lambda: w.pop(k), lambda: w.insert(k, "y"), lambda: None])()
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_repeats"], r["n_near"]) for r in lines.report(docs).collect()}

    def apart(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
            return False
        p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + 1:] == b[p + 1:] or a[p + 1:] == b[p:] or a[p:] == b[p + 1:]

    firsts = {}
    for k, t in enumerate(texts):
        firsts.setdefault(t, k)
    for k, t in enumerate(texts):
        near = any(f < firsts[t] and apart(t.split(), o.split()) for o, f in firsts.items() if o != t)
        assert got[k] == (int(firsts[t] != k), int(firsts[t] == k and near)), t


# mixing -------------------------------------------------------------------------------------------------------------

def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = {r["source"]: r["source_size"] for r in got}
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(total.values()))
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in mixing.mix(odd).collect()}
    rows = mixing.repeated(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).count() == 0


# decontamination ----------------------------------------------------------------------------------------------------

def test_fm_index_finds_all():
    rng = np.random.default_rng(2)
    for _ in range(40):
        x = rng.integers(0, 4, rng.integers(1, 120))
        x[-1] = 0
        index = fmindex.FmIndex(x)
        phrases = rng.integers(1, 5, (30, 4))
        lengths = rng.integers(1, 5, 30)
        low, high = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high):
            expected = [k for k in range(len(x) - n + 1) if (x[k:k + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_decontamination_odd_rows(spark, odd, none):
    tests = spark.createDataFrame([(1, " ".join(PROSE.split()[3:20])), (2, "der DIE das"), (2, "der die das"), (None, "中文"), (5, None), (6, "?!")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.report(odd, tests).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[7]["n_hit"], got[10]["n_hit"], got[10]["n_items"], got[3]["n_words"]) == (17, 1, 3, 1, 0, 0)
    assert got[1]["contaminated"] and not got[4]["contaminated"]
    assert decontaminate.report(none, tests).count() == 0 and decontaminate.report(odd, tests.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.uncontaminated(odd, tests)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 7)").count() == 0 and kept.where("doc_id IN (3, 4, 9)").count() == 3


def test_decontamination_in_blocks(spark, documents, sf_dir, monkeypatch):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.report(documents, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    monkeypatch.setattr(decontaminate, "SHARD", 3000)
    assert sorted(map(tuple, decontaminate.report(documents, benchmark).collect())) == whole


# SimHash ------------------------------------------------------------------------------------------------------------

def plain_print(text):
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(id, print) -> the smallest id of each row's component."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, (doc, _) in enumerate(prints):
        ids[find(k)].append(doc)
    return [min((d for d in ids[find(k)] if d is not None), default=None) for k in range(len(prints))]


@pytest.mark.parametrize("crowd", [1024, 2])
def test_simhash_equals_all_pairs(spark, documents, crowd):
    rows = documents.select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_print(r["text"])) for r in rows]
    expected = {(d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints))}
    assert {tuple(r) for r in simhash.near_duplicates(documents, crowd=crowd).collect()} == expected


def test_simhash_crowds(spark):
    import random

    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        p = rng.choice(prints)
        for _ in range(rng.randint(0, 5)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    table = spark.createDataFrame(signed, "doc_id long, fp long")
    expected = plain_components(list(enumerate(prints)))
    for crowd in (1024, 1, 5):
        assert [r["component_id"] for r in simhash.groups(table, crowd=crowd).orderBy("doc_id").collect()] == expected


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == "0" * 16 and by[5]["component_id"] == 3 and by[2]["component_id"] == 1
    kept = [r["doc_id"] for r in simhash.first_of_each(odd).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({r["component_id"] for r in got} - {None})
    assert simhash.near_duplicates(none).count() == 0 and simhash.first_of_each(none).columns == none.columns


def test_simhash_rows_that_share_an_id(spark):
    """Unrelated texts under one id are components of their own, and each keeps a row."""
    other = "completely different words stand in this second text which shares only its number with the first one above"
    rows = [(1, PROSE, "x"), (1, other, "x"), (2, "a third text with words that neither of the others has at all today", "y"), (3, other, "z"), (None, PROSE + " again and more", "n"), (1, PROSE, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    kept = simhash.first_of_each(df).collect()
    near = {r["fingerprint"] for r in simhash.near_duplicates(df).where("doc_id IS NULL").collect()}
    assert len(near) == 1
    assert sorted((r["doc_id"], r["text"], r["n"]) for r in kept if r["doc_id"]) == sorted([(1, PROSE, "w"), (1, other, "x"), (2, rows[2][1], "y")])
    assert len(kept) in (3, 4) and df.columns == simhash.first_of_each(df).columns


@pytest.mark.parametrize("distance", [2, 4, 6])
def test_simhash_links_are_all_near_pairs(spark, distance):
    """Every pair within the distance is linked at any crowd: pairs that differ in all ways of spreading the bits."""
    rng = np.random.default_rng(distance)
    centres = [int(x) for x in rng.integers(0, 2**63, 12, dtype=np.uint64)]
    prints = set(centres)
    for c in centres:
        for flips in range(1, distance + 2):
            for _ in range(12):
                prints.add(c ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    expected = {(max(a, b), min(a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= distance}
    found = simhash.links(spark.createDataFrame(signed, "fp long"), distance).collect()
    assert {(max(x, y), min(x, y)) for x, y in ((r["a"] % 2**64, r["b"] % 2**64) for r in found)} == expected


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (901, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {900: 900, 901: 900}


# passages -----------------------------------------------------------------------------------------------------------

def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, 12, rng.integers(1, 60)).astype(np.uint64)
        t = int(rng.integers(1, 8))
        expected = set()
        for k in np.flatnonzero(x):
            a = b = int(k)
            while a > 0 and x[a - 1] > x[k]:
                a -= 1
            while b + 1 < len(x) and x[b + 1] >= x[k]:
                b += 1
            if b - a + 1 >= t:
                expected.add((a, int(k), b))
        assert set(zip(*(v.tolist() for v in passages.compact_windows(x, t)))) == expected


def test_signatures_of_two_functions_are_all_pairs_of_least_tokens():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, t = int(rng.integers(1, 50)), int(rng.integers(1, 8))
        x, y = (rng.integers(1, rng.choice([4, 12, 1000]), n).astype(np.uint64) for _ in range(2))
        x[gaps := rng.random(n) < 0.05] = 0
        y[gaps] = 0
        expected = {}
        for a in range(n):
            for b in range(a + t, n + 1):
                if (x[a:b] == 0).any():
                    break
                both = a + int(np.argmin(x[a:b])), a + int(np.argmin(y[a:b]))
                low, high = expected.get(both, (a, b - 1))
                expected[both] = min(low, a), max(high, b - 1)
        l, c, r = passages.compact_windows(x, t)
        got = passages.refined({"l": l, "c": c, "h": c, "r": r}, y, t)
        assert set(zip(*(got[k].tolist() for k in ("l", "c", "h", "r")))) == {(l, min(k), max(k), r) for k, (l, r) in expected.items()}


def test_packed_windows_come_back():
    rng = np.random.default_rng(1)
    kinds = {n: np.int64 if n in passages._WIDE else np.int32 for n in passages._NAMES}
    w = {n: rng.integers(np.iinfo(kind).min, np.iinfo(kind).max, 1000, kind) for n, kind in kinds.items()}
    for names in (passages._NAMES, list(passages.WINDOW)):
        got = passages._unpacked(passages._packed({n: w[n] for n in names}), names)
        assert all(got[n].dtype == kinds[n] and (got[n] == w[n]).all() for n in names)


def test_parts_hold_every_good_run():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = rng.integers(0, 30, 3)
        twice = np.concatenate([np.append(rng.random(k) < rng.choice([0.5, 0.8, 0.95]), False) for k in n])
        begin = np.cumsum(n + 1) - n - 1
        expected = set()
        for first, size in zip(begin.tolist(), n.tolist()):
            for a in range(first, first + size):
                for b in range(a + 8, first + size + 1):
                    if twice[a] and 5 * twice[a:b].sum() >= 4 * (b - a):
                        expected |= set(range(max(a - 2, first), min(b + 2, first + size)))
        low, high = passages.runs(twice, begin, 10, 0.8)
        got = [k for a, b in zip(low.tolist(), high.tolist()) for k in range(a, b + 1)]
        assert sorted(expected) == got


def test_pairs_turned_away_early_have_no_passage(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(300):
        a = rng.integers(1, 1 << 60, rng.integers(40, 160)).astype(np.uint64)
        b = np.where(rng.random(len(a)) < rng.choice([0.05, 0.15, 0.25, 0.5]), rng.integers(1, 1 << 60, len(a)).astype(np.uint64), a)
        pairs.append((a, b, (0, len(a) - 1), (0, len(b) - 1), 0, 46, 0.8))
    got = [passages.verified(*p) for p in pairs]
    monkeypatch.setattr(passages, "runs", lambda *_: ([0], [0]))
    assert got == [passages.verified(*p) for p in pairs] and 20 < sum(map(bool, got)) < 280


def test_only_parts_that_come_twice_are_looked_at(spark):
    fresh = lambda k, n: [f"w{k}x{j}" for j in range(n)]
    passage = fresh("p", 60)
    rows = [(k, " ".join(fresh(k, 30) + (passage if k in (3, 7) else []) + fresh(f"z{k}", 70))) for k in range(10)]
    # 56 tokens come twice, 14 more are a fifth of the run, 9 on both sides make a window of 46
    for n in (1, 4):
        got = passages.repeated(spark.createDataFrame(rows, "doc long, text string").repartition(n), 46, 0.8).collect()
        assert sorted((r["doc"], r["low"], r["high"]) for r in got) == [(3, [21], [108]), (7, [21], [108])]


def test_a_copied_text_has_one_row(spark):
    text, other, short = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("b", 70), ("c", 40)))
    rows = [(1, other + " x " + text), *[(k, text) for k in (2, 2, 3, 4)], (4, other), (5, short), (6, short)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r)[:6] for r in got) == [(2, 0, 60, 1, 71, 60), (3, 0, 60, 2, 0, 60), (4, 0, 60, 2, 0, 60), (4, 0, 70, 1, 0, 70)]


def near_pairs(texts):
    """All pairs of texts of which some 46 five-word runs in a row each have a Jaccard similarity of 0.8, by trying them all."""
    runs = {d: [tuple(w[k:k + 5]) for k in range(len(w) - 4)] for d, w in texts.items()}
    holders, shared = collections.defaultdict(set), collections.Counter()
    for d, r in runs.items():
        for x in set(r):
            holders[x].add(d)
    for d in holders.values():
        shared.update((a, b) for a in d for b in d if a > b)
    out = set()
    for (a, b), n in shared.items():
        if n < 37:
            continue
        every, other = set(runs[b]), [set(runs[b][k:k + 46]) for k in range(len(runs[b]) - 45)]
        for k in range(len(runs[a]) - 45):
            mine = set(runs[a][k:k + 46])
            if 9 * len(mine & every) >= 4 * (len(mine) + 37) and any(len(mine & o) >= 0.8 * len(mine | o) for o in other):
                out.add((a, b))
                break
    return out


def test_passages_hang_together_as_all_near_pairs(spark, documents):
    texts = {r["doc_id"]: r["text"].lower().split() for r in documents.where("text IS NOT NULL").collect()}
    expected = near_pairs(texts)
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for r in passages.repeated_passages(documents).collect():
        root[top(r["doc_id"])] = top(r["of_doc"])
    lost = {(a, b) for a, b in expected if top(a) != top(b)}
    assert len(expected) > 20 and not lost


def test_passages_against_all_windows(spark, documents):
    texts = {r["doc_id"]: r["text"].lower().split() for r in documents.collect()}
    where = collections.defaultdict(set)
    for doc, words in texts.items():
        for k in range(len(words) - 49):
            where[tuple(words[k:k + 50])].add(doc)
    shared = set().union(*(d for d in where.values() if len(d) > 1))
    got = passages.repeated_passages(documents).collect()
    found = {d for r in got for d in (r["doc_id"], r["of_doc"])}
    assert not shared - found
    for r in got:
        a = texts[r["doc_id"]][r["first_word"]:r["first_word"] + r["n_words"]]
        b = texts[r["of_doc"]][r["of_first_word"]:r["of_first_word"] + r["of_n_words"]]
        x, y = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(x & y) / len(x | y) >= 0.8 and r["of_doc"] < r["doc_id"]


def test_passages_odd_rows(spark, odd, none):
    assert passages.repeated_passages(odd).count() == 0  # the long text repeats itself only
    assert passages.repeated_passages(none).count() == 0
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join([f"x{k}{j}" for j in range(30)] + words[50:110] + [f"y{k}{j}" for j in range(30)]), "t") for k in range(40)] + [(None, " ".join(words), "t")], "doc_id long, text string, a string")
    got = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 40)) and all((r["first_word"], r["n_words"]) == (30, 60) for r in got)
    assert len(got) <= 2 * passages.PAIRS * 39  # never all pairs


def test_passages_find_every_near_copy(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 60, n)]
    rows = []
    for k in range(0, 800, 2):
        passage = fresh(50)
        copy = passage[:25] + fresh(1) + passage[26:]  # 41 of 51 tokens
        rows += [(k, " ".join(fresh(40) + passage + fresh(40))), (k + 1, " ".join(fresh(40) + copy + fresh(40)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], r["of_doc"]) for r in got} == {(k + 1, k) for k in range(0, 800, 2)}


def test_passages_with_a_wide_insertion():
    rng = np.random.default_rng(6)
    a = " ".join(f"w{k}" for k in rng.integers(0, 1 << 60, 90))
    b = " ".join([*a.split()[:45], *(f"x{k}" for k in range(8)), *a.split()[45:]])
    x, y = (passages.token_hashes([t.encode()])[0][:-1] for t in (a, b))
    assert passages.verified(x, y, (0, 85), (0, 93), 0, 46, 0.8) == [(0, 85, 0, 93, 82 / 98)]
    assert passages.verified(y, x, (0, 93), (0, 85), 0, 46, 0.8) == [(0, 93, 0, 85, 82 / 98)]


def test_passages_around_frequent_words(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 60, n)]
    hot, rows, pairs = fresh(40), [], 60
    for k in range(pairs):  # 60 equal words, of which 40 are in all other texts too
        passage = fresh(10) + hot + fresh(10)
        rows += [(2 * k + j, " ".join(fresh(30) + passage + fresh(30))) for j in (0, 1)]
    rows += [(1000 + k, " ".join(fresh(40) + hot + fresh(40))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(docs.repartition(4)).collect()
    assert {(r["doc_id"], r["of_doc"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(pairs)}


def test_copies_of_one_root_meet_again_once(spark):
    text = " ".join(f"w{k}" for k in range(100))
    other = text.replace("w70 ", "x70 ")
    texts = spark.createDataFrame([(k, text if k < 40 else other) for k in range(42)], "doc long, text string")
    # 20 copies with root 0, 20 with root 20, two that differ in one word with root 0, and one window that ends before it
    rows = [(7, k, 5, 50, 52, 90, 0 if k < 20 or k > 39 else 20) for k in range(42)] + [(7, 41, 5, 50, 52, 60, 0), (7, 3, 5, 50, 52, 60, 0), (8, 9, 5, 50, 52, 90, 0)]
    windows = spark.createDataFrame(rows, "key long, doc long, l int, c int, h int, r int, root long")
    got = sorted((r["key"], r["doc"], r["r"], r["root"], r["m"]) for r in passages.unlike(windows, texts).collect())
    assert got == [(7, 0, 90, 0, 4), (7, 3, 60, 0, 4), (7, 20, 90, 20, 4), (7, 40, 90, 0, 4), (8, 9, 90, 0, 1)]


def test_words_around_elements_without_content():
    page = "<body><article><p>wo<img src=x>rd and fl<input type=hidden>ow <video src=v></video>on</p><p>next</p></article></body>"
    nodes = htmltree.parse(page)
    assert htmltree.joined(nodes, [True] * len(nodes)) == "word and flow on next"


def test_shards_are_read_by_many_tasks(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/t"
    tokens.write_shards(documents, folder, queries.tokenizer_path())
    shards = spark.read.parquet(f"{folder}/manifest").count()
    assert tokens.read_shards(spark, folder).rdd.getNumPartitions() == shards


def test_classifier_without_a_telling_statistic(spark):
    rows = [("the same text", k % 4 == 0) for k in range(40)]
    model = classifier.fit(spark.createDataFrame(rows, "text string, label boolean").selectExpr("text", "int(label) AS label"))
    scores = classifier.scored(spark.createDataFrame([(1, "any text")], "doc_id long, text string"), model).collect()
    assert scores[0]["score"] == pytest.approx(0.25, abs=1e-6)
