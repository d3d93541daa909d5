"""Corpus operators on small hostile tables, against brute force."""

import hashlib
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import common, exact_dedup, language, licenses, line_dedup, mixing, ngram_join, packing, quality, toxicity
from seriesloom.llm.common import WordSplitter, text_slices, windows
from seriesloom.llm.queries import word_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, row string, size long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, lang, src, None if t is None else len(t), 0.5, "b", "r", -1) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


LINE = "this very common line is long enough to count"
HOSTILE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", "a"),
    (4, "Hello World", "en", "a"),
    (5, "Hello  World\n", "en", "b"),
    (6, "HelloWorld", None, "b"),
    (7, f"{LINE}\nown words here\n{LINE}", "en", "b"),
    (8, f"  {LINE.upper()}\t\nother words there", "en", "a"),
    (9, f"{LINE}\n", "fr", None),
    (9, f"{LINE}\n", "fr", None),
    (10, "x" * 70_000 + " " + "y z " * 20_000, "en", "a"),
    (11, "日本語 テキスト ١٢٣ é́ ß İ Σας <|endoftext|> it's 12.5%", "xx", "c"),
    (None, "no id here at all, really none", "en", "a"),
    (12, "a b c d e f g a b c d e f g", "en", "c"),
    (13, "Released under the MIT Licence", "en", "c"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    return docs(spark, HOSTILE).cache()


def by_id(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["doc_id"]].append(r.asDict())
    return out


def test_word_hashes_agree_across_pieces(monkeypatch):
    texts = ["", "one two  three", "two", "x" * 500, "a\nb c" * 40, "one"]
    for kind, pattern in (("run", r"[^\x20\x09-\x0D]+"), ("alnum", r"\w+")):
        whole, counts, chars = WordSplitter(kind).split(texts)
        words = [re.findall(pattern, t) for t in texts]
        assert counts.tolist() == [len(w) for w in words] and chars.tolist() == [sum(map(len, w)) for w in words]
        flat = [w for part in words for w in part]
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(flat, whole.tolist())) and len(set(seen.values())) == len(seen)
        monkeypatch.setattr("seriesloom.llm.common.PIECE", 600)
        again, counts2, _ = WordSplitter(kind).split(texts)
        assert (again == whole).all() and (counts2 == counts).all()
        monkeypatch.undo()
    keys, at = windows(np.arange(6, dtype=np.uint64), np.array([2, 4]), 3)
    assert at.tolist() == [2, 3] and len(set(keys.tolist())) == 2


def test_licenses(spark, hostile):
    got = by_id(licenses.scan(hostile))
    assert sum(map(len, got.values())) == len(HOSTILE)
    assert got[13][0]["license_id"] == "MIT" and got[13][0]["notice_ids"] == "MIT" and got[13][0]["permissive"]
    assert got[1][0]["text_digest"] == got[3][0]["text_digest"] and got[1][0]["license_id"] is None
    mit = next(t for i, _, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    noisy = "Copyright (c) 2001 Somebody\nAll rights reserved.\n" + mit.upper().replace("COPYRIGHT NOTICE", "copyright  notice").replace("SUBLICENSE", "sub-license")
    rows = [(1, noisy, None, None), (2, "Text before\n\n" + mit, None, None), (3, mit + " And more", None, None)]
    got = by_id(licenses.scan(docs(spark, rows)))
    assert got[1][0]["license_id"] == "MIT"
    assert got[2][0]["license_id"] is None and got[2][0]["notice_ids"] == "MIT"
    assert got[3][0]["notice_ids"] == ""
    assert licenses.scan(docs(spark, [])).count() == 0


def test_complete_license_files(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    files = [(p.stem.split("~")[0], p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "CC-BY-SA-4.0"} <= {n for n, _ in files}
    body = dict(files)
    owner = "Copyright (c) 2020 A. N. Author\nAll rights reserved.\n\n"
    files += [(n, f"{title}\n\n{owner}{body[n]}") for n, title in (("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"))]
    for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        for width in (66, 72, 78, 80):
            files.append((n, owner + "\n\n".join(textwrap.fill(p, width) for p in body[n].split("\n\n"))))
    rows = [(i, text, None, None) for i, (_, text) in enumerate(files)]
    rows.append((9000, f"read this first\n\nMIT License\n\n{body['MIT']}\n\nand more", None, None))
    got = by_id(licenses.scan(docs(spark, rows)))
    assert [(n, got[i][0]["license_id"]) for i, (n, _) in enumerate(files) if got[i][0]["license_id"] != n] == []
    assert got[9000][0]["license_id"] is None and got[9000][0]["notice_ids"] == "MIT"


def brute_segments(scores):
    """Maximal segments by their definition: greatest first, then left and right of it."""
    if not len(scores):
        return []
    best = max(((sum(scores[i : j + 1]), -(j - i), i, j) for i in range(len(scores)) for j in range(i, len(scores))))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    left, right = brute_segments(scores[:i]), brute_segments(scores[j + 1 :])
    return left + [(i, j, best[0])] + [(a + j + 1, b + j + 1, s) for a, b, s in right]


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(60):
        scores = np.round(rng.normal(-0.3, 1, rng.integers(0, 25)), 3)
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores.tolist())]


def test_segment_scan_takes_linear_time():
    def seconds(hits):
        scores = np.full(26 * hits, -0.05)
        scores[::26] = 1.0  # prefix sums fall, so no segment ever joins another
        begin = time.perf_counter()
        assert len(toxicity.maximal_segments(scores)) == hits
        return time.perf_counter() - begin

    assert seconds(64_000) < 12 * max(seconds(16_000), 0.01)


def test_toxicity(spark, hostile):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        toxic = i % 5 == 0
        for _ in range(6 if toxic else 0):
            words.insert(int(rng.integers(20, 40)), str(rng.choice(["vile", "nasty", "foul"])))
        rows.append((i, " ".join(words), "en", "a"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    table = docs(spark, rows)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    got = by_id(toxicity.score(table, model))
    assert np.mean([(got[i][0]["score"] >= 0.5) == (i % 5 == 0) for i in range(600)]) > 0.97
    spans = got[0][0]["spans"]
    assert spans and all(10 <= s["first_word"] <= s["last_word"] <= 60 for s in spans)
    odd = by_id(toxicity.score(hostile, model))
    assert sum(map(len, odd.values())) == len(HOSTILE) and all(0 <= r["score"] <= 1 for v in odd.values() for r in v)
    assert odd[1][0]["score"] == odd[2][0]["score"] and odd[1][0]["n_words"] == 0
    none = toxicity.fit(table, known.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score(hostile, none).collect())


@pytest.mark.parametrize("memory", [1_000_000, 8])
def test_packing_round_trip(spark, hostile, memory, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", memory)
    encoder = Tokenizer.from_file(word_vocabulary())
    odd = [chr(c) for c in (0x1C, 0x1D, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF, 0x301)]
    more = [(100 + i, f"left{c}right end.{c} {c}x", None, None) for i, c in enumerate(odd)]
    more += [(200, "Don't WON'T i'll 'tis o'clock's rock'n'roll ... !!! a.b,c; (x) \"q\" ǅ ﬁ ﷺ é Ω ΑΣ Σ ΑΣ.", None, None)]
    table = hostile.unionByName(docs(spark, more))
    pieces = defaultdict(list)
    rows = packing.pack(table, word_vocabulary, 256).collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text, *_ in [*HOSTILE, *more]:
        want = encoder.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(pieces[i], key=lambda r: (r["start"], r["sequence_id"]))
        if i == 9:
            mine = mine[::2] if len(mine) == 2 else mine
            assert len(pieces[9]) >= 2
        got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist()
        assert got[: len(want)] == want, i
        assert all(r["doc_tokens"] == len(want) for r in mine)
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    last = max(fill)
    for k, spans in fill.items():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
        assert k == last or sum(n for _, n in spans) == 256
    assert packing.pack(docs(spark, []), word_vocabulary).count() == 0


@pytest.mark.parametrize("memory", [1_000_000, 8])
def test_ids_of_odd_words(memory, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", memory)
    encoder, words = Tokenizer.from_file(word_vocabulary()), packing.WordTokenizer(word_vocabulary())
    # names of special tokens count in their own case only
    texts = ["a <|ENDOFTEXT|> b", "A<|endoftext|>B", "<|StartOfText|>", "<| ÄB Σ", "", " \t", "x\x1fy Z", "e\u0338=\u0338 =\u0338 a=\u0338"]
    signs = list("aZéÿʯŉǅßΣσİжҐ漢か\u0958\ufb1d\u212be\u0301ªº²٣9_'.,!=<|>… \n\t\xa0\x85\u2003\x1c\u200b😀÷×\u0338") + ["'s", "'LL", "the", "Über"]
    rng = np.random.default_rng(8)
    texts += ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(3000)]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        got = [np.frombuffer(x, words.dtype).tolist() for x in words.encode(part)]
        assert got == [encoder.encode(t, add_special_tokens=False).ids for t in part]
    assert len(words.words) <= max(memory, 10_000)


def test_a_word_longer_than_others_together(monkeypatch):
    from tokenizers import Tokenizer

    text = "ab " * 400 + "é" * 3000 + "!" * 3000 + " x"
    monkeypatch.setattr(packing, "LINES", 1)
    want = Tokenizer.from_file(word_vocabulary()).encode(text, add_special_tokens=False).ids
    got = packing.WordTokenizer(word_vocabulary()).encode([text, "", text])
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [want, [], want]


def test_language(spark, hostile):
    rng = np.random.default_rng(2)
    kinds = {"aa": ["thing", "other", "with", "the", "and"], "bb": ["être", "queue", "les", "mais", "où"], "cc": ["nicht", "straße", "über"]}
    rows = [(i, " ".join(rng.choice(kinds[k], 30)), k, "s") for i, k in enumerate(rng.choice(list(kinds), 300))]
    table = docs(spark, rows + [(1000, None, "aa", None), (1001, "abc", None, None)])
    profiles = language.learn(table)
    assert set(profiles) == set(kinds) and all(len(p) <= language.RANKS for p in profiles.values())
    got = by_id(language.predict(table, profiles))
    assert all(got[i][0]["lang_pred"] == k for i, _, k, _ in rows)
    assert got[1000][0] == {"doc_id": 1000, "lang_pred": "und", "score": 0.0}
    odd = by_id(language.predict(hostile, profiles))
    assert sum(map(len, odd.values())) == len(HOSTILE)
    assert {odd[i][0]["lang_pred"] for i in (1, 2, 3)} == {"und"} and odd[10][0]["lang_pred"] in kinds
    assert language.predict(hostile, {}).filter("lang_pred <> 'und'").count() == 0
    # a sample of the labelled rows, drawn by hash, gives nearly the same profile
    few = language.learn(table, sample=100)
    assert set(few) == set(kinds) and len(set(few["aa"]) & set(profiles["aa"])) > 0.8 * len(profiles["aa"])
    assert language.learn(docs(spark, [])) == {}


def plain_grams(text):
    """n-grams of a text by their definition: words of letters, padded by one blank."""
    counts = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {w} "
        counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (padded[i : i + n].strip() if n < 3 else padded[i + 1] != " "))
    return counts


def gram_name(code):
    places = [code >> 21 * k & (1 << 21) - 1 for k in (2, 1, 0)]
    return "".join(" " if p == language.GAP else chr(p) for p in places if p)


def plain_ranks(text, ranks):
    grams = plain_grams(text)
    order = sorted(grams, key=lambda g: (-grams[g], len(g), [language.GAP if c == " " else ord(c) for c in g]))
    return order[:ranks]


def test_out_of_place_distance(spark, monkeypatch):
    texts = ["Abca abc, b", "é м ß в ä œ з éм", "x", "a" * 50 + "\U00031350\U00031351 b", "日本 語", ""]
    for text in texts:
        for step in (1 << 20, 3):
            monkeypatch.setattr(language, "STEP", step)
            codes, n = language.gram_counts(text)
            assert dict(zip(map(gram_name, codes.tolist()), n.tolist())) == plain_grams(text)
        assert [gram_name(c) for c in language.rank_text(text, 5).tolist()] == plain_ranks(text, 5)
    monkeypatch.undo()
    # prediction by the definition of the distance
    rows = [(i, t, k, "s") for i, (t, k) in enumerate([("the cat and the dog", "aa"), ("la queue et le chat", "bb"), ("der Hund und die Katze", "cc")] * 8)]
    table = docs(spark, rows)
    profiles = {k: [gram_name(c) for c in p] for k, p in language.learn(table).items()}
    asked = ["the dog ate", "le chat et", "die Katze", "étude", "zzz the la der", "\U00031350"]
    got = by_id(language.predict(docs(spark, [(i, t, None, None) for i, t in enumerate(asked)]), language.learn(table)))
    for i, text in enumerate(asked):
        ranked = plain_ranks(text, language.RANKS)
        apart = {k: sum(abs(p.index(g) - r) if g in p else language.RANKS for r, g in enumerate(ranked)) for k, p in profiles.items()}
        first, second = sorted(apart, key=lambda k: (apart[k], k))[:2]
        assert got[i][0]["lang_pred"] == first
        assert got[i][0]["score"] == pytest.approx(1 - apart[first] / (apart[first] + apart[second]))


def test_very_long_words_and_texts(spark):
    """A size changes no result: words of millions of letters, texts of millions of characters."""
    long = "ab" * 1_500_000
    text = "one two " + long + " three"
    hashes, counts, chars = WordSplitter("run").split([text, long, "three"])
    assert counts.tolist() == [4, 1, 1] and chars[0] == len(long) + 11
    assert hashes[2] == hashes[4] and hashes[3] == hashes[5]
    _, _, _, heads = WordSplitter("alnum").split([long, "abab", "\U00031350\U00031351"], 4)
    assert heads[0] == heads[1] and len(heads) == 3
    wide = "nicht straße über " * 280_000 + "z"  # five million characters
    codes, n = language.gram_counts(wide)
    plain = Counter({g: 280_000 * c for g, c in plain_grams("nicht straße über").items()}) + plain_grams("z")
    assert dict(zip(map(gram_name, codes.tolist()), n.tolist())) == plain
    rows = [(1, text, "en", "a"), (2, wide, "en", "a"), (3, " ".join(["w"] * 9 + ["x" * 1_200_000, "y"]), "en", "a")]
    table = docs(spark, rows)
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    judged = by_id(quality.judge(table, quality.log_ratios(table, known)))
    assert [judged[i][0]["n_words"] for i in (1, 2, 3)] == [4, 840_001, 11]
    scored = by_id(toxicity.score(table.select("doc_id", "text"), toxicity.fit(table, known)))
    assert all(0 <= scored[i][0]["score"] <= 1 for i in (1, 2, 3))
    twice = docs(spark, rows[:1] + [(5, text.upper(), "en", "a"), (6, text.replace(" three", "c three"), "en", "a")])
    joined = by_id(ngram_join.join(twice))
    assert joined[5][0]["class_id"] == 1 and joined[1][0]["n_copies"] == 2 and joined[6][0]["class_id"] == 6


def shingle_sets(rows):
    out = {}
    for i, text, *_ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        if i is not None and words:
            out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return out


def brute_join(rows, least=0.8):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    links = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(links):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}, links, sets


def near_rows(rng, groups=25, size=4, words=120, start=0):
    rows, i = [], start
    for g in range(groups):
        base = [f"g{g}w{k}" for k in rng.integers(0, 5000, words)]
        for m in range(size):
            text = list(base)
            for _ in range(m):  # each change spoils five shingles
                text[int(rng.integers(0, words))] = f"new{i}x{rng.integers(1 << 30)}"
            rows.append((i, " ".join(text), "en", "a"))
            i += 1
    return rows


def test_ngram_join(spark, hostile):
    rows = near_rows(np.random.default_rng(7)) + [(500 + i, t, a, b) for i, t, a, b in [(0, "Short text", None, None), (1, "short, text", None, None), (2, None, None, None), (3, "!!!", None, None), (4, "!!!", None, None)]]
    got = by_id(ngram_join.join(docs(spark, rows)))
    classes, links, sets = brute_join(rows)
    assert all(got[i][0]["class_id"] == c for i, c in classes.items())
    # links join different texts only
    texts = {i: tuple(re.findall(r"\w+", (t or "").lower())) for i, t, *_ in rows}
    for i in classes:
        near = {texts[b if a == i else a] for a, b in links if i in (a, b)} - {texts[i]}
        assert got[i][0]["n_links"] == len(near)
    assert got[500][0]["class_id"] == got[501][0]["class_id"] == 500 and got[500][0]["n_copies"] == 2
    assert [got[i][0]["class_id"] for i in (502, 503, 504)] == [502, 503, 504]
    odd = by_id(ngram_join.join(hostile))
    assert sum(map(len, odd.values())) == len(HOSTILE) and odd[None][0]["class_id"] is None
    assert odd[4][0]["class_id"] == odd[5][0]["class_id"] == 4 and len(odd[9]) == 2
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_ngram_join_of_a_group_beyond_the_bucket(spark):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        for k in rng.integers(0, 200, 2):
            text[int(k)] = f"n{i}x{k}"
        rows.append((i, " ".join(text), "en", "a"))
    rows += near_rows(rng, 10, 3, start=1000)
    got = by_id(ngram_join.join(docs(spark, rows), bucket=16, depth=3))
    classes, _, _ = brute_join(rows)
    wrong = [i for i, c in classes.items() if got[i][0]["class_id"] != c]
    assert len(wrong) <= 2


def test_ngram_join_meets_every_pair_of_a_large_bucket(spark):
    rng = np.random.default_rng(11)
    passage = [f"w{k}" for k in range(140)]
    # texts half of which is one passage; near pairs are hidden among them
    rows = [(i, " ".join(passage + [f"o{i}x{k}" for k in range(70)]), "en", "a") for i in range(500)]
    rows += [(1000 + i, rows[i][1] + " end", "en", "a") for i in range(0, 500, 10)]
    # a star: edits each about 0.8 similar to one text, not to each other
    star = [f"s{k}" for k in range(200)]
    rows.append((2000, " ".join(star), "en", "a"))
    for i in range(2001, 2301):
        text = list(star)
        for k in rng.choice(np.arange(5, 195, 10), 4, replace=False):
            text[k] = f"n{i}x{k}"
        rows.append((i, " ".join(text), "en", "a"))
    got = by_id(ngram_join.join(docs(spark, rows), bucket=16))
    classes, links, _ = brute_join(rows)
    degree = Counter(i for pair in links for i in pair)
    assert len(links) > 350 and degree[2000] == 300
    assert [i for i, c in classes.items() if got[i][0]["class_id"] != c] == []
    assert [i for i in classes if got[i][0]["n_links"] != degree[i]] == []


def test_ngram_join_of_a_large_bucket_of_many_sizes(spark):
    rng = np.random.default_rng(12)
    passage = [f"w{k}" for k in range(120)]
    # a common passage in texts of 125 to 640 words; some have a copy that is longer by up to a quarter, at the threshold
    rows = [(i, " ".join(passage + [f"o{i}x{k}" for k in range(int(rng.integers(5, 520)))]), "en", "a") for i in range(600)]
    for i in range(0, 600, 6):
        n = len(rows[i][1].split()) - 4
        more = n // 4 + int(rng.integers(-2, 2))
        rows.append((1000 + i, rows[i][1] + "".join(f" m{i}x{k}" for k in range(more)), "en", "a"))
    reps = [(i, len(t.split()) - 4) for i, t, *_ in rows]
    heavy = spark.createDataFrame([(7, i, len(reps)) for i, _ in reps], "bucket long, rep long, n long")
    blocks, pairs = ngram_join.block_pairs(heavy, spark.createDataFrame(reps, "rep long, size long"), block=32)
    sizes = dict(reps)
    block = {r["rep"]: r["block"] for r in blocks.collect()}
    near = {(r["a"], r["b"]): r["near"] for r in pairs.collect()}
    assert len(block) == len(reps) and not all(near.values())
    for i in sizes:
        for j in sizes:
            if sizes[i] <= sizes[j] and sizes[i] >= 0.8 * sizes[j]:
                assert near[tuple(sorted((block[i], block[j])))]
    got = by_id(ngram_join.join(docs(spark, rows), bucket=16))
    classes, links, _ = brute_join(rows)
    degree = Counter(i for pair in links for i in pair)
    assert len(links) > 40
    assert [i for i, c in classes.items() if got[i][0]["class_id"] != c] == []
    assert [i for i in classes if got[i][0]["n_links"] != degree[i]] == []


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = dict(ngram_join.components(spark.createDataFrame(edges, "a long, b long")).select("rep", "root").collect())
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert all(got.get(i, i) == find(i) for i in root)


def test_line_dedup(spark, hostile):
    got = by_id(line_dedup.deduplicate(hostile))
    assert sum(map(len, got.values())) == len(HOSTILE)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1][0]["n_lines"] == 1 and got[1][0]["kept_sha256"] == sha("")
    assert got[7][0]["n_dropped"] == 2 and got[7][0]["kept_text"] == "own words here"
    assert got[8][0]["kept_text"] == "other words there" and got[9][0]["n_dropped"] == 0
    assert got[None][0]["n_dropped"] == 0
    rng = np.random.default_rng(3)
    lines = [f"line number {k} of the shared ones" for k in range(80)]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(0, 6))) or None, "en", "a") for i in range(200)]
    rows += [(1000 + i, lines[0], "en", "a") for i in range(500)]
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders[x].add(i)
    got = by_id(line_dedup.deduplicate(docs(spark, rows)))
    for i, t, *_ in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(x) >= 20 and len(holders[x]) >= 3 and max(holders[x]) != i)]
        assert (got[i][0]["kept_text"], got[i][0]["n_dropped"]) == ("\n".join(kept), len(parts) - len(kept))
    assert line_dedup.deduplicate(docs(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_survives_storage():
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        table = line_dedup.PerfectHash.load(line_dedup.PerfectHash(keys).dump())
        assert sorted(table.index(keys).tolist()) == list(range(keys.size))


def test_exact_dedup(spark, hostile):
    got = by_id(exact_dedup.deduplicate(hostile))
    assert sum(map(len, got.values())) == len(HOSTILE)
    assert {got[i][0]["keep_id"] for i in (4, 5, 6)} == {5} and [got[i][0]["kept"] for i in (4, 5, 6)] == [False, True, False]
    assert {got[i][0]["keep_id"] for i in (1, 2, 3)} == {3} and got[1][0]["group_size"] == 3
    assert got[9][0]["group_size"] == 2 and got[None][0]["kept"]
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0


def test_exact_dedup_deals_again_until_buckets_fit(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"text {k} " + "pad " * int(k), "en", "a") for i, k in enumerate(rng.integers(0, 150, 600))]
    rows += [(5000 + i, "the same again", "en", "a") for i in range(300)]
    got = by_id(exact_dedup.deduplicate(docs(spark, rows), bucket_bytes=64))
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[re.sub(r"\s", "", t)].append((-len(t), i))
    for members in want.values():
        for _, i in members:
            assert (got[i][0]["keep_id"], got[i][0]["group_size"]) == (min(members)[1], len(members))


def test_open_table_compares_content():
    table = exact_dedup.OpenTable(4)
    numbers = [table.add(str(i).encode(), 7)[0] for i in range(50)]  # one hash for all
    assert numbers == list(range(50)) and table.add(b"13", 7) == (13, False)


def test_quality(spark, hostile):
    good = [f"good{k}" for k in range(400)]
    bad = [f"bad{k}" for k in range(400)]
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad, 80)), "en", "a") for i in range(200)]
    rows.append((900, "# a b c a b c *\nline one\nline one\n \n \n" + "w " * 60, "en", "a"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    ratios = quality.log_ratios(table, labels)
    got = by_id(quality.judge(table, ratios, 0.0))
    assert np.mean([got[i][0]["kept"] == (i % 4 > 0) for i in range(200)]) > 0.98
    r = got[900][0]
    text = rows[-1][1]
    words = text.split()
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {k + s for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for s in range(3)}
    assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), 2)
    assert (r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (1, len(repeat), True, False)
    odd = by_id(quality.judge(hostile, ratios))
    assert sum(map(len, odd.values())) == len(HOSTILE) and odd[1][0]["n_words"] == 0 and odd[1][0]["base_failed"]
    assert not quality.log_ratios(table, labels.limit(0)).any()


def test_mixing(spark, hostile):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 400))), "en", s) for i, s in enumerate(rng.choice(["a", "b", "c", "d"], 300, p=[0.7, 0.02, 0.08, 0.2]))]
    rows += [(1000, "tiny", "en", None), (1001, None, "en", "e"), (1002, "one two", "en", "")]
    table = docs(spark, rows)
    placed, pieces = mixing.mix(table)
    out = mixing.mixed_documents(placed, pieces).collect()
    sizes = Counter()
    for i, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = mixing.targets(dict(sizes))
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    taken = Counter()
    source = {i: s for i, _, _, s in rows}
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["target"] == want[source[r["doc_id"]]] and r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mixed_documents(*mixing.mix(table)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in out}
    texts = mixing.mixed_texts(table, pieces)
    assert texts.columns == table.columns
    words = Counter()
    for r in texts.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({r["doc_id"]: r["taken"] for r in out if r["taken"]})
    odd = mixing.mixed_documents(*mixing.mix(hostile)).collect()
    assert len(odd) == len(HOSTILE) and all(r["taken"] <= 3 * r["size"] for r in odd)
    assert mixing.mixed_documents(*mixing.mix(docs(spark, []))).count() == 0


def test_targets_stop_at_three_times_the_source():
    got = mixing.targets({"b": 1, "a": 100, "c": 1000, None: 50})
    # by code point: a weighs 5, b 2, c 1, null 5
    assert got["b"] == 3 and got["a"] == 300 and got[None] == 150 and got["c"] == pytest.approx(1151 - 453)
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}


def test_texts_come_in_bounded_slices():
    texts = ["é" * 5, None, "", "x" * 50, "yy", "z" * 9, "w"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["cut off", *texts])], names=["doc_id", "text"]).slice(1)
    got = list(text_slices(iter([batch, batch.slice(7)]), 16))
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist()
    assert [b.column("text").to_pylist() for b in got] == [texts[:3], texts[3:4], texts[4:]]


def test_a_task_holds_a_slice_of_texts(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE", 1 << 10)

    def work(texts):
        return {"most": [sum(map(len, texts))] * len(texts)}

    rows = docs(spark, [(i, "word " * 100, None, None) for i in range(40)]).coalesce(1)
    most = common.map_texts(rows, ["doc_id"], lambda: work, "most long").collect()
    assert sorted(r["doc_id"] for r in most) == list(range(40))
    assert max(r["most"] for r in most) < 40 * 500
