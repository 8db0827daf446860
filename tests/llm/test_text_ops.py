"""Text operators against brute force, with the awkward rows of every kind."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import decision_list, decontam, near_dup, queries, quotes, site_quality, textstats, toxicity, unigram

AWKWARD = [None, "", " \n\t ", "a", "a b c d e", "x " * 300, "A! B!! ***\nsame line\nsame line\n\n \nsame line", "é ß words | here\n" * 4,
           "one two three four five six one two three four five", "the " * 9 + "end", "w" * 5000, "q r s t u v w x y z " * 3]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string"


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", 0, "clash", "clash") for i, t in enumerate(texts)] + [
        (1, "", "en", None, 0, "x", "y"), (1, "", "en", None, 0, "x", "y"), (None, "null id text here", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(AWKWARD), SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_stats(t):
    t, w = t or "", words(t)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), len(hit), len(lines), len(lines) - len(set(lines)), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), t.count("!"))


def test_doc_stats(spark, docs):
    out = docs.select("text", textstats.doc_stats(F.col("text")).alias("s")).select("text", *textstats.flat(F.col("s"))).collect()
    for r in out:
        assert tuple(r)[1:8] == brute_stats(r.text), r.text


def test_decision_list(spark):
    rng = random.Random(5)
    clean = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(40)) for _ in range(120)]
    junk = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(900)) + "***" for _ in range(40)) for _ in range(60)]
    loud = [" ".join(rng.choice("ABCDEF") * 3 + str(rng.randrange(900)) + "!!" for _ in range(40)) for _ in range(60)]
    texts = clean + junk + loud
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240) if i % 2] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in decision_list.quality_rules(d, labels).collect()}
    assert all(got[i] == (i < 120) for i in got)
    plan = decision_list.quality_rules(d, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decision_list_awkward(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = decision_list.quality_rules(docs, none).collect()
    assert len(out) == len(rows_of(AWKWARD)) and all(r.kept == (not r.base_failed) for r in out)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert decision_list.quality_rules(docs.limit(0), none).count() == 0


def test_unigram_against_plain_dynamic_programming(spark, docs):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    v = unigram.Vocabulary.from_sentencepiece(path)

    def plain(word):
        s = unigram.MARK + word
        best = [(0.0, 0)]
        for e in range(1, len(s) + 1):
            c = [(best[b][0] + v.score[s[b:e]], -best[b][1] - 1) for b in range(max(0, e - 40), e) if s[b:e] in v.score]
            if s[e - 1] not in v.score:
                n = len(s[e - 1].encode())
                c.append((best[e - 1][0] + n * v.byte_score, -best[e - 1][1] - n))
            top = max(c)
            best.append((top[0], -top[1]))
        return best[-1]

    out = unigram.token_counts(docs, path).collect()
    assert len(out) == len(rows_of(AWKWARD))
    want = sorted((len(words(t)), sum(plain(w)[1] for w in words(t))) for _, t, *_ in rows_of(AWKWARD))
    assert sorted((r.n_words, r.n_tokens) for r in out) == want
    counter = unigram.TrieCounter(v, capacity=2)
    for _ in range(2):
        counter.add({"aaab", "aaac", "aaad"})
        assert all(counter[w][0] == plain(w)[1] and math.isclose(counter[w][1], plain(w)[0]) for w in ("aaab", "aaac", "aaad"))


def test_site_quality(spark):
    rng = random.Random(2)
    mk = lambda mark: " ".join(rng.choice("abcdef") + str(rng.randrange(99)) + mark for _ in range(30))
    data = [(i, mk("***" if i % 4 == 0 else ""), "en", "big" if i % 3 else "small") for i in range(200)] + [(None, None, None, None), (7, "", "en", "new")]
    d = spark.createDataFrame([(*r, 0, "clash") for r in data], "doc_id long, text string, lang string, source string, n_chars long, quality string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200, 3)], "doc_id long, quality int")
    out = site_quality.score(d, labels)
    assert out.columns == [*d.columns, site_quality.OWN]
    got = [(r.doc_id, r[site_quality.OWN].quality) for r in out.where("text <> '' and doc_id is not null").collect()]
    assert len(got) == 200 and all((q >= 0.5) == (i % 4 != 0) for i, q in got)
    assert site_quality.score(d.limit(0), labels).count() == 0
    assert site_quality.score(d, labels.limit(0)).count() == 202


def test_grammar():
    stems = {"idiot", "mor"}
    sym = lambda t: "".join(toxicity.symbol(x, stems) for x in toxicity.TOKEN.findall(t.lower()))
    cases = {"you are an idiot": "insult+target", "what an idiot": "insult", "not an idiot": "insult+negated", "a nice day": None,
             "kill time": None, "i will kill you": "threat+target", 'he said "moron" aloud': "insult+target+reported", "idiots everywhere": "insult"}
    for text, want in cases.items():
        assert toxicity.pattern(sym(text)) == want, text


def test_toxicity_learns_stems(spark):
    rng = random.Random(9)
    base = lambda: [rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("rstuv") * 2 + str(rng.randrange(50)) for _ in range(40)]
    data = []
    for i in range(900):
        w = base()
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["scumbag", "zoblek", "zobleks", "worthless"])
        data.append((i, " ".join(w)))
    data += [(5000, None), (5001, ""), (None, "scumbag")]
    d = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    model = toxicity.learn(d, labels)
    out = toxicity.score_texts(d, model).collect()
    assert len(out) == len(data)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 900:
            assert r.predicted == int(r.doc_id % 5 == 0)
    assert d.where("doc_id < 900").where(toxicity.is_toxic(F.col("text"), model)).count() == 180
    empty = toxicity.learn(d, labels.limit(0))
    assert all(r.score == 0.5 for r in toxicity.score_texts(d, empty).collect())


def test_rare_stem_among_many_frequent_ones(spark):
    filler = " ".join("".join(chr(97 + k // 26**j % 26) for j in range(3)) + "qrstu" for k in range(9000))
    rows = [(f"{filler} {'zoblek' if i < 12 else ''} n{i}", 1) for i in range(30)] + [(f"{filler} c{i}", 0) for i in range(30)]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "text string, _y int"))
    assert any("zoblek".startswith(s) for s in stems)


def edited(rng, text, n):
    w = list(text)
    for _ in range(n):
        j = rng.randrange(len(w))
        w[j] = rng.choice(["", "z", w[j] + "y"])
    return "".join(w)


def test_edit_distance():
    rng = random.Random(1)

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (12, 30))
        assert decontam.semi_global(p, t) == plain(p, t)


def test_leaks(spark, docs):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(14, 60))) for i in range(30)] + [(30, None), (31, ""), (32, "too short")]
    data, want = [], set()
    for i in range(120):
        k = i % 40
        body = text(rng.randrange(5, 200))
        if k < 30:
            p = edited(rng, items[k][1], (i // 40) * len(items[k][1]) // 40)  # 0, 2.5 and 5 % of the characters
            body = f"{body}  {p.upper() if i % 2 else p}\n{text(30)}"
            want.add((i, k))
        data.append((i, body))
    d = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, bench).collect()}
    assert not got - want and len(want & got) >= 0.95 * len(want) and {w for w in want if w[0] < 40} <= got
    assert {r.doc_id for r in d.where(decontam.holds_item(F.col("text"), bench)).collect()} == {i for i, _ in got}
    assert decontam.leaks(docs, bench).count() == 0 and decontam.leaks(d, bench.limit(0)).count() == 0


def test_leaks_of_short_items():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 9)))
    rows = [(i, " ".join(word() for _ in range(5 + i % 4))) for i in range(800)] + [(800, "again " * 5 + "again"), (801, "once " * 20)]
    texts = [" ".join([word() for _ in range(20)] + [t] + [word() for _ in range(20)]) for _, t in rows] + [rows[0][1]]
    items = decontam.Items(rows, 0.2)
    found = {(row, items.ids[i]) for row, i, _, distance in items.search(pa.array(texts)) if not distance}
    assert {(i, i) for i in range(802)} | {(802, 0)} <= found
    for walk in range(3):
        assert len({tuple(decontam.coordinates(walk, t)) for t in range(decontam.TABLES)}) == decontam.TABLES


@pytest.mark.parametrize("rate", [0, 0.05, 0.1, 0.15, 0.19])
def test_leaks_at_the_promised_rate(rate):
    """Recall of edited copies inside other text, up to the rate promised."""
    rng = random.Random(11)
    syllables = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéñ")) for _ in range(60)]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, prose(rng.randrange(12, 70))) for i in range(150)]
    items = decontam.Items(rows, 0.2)
    texts = [f"{prose(30)}\n{edited(rng, t, int(rate * len(t)))} {prose(30)}" for _, t in rows]
    found = {(row, items.ids[i]): d for row, i, _, d in items.search(pa.array(texts))}
    for (row, i), d in found.items():  # never wrong, whatever the key said
        assert d <= 0.2 * len(items.texts[i]) and d >= decontam.semi_global(items.texts[i], decontam.normal(texts[row]))
    assert sum((i, i) in found for i in range(150)) >= (0.95 if rate else 1) * 150


def test_leaks_against_brute_force():
    """Items below the length at which keys suffice: every text and item."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 6))) for _ in range(n))
    rows = [(i, prose(1 + i % 4)) for i in range(30)] + [(None, "zebra xylophone"), (None, "zebra xylophone"), (40, ""), (41, " \n")]
    items = decontam.Items(rows, 0.2, effort={k: len(decontam.EFFORTS) for k in range(12)})
    texts = [prose(40) for _ in range(40)] + ["", None, "a ZEBRA \n xylofone b"]
    found = {(r, i): d for r, i, _, d in items.search(pa.array(texts))}
    want = {}
    for r, t in enumerate(texts):
        for i, pattern in enumerate(items.texts):
            d = decontam.semi_global(pattern, decontam.normal(t or ""))
            if d <= items.most[i]:
                want[r, i] = d
    assert found == want and sum(items.ids[i] is None for _, i in found) == 2


def test_leaks_of_awkward_rows(spark):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(n))
    item, other = prose(30), prose(25)
    long_text = f"{prose(400_000)} {item} {prose(100_000)}"  # megabytes, the passage far inside
    docs = spark.createDataFrame([(1, long_text, 5), (1, item, 6), (1, item, 7), (None, other, 8), (2, None, 9), (3, "", 9), (4, prose(50), 9)],
                                 "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item, "x"), (7, other, "y"), (None, item, "z"), (None, None, "z"), (9, "", "z")],
                                  "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.first_word, r.distance) for r in decontam.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, 7, 400_000, 0), (1, None, 400_000, 0), (1, 7, 0, 0), (1, 7, 0, 0), (1, None, 0, 0), (1, None, 0, 0), (None, 7, 0, 0)], key=str)
    assert docs.where(decontam.holds_item(F.col("text"), bench)).count() == 4
    assert docs.where(decontam.holds_item(F.col("text"), bench.limit(0))).count() == 0


def test_pieces_near_a_place_against_brute_force():
    """Bit-parallel with early decisions against plain distances, also at both
    ends of a text, for pieces shorter than a machine word and in long runs."""
    rng = random.Random(4)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (30, 64, 65, 100, 200)]
    texts = [decontam.edited(i, k, rng) for i in items for k in (0, 5, 12, 25)] + ["", "abc"]
    raw = "".join(texts).encode()
    starts = np.cumsum([0] + [len(t) for t in texts])
    symbols, first, last = decontam.symbols_of(np.frombuffer(raw, np.uint8), starts)
    pieces = decontam.Pieces([i.encode() for i in items])
    rows = [(t, i, o, a) for t in range(len(texts)) for i in range(len(items)) for o in range(0, len(items[i]), 13)
            for a in range(int(first[t]), int(last[t]), 11)]
    text, item, offset, at = (np.array(x, np.int64) for x in zip(*rows))
    got = pieces.near(symbols, first[text], last[text], item, offset, at, 0.3)
    span, want = decontam.PIECE + 2 * decontam.DRIFT, []
    for t, i, o, a in rows:
        piece = min(int(pieces.first[i]) + (max(o + decontam.SAMPLED // 2 - decontam.PIECE // 2, 0) + decontam.STRIDE // 2) // decontam.STRIDE, int(pieces.last[i]))
        own = items[i][int(pieces.begin[piece]):int(pieces.begin[piece]) + decontam.PIECE]
        begin = a - o + int(pieces.begin[piece]) - decontam.DRIFT
        around = symbols[max(begin, int(first[t])):max(min(begin + span, int(last[t])), 0)].tobytes().decode()
        want.append(decontam.semi_global(own, around) <= 0.3 * len(own))
    assert got.tolist() == want and 50 < sum(want) < len(want) - 50


def test_near_dup_against_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: [str(rng.randrange(5000)) for _ in range(n)]
    common = text(40)  # a passage that most documents share
    texts = []
    for n in (6, 30, 100, 150, 200, 400, 900):
        for _ in range(4):
            base = text(n) + (common if n > 100 else [])
            for copies in range(6):
                w = list(base)
                for _ in range(copies * len(w) // 150):
                    w[rng.randrange(len(w))] = str(rng.randrange(5000))
                texts.append(" ".join(w))
    texts += ["", None, " ", "one two", "one two", "two one"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[0], 1), (None, "lonely null id", 1)],
                              "doc_id long, text string, class_id long")
    got = {}
    for r in near_dup.classes(d).collect():
        if r.doc_id is not None:
            assert got.setdefault(r.doc_id, r.class_id) == r.class_id
    n_docs, table = near_dup.common_shingles(d, 0.1)
    found = table.collect()
    idf = near_dup.Idf(n_docs, [r.sh for r in found], [r.df for r in found], 0.1)
    sets = [dict(zip(s.tolist(), w.tolist())) for s, w in near_dup.shingle_sets(pa.array(texts, pa.string()), idf)]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            low = sum(min(w, b[s]) for s, w in a.items() if s in b)
            if low >= 0.8 * (sum(a.values()) + sum(b.values()) - low) - 1e-9 and (a or not b):
                up[find(i)] = find(j)
    classes, mine = {}, {}
    for i in range(len(texts)):
        classes.setdefault(find(i), []).append(i)
        mine.setdefault(got[i], []).append(i)
    assert sorted(classes.values()) == sorted(mine.values())
    assert near_dup.classes(d.limit(0)).count() == 0


def test_near_dup_weighs_by_exact_document_frequency(spark, monkeypatch):
    """A passage in 7 of 90 texts weighs ln 13 a shingle, words of one text ln 90."""
    monkeypatch.setattr(near_dup, "CELL", 2000)  # several cells and parts
    monkeypatch.setattr(near_dup, "PART", 5000)
    rng = random.Random(12)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(104)
    rows = [passage + text(10) for _ in range(6)]  # 100 of 110 shingles in common: 100 / 120 if all weigh alike
    rows += [text(40) for _ in range(83)]
    rows += [rows[0][:113] + text(1)]
    shingled = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in rows]
    df = Counter(s for own in shingled for s in own)
    weight = lambda own: sum(math.log(len(rows) / df[s]) for s in own)
    similar = lambda a, b: weight(shingled[a] & shingled[b]) / weight(shingled[a] | shingled[b])
    assert similar(0, 1) < 0.78 and similar(0, 89) > 0.9 and len(shingled[0] & shingled[1]) / len(shingled[0] | shingled[1]) > 0.8
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(d).collect()}
    assert got == {i: 0 if i == 89 else i for i in range(90)}
    held = near_dup.text_cells(d, 5).cache()
    texts = [" ".join(w) for w in rows]
    n_docs, table = near_dup.common_shingles(d)
    idf = near_dup.Idf(n_docs, *zip(*((r.sh, r.df) for r in table.collect())))
    want = {t: w.tolist() for t, (_, w) in zip(texts, near_dup.shingle_sets(pa.array(texts), idf))}
    told = near_dup.signatures(held, 3, near_dup.Idf(n_docs), 0.8)
    found = near_dup.texts_of(held, 5, told).toArrow()
    mine = near_dup.shingle_sets(found["text"].combine_chunks().cast(pa.string()), near_dup.Idf(n_docs), found["df"].combine_chunks())
    assert {t: w.tolist() for t, (_, w) in zip(found["text"].to_pylist(), mine)} == want


def test_memory_of_near_dup_tasks(spark):
    """A task's hashing takes blocks, not cells, and counts take few bytes a
    shingle; no row holds what a whole cell is told."""
    rng = random.Random(4)
    texts = pa.array([" ".join(f"w{rng.randrange(10**5)}" for _ in range(500)) for _ in range(1200)])

    def peak(work) -> float:
        work()
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert texts.nbytes > 3.5e6 and peak(lambda: [None for _ in near_dup.block_shingles(texts)]) < 40
    n = 10**6
    sent, counts = np.random.default_rng(4).integers(0, 9, (n, near_dup._SENT), np.uint8), np.ones(n, np.uint32)
    row = lambda x: pa.array([x[:n // 2].tobytes(), x[n // 2:].tobytes()], pa.binary())
    part = pa.table({"part": [1, 1], "cell": [1, 2], "sh": row(sent), "n": row(counts)})
    assert peak(lambda: near_dup._answers(part)) < 45
    want = Counter(map(bytes, sent))
    got = np.frombuffer(b"".join(near_dup._answers(part)["df"].to_pylist()), np.uint32)
    assert got.tolist() == [want[bytes(x)] for x in sent]
    cells = near_dup.text_cells(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), 2).cache()
    told = near_dup.signatures(cells, 1, near_dup.Idf(1), 0.8)
    for df in (told, near_dup.texts_of(cells, 2, told)):
        assert df.count() == 1 and "collect_list" not in df._jdf.queryExecution().toString()


def test_memory_of_a_full_near_dup_part():
    """A part of the usual size, of words of five letters, is counted in a few
    bytes for each of its own."""
    def peak(work) -> float:
        work()
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    rng, n = np.random.default_rng(5), near_dup.PART // 6
    rows = [(rng.integers(0, 256, (n // 8, near_dup._SENT), np.uint8).tobytes(), np.ones(n // 8, np.uint32).tobytes()) for _ in range(8)]
    part = pa.table({"part": [1] * 8, "cell": list(range(8)), **{c: pa.array(x, pa.binary()) for c, x in zip(("sh", "n"), zip(*rows))}})
    assert peak(lambda: near_dup._answers(part)) < 40


def test_near_copy_of_the_hottest_text(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    hot = text(104)  # 100 shingles, of which four changed words change eight
    near = hot[:50] + text(4) + hot[54:]
    rows = [" ".join(hot)] * 40 + [" ".join(near)] + [" ".join(text(30)) for _ in range(79)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dup.classes(d).collect()}
    assert all(got[i] == (0, 41) for i in range(41)) and all(got[i] == (i, 1) for i in range(41, 120))


def test_pairs_in_crowded_buckets(spark):
    """Two alike texts that share one bucket with 30 texts met by chance."""
    rng = np.random.default_rng(6)
    draws = lambda: rng.integers(1, 2**62, near_dup.SAMPLES).astype(np.uint64)
    rows, want = [], set()
    for group in range(8):
        first = draws()
        for k in range(32):
            own = first.copy() if k < 2 else draws()
            own[:near_dup.ROWS] = first[:near_dup.ROWS]
            if k == 1:  # no other band in common
                own[near_dup.ROWS::near_dup.ROWS] = draws()[near_dup.ROWS::near_dup.ROWS]
            rows.append((bytearray(f"{group:08d}{k:08d}".encode()), bytearray(own.tobytes()), None))
        want.add((bytes(rows[-32][0]), bytes(rows[-31][0])))
    texts = spark.createDataFrame(rows, "uid binary, whole binary, binned binary")
    for block in (8, 128):
        pairs = near_dup.met_pairs(near_dup.band_rows(texts), texts, block)
        assert {(bytes(r.a), bytes(r.b)) for r in pairs.collect()} == want


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(0)
    sh = np.sort(rng.integers(1, 2**62, 1200)).astype(np.uint64)
    a, b = np.arange(1200) < 1080, np.arange(1200) >= 120
    w = rng.uniform(0.5, 3, 1200)
    true = w[a & b].sum() / w.sum()
    for make in (near_dup.samples_whole, near_dup.samples_binned):
        sa, sb = (make(sh[m], w[m], np.zeros(m.sum(), np.int64), 1)[0] for m in (a, b))
        assert abs((sa == sb).mean() - true) < 0.17


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there.\n\nHow does  it work?"), (1, 1, "bot", "> how does it WORK?\nIt works well."), (1, 2, "user", "Unrelated."),
            (1, 3, "user", ">> How does it work?\n> It works well.\nThanks!"), (1, 4, "bot", "> never said\nWhat?"), (2, 0, "user", "> It works well.\nOther conversation"),
            (2, 0, "user", "> It works well.\nOther conversation"), (None, 3, "user", "no conversation"), (3, None, "user", None), (3, 1, None, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    out = quotes.reply_threads(df)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(got) == len(rows) - 1
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, None, 1, None]
    assert [got[1, t].thread_turn for t in range(5)] == [0, 0, 2, 0, 4]
    assert [got[1, t].position for t in range(5)] == [1, 2, 4, 3, 5]
    assert got[1, 1].own_text == "It works well." and got[1, 3].own_text == "Thanks!" and got[1, 3].quote_depth == 2
    assert got[2, 0].copies == 2 and got[2, 0].parent_turn is None and got[2, 0].own_text == "Other conversation"
    assert quotes.reply_threads(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "m0")] + [(1, t, "u", f"> m{t - 1}\nm{t}") for t in range(1, 40)]
    got = quotes.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.thread_turn == 0 and r.position == r.turn + 1 for r in got)


def plain_rules(train, prune, min_cover=3, min_precision=0.8):
    """Sequential covering over rows of (bins, y), by the same gain and the same folds."""
    grid = decision_list.GRID

    def holds(row, rule):
        return all((row[0][f] <= cut) == below for f, cut, below in rule)

    rules, train, prune = [], list(train), list(prune)
    while True:
        rule, own = [], train
        while True:
            p0, n0 = (sum(y == k for _, y in own) for k in (0, 1))
            best = (0.0, None)
            if p0 and n0:
                for f in grid:
                    for cut in range(len(grid[f])):
                        for below in (False, True):
                            inside = [y for b, y in own if (b[f] <= cut) == below]
                            p, n = inside.count(0), inside.count(1)
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                            if gain > best[0] + 1e-9:
                                best = gain, (f, cut, below)
            if best[1] is None:
                break
            rule.append(best[1])
            own = [r for r in own if holds(r, rule)]
        if not rule:
            return rules
        worth = []
        for k in range(1, len(rule) + 1):
            ys = [y for b, y in prune if holds((b, y), rule[:k])]
            p, n = ys.count(0), ys.count(1)
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, n))
        keep = max(range(len(rule)), key=lambda k: (worth[k][0], -k))
        _, p, n = worth[keep]
        if p < min_cover or p / (p + n) < min_precision:
            return rules
        rules.append(rule[:keep + 1])
        train, prune = ([r for r in rows if not holds(r, rules[-1])] for rows in (train, prune))


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_list_equals_plain_covering(spark, seed):
    rng = random.Random(seed)
    grid = decision_list.GRID
    names = list(grid)
    rows = []
    for i in range(900):
        b = {f: rng.randrange(len(grid[f]) + 1) for f in names}
        bad = (b[names[0]] > 1 and b[names[1]] <= 1) or b[names[2]] == 0 or rng.random() < 0.03
        rows.append((i % 3 == 0, 0 if bad else 1, *b.values()))
    cells = spark.createDataFrame(rows, "pruning boolean, y int, " + ", ".join(f"{f} int" for f in names))
    cells = cells.groupBy("pruning", "y", *names).agg(F.count(F.lit(1)).alias("n"))
    train, prune = ([(dict(zip(names, r[2:])), r[1]) for r in rows if r[0] == fold] for fold in (False, True))
    got = [[(c.feature, c.cut, c.below) for c in rule] for rule in decision_list.learn(cells)]
    want = [list(r) for r in plain_rules(train, prune)]
    assert got == want and len(want) >= 2


def test_every_place_of_items_and_documents_is_embedded():
    from riskloom.llm import decontam as D
    text = "the quick brown fox jumps over the lazy dog while seven other animals watch it from the hill behind the old mill"
    items = D.Items([(1, text)], 0.2, effort={len(text).bit_length(): 0})
    assert items.tables
    for keys in items.tables.values():  # a share of one in eight before
        assert sorted(keys.offset.tolist()) == list(range(len(text)))
    data = np.frombuffer(f"{text} {text}".encode(), np.uint8)
    symbols, first, last = D.symbols_of(data, np.array([0, len(text), len(data)]))
    seen = [first[0] + i for i in range(len(text))] + [p for p in range(int(first[1]), int(last[1]))]
    assert D.places(symbols).tolist() == seen


def test_a_found_item_begins_where_most_keys_say():
    from riskloom.llm import decontam as D
    text = "the quick brown fox jumps over the lazy dog while seven other animals watch it from the hill behind the old mill"
    items = D.Items([(1, text)], 0.2, effort={len(text).bit_length(): 0})
    copies = ["zz zz zz " + text + " zz", "a the the the " + text]
    assert [(r, w, d) for r, _, w, d in items.search(pa.array(copies))] == [(0, 3, 0), (1, 4, 0)]
