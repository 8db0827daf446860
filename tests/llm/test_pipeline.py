"""The pipeline's stages on awkward rows, and its rules against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from riskloom.llm import near_dup, packing, site_quality
from riskloom.llm.queries import tokenizer_path
from riskloom.llm.tables import DOC_COLUMNS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randrange(1, 4))) for _ in range(900)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def ids(df):
    return sorted((r.doc_id is None, r.doc_id, r.text) for r in df.collect())


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_row_of_each_class(spark):
    a, b, c = prose(120), prose(120), prose(80)
    near = a.split()
    near[60] = "changed"
    near = " ".join(near)
    rows = [(3, a), (9, near), (3, c), (7, c), (5, b), (5, b), (None, b), (None, "alone without an id here"), (12, None), (13, ""), (14, " \n")]
    kept = P.near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == DOC_COLUMNS
    # the class of a keeps (3, a), that of c keeps (3, c), though both carry doc_id 3
    assert ids(kept) == sorted((i is None, i, t) for i, t in [(3, a), (3, c), (5, b), (None, "alone without an id here"), (12, None)])


def test_classes_by_brute_force(spark):
    texts = [prose(60) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(0, 40, 3):
        w = texts[i].split()
        w[30] = "other"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, texts[i]) for i in range(0, 40, 5)]
    left = {r.doc_id for r in P.near_duplicates(spark, frame(spark, rows), "").collect()}
    want, seen = set(), []
    for i, t in sorted(rows):
        s = shingles(t)
        if not any(len(s & o) / len(s | o) >= 0.8 for o in seen):
            want.add(i)
        seen.append(s)
    assert left == want


def test_stages_on_an_empty_table(spark):
    none = frame(spark, [])
    assert P.near_duplicates(spark, none, "").count() == 0
    assert P.pack(spark, none, "").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert site_quality.score(none, labels).count() == 0


def test_site_quality_leaves_clashing_columns_alone(spark):
    rows = [(i, prose(30), "en", "s", 1, "mine", "mine", "mine", "mine") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _rate string, _h string, _site string, _site_quality string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = site_quality.score(docs, labels)
    assert out.count() == 20 and out.where("_rate = 'mine' AND _h = 'mine' AND _site = 'mine'").count() == 20
    assert out.where(F.col(f"{site_quality.OWN}.quality").between(0, 1)).count() == 20


def test_packing_covers_what_is_left(spark):
    d = frame(spark, [(1, prose(2000)), (2, None), (2, None), (None, "x"), (3, "")])
    pieces = P.pack(spark, d, "").toPandas()
    whole = packing.pack_documents(d, tokenizer_path("byte_bpe_50k.json")).toPandas()
    assert pieces["length"].sum() == whole["length"].sum() and (pieces["length"] > 0).all()
    assert len(pieces[pieces.doc_id == 2]) == 2


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_are_named_and_documented(name):
    stage = dict(P.STAGES)[name]
    assert stage.__doc__ and "null" in stage.__doc__.lower()


def test_classes_are_unchanged_by_the_split(spark):
    d = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (4, None)])
    assert {(r.doc_id, r.class_id, r.class_size) for r in near_dup.classes(d).collect()} == {(1, 1, 3), (2, 1, 3), (None, 1, 3), (4, 4, 1)}
