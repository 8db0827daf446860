"""Site quality and quotation threads against plain Python versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from riskloom.llm import quotes, site_quality
from riskloom.llm.site_quality import GRID, OWN


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def strength(rates, least=2.0, most=1e4):
    rates = [(g, n, m) for g, n, m in rates if n > 0]
    total, mm = sum(n for _, n, _ in rates), sum(n * m * (1 - m) for _, n, m in rates)
    if not rates or not total or not mm:
        return most
    spread = mm / total
    between = (sum(n * (g / n - m) ** 2 for g, n, m in rates) - len(rates) * spread) / total
    return most if between <= 0 else min(most, max(least, spread / between - 1))


def plain_quality(rows, soft=0.1):
    """rows: (bins, host, path, y or None); the site rate and quality of each."""
    labelled = [(b, y) for b, _, _, y in rows if y is not None]
    ones = sum(y for _, y in labelled)
    prior = (ones + 1) / (len(labelled) + 2)
    table = {f: [0.0] * (len(c) + 1) for f, c in GRID.items()}
    if 0 < ones < len(labelled):
        for f, cuts in GRID.items():
            n = Counter((b[f], y) for b, y in labelled)
            k = len(cuts) + 1
            table[f] = [math.log((n[v, 1] + 1) / (ones + k)) - math.log((n[v, 0] + 1) / (len(labelled) - ones + k)) for v in range(k)]
    e = [sum(table[f][b[f]] for f in GRID) for b, *_ in rows]
    paths, hosts = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for x, (_, h, p, y) in zip(e, rows):
        good, n = (y, 1.0) if y is not None else (round(soft * round(sigmoid(x + math.log(prior / (1 - prior))), 6), 6), soft)
        for at in (paths[h, p], hosts[h]):
            at[0] += good
            at[1] += n
    k = strength([(g, n, prior) for g, n in hosts.values()])
    m = {h: (g + k * prior) / (n + k) for h, (g, n) in hosts.items()}
    k = strength([(g, n, m[h]) for (h, _), (g, n) in paths.items()])
    rate = {(h, p): (g + k * m[h]) / (n + k) for (h, p), (g, n) in paths.items()}
    out = []
    for x, (_, h, p, _) in zip(e, rows):
        r = min(max(rate[h, p], 1e-6), 1 - 1e-6)
        out.append((x, rate[h, p], sigmoid(x + math.log(r / (1 - r)))))
    return out


@pytest.mark.parametrize("seed,classes", [(1, (0, 1)), (2, (0, 1)), (3, (1,))])
def test_site_quality_equals_the_plain_version(spark, seed, classes):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(260):
        host = None if i % 41 == 0 else f"h{min(rng.randrange(12), 5)}"
        path = rng.choice(["en", "de", None])
        junk = rng.random() < (0.7 if host in ("h0", "h5") else 0.2)
        text = None if i % 37 == 0 else " ".join(("%$#" if junk and rng.random() < 0.3 else "w") + str(rng.randrange(500)) for _ in range(rng.randrange(0, 90)))
        rows.append((i, text, path, host, 0))
        if i % 3 == 0:
            labels.append((i, classes[0] if junk else classes[-1]))
    labels += [(0, 0), (0, 1)] if len(classes) > 1 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = {}
    for i, y in labels:
        own[i] = min(y, own.get(i, 1))
    bins = {r.doc_id: r[OWN] for r in site_quality.prepared(docs).collect()}
    ordered = sorted(bins)
    want = plain_quality([({f: bins[i][f] for f in GRID}, bins[i].host, bins[i].path, own.get(i)) for i in ordered])
    got = {r.doc_id: r[OWN] for r in site_quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for i, (e, rate, quality) in zip(ordered, want):
        assert (got[i].evidence, got[i].site_rate, got[i].quality) == pytest.approx((e, rate, quality), abs=2e-6)


MARKS = re.compile(r"((?:[ \t]*>)+)")


def level(line):
    m = MARKS.match(line)
    return m.group(1).count(">") if m else 0


def norm(t):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")


def plain_threads(messages):
    """messages: (conv, turn, role, text), one a turn; {(conv, turn): (parent, thread)}."""
    own, said = {}, {}
    for c, t, _, text in messages:
        own[c, t] = re.sub(r"^\s*\n|\s+$", "", "\n".join(x for x in text.split("\n") if level(x) == 0))
        for body in [own[c, t], *re.split(r"\n\s*\n", own[c, t]), *own[c, t].split("\n")]:
            if norm(body):
                said[c, norm(body)] = min(t, said.get((c, norm(body)), t))
    parent = {}
    for c, t, _, text in messages:
        runs, last, found = [], -1, []
        for n, raw in enumerate(text.split("\n")):
            if level(raw) != last:
                runs.append((level(raw), []))
                last = level(raw)
            runs[-1][1].append((n, re.sub(MARKS.pattern + r"[ \t]?", "", raw, count=1) if level(raw) else raw))
        for number, (lv, lines) in enumerate(runs, 1):
            if lv:
                whole = "\n".join(b for _, b in lines)
                for part, n, body in [(0, -1, whole), *((1, n, b) for n, b in lines)]:
                    at = said.get((c, norm(body))) if norm(body) else None
                    if at is not None and at < t:
                        found.append((lv, part, number, n, at))
        parent[c, t] = min(found)[-1] if found else None
    out = {}
    for c, t, *_ in messages:
        top = t
        while parent[c, top] is not None:
            top = parent[c, top]
        out[c, t] = (parent[c, t], top, own[c, t])
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_threads_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Yes", "no", "please  try", "it works", "see <a>", "ok.", "> not"[2:]])
    messages = []
    for c in range(30):
        texts = []
        for t in range(rng.randrange(1, 12)):
            fresh = [" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 4))]
            if texts and rng.random() < 0.7:
                quoted = [("> " if rng.random() < 0.8 else ">") + x for x in rng.choice(texts).split("\n")]
                if rng.random() < 0.3:
                    quoted = [x.upper() for x in quoted][: rng.randrange(1, 3)]
                fresh = quoted + ([""] if rng.random() < 0.5 else []) + fresh
            texts.append("\n".join(fresh))
            messages.append((c, t * 2 + 1, "user", texts[-1]))
    want = plain_threads(messages)
    out = quotes.reply_threads(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.own_text) for r in out} == want
    assert sum(p is not None for p, *_ in want.values()) > 20
    per = defaultdict(list)
    for r in out:
        per[r.conv_id].append((r.thread_turn, r.turn, r.position))
    for own in per.values():
        assert [p for *_, p in sorted(own)] == list(range(1, len(own) + 1))


def test_threads_of_very_long_messages(spark):
    long = "\n".join(f"line {i} of a very long message with some words" for i in range(40_000))
    rows = [(1, 1, "a", long), (1, 2, "b", "> " + long.replace("\n", "\n> ") + "\nagreed"), (1, 3, "a", "> agreed\nfine")]
    out = {r.turn: r for r in quotes.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[2].parent_turn, out[3].parent_turn, out[3].thread_turn, out[2].own_text) == (1, 2, 1, "agreed")
