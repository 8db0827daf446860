"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set of five-word shingles: weight = (1 + ln tf) * idf,
with the inverse document frequency ``ln(N / df)`` over the ``N`` different
texts, so that copies of a text change no weight.  Every shingle is counted
exactly: the texts lie in cells of about ``CELL`` bytes, one row each; a cell
sends its distinct shingles with their counts to the parts of the hash range,
each part adds up the counts of its own, and sends every cell the frequencies
of what it asked for, in the same order.  What is sent grows with the texts, and
a shingle of all texts is sent once a cell.

Improved consistent weighted sampling draws from a weighted set a shingle and
a level, so that two sets agree with probability equal to their weighted
Jaccard similarity.  Texts of up to ``split`` shingles take every sample over
the whole set.  Longer texts take one sample per hash bin of their shingles
(an empty bin borrows from the next), which needs one evaluation a shingle.
Texts between ``threshold * split`` and ``split`` do both, and a similarity of
``threshold`` allows no larger ratio of total weights, so a similar pair
always meets in one scheme.  Samples form ``BANDS`` bands of ``ROWS``.

Equal texts are collapsed before anything else.  Each different text is
given one star centre per band bucket, chosen by hash; centres whose samples
agree with its own in less than half the places only met it by chance (a shared
passage) and are left.  What a bucket leaves so meets all its members in blocks.
A text is verified against the centre it meets most often.
Classes joined by the other centres make loose groups.  A group with several classes
is finished exactly: members outside its largest class meet all its members in
bounded blocks; there agreeing samples choose what is verified, and only links
that join what the block has not joined yet come out.  Verification computes
the weighted Jaccard similarity of the whole texts; classes are the connected
components of the verified links, by large-star / small-star rounds on the
edge table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import wordhash as W
from riskloom.llm.tables import bucketed, drop, written

SHINGLE, BANDS, ROWS = 5, 14, 4
SAMPLES = BANDS * ROWS
SPLIT = 160
# bytes of text in a cell, and those whose shingles are counted in one part: a
# Python worker takes about 8 times as much, and keeps some of it for later stages
CELL, PART = 4 << 20, 4 << 20
_SENT = 6  # low bytes of a shingle that are sent; its part says the high bits
_U = np.uint64


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts, sorted by text; a text of fewer
    than five words is one shingle of all its words, one without words none."""
    hashes, text, _, _ = W.words(data, starts)
    sh, first = W.windows(hashes, text, SHINGLE)
    owner = text[first]
    n_words = np.bincount(text, minlength=len(starts) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        begin = np.searchsorted(text, short)
        whole = np.zeros(len(short), _U)
        for k in range(SHINGLE - 1):
            use = k < n_words[short]
            whole = np.where(use, whole * _U(W._STEP) + hashes[np.minimum(begin + k, len(hashes) - 1)], whole)
        sh, owner = np.concatenate([sh, W.mix(whole, 2)]), np.concatenate([owner, short])
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], sh[at], np.diff(np.append(at, len(sh)))


class Idf:
    """Weights of shingles from their document frequencies.  Where none come
    with the shingles they are looked up in the table ``keys``, ``dfs`` of those
    in two or more texts.  ``common`` has no effect: no weight is held back."""

    def __init__(self, n_docs: int, keys: list[int] = (), dfs: list[int] = (), common: float | None = None):
        self.n_docs = max(n_docs, 1)
        order = np.argsort(np.array(keys, dtype=np.int64).view(_U))
        self.keys = np.array(keys, dtype=np.int64).view(_U)[order]
        self.dfs = np.array(dfs, dtype=np.float64)[order]
        self.top = self.of(1.0)

    def of(self, df: np.ndarray | float) -> np.ndarray | float:
        # a shingle of every document keeps a little weight
        return np.maximum(np.log(self.n_docs / df), 0.01)

    def weights(self, sh: np.ndarray, tf: np.ndarray, df: np.ndarray | None = None) -> np.ndarray:
        if df is None:
            df = np.ones(len(sh))
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, sh), len(self.keys) - 1)
                hit = self.keys[at] == sh
                df[hit] = self.dfs[at[hit]]
        return (1 + np.log(tf)) * self.of(df)


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    return ((W.mix(h, seed) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def draw(sh: np.ndarray, w: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, level t) of each element: a set's sample is its element with the
    least ln a, together with t.  r and c are Gamma(2, 1), beta uniform."""
    s = 8 * seed + 100
    r = -np.log(_uniform(sh, s) * _uniform(sh, s + 1))
    ln_c = np.log(-np.log(_uniform(sh, s + 2) * _uniform(sh, s + 3)))
    beta = _uniform(sh, s + 4)
    t = np.floor(np.log(w) / r + beta)
    return ln_c - r * (t - beta) - r, t


def _named(sh: np.ndarray, t: np.ndarray) -> np.ndarray:
    return W.mix(sh ^ W.mix(t.astype(np.int64).view(_U), 3), 4)


def samples_whole(sh: np.ndarray, w: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES per text, each over all its shingles."""
    out = np.zeros((n, SAMPLES), _U)
    if len(sh):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        own, sizes = owner[first], np.diff(np.append(first, len(sh)))
        for k in range(SAMPLES):
            a, t = draw(sh, w, k + 1)
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), sizes))
            _, one = np.unique(owner[hit], return_index=True)
            out[own, k] = _named(sh[hit[one]], t[hit[one]])
    return out


def samples_binned(sh: np.ndarray, w: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES per text, one per hash bin of its shingles; an empty bin takes
    the sample of the next full one, marked with the distance."""
    out, full = np.zeros((n, SAMPLES), _U), np.zeros((n, SAMPLES), bool)
    if len(sh):
        a, t = draw(sh, w, 0)
        cell = owner * SAMPLES + (W.mix(sh, 5) % _U(SAMPLES)).astype(np.int64)
        order = np.lexsort((a, cell))
        first = order[np.append(True, np.diff(cell[order]) > 0)]
        out.reshape(-1)[cell[first]] = _named(sh[first], t[first])
        full.reshape(-1)[cell[first]] = True
        for row in np.flatnonzero(full.any(1) & ~full.all(1)):
            at = np.flatnonzero(full[row])
            for k in np.flatnonzero(~full[row]):
                nxt = at[np.searchsorted(at, k) % len(at)]
                out[row, k] = W.mix(out[row, nxt:nxt + 1], 10 + (nxt - k) % SAMPLES)[0]
    return out


def word_ids(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits per text from its sequence of words; 0 without words."""
    hashes, text, _, _ = W.words(data, starts)
    n = len(starts) - 1
    pos = (np.arange(len(text)) - np.searchsorted(text, np.arange(n))[text]).astype(_U)
    uid = np.zeros((n, 2), _U)
    for half in (0, 1):
        np.add.at(uid[:, half], text, W.mix(hashes + W.mix(pos, 6 + half), 8 + half))
    return uid


def named(rows: DataFrame) -> DataFrame:
    """doc_id, uid (128-bit hash of the words) and bytes of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in W.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([u.tobytes() for u in word_ids(data, starts)], pa.binary()),
                                                  pa.array(np.diff(starts), pa.int64())], names=["doc_id", "uid", "bytes"])

    return rows.mapInArrow(run, "doc_id long, uid binary, bytes long")


def different(rows: DataFrame) -> DataFrame:
    """uid and text of every different text."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            yield _first_seen(batch.column(0).to_pylist(), batch.column(1), seen)

    return first_of_task(rows).repartition("uid").mapInArrow(merge, "uid binary, text string")


def first_of_task(rows: DataFrame) -> DataFrame:
    """uid and text of the different texts of each task, so that a text that
    fills a third of the rows costs one row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for a, b, data, starts in W.blocks(batch.column(0)):
                yield _first_seen([u.tobytes() for u in word_ids(data, starts)], batch.column(0).slice(a, b - a), seen)

    return rows.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "uid binary, text string")


def cell_of(uid, cells: int) -> F.Column:
    return F.pmod(F.xxhash64(uid), F.lit(cells))


def text_cells(rows: DataFrame, cells: int) -> DataFrame:
    """cell, uid and text (arrays): every different text in the cell of its uid."""
    def merge(table: pa.Table) -> pa.Table:
        both = table.select(["uid", "text"]).combine_chunks().to_batches()[0]
        own = _first_seen(both.column(0).to_pylist(), both.column(1), set())
        return pa.table({"cell": table["cell"][:1], **{c: pa.ListArray.from_arrays([0, own.num_rows], own[c]) for c in ("uid", "text")}})

    return (first_of_task(rows).withColumn("cell", cell_of("uid", cells)).groupBy("cell")
            .applyInArrow(merge, "cell long, uid array<binary>, text array<string>"))


def _first_seen(uids: list[bytes], texts: pa.Array, seen: set[bytes]) -> pa.RecordBatch:
    """The rows whose uid is not in ``seen`` yet."""
    new = []
    for u in uids:
        new.append(u not in seen)
        seen.add(u)
    return pa.RecordBatch.from_arrays([pa.array(uids, pa.binary()), texts], names=["uid", "text"]).filter(pa.array(new, pa.bool_()))


def frequencies(cells: DataFrame, parts: int) -> DataFrame:
    """cell, part and df: the document frequency of every distinct shingle that
    the cell has in the part, in ascending order of the shingles."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sh, n = np.unique(np.concatenate([sh for _, _, sh, _ in block_shingles(texts.values)]), return_counts=True)
                part = (sh >> _U(32)) * _U(parts) >> _U(32)
                own = np.unique(part)
                low, high = np.searchsorted(part, own), np.searchsorted(part, own, side="right")
                sent = np.ascontiguousarray(sh.view(np.uint8).reshape(-1, 8)[:, :_SENT])
                n = n.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int64)), pa.array(np.full(len(own), cell)),
                     *(pa.array([x[i:j].tobytes() for i, j in zip(low, high)], pa.binary()) for x in (sent, n))], names=["part", "cell", "sh", "n"])

    asked = cells.select("cell", "text").mapInArrow(ask, "part long, cell long, sh binary, n binary")
    return asked.groupBy("part").applyInArrow(_answers, "cell long, part long, df binary")


def _answers(table: pa.Table) -> pa.Table:
    """To every row of one part its shingles' counts over all rows."""
    sent = _bytes(table["sh"]).reshape(-1, _SENT)
    sh = np.zeros((len(sent), 8), np.uint8)
    sh[:, :_SENT] = sent
    del sent
    sh = sh.view(_U).ravel()
    order = np.argsort(sh)
    sh = sh[order]
    first = np.flatnonzero(np.append(True, sh[1:] != sh[:-1]))
    sizes = np.diff(np.append(first, len(sh)))
    del sh
    df = np.empty(len(order), np.uint32)
    df[order] = np.repeat(np.add.reduceat(_bytes(table["n"]).view(np.uint32)[order], first, dtype=np.uint32), sizes)
    cut = np.cumsum([0] + [len(x.as_buffer()) // 4 for x in table["n"]])
    return pa.table({"cell": table["cell"], "part": table["part"], "df": pa.array([df[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())})


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows, end to end."""
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8) for x in column)])


def block_shingles(texts: pa.Array) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """(first and end row, owner, shingle, count) of runs of texts."""
    for a, b, data, starts in W.blocks(texts):
        yield (a, b), *shingles(data, starts)


def signatures(cells: DataFrame, parts: int, idf: Idf, threshold: float) -> DataFrame:
    """uid, samples and df of every text: the document frequencies of its
    distinct shingles, in their order."""
    def run(held: pa.Table, told: pa.Table) -> pa.Table:
        uids, texts = (held[c].combine_chunks().flatten() for c in ("uid", "text"))
        runs = list(block_shingles(texts))
        sh = np.concatenate([sh for _, _, sh, _ in runs])
        _, at = np.unique(sh, return_inverse=True)
        del sh
        every = _bytes(told.sort_by("part")["df"]).view(np.uint32)[at]
        done, out = 0, []
        for (a, b), owner, sh, tf in runs:
            n, df = b - a, every[done:done + len(sh)]
            done += len(sh)
            w = idf.weights(sh, tf, df)
            total = np.bincount(owner, w, n)
            size = total / idf.top
            forms = []
            for use, make in ((size <= SPLIT, samples_whole), (size >= threshold * SPLIT, samples_binned)):
                use = use & (total > 0)
                pick = use[owner]
                s = make(sh[pick], w[pick], owner[pick], n)
                forms.append(pa.array([s[i].tobytes() if use[i] else None for i in range(n)], pa.binary()))
            cut = np.searchsorted(owner, np.arange(n + 1))
            own = pa.array([df[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())
            out.append(pa.RecordBatch.from_arrays([uids.slice(a, n), *forms, own], names=["uid", "whole", "binned", "df"]))
        return pa.Table.from_batches(out)

    return (cells.select("cell", "uid", "text").groupBy("cell").cogroup(frequencies(cells, parts).groupBy("cell"))
            .applyInArrow(run, "uid binary, whole binary, binned binary, df binary"))


def texts_of(cells: DataFrame, n_cells: int, wanted: DataFrame) -> DataFrame:
    """uid, text and df of the ``wanted`` (uid, df), found in their cells."""
    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        uids, texts = (held[c].combine_chunks().flatten() for c in ("uid", "text"))
        where = pc.index_in(uids, value_set=wanted["uid"].combine_chunks())
        hit = where.is_valid()
        return pa.table({"uid": uids.filter(hit), "text": texts.filter(hit), "df": wanted["df"].take(where.filter(hit))})

    own = wanted.select(cell_of("uid", n_cells).alias("cell"), "uid", "df")
    return cells.select("cell", "uid", "text").groupBy("cell").cogroup(own.groupBy("cell")).applyInArrow(run, "uid binary, text string, df binary")


def common_shingles(docs: DataFrame, common: float | None = None) -> tuple[int, DataFrame]:
    """Number of different texts; sh and df of the shingles in two or more of
    them, as a plain table; ``common`` leaves none out any more."""
    held = written(different(docs), "different-texts")
    n_docs = held.count()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sh, _ in block_shingles(batch.column(0)):
                sh, df = np.unique(sh, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(df)], names=["sh", "n"])

    counted = held.select("text").mapInArrow(local, "sh long, n long").groupBy("sh").agg(F.sum("n").alias("df"))
    return n_docs, counted.where("df > 1")


def band_rows(texts: DataFrame) -> DataFrame:
    """(bucket, uid) for every band of every scheme of the different texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_pylist()
            for scheme in (1, 2):
                own = [(u, s) for u, s in zip(uids, batch.column(scheme).to_pylist()) if s is not None]
                if own:
                    m = np.frombuffer(b"".join(s for _, s in own), _U).reshape(len(own), BANDS, ROWS)
                    key = np.broadcast_to(np.arange(BANDS, dtype=_U) + _U(1000 * scheme), (len(own), BANDS)).copy()
                    for k in range(ROWS):
                        key = W.mix(key * _U(W._STEP) + m[:, :, k], 7)
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)),
                                                      pa.array(np.repeat(np.array([u for u, _ in own], dtype=object), BANDS).tolist(), pa.binary())], names=["bucket", "uid"])

    return texts.select("uid", "whole", "binned").mapInArrow(run, "bucket long, uid binary")


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are at least ``threshold`` similar,
    with the similarity; ``texts`` is the table uid, text, df."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            both = [shingle_sets(batch.column(c), idf, batch.column(c + 2)) for c in (2, 3)]
            for (sa, wa), (sb, wb) in zip(*both):
                _, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                low = np.minimum(wa[ia], wb[ib]).sum()
                high = wa.sum() + wb.sum() - low
                sims.append(low / high if high else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    a = texts.select(F.col("uid").alias("a"), F.col("text").alias("ta"), F.col("df").alias("da"))
    b = texts.select(F.col("uid").alias("b"), F.col("text").alias("tb"), F.col("df").alias("db"))
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb", "da", "db")
    return joined.mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold - 1e-9)


def shingle_sets(texts: pa.Array, idf: Idf, dfs: pa.Array | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and weights of every text; ``dfs`` as ``signatures`` gives them."""
    for (a, b), owner, sh, tf in block_shingles(texts):
        df = None if dfs is None else np.frombuffer(b"".join(dfs.slice(a, b - a).to_pylist()), np.uint32)
        w = idf.weights(sh, tf, df)
        cut = np.searchsorted(owner, np.arange(b - a + 1))
        for i in range(b - a):
            yield sh[cut[i]:cut[i + 1]], w[cut[i]:cut[i + 1]]


def agreeing(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b, n) whose samples agree in ``least`` places or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for x, y in ((3, 5), (4, 6)):
                sides = [(i, u, v) for i, (u, v) in enumerate(zip(batch.column(x).to_pylist(), batch.column(y).to_pylist())) if u and v]
                if sides:
                    at = [i for i, _, _ in sides]
                    u, v = (np.frombuffer(b"".join(s[k] for s in sides), _U).reshape(len(sides), SAMPLES) for k in (1, 2))
                    keep[at] |= (u == v).sum(1) >= least
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["a", "b", "n"]).filter(pa.array(keep))

    a, b = (texts.select(F.col("uid").alias(c), F.col("whole").alias(f"w{c}"), F.col("binned").alias(f"s{c}")) for c in "ab")
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "n", "wa", "sa", "wb", "sb")
    return joined.mapInArrow(run, "a binary, b binary, n long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct ``edges`` (u > v) has one smaller
    neighbour or none, and a smaller neighbour has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def components(edges: DataFrame, name: str = "components", most_rounds: int = 50) -> DataFrame:
    """uid and root (the least uid) of every node of ``edges`` (a, b), by
    alternating large-star and small-star until every component is a star;
    each round is written once."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # one row an edge: repeats are left for the end of the round
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
    else:
        raise RuntimeError(f"no stars after {most_rounds} rounds")
    return edges.select(F.col("u").alias("uid"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("uid"), F.col("v").alias("root")).distinct())


class _Joined:
    """Union-find over the roots met in one block pair."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a: bytes, b: bytes) -> None:
        self.up[self.find(a)] = self.find(b)


def met_pairs(bands: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b, n) that join all members of a bucket that agree in half the places."""
    # one star centre per bucket, by hash, so that different bands try different centres
    centre = bands.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("uid", "bucket").alias("h"), "uid")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = bands.join(centre, "bucket").select("bucket", "uid", F.col("c.uid").alias("centre"), "n")
    met = star.where("uid <> centre").groupBy(F.least("uid", "centre").alias("a"), F.greatest("uid", "centre").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    starred = written(agreeing(met, texts, SAMPLES // 2), "star-pairs")
    return starred.unionByName(met_again(star, starred, texts, block)).groupBy("a", "b").agg(F.sum("n").alias("n"))


def met_again(star: DataFrame, pairs: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b, n) that join what met in a bucket but not through its centre.

    ``star``: bucket, uid, centre and the bucket's size n; ``pairs``: the star
    pairs that agree in half the places.  Members whose pair with the centre was
    left meet all members of the bucket in blocks, until all that agree in half
    the places are joined; a bucket of two has no one else to meet."""
    kept = pairs.select("a", "b", F.lit(True).alias("kept"))
    sides = star.where("n > 2").withColumn("a", F.least("uid", "centre")).withColumn("b", F.greatest("uid", "centre"))
    members = sides.join(kept, ["a", "b"], "left").select(
        F.col("bucket").alias("grp"), "uid", F.when(F.col("kept") | (F.col("uid") == F.col("centre")), F.col("centre")).otherwise(F.col("uid")).alias("root"))
    members = written(members, "bucket-members")
    left = members.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("grp")
    # members with the same class all over carry no news
    crowd = written(members.join(left, "grp", "left_semi"), "crowded-buckets")
    full = crowd.join(texts.select("uid", "whole", "binned"), "uid").withColumns({"text": F.lit(None).cast("string"), "df": F.lit(None).cast("binary")})
    return finish(full, None, 0.0, block, SAMPLES // 2).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def finish(members: DataFrame, idf: Idf | None, threshold: float, block: int, least_agree: int) -> DataFrame:
    """Links (a, b) between the roots of different classes of one loose group.

    ``members``: grp, uid, root, whole, binned, text, df.  Members outside the
    group's largest class meet all members, block against block of about
    ``block`` rows; a pair in different classes whose samples agree often enough
    is verified on its whole texts (without ``idf``: linked as it is), unless the
    block has joined them already."""
    sizes = members.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
    open_ = members.join(per.where("classes > 1"), "grp").withColumn("outside", F.col("root") != F.col("top.root"))
    row = F.struct("uid", "root", "whole", "binned", "text", "df")

    def grouped(df: DataFrame, n: F.Column, name: str) -> DataFrame:
        return (df.withColumn("part", F.pmod(F.xxhash64("uid"), F.ceil(n / block))).groupBy("grp", "part")
                .agg(F.collect_list(row).alias(name), F.max("all").alias("all")))

    # every outer block goes to each inner block's own key, so that the block
    # pairs of one large group are dealt over many tasks
    inner_parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("all") / block) - 1)
    outer = (grouped(open_.where("outside"), F.col("all") - F.col("top.n"), "l")
             .select("grp", "l", F.explode(inner_parts).alias("part")).repartition("grp", "part"))
    inner = grouped(open_, F.col("all"), "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _links_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), idf, threshold, least_agree)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*found)], names=["a", "b"])

    return outer.join(inner, ["grp", "part"]).select("l", "r").mapInArrow(run, "a binary, b binary").distinct()


def _links_of(left: list[dict], right: list[dict], idf: Idf | None, threshold: float, least_agree: int) -> list[tuple[bytes, bytes]]:
    """Links of one block pair; only texts with a candidate are cut into shingles."""
    near: list[tuple[int, int]] = []
    for form in ("whole", "binned"):
        li, ri = ([i for i, x in enumerate(side) if x[form] is not None] for side in (left, right))
        if not li or not ri:
            continue
        lm, rm = (np.frombuffer(b"".join(side[i][form] for i in own), _U).reshape(len(own), SAMPLES)
                  for side, own in ((left, li), (right, ri)))
        for i, samples in zip(li, lm):
            agree = (rm == samples).sum(1)
            hit = np.flatnonzero(agree >= least_agree)
            near += [(i, ri[j]) for j in hit[np.argsort(-agree[hit], kind="stable")] if left[i]["root"] != right[ri[j]]["root"]]
    if not near:
        return []
    sets = []
    for side, own in () if idf is None else ((left, sorted({i for i, _ in near})), (right, sorted({j for _, j in near}))):
        cut = shingle_sets(pa.array([side[i]["text"] for i in own], pa.string()), idf, pa.array([side[i]["df"] for i in own], pa.binary()))
        sets.append({i: (sh, w, w.sum()) for i, (sh, w) in zip(own, cut)})
    joined, found = _Joined(), []
    for i, j in near:
        x, y = left[i]["root"], right[j]["root"]
        if joined.find(x) == joined.find(y):
            continue
        if idf is None:
            joined.join(x, y)
            found.append((min(x, y), max(x, y)))
            continue
        (sa, wa, na), (sb, wb, nb) = sets[0][i], sets[1][j]
        _, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
        low = np.minimum(wa[ia], wb[ib]).sum()
        if low >= (threshold - 1e-9) * (na + nb - low):
            joined.join(x, y)
            found.append((min(x, y), max(x, y)))
    return found


def classed(docs: DataFrame, threshold: float, block: int) -> DataFrame:
    """doc_id, uid (hash of its words) and root (the class) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = written(named(rows), "ids")
    size = ids.agg(F.sum("bytes")).first()[0] or 0
    n_cells, parts = size // CELL + 1, size // PART + 1
    cells, cell_table, cell_path = bucketed(text_cells(rows, n_cells), "text-cells", "cell", n_cells)
    # a text counts once, however often it was copied
    idf = Idf(cells.agg(F.sum(F.size("uid"))).first()[0] or 0)
    texts = written(signatures(cells, parts, idf, threshold), "signatures")
    bands = written(band_rows(texts), "bands")

    pairs = written(met_pairs(bands, texts, block), "pairs")
    ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    held = written(texts_of(cells, n_cells, texts.select("uid", "df").join(ends, "uid", "left_semi")), "pair-texts")
    docs.sparkSession.sql(f"DROP TABLE {cell_table}")
    drop(docs.sparkSession, cell_path)

    sides = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "n").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "n"))
    first = sides.groupBy("x").agg(F.max_by("y", F.struct("n", "y")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    roots = written(components(verified(first, held, idf, threshold)), "roots")
    known = written(ends.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "known")

    # of the other pairs only those between classes matter
    own = [known.select(F.col("uid").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    between = pairs.join(own[0], "a").join(own[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    loose = components(between, "loose-groups").select(F.col("uid").alias("root"), F.col("root").alias("grp"))
    members = written(known.join(loose, "root"), "loose-members")
    members = members.join(texts.select("uid", "whole", "binned"), "uid").join(held, "uid")
    more = written(finish(members, idf, threshold, block, int(0.64 * SAMPLES)), "rest-links")
    if not more.isEmpty():  # links of whole classes: only their roots take part
        merged = components(more, "merged").select(F.col("uid").alias("root"), F.col("root").alias("top"))
        roots = known.join(merged, "root", "left").select("uid", F.coalesce("top", "root").alias("root"))

    return ids.select("doc_id", "uid").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def classes(docs: DataFrame, threshold: float = 0.8, block: int = 128) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row, with
    the number of members.

    Equal word sequences are one text; a text without words is alike only to
    others without words.  Rows whose doc_id is null keep it, and a class of
    only such rows has a null class_id; repeated rows are in one class; an
    empty table gives no rows; extra columns are ignored.
    """
    rows = classed(docs, threshold, block)
    own = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(own, "root").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, columns: list[str], threshold: float = 0.8, block: int = 128) -> DataFrame:
    """``columns`` of one row a class: its least doc_id (null last), of that id's
    texts in the class the one with the least hash, and of rows equal in both
    the least by the other columns.

    A row stands for its class by doc_id and text together, so unlike texts
    under one doc_id each keep their class's row.  Null doc_ids and texts,
    repeated rows and empty tables as in ``classes``; ``columns`` must hold
    doc_id and text.
    """
    def key(doc_id):  # equal also where null, so that rows and representatives meet on hash partitions
        return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"))

    doc_id = F.col("doc_id").cast("long")
    found = classed(docs, threshold, block)
    best = found.groupBy("root").agg(F.min(F.struct(key(F.col("doc_id")).alias("_key"), F.col("uid").alias("_uid"))).alias("r"))
    inner = docs.select(doc_id.alias("doc_id"), F.struct(*columns).alias("row"))
    kinds = inner.schema["row"].dataType
    at = columns.index("text")
    if kinds[at].dataType.simpleString() != "string":  # else a text goes to Python once, in its row
        inner = inner.withColumn("text", F.col("row").getField(kinds[at].name).cast("string"))
    fields = kinds.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, rows = batch.column(0), batch.column(1)
            for a, b, data, starts in W.blocks(batch.column(2) if batch.num_columns > 2 else rows.field(at)):
                uids = pa.array([u.tobytes() for u in word_ids(data, starts)], pa.binary())
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), uids, rows.slice(a, b - a)], names=["doc_id", "_uid", "row"])

    named_rows = inner.mapInArrow(run, f"doc_id long, _uid binary, row {fields}").select(key(F.col("doc_id")).alias("_key"), "_uid", "row")
    once = named_rows.groupBy("_key", "_uid").agg(F.min("row").alias("row"))
    return once.join(best.select("r.*"), ["_key", "_uid"], "left_semi").select("row.*")
