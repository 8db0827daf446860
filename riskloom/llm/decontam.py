"""Benchmark passages in documents, by edit distance.

The CGK embedding walks along a string and copies its symbols; at step t it
moves on when a random bit of (t, symbol) is 1 and repeats the symbol when it
is 0.  Two strings that differ by few edits fall back into step soon after an
edit, so the edit distance becomes a Hamming distance between walks.  Sampling
coordinates of a walk as a key then is a locality-sensitive hash, and several
keys of several walks bring the recall to its target.

Symbols are the bytes of the text, lower-cased in ASCII, white space as one
blank.  At one edit in five characters a walk over a whole item hardly ever
ends in step, so an item is embedded from all of its places, and the document
from all of its own.  A shared key proposes an item-sized window of the document.  A proposal must first match a
piece of 64 symbols around the key (an item within r edits a symbol has a piece
within r); then the whole item is searched in its window by exact semi-global
edit distance over characters (bit-parallel).

How many walks an item gets follows from the target recall: copies
of items with ``max_rate`` random edits are searched on the driver for every
length class, with rising effort until the target is reached.  Items too short
for it are searched exactly: of k + 1 parts of an item with at most k edits one
is intact, and all occurrences of the parts are verified.

One narrow pass over whole texts per block of items; nothing is shuffled.
Items are bounded by ``block_bytes`` a block, and there are as many blocks as
the benchmark needs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm import wordhash as W

_U = np.uint64
SCHEMA = "doc_id long, item_id long, first_word long, distance long, item_chars long"
STEPS, SAMPLED, TABLES = 32, 16, 2
# walks from every place, by rising effort
EFFORTS = (1, 2, 3)
PIECE, STRIDE, DRIFT = 64, 16, 16
_RUN = 1 << 15  # places at a time: few calls, and what a walk touches is a few MB
_SPACES = {c: " " for c in range(0x09, 0x0E)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def symbols_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts that lie end to end in ``data``, two zeros behind each;
    first and last+1 symbol of every text."""
    low = _LOWER[data]
    space = low == 32
    drop = space.copy()
    drop[1:] &= space[:-1]
    inner = starts[:-1][starts[:-1] < len(low)]
    drop[inner] = space[inner]  # blanks that begin a text
    gone = np.flatnonzero(drop)
    at = starts - np.searchsorted(gone, starts)
    shift = 2 * np.arange(len(starts))
    return np.insert(low[~drop], np.repeat(at[1:], 2), 0), (at + shift)[:-1], (at[1:] + shift[:-1])


def normal(text: str) -> str:
    return " ".join(w for w in lowered(text).split(" ") if w)


def lowered(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text).translate(_SPACES)


def places(symbols: np.ndarray) -> np.ndarray:
    """The places of all symbols, without the zeros between texts."""
    return np.flatnonzero(symbols)


def embed(symbols: np.ndarray, walk: int) -> np.ndarray:
    """The moves of every symbol, that after step t in bit t: 32 random bits,
    other ones for each symbol, that name it too; a walk stays on a zero."""
    move = np.random.default_rng([walk, STEPS]).integers(0, 1 << STEPS, 256, dtype=np.uint64).astype(np.uint32)
    move[0] = 0
    return np.take(move, symbols)


def steps(embedded: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
    """The CGK walk from every place in ``start``, step by step, each in the same
    array."""
    here = start.astype(np.int64)
    step, move = np.empty(len(here), np.uint32), np.empty(len(here), np.uint32)
    for t in range(STEPS):
        np.take(embedded, here, out=step, mode="clip")
        yield step
        np.right_shift(step, np.uint32(t), out=move)
        np.bitwise_and(move, np.uint32(1), out=move)
        here += move


def coordinates(walk: int, table: int) -> np.ndarray:
    """The sampled steps of a table."""
    return np.sort(np.random.default_rng([walk, table]).choice(STEPS, SAMPLED, replace=False))


def window_keys(symbols: np.ndarray, start: np.ndarray, walks: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number of walk and table, first place, keys of the windows from there
    on), in runs of places, so that a long text needs no more memory."""
    sampled = [[set(coordinates(walk, table).tolist()) for table in range(TABLES)] for walk in range(walks)]
    for walk in range(walks):
        embedded = embed(symbols, walk)
        for a in range(0, len(start), _RUN):
            own = start[a:a + _RUN]
            keys = [np.full(len(own), 1 + walk * TABLES + table, np.uint32) for table in range(TABLES)]
            for t, step in enumerate(steps(embedded, own)):
                for key, taken in zip(keys, sampled[walk]):
                    if t in taken:
                        key += step
                        key *= np.uint32(W._STEP & 0xFFFFFFFF)
            for table, key in enumerate(keys):
                yield walk * TABLES + table, a, key


def semi_global(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any substring of the text
    (bit-parallel dynamic programming, one column per character)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
    return best


class Pieces:
    """Pieces of ``PIECE`` symbols of every item, compared with many stretches
    at once: one machine word a piece, bit-parallel over its symbols.  Symbols
    that agree in their last five bits count as equal, which can only lower a
    distance."""

    def __init__(self, items: list[bytes]):
        self.first, self.last, self.begin, size = [], [], [], []
        masks = []
        for b in items:
            self.first.append(len(masks))
            end = max(0, len(b) - PIECE)
            for s in [*range(0, end, STRIDE), end]:
                mask = np.zeros(33, _U)
                for i, c in enumerate(b[s:s + PIECE]):
                    mask[c & 31] |= _U(1 << i)
                masks.append(mask)
                self.begin.append(s)
                size.append(min(PIECE, len(b)))
            self.last.append(len(masks) - 1)
        self.first, self.last, self.begin = (np.array(x, np.int64) for x in (self.first, self.last, self.begin))
        self.size = np.array(size, np.int64)
        self.masks = np.array(masks, _U).reshape(-1)

    def near(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, offset: np.ndarray,
             at: np.ndarray, rate: float) -> np.ndarray:
        """Whether the item's piece around ``offset`` is within ``rate`` edits a
        symbol of some stretch of the text [low, high) around ``at``."""
        want = np.maximum(offset + SAMPLED // 2 - PIECE // 2, 0)
        piece = np.minimum(self.first[item] + (want + STRIDE // 2) // STRIDE, self.last[item])
        size = self.size[piece]
        begin = at - offset + self.begin[piece] - DRIFT
        span = PIECE + 2 * DRIFT
        # the stretches side by side, one step a row; 32 outside the text
        around = np.lib.stride_tricks.sliding_window_view(np.pad(symbols & 31, span, constant_values=32), span)
        window = around[np.clip(begin + span, 0, len(around) - 1)]
        step = np.arange(span)
        outside = np.flatnonzero((begin < low) | (begin + span > high))
        p = begin[outside, None] + step
        window[outside] = np.where((p >= low[outside, None]) & (p < high[outside, None]), window[outside], 32)
        window = np.ascontiguousarray(window.T)
        most = (rate * size).astype(np.int64)
        mask_at, top = piece * 33, (size - 1).astype(_U)
        own = np.arange(len(at))
        pv, mv = np.full(len(at), ~_U(0)), np.zeros(len(at), _U)
        score, best = size.copy(), size.copy()
        near = np.zeros(len(at), bool)
        index, (eq, xv, xh, ph, mh) = np.empty(len(at), np.int64), np.empty((5, len(at)), _U)
        for t in range(span):
            np.add(mask_at, window[t], out=index)
            np.take(self.masks, index, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            xh ^= pv
            xh |= eq
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            np.bitwise_and(pv, xh, out=mh)
            for change, side in ((np.add, ph), (np.subtract, mh)):
                np.right_shift(side, top, out=xh)
                xh &= _U(1)
                change(score, xh.view(np.int64), out=score)
                side <<= _U(1)
            np.bitwise_or(xv, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            np.bitwise_and(ph, xv, out=mv)
            np.minimum(best, score, out=best)
            if t >= PIECE and t % 4 == 3:
                near[own[best <= most]] = True
                # a score falls by one a step at most, so only these are still open
                left = np.flatnonzero((best > most) & (score <= most + (span - 1 - t)))
                if 4 * len(left) < 3 * len(own) or t == span - 1:
                    own, pv, mv, score, best, most, mask_at, top = (x[left] for x in (own, pv, mv, score, best, most, mask_at, top))
                    window = window[:, left]
                    index, eq, xv, xh, ph, mh = (x[:len(left)] for x in (index, eq, xv, xh, ph, mh))
        return near


class Keys:
    """Sorted window keys of one table and the (item, offset) of each."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], item[order], offset[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.keys >> np.uint32(10)] = True

    def hits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the window, index of the owner) of every shared key."""
        hit = np.flatnonzero(np.take(self.filter, key >> np.uint32(10)))
        lo = np.searchsorted(self.keys, key[hit])
        n = np.searchsorted(self.keys, key[hit], side="right") - lo
        run = np.repeat(np.cumsum(n) - n, n)
        return np.repeat(hit, n), np.repeat(lo, n) + np.arange(int(n.sum())) - run


class Items:
    """Window keys of a block of benchmark items, (item_id, text) each.  An item
    without a word holds nothing and is never found."""

    def __init__(self, rows: list[tuple[int | None, str]], max_rate: float, target: float = 0.95, effort: dict[int, int] | None = None):
        self.max_rate = max_rate
        rows = [(i, n) for i, n in ((i, normal(t)) for i, t in rows) if n]
        self.ids, self.texts = [i for i, _ in rows], [t for _, t in rows]
        self.most = [int(max_rate * len(t)) for t in self.texts]
        raw = [t.encode("utf-8", "replace") for t in self.texts]
        self.size = np.array([len(b) for b in raw], np.int64)
        self.slack = 4 * np.array(self.most, np.int64) + 8  # a character has up to four bytes
        effort = efforts(self.texts, max_rate, target) if effort is None else effort
        level = np.array([effort[len(b).bit_length()] for b in raw], np.int64)
        self.exact = [j for j in range(len(raw)) if level[j] == len(EFFORTS)]
        self.pieces = Pieces(raw)
        self.walks = 0
        found: dict[int, list[tuple]] = {}
        for own in sorted(set(level.tolist()) - {len(EFFORTS)}):
            walks = EFFORTS[own]
            self.walks = max(self.walks, walks)
            mine = np.flatnonzero(level == own)
            data = np.frombuffer(b"".join(raw[j] for j in mine), np.uint8)
            symbols, first, _ = symbols_of(data, np.concatenate([[0], np.cumsum(self.size[mine])]))
            at = places(symbols)
            k = np.searchsorted(first, at, side="right") - 1
            for table, a, key in window_keys(symbols, at, walks):
                run = slice(a, a + len(key))
                found.setdefault(table, []).append((key, mine[k[run]], (at - first[k])[run]))
        self.tables = {table: Keys(*(np.concatenate(x) for x in zip(*parts))) for table, parts in found.items()}

    def proposals(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, symbol where the item would begin, keys that say so),
        sorted, of all hits whose piece is near enough."""
        parts = []
        starts = places(symbols) if self.tables else np.zeros(0, np.int64)
        for k, a, key in window_keys(symbols, starts, self.walks):
            if k in self.tables:
                window, owner = self.tables[k].hits(key)
                parts.append((starts[a + window], self.tables[k].item[owner], self.tables[k].offset[owner]))
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        at, item, offset = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((at - offset, item))
        at, item, offset = at[order], item[order], offset[order]
        own = np.ones(len(at), bool)
        own[1:] = (item[1:] != item[:-1]) | ((at - offset)[1:] != (at - offset)[:-1])
        said = np.diff(np.append(np.flatnonzero(own), len(at)))
        said = np.repeat(said, said)
        # one hit for each 16 places along and across the diagonal, of the beginning most keys say
        across = (at - offset) // 16
        order = np.lexsort((offset, -said, offset // 16, across, item))
        at, item, offset, across, said = at[order], item[order], offset[order], across[order], said[order]
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (across[1:] != across[:-1]) | (offset[1:] // 16 != offset[:-1] // 16)
        at, item, offset, said = at[new], item[new], offset[new], said[new]
        text = np.searchsorted(first, at, side="right") - 1
        near = np.zeros(len(at), bool)
        for a in range(0, len(at), _RUN):
            s = slice(a, a + _RUN)
            near[s] = self.pieces.near(symbols, first[text[s]], last[text[s]], item[s], offset[s], at[s], 1.5 * self.max_rate)
        text, item, begin, said = text[near], item[near], (at - offset)[near], said[near]
        order = np.lexsort((begin, item, text))
        return text[order], item[order], begin[order], said[order]

    def stretch(self, symbols: np.ndarray, lo: int, hi: int, item: int) -> int:
        return semi_global(self.texts[item], symbols[lo:hi].tobytes().decode("utf-8", "replace"))

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, distance): the best place of every item within
        ``max_rate`` edits a character of the row's text."""
        for a, _, data, starts in W.blocks(texts, 1 << 18):
            symbols, first, last = symbols_of(data, starts)
            if len(symbols) < 3:
                continue
            best: dict[tuple[int, int], tuple[int, int]] = {}
            # [row, item, first beginning, last one inside the stretch, most keys, the beginning they say]
            stretches: list[list[int]] = []
            for row, item, begin, said in zip(*(x.tolist() for x in self.proposals(symbols, first, last))):
                if stretches and stretches[-1][:2] == [row, item] and begin <= stretches[-1][3]:
                    if said > stretches[-1][4]:
                        stretches[-1][4:] = said, begin
                else:
                    stretches.append([row, item, begin, begin + int(self.slack[item]) // 2, said, begin])
            for row, item, begin, _, _, likely in stretches:
                slack = int(self.slack[item])
                lo, hi = max(begin - slack, int(first[row])), min(begin + int(self.size[item]) + 2 * slack, int(last[row]))
                found = self.stretch(symbols, lo, hi, item), max(likely, int(first[row]))
                if found[0] <= self.most[item]:
                    best[row, item] = min(found, best.get((row, item), found))
            for row in range(len(first)) if self.exact else ():
                best.update(self.short(symbols, int(first[row]), int(last[row]), row))
            for (row, item), (distance, begin) in sorted(best.items()):
                yield a + row, item, int(np.count_nonzero(symbols[first[row]:begin] == 32)), distance

    def short(self, symbols: np.ndarray, first: int, last: int, row: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        """Items too short for the target recall: of most + 1 parts one is intact."""
        text = symbols[first:last].tobytes().decode("utf-8", "replace")
        for item in self.exact:
            pattern, most, best = self.texts[item], self.most[item], None
            m = len(pattern)
            cuts = [m * j // (most + 1) for j in range(most + 2)]
            where = set()
            for lo, hi in zip(cuts, cuts[1:]):
                p = text.find(pattern[lo:hi])
                while p >= 0:
                    where.add(max(p - lo, 0))
                    p = text.find(pattern[lo:hi], p + 1)
            seen = -1
            for p in sorted(where):
                if p <= seen:
                    continue
                seen = p + m  # one stretch serves the places up to here
                d = semi_global(pattern, text[max(p - most, 0):seen + m + most])
                if d <= most and (best is None or d < best[0]):
                    best = d, first + len(text[:p].encode("utf-8", "replace"))
            if best:
                yield (row, item), best


def edited(text: str, edits: int, rng: random.Random) -> str:
    """The text after that many random substitutions, insertions and removals
    of characters; new ones are drawn from the text."""
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out)) if out else 0, rng.randrange(3)
        out[k:k + (kind != 1)] = [rng.choice(text)] if kind < 2 else []
    return "".join(out)


def efforts(texts: list[str], max_rate: float, target: float, sample: int = 120) -> dict[int, int]:
    """Length class -> least effort at which ``target`` of the edited copies of
    its items are found inside other text; ``len(EFFORTS)``: none is enough.
    ``sample`` copies a class, of items spread over the class."""
    rng, out = random.Random(1), {}
    classes: dict[int, list[str]] = {}
    for t in texts:
        classes.setdefault(len(t.encode("utf-8", "replace")).bit_length(), []).append(t)
    for own, members in sorted(classes.items()):
        members = sorted(set(members))
        members = [members[j * len(members) // sample] for j in range(sample)]
        around = [rng.choice(members) for _ in members]
        copies = [normal(f"{b} {edited(t, int(max_rate * len(t)), rng)} {b}") for t, b in zip(members, around)]
        held = {r for r, t in enumerate(members) if semi_global(t, copies[r]) <= int(max_rate * len(t))}
        for out[own] in range(len(EFFORTS) + 1):
            if out[own] == len(EFFORTS):
                break
            items = Items([(0, t) for t in sorted(set(members))], max_rate, effort=out)
            found = {(row, items.texts[item]) for row, item, _, _ in items.search(pa.array(copies))}
            if sum((r, members[r]) in found for r in held) >= target * len(held):
                break
    return out


def item_blocks(benchmark: DataFrame, max_rate: float, target: float, block_bytes: int = 4 << 20) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes``; one row per item_id and
    text.  Null texts and texts without a word hold nothing that could be called
    a leaked passage and are left out; a null item_id is an id like any other."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        # a repeated item_id counts as several items
        yield Items([(r["item_id"], r["text"]) for r in own], max_rate, target)


def leaks(docs: DataFrame, benchmark: DataFrame, max_rate: float = 0.2, target: float = 0.95) -> DataFrame:
    """doc_id, item_id, first_word, distance, item_chars: one row per document
    row and benchmark item that it holds within ``max_rate`` edits a character;
    of such places with evenly spread edits a share of ``target`` is found.
    first_word is the word that the best place begins in, as the key sees it.

    Null or empty texts hold nothing; null doc_ids and item_ids stay null;
    repeated rows are searched each; without documents or items there are no
    rows; extra columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in item_blocks(benchmark, max_rate, target):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[r], items.ids[i], word, d, len(items.texts[i])) for r, i, word, d in items.search(batch.column(1))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)],
                                                     names=["doc_id", "item_id", "first_word", "distance", "item_chars"])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def holds_item(text: Column, benchmark: DataFrame, max_rate: float = 0.2, target: float = 0.95) -> Column:
    """Boolean column: the text holds some benchmark item; for filters.  False
    for null and empty texts and for a benchmark without items."""
    out = F.lit(False)
    for items in item_blocks(benchmark, max_rate, target):
        out = out | _holds(items)(text.cast("string"))
    return out


def _holds(items: Items):
    @F.arrow_udf("boolean")
    def leaked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            hit = np.zeros(len(t), bool)
            hit[[r for r, *_ in items.search(t)]] = True
            yield pa.array(hit)

    return leaked
