"""What is looked up within one document: texts that hold a needle, passages and annotations in a new cut of the text.  Helpers of
the operators in ``joins``, which give them one document at a time inside a task."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

#: Lengths of seeds; a needle of at least ``2 * size - 1`` characters has a whole window of ``size`` seeds.
SEEDS = (12, 4, 1)
#: Seeds of a needle of which the rarest is looked up; each of them is in every text that holds the needle.
LOOKED_UP = 8
#: Characters that are hashed at once.
AT_ONCE = 1 << 20
#: Needles times characters up to which a document is read through for every needle; beyond it, it is indexed.
READ_THROUGH = 1 << 24

#: Unicode white space, as ``(?U)\s`` of Spark's patterns.
_OTHER = "\t-\r\x85\xa0  -     　"
#: Runs of it that are not one space.
_BLANKS = re.compile(f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+")


def window_seeds(texts: Sequence[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of each window of ``size`` stretches side by side, and the number of its text.  Those of a needle are among
    those of every text that holds it."""
    parts = np.cumsum([len(t) for t in texts]) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(texts)]
    found = [_hashed(texts[a:b], size, a) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([value for value, _ in found]), np.concatenate([of for _, of in found])


def _hashed(texts: Sequence[str], size: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    windows = len(codes) - 2 * size + 2
    if windows <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashed = np.zeros(windows + size - 1, np.uint64)
    for i in range(size):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(hashed)]
    hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(32)
    least = hashed[:windows]
    for i in range(1, size):
        least = np.minimum(least, hashed[i : i + windows])
    row = np.repeat(np.arange(len(texts)), lengths)
    own = np.arange(windows) + 2 * size - 1 <= np.cumsum(lengths)[row[:windows]]  # no window lies across two texts
    value, of = least[own], row[:windows][own]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new] + begin


def holding(texts: Sequence[str], needles: Sequence[str]) -> list[list[int]]:
    """For each needle the numbers of the texts that hold it, in order; an empty needle is in none.

    Few needles are sought in every text.  Beyond that texts are known by the hashes of their windows, about two in ``size`` characters;
    of a few of a needle's hashes the rarest is looked up, and what is found is compared in full.
    """
    if len(needles) * sum(map(len, texts)) <= READ_THROUGH:
        return [[i for i, text in enumerate(texts) if needle in text] if needle else [] for needle in needles]
    found: list[list[int]] = [[] for _ in needles]
    sizes = [next((s for s in SEEDS if len(n) >= 2 * s - 1), 0) for n in needles]
    for size in SEEDS:
        mine = [i for i, s in enumerate(sizes) if s == size]
        if not mine:
            continue
        value, of = window_seeds(texts, size)
        order = np.argsort(value, kind="stable")
        value, of = value[order], of[order]
        seed, needle = window_seeds([needles[i] for i in mine], size)
        low, high = np.searchsorted(value, seed), np.searchsorted(value, seed, "right")
        begin = np.searchsorted(needle, np.arange(len(mine) + 1))
        for k, i in enumerate(mine):
            looked_up = slice(begin[k], min(begin[k + 1], begin[k] + LOOKED_UP))
            rarest = looked_up.start + np.argmin(high[looked_up] - low[looked_up])
            found[i] = [int(t) for t in np.unique(of[low[rarest] : high[rarest]]) if needles[i] in texts[t]]
    return found


def moved_passages(pointers: Sequence, needles: Sequence, old_ids: Sequence, old_texts: Sequence, new_ids: Sequence, new_texts: Sequence, lowered: Sequence) -> list:
    """For each pointer the new passage of the same id and text, else the first of the same text, else the first that holds
    the needle, runs of blanks aside."""
    was, now, first = dict(zip(old_ids, old_texts)), dict(zip(new_ids, new_texts)), {}
    for name, text in zip(new_ids, new_texts):
        first.setdefault(text, name)
    first.pop(None, None)
    found = []
    for name in pointers:
        old, new = was.get(name), now.get(name)
        found.append(name if new is not None and (old is None or old == new) else first.get(old))
    open_ = {needle: squeezed(needle) for needle, hit in zip(needles, found) if hit is None and needle}
    sought = sorted({needle for needle in open_.values() if needle})
    if sought:
        at = {squeezed(text): i for i, text in reversed(list(enumerate(lowered))) if text is not None}  # of equal texts the first stands for all
        texts = list(at)
        hits = {needle: new_ids[min(at[texts[t]] for t in held)] for needle, held in zip(sought, holding(texts, sought)) if held}
        found = [hits.get(open_.get(needle)) if hit is None else hit for needle, hit in zip(needles, found)]
    return found


def squeezed(text: str) -> str:
    return _BLANKS.sub(" ", text).removeprefix(" ").removesuffix(" ")


def anchored(blocks: dict, start_pos: int, start_offset: int, end_pos: int, end_offset: int) -> str | None:
    """The text between two anchors, blocks joined by spaces; none where they do not fit.  ``blocks``: texts by position."""
    if any(x is None or x != x for x in (start_pos, start_offset, end_pos, end_offset)) or (start_pos, start_offset) >= (end_pos, end_offset) or end_pos - start_pos >= len(blocks):
        return None
    parts = []
    for pos in range(int(start_pos), int(end_pos) + 1):
        text = blocks.get(pos)
        if text is None:
            return None
        begin, end = int(start_offset) if pos == start_pos else 0, int(end_offset) if pos == end_pos else len(text)
        if begin > len(text) or end > len(text):
            return None
        parts.append(text[begin : max(begin, end)])
    return " ".join(parts)


def _sought(probe: str, text: str, folded: str, begin: int = 0) -> tuple[int, int] | None:
    """Where a squeezed probe stands in a text, any run of ASCII blanks for another."""
    if text == folded:
        at = text.find(probe, begin)
        return (at, at + len(probe)) if at >= 0 else None
    found = re.compile(r"\s+".join(map(re.escape, probe.split(" "))), re.ASCII).search(text, begin)
    return found and found.span()


def rescued(positions: Sequence, texts: Sequence, notes: Sequence[tuple], probe: int) -> list[tuple]:
    """``status`` of each note ``start_pos, start_offset, end_pos, end_offset, excerpt``, and its new anchors if it is moved."""
    blocks = dict(sorted((pos, text) for pos, text in zip(positions, texts) if text is not None))
    out, lost = [], []
    for place in notes:
        *anchors, excerpt = place
        now = anchored(blocks, *anchors) if excerpt else None
        plain = None if now is None else squeezed(now)
        same = plain is not None and plain.startswith(excerpt[:probe]) and plain.endswith(excerpt[-probe:])
        out.append(("kept" if same else "orphaned", None, None, None, None))
        if excerpt and not same:
            lost.append((len(out) - 1, squeezed(excerpt[:probe]), squeezed(excerpt[-probe:]) if len(excerpt) > probe else None))
    if not lost:
        return out
    order, folded = list(blocks), [_BLANKS.sub(" ", text) for text in blocks.values()]
    probes = sorted({p for _, head, tail in lost for p in (head, tail) if p})
    held = dict(zip(probes, holding(folded, probes)))

    def first(sought: str, block: int, begin: int) -> tuple[int, int, int] | None:
        for i in held.get(sought, ()):
            if i >= block and (span := _sought(sought, blocks[order[i]], folded[i], begin if i == block else 0)):
                return (i, *span)
        return None

    for k, head, tail in lost:
        if hit := first(head, 0, 0):
            last = hit if tail is None else first(tail, hit[0], hit[1])
            if last:
                out[k] = ("moved", order[hit[0]], hit[1], order[last[0]], last[2])
    return out
