"""Re-Pair grammar compression of one shard of token ids.

Each round counts the neighbouring pairs of the sequence, makes nonterminals of the most frequent
ones and replaces their occurrences from left to right; the next round sees the shorter sequence.
Rounds with hashed counters come first. When one gains little, rounds with exact counts follow until
no pair is left that occurs ``least`` times.
The end mark of a document is in no pair, so documents begin and end at symbol borders. A shard
stores its rules, the length of every rule's expansion, and where each document begins among
symbols and among tokens; so a document, or a range of its tokens, is decoded by itself.

Layout, little-endian: ``MAGIC``; 9 unsigned 64-bit counts (terminals, end id, rounds, rules,
documents, symbols, bits per symbol, null ids, bytes per expansion length); then rules per round
(unsigned 32-bit), left and right symbols of rules, their expansion lengths, document ids (signed
64-bit), positions of null ids, document starts among symbols and tokens (unsigned 64-bit, one more
than documents), symbols. Symbols, those of rules too, are stored as the low 16 bits of each, then a
bit vector for every further bit. A rule so takes five to eight bytes and a pair that occurs
``least`` = 6 times saves at least twelve.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from itertools import islice

import numpy as np

MAGIC = b"REPAIR03"
_HEAD = "<8s9Q"
_BUCKETS = 18  # log2 of the pair counters of a round
_LITTLE = 50  # a round with hashed counters has to shorten the sequence by this share


def replace_pairs(seq: np.ndarray, end: int, free: int, most: int, least: int):
    """One round: the shorter sequence and the (left, right) of the new symbols from ``free`` on."""
    # every pair as one number, read in place: the left symbol in the low half
    pair = np.ndarray(len(seq) - 1, "<u8", seq, strides=(4,))
    bucket = pair * np.uint64(0x9E3779B97F4A7C15)
    bucket >>= np.uint64(64 - _BUCKETS)
    bucket = bucket.view(np.int64)
    counts = np.bincount(bucket, minlength=1 << _BUCKETS)
    cut = max(least, int(np.partition(counts, -most)[-most]))
    at = np.flatnonzero((counts >= cut)[bucket])
    at = at[(seq[at] != end) & (seq[at + 1] != end)]
    if not len(at):
        return seq, np.empty((0, 2), np.uint32)
    here = bucket[at]
    owner = np.zeros(1 << _BUCKETS, np.uint64)
    owner[here] = pair[at]  # of pairs that share a counter one is taken, the others wait
    taken = owner[here] == pair[at]
    at, here = at[taken], here[taken]
    # of neighbouring occurrences every other one is replaced, as they share a symbol
    opens = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    run = np.repeat(opens, np.diff(opens, append=len(at)))
    free_of = (np.arange(len(at)) - run) % 2 == 0
    at, here = at[free_of], here[free_of]
    exact = np.bincount(here, minlength=1 << _BUCKETS)
    chosen = np.flatnonzero(exact >= least)
    chosen = chosen[np.lexsort((owner[chosen], -exact[chosen]))][:most]
    return _replaced(seq, at, here, chosen, owner, free)


def _replaced(seq: np.ndarray, at: np.ndarray, here: np.ndarray, chosen: np.ndarray,
              pairs: np.ndarray, free: int):
    """The sequence with the ``chosen`` of ``pairs`` replaced at ``at``, and their rules."""
    symbol = np.zeros(len(pairs), np.int64)
    symbol[chosen] = free + np.arange(len(chosen))
    used = symbol[here] > 0
    at, here = at[used], here[used]
    out = seq.copy()
    out[at] = symbol[here]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    rules = pairs[chosen]
    return out[keep], np.column_stack([rules & np.uint64(0xFFFFFFFF), rules >> np.uint64(32)]).astype(
        np.uint32)


def _choose(pairs: np.ndarray, counts: np.ndarray, most: int, least: int) -> list[int]:
    """The pairs of a round, by frequency, and of equal ones the smaller first.

    A pair waits if its occurrences could share a symbol with those of one taken before: a symbol
    stands either left or right in the pairs of a round.
    """
    often = np.flatnonzero(counts >= least)
    often = often[np.argsort(-counts[often], kind="stable")]
    chosen, side = [], {}
    for i, pair in zip(often.tolist(), pairs[often].tolist()):
        left, right = pair & 0xFFFFFFFF, pair >> 32
        own = ("both", "both") if left == right else ("left", "right")
        if left == right and left in side:
            continue
        if side.get(left, own[0]) == own[0] and side.get(right, own[1]) == own[1]:
            side[left], side[right] = own
            chosen.append(i)
            if len(chosen) == most:
                break
    return chosen


def exact_rounds(seq: np.ndarray, end: int, free: int, most: int, least: int):
    """Rounds until no pair occurs ``least`` times without overlap: sequence and rules after each.

    The whole sequence is counted once. From then on a pair can only become frequent beside a symbol
    just made, so a round looks at the places of pairs that waited and at those beside new symbols.
    """
    pair = np.ndarray(len(seq) - 1, "<u8", seq, strides=(4,))
    bucket = pair * np.uint64(0x9E3779B97F4A7C15)
    bucket >>= np.uint64(64 - _BUCKETS)
    bucket = bucket.view(np.int64)
    at = np.flatnonzero((np.bincount(bucket, minlength=1 << _BUCKETS) >= least)[bucket])
    while True:
        at = at[(seq[at] != end) & (seq[at + 1] != end)]
        key = np.ndarray(len(seq) - 1, "<u8", seq, strides=(4,))[at]
        pairs, here = np.unique(key, return_inverse=True)
        # occurrences overlap only in a run of one symbol, of which every other one counts
        opens = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(here, prepend=-1) != 0))
        run = np.repeat(opens, np.diff(opens, append=len(at)))
        apart = (np.arange(len(at)) - run) % 2 == 0
        counts = np.bincount(here[apart], minlength=len(pairs))
        chosen = _choose(pairs, counts, most, least)
        if not chosen:
            return
        symbol = np.zeros(len(pairs), np.int64)
        symbol[chosen] = free + np.arange(len(chosen))
        made = apart & (symbol[here] > 0)
        places, waits = at[made], at[(counts >= least)[here]]
        touched = np.zeros(len(seq), bool)
        touched[places] = touched[places + 1] = True
        waits = waits[~(touched[waits] | touched[waits + 1])]
        seq[places] = symbol[here[made]]
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, free = seq[keep], free + len(chosen)
        waits = waits - np.searchsorted(places, waits)
        fresh = places - np.arange(len(places))
        at = np.unique(np.concatenate([waits, fresh[fresh > 0] - 1, fresh[fresh < len(seq) - 1]]))
        rules = pairs[chosen]
        yield seq, np.column_stack([rules & np.uint64(0xFFFFFFFF), rules >> np.uint64(32)]).astype(
            np.uint32)


def gather(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
           flat: np.ndarray) -> np.ndarray:
    """The expansions of ``symbols`` one after another."""
    sizes = lengths[symbols]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[symbols] - (ends - sizes), sizes) + np.arange(total)]


def encode_shard(ids: list[int | None], seq: np.ndarray, terminals: int, end_id: int, *,
                 rounds: int | None = None, most: int = 4000, least: int = 6) -> bytes:
    """A shard from its documents' ids and their tokens.

    ``seq`` has every document's tokens followed by the mark ``terminals``, which decodes to
    ``end_id``; tokens are below ``terminals``. Without ``rounds`` no pair is left that occurs
    ``least`` times.
    """
    seq = np.ascontiguousarray(seq, "<i4")
    tokens = np.concatenate([[0], np.flatnonzero(seq == terminals) + 1]).astype(np.uint64)
    rules: list[np.ndarray] = []
    free = terminals + 1
    while (rounds is None or len(rules) < rounds) and len(seq) > 1:
        shorter, made = replace_pairs(seq, terminals, free, most, least)
        if len(seq) - len(shorter) < len(seq) / _LITTLE:
            break
        seq, free = shorter, free + len(made)
        rules.append(made)
    if len(seq) > 1:
        more = exact_rounds(seq.copy(), terminals, free, most, least)
        for seq, made in more if rounds is None else islice(more, rounds - len(rules)):
            free += len(made)
            rules.append(made)
    per_round = [len(made) for made in rules]
    rules = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    lengths = _tables(terminals, end_id, rules, per_round)[1][terminals + 1:].astype(np.uint32)
    width = max(16, (free - 1).bit_length())
    nulls = np.array([i for i, x in enumerate(ids) if x is None], np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(seq == terminals) + 1]).astype(np.uint64)
    size = next(b for b in (1, 2, 4) if lengths.max(initial=0) < 1 << 8 * b)
    head = struct.pack(_HEAD, MAGIC, terminals, end_id, len(per_round), len(rules), len(ids), len(seq), width,
                      len(nulls), size)
    parts = [np.array(per_round, "<u4"), *_packed(rules[:, 0], width), *_packed(rules[:, 1], width),
             lengths.astype(f"<u{size}"), np.array([x or 0 for x in ids], "<i8"), nulls.astype("<u8"),
             starts.astype("<u8"), tokens.astype("<u8"), *_packed(seq, width)]
    return head + b"".join(p.tobytes() for p in parts)


def _packed(symbols: np.ndarray, width: int) -> list[np.ndarray]:
    """Symbols at ``width`` bits: 16 of each, then a bit vector for every further one."""
    return [(symbols & 0xFFFF).astype("<u2"), *[np.packbits((symbols >> bit & 1).astype(
        np.uint8), bitorder="little") for bit in range(16, width)]]


def _tables(terminals: int, end_id: int, rules: np.ndarray, per_round) -> tuple:
    """Starts, lengths and the text of every symbol's expansion; rules build on earlier rounds."""
    flat = np.append(np.arange(terminals, dtype=np.uint32), np.uint32(end_id))
    starts, lengths = np.arange(terminals + 1), np.ones(terminals + 1, np.int64)
    done = 0
    for count in per_round:
        own = rules[done:done + count].astype(np.int64)
        text = gather(own.ravel(), starts, lengths, flat)
        size = lengths[own].sum(axis=1)
        starts = np.append(starts, len(flat) + np.cumsum(size) - size)
        lengths, flat, done = np.append(lengths, size), np.append(flat, text), done + int(count)
    return starts, lengths, flat


@dataclass
class Shard:
    """A shard opened for reading."""

    content: bytes

    def __post_init__(self) -> None:
        (magic, self.terminals, self.end_id, rounds, rules, self.documents, symbols, width, nulls,
         size) = struct.unpack_from(_HEAD, self.content)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = struct.calcsize(_HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.content, kind, count, at)
            at += out.nbytes
            return out

        def unpack(count: int) -> np.ndarray:
            out = take("<u2", count).astype(np.uint32)
            for bit in range(16, width):
                out |= np.unpackbits(take("u1", (count + 7) // 8), count=count,
                                     bitorder="little").astype(np.uint32) << np.uint32(bit)
            return out

        per_round = take("<u4", rounds)
        left, right = unpack(rules), unpack(rules)
        self.rule_lengths = take(f"<u{size}", rules)
        ids = take("<i8", self.documents)
        null = set(take("<u8", nulls).tolist())
        self.ids = [None if i in null else x for i, x in enumerate(ids.tolist())]
        self.symbol_starts = take("<u8", self.documents + 1).astype(np.int64)
        self.token_starts = take("<u8", self.documents + 1).astype(np.int64)
        self.symbols = unpack(symbols)
        self._starts, self._lengths, self._flat = _tables(
            self.terminals, self.end_id, np.column_stack([left, right]), per_round)

    def all_tokens(self) -> np.ndarray:
        """The token ids of all documents, end ids included."""
        return gather(self.symbols.astype(np.int64), self._starts, self._lengths, self._flat)

    def tokens(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids ``start`` to ``stop`` of one document, decoded from the symbols they need."""
        own = self.symbols[self.symbol_starts[document]:self.symbol_starts[document + 1]].astype(
            np.int64)
        ends = np.cumsum(self._lengths[own])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(ends, [start, stop - 1], side="right")
        before = int(ends[a] - self._lengths[own[a]])
        return gather(own[a:b + 1], self._starts, self._lengths, self._flat)[
            start - before:stop - before]
