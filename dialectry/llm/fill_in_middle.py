"""Fill-in-middle transformation by a byte automaton.

One table-driven automaton reads UTF-8 bytes. Its states are the nodes of the sentinels' prefix tree and
one to three outstanding continuation bytes; a transition can complete a unit (a code point) or a
sentinel. Texts are cut into lanes of ``LANE`` bytes that step together. The first pass starts each lane in
its state after the bytes just before it and counts its units and sentinels; the second pass replays
only the lanes that hold a cut, up to the cut's unit.

What a document becomes is decided by a hash of its id. Defined results: a null text is the empty one, which
stays plain, as does a text that holds a sentinel; a null id hashes as the empty string; repeated rows are
rows of their own; an empty table gives an empty result. Only the named columns are read, so further
columns do no harm.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import slices, text_buffer

SENTINELS = ("<P>", "<S>", "<M>")
LANE = 256
UNIT, MARK, RESET = 1, 2, 256


class Automaton:
    """``next`` and ``emits`` by state and byte; byte ``RESET`` is the space between texts. State 0 is a unit's boundary."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        words = [s.encode("ascii") for s in sentinels]
        inside = any(a in b for a in words for b in words if a != b)
        if not all(words) or len(set(words)) < len(words) or inside or any(a[k:] == b[: len(a) - k] for a in words for b in words for k in range(1, len(a))):
            raise ValueError("sentinels must be ASCII, not empty, and must not overlap or hold one another")
        trie: list[dict[int, int]] = [{}]
        ends = set()
        for w in words:
            at = 0
            for b in w:
                if b not in trie[at]:
                    trie[at][b] = len(trie)
                    trie.append({})
                at = trie[at][b]
            ends.add(at)
        nodes = len(trie)
        self.next = np.zeros((nodes + 3, 257), dtype=np.int64)
        self.emits = np.zeros((nodes + 3, 257), dtype=np.uint8)
        fail, queue = [0] * nodes, deque([0])
        while queue:  # breadth first: the failure node's row is complete before it is needed
            at = queue.popleft()
            row = self.next[fail[at], :128].copy() if at else np.zeros(128, dtype=np.int64)
            for b, child in trie[at].items():
                fail[child] = int(row[b]) if at else 0
                row[b] = child
                queue.append(child)
            self.next[at, :128] = row
        for k in range(3):  # a malformed sequence starts anew
            self.next[nodes + k, :128] = self.next[0, :128]
        self.emits[:, :128] = UNIT
        self.emits[:, :128] |= np.where(np.isin(self.next[:, :128], list(ends)), MARK, 0).astype(np.uint8)
        for low, high, k in ((0xC0, 0xE0, 0), (0xE0, 0xF0, 1), (0xF0, 0x100, 2)):
            self.next[:, low:high] = nodes + k
        self.next[nodes + 1 :, 0x80:0xC0] = np.arange(nodes, nodes + 2)[:, None]
        self.emits[nodes, 0x80:0xC0] = UNIT
        self.warm = max(3, *map(len, words))

    def lanes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts in lanes, step by step (LANE rows), each lane's first state, and the n + 1 offsets of the texts' lanes."""
        per = -(-np.diff(at) // LANE)
        first = np.concatenate([[0], np.cumsum(per)])
        held = np.full((int(first[-1]), LANE), RESET, dtype=np.int16)
        flat = held.reshape(-1)
        for r in np.flatnonzero(per):
            flat[first[r] * LANE : first[r] * LANE + at[r + 1] - at[r]] = raw[at[r] : at[r + 1]]
        steps = np.ascontiguousarray(held.T)
        state = np.zeros(len(held), dtype=np.int64)
        goes_on = np.ones(len(held), dtype=bool)
        goes_on[first[:-1][per > 0]] = False
        later = np.flatnonzero(goes_on)
        for t in range(LANE - self.warm, LANE):
            state[later] = self.next[state[later], steps[t, later - 1]]
        return steps, state, first

    def count(self, steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that each lane completes, and whether it completes a sentinel."""
        units, seen = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.uint8)
        for row in steps:
            out = self.emits[state, row]
            units += out & UNIT
            seen |= out
            state = self.next[state, row]
        return units, (seen & MARK) > 0

    def places(self, steps: np.ndarray, state: np.ndarray, lane: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Bytes of each named lane up to and with its ``unit``-th completed unit (from 1)."""
        found, left, own = np.zeros(len(lane), dtype=np.int64), unit.copy(), state[lane]
        for t, row in enumerate(steps):
            b = row[lane]
            left -= self.emits[own, b] & UNIT
            found[(left == 0) & (found == 0)] = t + 1
            own = self.next[own, b]
        return found


def cut_texts(dfa: Automaton, raw: np.ndarray, at: np.ndarray, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, whether it holds a sentinel, and the byte ends of its prefix and middle (2 columns).

    ``pick`` maps the units to the units before each of the two cuts.
    """
    steps, state, first = dfa.lanes(raw, at)
    units, marked = dfa.count(steps, state)
    total = np.concatenate([[0], np.cumsum(units)])
    n = total[first[1:]] - total[first[:-1]]
    marks = np.concatenate([[0], np.cumsum(marked)])
    cuts = pick(n)
    ends = np.where(cuts >= n[:, None], np.diff(at)[:, None], 0)
    row, which = np.nonzero((cuts > 0) & (cuts < n[:, None]))
    wanted = cuts[row, which] + total[first[row]]
    lane = np.searchsorted(total, wanted, "left") - 1
    ends[row, which] = (lane - first[row]) * LANE + dfa.places(steps, state, lane, wanted - total[lane])
    return n, marks[first[1:]] > marks[first[:-1]], ends


def fill_in_middle(docs: DataFrame, seed: int = 1, moved_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; ``sentinels`` mark prefix, suffix and middle.

    Of texts without a sentinel, ``moved_percent`` are cut at two places and put into the order
    ``psm`` (prefix, suffix, middle), ``spm_percent`` of these into ``spm``; all others stay ``plain``.
    """
    Automaton(sentinels)  # a bad parameter fails here
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest.alias("h"))
    group = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    p, s, m = (x.encode() for x in sentinels)

    def run(batches):
        dfa = Automaton(sentinels)
        for batch in batches:
            for few in slices(batch, "text"):
                raw, at = text_buffer(few.column("text"))
                h1, h2, h3, h4 = (few.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
                n, marked, ends = cut_texts(dfa, raw, at, lambda n: np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], axis=1), axis=1))
                cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], axis=1), axis=1)
                plain = (n == 0) | marked | (h3 % 100 >= moved_percent)
                spm = h4 % 100 < spm_percent
                data, out = raw.tobytes(), []
                for a, b, (x, y), stays, swapped in zip(at[:-1].tolist(), at[1:].tolist(), ends.tolist(), plain.tolist(), spm.tolist()):
                    if stays:
                        out.append(data[a:b])
                    elif swapped:
                        out.append(b"".join((s, data[a + y : b], p, data[a : a + x], m, data[a + x : a + y])))
                    else:
                        out.append(b"".join((p, data[a : a + x], s, data[a + y : b], m, data[a + x : a + y])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.record_batch(
                    [few.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(cuts[:, 0], mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return named.select("doc_id", "text", *(group(k) for k in range(4))).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from an output and its form."""
    p, s, m = map(F.lit, sentinels)
    part = lambda c, mark, k: F.split_part(c, mark, F.lit(k))
    head, tail, middle = part(output, m, 1), output, part(output, m, 2)
    psm = F.concat(part(part(tail, s, 1), p, 2), middle, part(head, s, 2))
    spm = F.concat(part(head, p, 2), middle, part(part(head, p, 1), s, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def with_digests(done: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Replace the output by its digest and that of the text rebuilt from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"), sentinels)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))
