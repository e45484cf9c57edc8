"""Static range asymmetric numeral system over token ids, in independent interleaved blocks.

A block's ids are dealt in turn to lanes. Every lane is a coder with a 32-bit state that
passes 16-bit words to one stream shared by the block; a decoder reads the words in the
order in which lanes run dry, so all lanes advance together as numpy vectors. Every
``EVERY`` steps a checkpoint keeps the states and the stream position: decoding may start
at any of them. Blocks carry CRC-32 sums of their ids and of their payload.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 16
SCALE = 1 << BITS
LANES = 2048
EVERY = 64
_LOW = np.uint32(1 << 16)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to ``counts``, summing to 65536; every counted id has at least 1."""
    counts = np.asarray(counts, np.int64)
    seen = np.flatnonzero(counts)
    if len(seen) > SCALE:
        raise ValueError(f"{len(seen)} distinct ids; a table of {SCALE} slots holds no more than that")
    freq = np.zeros(len(counts), np.int64)
    if not len(seen):
        return freq
    exact = counts[seen] * (SCALE / counts.sum())
    part = np.maximum(1, np.floor(exact).astype(np.int64))
    # the largest frequencies pay for ids raised to 1, the largest remainders get what is left
    while (over := part.sum() - SCALE) > 0:
        big = np.argsort(-part, kind="stable")
        room = part[big] - 1
        give = np.minimum(room, np.maximum(1, part[big] * over // max(1, part.sum())))
        give = np.where(np.cumsum(give) <= over, give, np.maximum(0, over - (np.cumsum(give) - give)))
        part[big] -= np.minimum(give, room)
    if over < 0:
        order = np.argsort(part - exact, kind="stable")
        part[order[: -over % len(order)]] += 1
        part[order] += -over // len(order)
    freq[seen] = part
    return freq


class Table:
    """The shared frequency table with its slot lookups."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint32)
        self.low = (np.cumsum(freq) - freq).astype(np.uint32)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)
        self.slot_freq = self.freq[self.symbol]
        self.slot_bias = np.arange(len(self.symbol), dtype=np.uint32) - self.low[self.symbol]

    def encode(self, ids: np.ndarray) -> dict:
        """``payload``, ``states`` (one row of lane states per checkpoint), ``places`` (stream positions)."""
        n = len(ids)
        lanes = min(LANES, max(1, n))
        steps = -(-n // lanes)
        state = np.full(lanes, _LOW, np.uint32)
        words, states, sizes = [], [], []
        f_all, c_all = self.freq[ids], self.low[ids]
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            f, c, x = f_all[a:b], c_all[a:b], state[: b - a]
            full = (x >> np.uint32(16)) >= f
            out = x[full]
            words.append((out & np.uint32(0xFFFF)).astype("<u2"))
            x = np.where(full, x >> np.uint32(16), x)
            q = x // f
            state[: b - a] = (q << np.uint32(16)) + (x - q * f) + c
            sizes.append(len(out))
            if step % EVERY == 0:
                states.append(state.copy())
        sizes = np.array(sizes[::-1], np.int64)
        places = (np.cumsum(sizes) - sizes)[::EVERY]
        payload = np.concatenate(words[::-1]).tobytes() if words else b""
        packed = np.array(states[::-1], "<u4").tobytes()
        return {"n_ids": n, "payload": payload, "states": packed, "places": places.tolist(), "ids_crc": zlib.crc32(ids.astype("<u4").tobytes()), "payload_crc": zlib.crc32(packed, zlib.crc32(payload))}

    def decode(self, block: dict, checkpoint: int = 0) -> np.ndarray:
        """The ids from ``checkpoint`` to the end; raises ValueError on a damaged block."""
        n = block["n_ids"]
        if zlib.crc32(block["states"], zlib.crc32(block["payload"])) != block["payload_crc"]:
            raise ValueError("damaged payload")
        if n == 0:
            return np.zeros(0, np.uint32)
        lanes = min(LANES, n)
        words = np.frombuffer(block["payload"], "<u2").astype(np.uint32)
        state = np.frombuffer(block["states"], "<u4").reshape(-1, lanes)[checkpoint].astype(np.uint32)
        at, first = block["places"][checkpoint], checkpoint * EVERY * lanes
        out = np.empty(n - first, np.uint32)
        for a in range(first, n, lanes):
            b = min(n, a + lanes)
            x = state[: b - a]
            slot = x & np.uint32(SCALE - 1)
            out[a - first : b - first] = self.symbol[slot]
            x = self.slot_freq[slot] * (x >> np.uint32(BITS)) + self.slot_bias[slot]
            dry = np.flatnonzero(x < _LOW)
            x[dry] = (x[dry] << np.uint32(16)) | words[at : at + len(dry)]
            at += len(dry)
            state[: b - a] = x
        if checkpoint == 0 and zlib.crc32(out.astype("<u4").tobytes()) != block["ids_crc"]:
            raise ValueError("damaged ids")
        return out
