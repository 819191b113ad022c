"""Merge-type SentencePiece vocabularies: agenda encoder, decoder, safe cuts, whole tokens.

Encoding keeps an agenda of adjacent symbol pairs whose union is a piece, ordered by score and then
by place, merges the best, and adds the pairs that the merge makes. A text is cut beforehand where
the vocabulary proves that no merge can cross: no piece holds a space mark after another character,
none holds a line feed, and certain signs never follow a letter or digit in a piece. These facts are
read from the vocabulary when the model is loaded; a model without the first two is encoded whole. Pieces of text between cuts recur, so their ids are remembered, up to a bound.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import ChainMap
from functools import lru_cache
from heapq import heapify, heappop, heappush

MARK = "▁"
CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
FLAT = 40
NEVER = 1 << 40
PROBES = ["ﬁ 　x", "  a  b ", "é é", "\t​Aßİ", "Ａ① ½"]


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [lib.id_to_piece(i) for i in range(len(lib))]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(len(lib))]
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.plain = set(self.ids.values())
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        self.control = {i for i in range(len(lib)) if lib.is_control(i)}
        for probe in PROBES:
            if lib.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError("only models with identity normalisation and a leading space mark are supported")
        # Ranks order the pieces as their scores do; equal scores share a rank.
        order = {v: k for k, v in enumerate(sorted({-lib.get_score(i) for i in self.plain}))}
        self.ranks = {p: order[-lib.get_score(i)] for p, i in self.ids.items()}
        self.raw_of = [None if i in self.byte_of else b"" if i in self.control else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        self.cuts = not any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids)
        self.parts = self._cutter() if self.cuts else (lambda s: [s])

    def _cutter(self):
        """Cuts before marks, around line feeds, and between a letter or digit and an ASCII sign.

        The last kind leaves out the characters that stand before a sign in some piece.
        """
        signs = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        joined = {a for p in self.ids for a, b in zip(p, p[1:], strict=False) if b in signs and a not in signs and a != MARK}
        not_letter = re.escape("".join(sorted(joined)))
        sign = re.escape("".join(sorted(signs)))
        letter, other = f"[^\\W_{not_letter}]", f"[\\W_{not_letter}]"
        word = f"{MARK}*{letter}+(?=[{sign}{MARK}\n]|\\Z)|[{sign}]+(?=[{MARK}\n]|\\Z)"  # most parts, found fast
        any_other, bound = f"(?![{MARK}\n]){other}", f"(?![{MARK}\n{sign}]){other}"
        find = re.compile(f"{word}|\n+|{MARK}*(?:{any_other})*(?:{letter}+{bound}(?:{any_other})*)*{letter}*").findall
        return lambda s: find(s)[:-1]  # the last is the empty end

    def split(self, text: str) -> list[str]:
        """Parts of the marked text that no merge crosses."""
        return self.parts(MARK + text.replace(" ", MARK)) if text else []

    def merge(self, part: str) -> list[int]:
        """Ids of one part, by the agenda."""
        if (i := self.ids.get(part)) is not None and len(part) < 3:
            return [i]  # a pair has one way to merge
        ranks, symbols, n = self.ranks, list(part), len(part)
        if n == 1:
            return [self.bytes[b] for b in part.encode()]
        if n <= FLAT:
            return self._ids(self._merge_flat(symbols))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of = ranks.get
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank_of(part[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            key = heappop(agenda)
            left = key & 0xFFFFFFFF
            right = after[left]
            both = symbols[left]
            if not both or right == n:
                continue
            both += symbols[right]
            if rank_of(both) != key >> 32:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = both, ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (r := rank_of(both + symbols[right])) is not None:
                    heappush(agenda, r << 32 | left)
            if (lead := before[left]) >= 0 and (r := rank_of(symbols[lead] + both)) is not None:
                heappush(agenda, r << 32 | lead)
        return self._ids([s for s in symbols if s])

    def _merge_flat(self, symbols: list[str]) -> list[str]:
        """The same agenda for short parts: one rank for each adjacent pair, in place."""
        rank_of = self.ranks.get
        agenda = [rank_of(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            both = symbols[i] + symbols.pop(i + 1)
            symbols[i] = both
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank_of(both + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank_of(symbols[i - 1] + both, NEVER)
        return symbols

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.merge(part)]

    def raw(self, ids: list[int]) -> bytes:
        """UTF-8 of ids with every mark a space; control ids give nothing."""
        try:
            return b"".join([self.raw_of[i] for i in ids])
        except TypeError:  # bytes among the ids
            pass
        out: list[bytes] = []
        loose = bytearray()
        for i in [*ids, -1]:
            b = self.byte_of.get(i)
            if b is not None:
                loose.append(b)
                continue
            if loose:
                out.append(_sound(bytes(loose)))
                loose.clear()
            if i >= 0:
                out.append(self.raw_of[i])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space mark that encoding puts first goes."""
        text = self.raw(ids).decode()
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first in self.plain and self.names[first][0] == MARK else text

    def whole(self) -> frozenset[str]:
        """Strings proved to encode alone as one token: every piece, put through the agenda."""
        return frozenset(p for p, i in self.ids.items() if self.merge(p) == [i])

    def verified(self, parts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """(packed ids, raw text, agreed) of parts, each compared with the library in one call.

        A line feed before a part keeps it apart from the mark that the library puts first. Where the
        library differs, its ids are returned.
        """
        if not self.cuts:
            return [self._whole_text(p) for p in parts]
        probes = ["\n" + p.replace(MARK, " ") for p in parts]
        theirs = self.library.encode(probes, num_threads=1)
        texts = self.library.decode(theirs, num_threads=1)
        out = []
        for part, ids, text, probe in zip(parts, theirs, texts, probes, strict=True):
            own = self.merge(part)
            raw = self.raw(own)
            agreed = ids[2:] == own and text == probe and raw == probe[1:].encode()
            if not agreed:
                own, raw = ids[2:], self.raw(ids[2:])
            out.append((pack(own), raw, agreed))
        return out

    def look_up(self, parts: set[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """verified() of parts, remembered by this process up to a bound; long parts aren't remembered."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known, new = {}, list(parts)
        found = dict(zip(new, self.verified(new), strict=True))
        self.known.update((p, v) for p, v in found.items() if len(p) <= CACHE_CHARS)
        return ChainMap(found, self.known) if any(len(p) > CACHE_CHARS for p in new) else self.known

    def _whole_text(self, part: str) -> tuple[bytes, bytes, bool]:
        text = part[1:].replace(MARK, " ")
        theirs, own = self.library.encode(text), self.merge(part)
        return pack(theirs), b" " + self.library.decode(theirs).encode(), own == theirs


def _sound(data: bytes) -> bytes:
    """Bytes that aren't UTF-8 become U+FFFD, one each."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                data[at : at + size].decode()
                out.append(data[at : at + size])
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(b"\xef\xbf\xbd")
            at += 1
    return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of this process; workers keep it between tasks."""
    return PieceModel(path)
