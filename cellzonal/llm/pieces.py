"""SentencePiece encoding and decoding for vocabularies that merge pairs of symbols.

A text's symbols are its characters, blanks written as U+2581 with one more in front. An agenda
holds the adjacent pairs that are pieces; the pair of the best score, the leftmost of equal
ones, is merged, and the pairs around it join the agenda. What is no piece in the end
is spelled in bytes. Texts fall apart where no piece has a blank behind another character,
so each part is merged by itself, and parts that come again are remembered. The agendas of
short parts of about one length are one table of a row for each, in which every turn merges the best
pair of each part; a long part has a heap of its own.

The library encodes and decodes every Arrow batch too, and each row says whether both agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellzonal.llm.text import blocks, small_batches, with_columns

BLANK = "▁"
#: What the library writes for the unknown piece.
UNKNOWN = " ⁇ "
#: Parts of up to so many characters are merged together and remembered.
SHORT = 48
#: So many parts are remembered by a worker before it starts anew.
REMEMBERED = 1 << 20
#: The rank of a pair that is no piece.
NONE = np.iinfo(np.int32).max
#: In place of a symbol that has been merged into the one before it.
GONE = -(1 << 30)
#: Parts of up to so many characters stand in one table, as rows.
WIDTHS = (8, 16, SHORT)


class Pieces:
    """A vocabulary of pieces with scores, that of a sentencepiece model of merges."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        texts = [self.library.id_to_piece(i) for i in range(size)]
        kept = [
            i
            for i in range(size)
            if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))
        ]
        if any(self.library.is_unused(i) for i in kept):
            raise ValueError("the model has unused pieces, which are not for encoding")
        if self.library.normalize(" a  Äﬁ ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}Äﬁ{BLANK}":
            raise ValueError("the model changes texts before it encodes them")
        self.ids = {texts[i]: i for i in kept}
        self.ranks = {texts[i]: -self.library.get_score(i) for i in kept}
        self.bytes = {int(texts[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        inner = any(re.search(f"[^{BLANK}]{BLANK}", t) for t in self.ids)
        # Without such pieces no merge reaches over the beginning of a run of blanks.
        self._part = re.compile("(?s).+" if inner else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._held: dict[str, bytes] = {}
        # Pairs of pieces that make a piece, and its rank, which tells it from all others.
        made = {}
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if a is not None and b is not None:
                    made[a << 32 | b] = (self.ranks[text], i)
        by_rank = {r: n for n, r in enumerate(sorted(set(made.values())))}
        self._table(np.array(list(made), np.int64), np.array([by_rank[r] for r in made.values()], np.int64))
        self._rank_ids = np.array([i for _, i in by_rank], np.int64)
        # For decoding: the text of each piece, or its byte.
        byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.values = [
            byte.get(i)
            or (UNKNOWN if self.library.is_unknown(i) else "" if self.library.is_control(i) else t.replace(BLANK, " "))
            for i, t in enumerate(texts)
        ]

        # The same as bytes, and what each gives in front.
        self._raw = [v if isinstance(v, bytes) else v.encode() for v in self.values]
        self._front = [
            r[1:] if r[:1] == b" " and isinstance(v, str) and v != UNKNOWN else r
            for v, r in zip(self.values, self._raw, strict=True)
        ]
        self._inner = inner

    def _table(self, pairs: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table of pairs and their ranks, most slots free, for arrays of questions."""
        self._bits = (4 * len(pairs) + 1).bit_length()
        self._pairs = np.full(1 << self._bits, -1)
        self._pair_ranks = np.full(1 << self._bits, NONE, np.int32)
        slot, todo = self._slots(pairs), np.arange(len(pairs))
        while len(todo):
            free = todo[self._pairs[slot[todo]] == -1]
            _, one = np.unique(slot[free], return_index=True)
            self._pairs[slot[free[one]]] = pairs[free[one]]
            self._pair_ranks[slot[free[one]]] = ranks[free[one]]
            todo = todo[self._pairs[slot[todo]] != pairs[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self._bits) - 1)

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        spread = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self._bits)).astype(np.int64)

    def merge(self, part: str) -> bytes:
        """The ids of one part, four bytes each, by the agenda of its adjacent pairs."""
        ranks = self.ranks
        symbols: list[str] = list(part)
        n = len(symbols)
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            rank = ranks.get(pair)
            if rank is not None:
                agenda.append((rank, i, i + 1, len(pair)))
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of them has been merged since
            whole = symbols[left] = a + b
            symbols[right] = ""
            follows = after[left] = after[right]
            if follows < n:
                before[follows] = left
                pair = whole + symbols[follows]
                rank = ranks.get(pair)
                if rank is not None:
                    heappush(agenda, (rank, left, follows, len(pair)))
            precedes = before[left]
            if precedes >= 0:
                pair = symbols[precedes] + whole
                rank = ranks.get(pair)
                if rank is not None:
                    heappush(agenda, (rank, precedes, left, len(pair)))
        ids: list[int] = []
        for s in symbols:
            if s:
                own = self.ids.get(s)
                if own is None:
                    ids.extend(self.bytes[b] for b in s.encode())
                else:
                    ids.append(own)
        return np.array(ids, np.int32).tobytes()

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; a symbol below 0 is a character that is no piece."""
        pairs = left << 32 | right  # below 0 if one of them is
        slot = self._slots(pairs)
        there = self._pairs[slot]
        ranks = np.where(there == pairs, self._pair_ranks[slot], NONE)
        todo = np.flatnonzero((there != pairs) & (there != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self._bits) - 1)
            there = self._pairs[slot[todo]]
            hit = there == pairs[todo]
            ranks[todo[hit]] = self._pair_ranks[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return ranks

    def merge_many(self, parts: Sequence[str]) -> list[bytes]:
        """The ids of many parts; every turn merges the best pair of each that has one."""
        letters = "".join(parts)
        codes = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
        letter, which = np.unique(codes, return_inverse=True)
        # A character that is no piece merges with none: an ASCII one is its byte already.
        known = [
            self.ids.get(chr(c), self.bytes[c] if c < 128 else -c - 1) for c in letter.tolist()
        ]
        symbol = np.array(known, np.int64)[which]
        rank = np.full(len(symbol), NONE, np.int32)
        if len(known) <= 1024:  # a table of all pairs of letters is small
            every = np.array(known, np.int64)
            every = self._ranks_of(np.repeat(every, len(every)), np.tile(every, len(every)))
            rank[:-1] = every[which[:-1] * len(known) + which[1:]]
        else:
            rank[:-1] = self._ranks_of(symbol[:-1], symbol[1:])
        length = np.array([len(p) for p in parts], np.int64)
        end = np.cumsum(length)
        rank[end - 1] = NONE
        found: list[bytes] = [b""] * len(parts)
        least = 0
        for most in (*WIDTHS, int(length.max(initial=0))):
            rows = np.flatnonzero((length > least) & (length <= most))
            least = max(least, most)
            if not len(rows):
                continue
            symbols = self._merged_rows(symbol, rank, (end - length)[rows], length[rows])
            kept = symbols != GONE
            ends = (4 * np.cumsum(kept.sum(1))).tolist()
            flat = symbols[kept]
            ids = flat.astype(np.int32).tobytes()
            spelled = set(np.flatnonzero(((symbols < 0) & kept).any(1)).tolist())
            for n, (i, a, b) in enumerate(zip(rows.tolist(), [0, *ends], ends, strict=False)):
                found[i] = ids[a:b]
                if n in spelled:
                    found[i] = self._spelled(np.frombuffer(found[i], np.int32).tolist())
        return found

    def _merged_rows(self, symbol: np.ndarray, rank: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Parts as rows of symbols, all merged, between columns of GONE on both sides."""
        width = int(length.max()) + 2
        column = np.arange(width)
        inside = (column > 0) & (column <= length[:, None])
        at = np.where(inside, start[:, None] + column - 1, 0)
        symbols = np.where(inside, symbol[at], GONE)
        ranks = np.where(inside, rank[at], np.int32(NONE))
        after = np.tile(column + 1, len(start))
        before = np.tile(column - 1, len(start))
        # The same tables as one row, for places.
        one, of = symbols.reshape(-1), ranks.reshape(-1)
        live = np.arange(len(start))
        while True:
            best = ranks[live].argmin(1) if len(live) < len(start) else ranks.argmin(1)
            left = live * width + best
            goes_on = of[left] < NONE
            live, left = live[goes_on], left[goes_on]
            if not len(live):
                return symbols
            row = live * width
            one[left] = self._rank_ids[of[left]]
            right = row + after[left]
            follows = after[right]
            one[right], of[right] = GONE, NONE
            after[left] = follows
            before[row + follows] = left - row
            precedes = row + before[left]
            follows = row + follows
            # GONE, before the first and behind the last, makes no pair.
            both = self._ranks_of(
                np.concatenate([one[left], one[precedes]]), np.concatenate([one[follows], one[left]])
            )
            of[left], of[precedes] = both[: len(left)], both[len(left) :]

    def _spelled(self, ids: Sequence[int]) -> bytes:
        out: list[int] = []
        for i in ids:
            out.extend((i,) if i >= 0 else (self.bytes[b] for b in chr(-i - 1).encode()))
        return np.array(out, np.int32).tobytes()

    def _parts(self, text: str) -> list[str]:
        """A text's parts; a single blank in front of one is left out."""
        if not text:
            return []
        plain = not (self._inner or BLANK in text or "  " in text or text[0] == " " or text[-1] == " ")
        return text.split(" ") if plain else self._part.findall(BLANK + text.replace(" ", BLANK))

    @property
    def known(self) -> dict[str, bytes]:
        """The ids of all parts that are remembered, each written with its blanks."""
        return {p if p[:1] == BLANK else BLANK + p: ids for p, ids in self._held.items()}

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text; an empty one has none."""
        split = [self._parts(t) for t in texts]
        if len(self._held) > REMEMBERED:
            self._held.clear()
        new = set().union(*split).difference(self._held)
        long = [p for p in new if len(p) > SHORT]
        short = list(new.difference(long))
        whole = [p if p[:1] == BLANK else BLANK + p for p in short]
        self._held.update(zip(short, self.merge_many(whole), strict=True))
        self._held.update((p, self.merge(p if p[:1] == BLANK else BLANK + p)) for p in long)
        known = self._held.__getitem__
        ids = [np.frombuffer(b"".join(map(known, parts)), np.int32) for parts in split]
        for p in long:
            del self._held[p]
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: bytes in a row are read as UTF-8, the blank in front is left out."""
        raw = list(map(self._raw.__getitem__, ids))
        if not raw or b"" in raw:  # a control id parts rows of bytes
            return self._decode_by_rows(ids)
        raw[0] = self._front[ids[0]]
        try:  # all bytes at once: they are UTF-8 if and only if each row of bytes is
            return b"".join(raw).decode()
        except UnicodeDecodeError:
            return self._decode_by_rows(ids)

    def _decode_by_rows(self, ids: Sequence[int]) -> str:
        values = self.values
        out: list[str] = []
        raw: list[bytes] = []
        first = True
        for i in ids:
            value = values[i]
            if isinstance(value, bytes):
                raw.append(value)
                first = False
                continue
            if raw:
                out.append(_utf8(b"".join(raw)))
                raw.clear()
            if first and value:
                value = value[1:] if value[0] == " " and value != UNKNOWN else value
                first = False
            out.append(value)
        if raw:
            out.append(_utf8(b"".join(raw)))
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Bytes as text, with a replacement character for each byte that fits nowhere."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    """A model file of the driver, which tasks get as bytes; it is as large as its vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _rows(lists: pa.ListArray) -> list[list[int]]:
    """The lists as Python has them, a null one empty; nulls within are an error."""
    flat, ends = lists.values.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
    there = lists.is_valid().to_pylist()
    return [
        flat[a:b] if own else [] for a, b, own in zip(ends, ends[1:], there, strict=False)
    ]


def encode_texts(docs: DataFrame, model: bytes, keep_text: bool = False) -> DataFrame:
    """docs' columns, text if asked for, with ids and ids_agree.

    docs: any columns, among them text. ids has the piece ids, without begin or end, and
    nothing for a null or empty text; ids_agree says whether the library gives the same. Rows
    stay as they are, repeated ones too; columns of docs of these names are replaced.
    Texts are taken whole and one at a time within a batch.
    """
    small_batches(docs.sparkSession)
    made = ("ids", "ids_agree")
    rest = [c for c in docs.columns if c not in made and (c != "text" or keep_text)]
    read = [*rest, *(() if keep_text else ("text",))]

    def encode(batches: Iterator[pa.RecordBatch]):
        own = _pieces(model)
        for part, _, _ in blocks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = own.encode(texts)
            checked = own.library.encode(texts, num_threads=1, return_type="numpy")
            agree = pa.array([np.array_equal(a, b) for a, b in zip(ids, checked, strict=True)])
            yield pa.record_batch([*[part.column(c) for c in rest], _lists(ids), agree], [*rest, *made])

    schema = with_columns(docs.select(*rest).schema, "ids array<int>, ids_agree boolean")
    return docs.select(*read).mapInArrow(encode, schema)


def decode_ids(rows: DataFrame, model: bytes) -> DataFrame:
    """rows' columns with decoded and decoded_agree.

    rows: any columns, among them ids; null ids count as none, and decode to an empty text.
    An id that the vocabulary lacks is an error. decoded_agree says whether the library
    gives the same text. Columns of rows of these names are replaced.
    """
    small_batches(rows.sparkSession)
    made = ("decoded", "decoded_agree")
    rest = [c for c in rows.columns if c not in made]

    def decode(batches: Iterator[pa.RecordBatch]):
        own = _pieces(model)
        for batch in batches:
            ids = _rows(batch.column("ids"))
            texts = [own.decode(i) for i in ids]
            checked = [own.library.decode(i) for i in ids]
            agree = pa.array([a == b for a, b in zip(texts, checked, strict=True)])
            columns = [batch.column(c) for c in rest]
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), agree], [*rest, *made])

    schema = with_columns(rows.select(*rest).schema, "decoded string, decoded_agree boolean")
    return rows.select(*rest).mapInArrow(decode, schema)
