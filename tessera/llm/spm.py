"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs wait on an agenda ordered by piece score, then position; the best
pair is merged until none is left, and characters outside the vocabulary fall back to
bytes.  No piece of such a vocabulary holds a space mark after another character, so a
text is encoded space by space and each distinct word of a slice needs its agenda once.
The agendas of a slice's words advance in lockstep: every round takes the best pair of
each word, as arrays, until no word has one left.  Texts with runs of spaces and very long
words go through a heap instead, with the same results.  The sentencepiece library
encodes and decodes every row too, and a difference stops the job.

Nulls and edge cases: null and empty texts have no ids and decode to an empty text; runs
of spaces, line feeds, characters outside the vocabulary and very long words are encoded
exactly; repeated rows are encoded alike; empty tables give empty results; extra columns
don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bytesops import chunks
from tessera.llm.common import map_arrow

MARK = "▁"
_NEVER = np.iinfo(np.int32).max
#: Longest word that goes through the lockstep agenda.
LOCKSTEP_CHARS = 64
#: Bytes of text encoded at a time; a longer text makes its own slice.
SLICE_BYTES = 1 << 20
#: Words whose ids a worker remembers (about 40 bytes each); it starts afresh beyond.
MEMO_WORDS = 1_500_000
#: Share of the rows that the library encodes again.
CHECK_SHARE = 1.0
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """Field numbers and values of a protocol-buffer message."""
    i, n = 0, len(data)

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value, i = data[i:i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = data[i:i + size], i + size
        yield key >> 3, value


class MergeModel:
    """A merge-type vocabulary read from a sentencepiece model file's bytes."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normal = {}, {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not of the merge type")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models without character maps and space removal are read")
        self.prefix = bool(normal.get(3, 1))
        kinds = [k for _, _, k in self.pieces]
        if USER_DEFINED in kinds or UNUSED in kinds or any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k == NORMAL):
            raise ValueError("pieces that cross spaces, and user-defined or unused pieces, are not read")
        self.unknown = kinds.index(UNKNOWN)
        self.id = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        order = sorted({s for _, s, k in self.pieces if k == NORMAL}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        self.rank = {p: rank[s] for p, s, k in self.pieces if k == NORMAL}
        if any("\n" in p for p in self.id):
            raise ValueError("pieces with line feeds are not read")
        self._tables()

    def _tables(self) -> None:
        """Symbol numbers of characters, and a hash table of pairs that make a piece.

        Symbols are piece ids; characters that only occur inside pieces, and all others,
        get numbers from ``other`` on.
        """
        self.other = len(self.pieces)
        chars = sorted({c for p in self.id for c in p} - self.id.keys())
        symbol = dict(self.id) | {c: self.other + i for i, c in enumerate(chars)}
        self.first_unseen = self.other + len(chars)
        self.char_symbol = np.arange(self.first_unseen, self.first_unseen + 0x110000, dtype=np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = i
        self.symbol_char = chars
        keys, made = [], []
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        bits = max(16, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_made = np.full(1 << bits, -1, np.int32)
        mask = (1 << bits) - 1
        where = self._slot(np.array(keys, np.int64)) if keys else []
        self.probes = 1
        for key, m, at in zip(keys, made, where):
            probe, at = 1, int(at)
            while self.slot_key[at] >= 0:
                at = at + 1 & mask
                probe += 1
            self.slot_key[at], self.slot_made[at] = key, m
            self.probes = max(self.probes, probe)
        self.piece_rank = np.full(self.other + 1, _NEVER, np.int32)
        for p, i in self.id.items():
            self.piece_rank[i] = self.rank[p]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece made of each two symbols; -1 if none."""
        key = a.astype(np.int64) << 32 | b
        at, mask = self._slot(key), len(self.slot_key) - 1
        found = self.slot_key[at]
        made = np.where(found == key, self.slot_made[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & mask
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            made[open_[hit]] = self.slot_made[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return made

    def lockstep(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of many escaped texts, and each text's first one, with the end.

        ``chars`` has the texts' code points one after another, ``size`` their numbers.
        Each round merges the best pair, the leftmost of equals, of every text that has one.
        """
        texts = len(size)
        sym = self.char_symbol[chars]
        word = np.repeat(np.arange(texts), size)
        done_sym, done_word = [], []
        # made[i]: the piece of symbols i and i + 1 of one text
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            made[inside] = self._pairs(sym[inside], sym[inside + 1])
        while len(sym):
            rank = self.piece_rank[made]
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(rank, begin)
            going = best < _NEVER
            if not going.all():
                stay = np.repeat(~going, count)
                done_sym.append(sym[stay])
                done_word.append(word[stay])
                sym, word, made, rank = sym[~stay], word[~stay], made[~stay], rank[~stay]
                best, count = best[going], count[going]
                if not len(sym):
                    break
                begin = np.cumsum(count) - count
            hit = np.flatnonzero(rank == np.repeat(best, count))
            owner = word[hit]
            hit = hit[np.concatenate(([True], owner[1:] != owner[:-1]))]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols stand afterwards
            sym, word, made = sym[keep], word[keep], made[keep]
            made[at] = -1
            right = at[at + 1 < len(sym)]
            right = right[word[right] == word[right + 1]]
            made[right] = self._pairs(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[word[left] == word[left + 1]]
            made[left] = self._pairs(sym[left], sym[left + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=texts))))

    def symbol_ids(self, symbol: int) -> list[int]:
        """Ids of a final symbol: its piece, or the bytes of its character."""
        if symbol < self.other:
            return [symbol]
        if not self.byte_id:
            return [self.unknown]
        c = self.symbol_char[symbol - self.other] if symbol < self.first_unseen else chr(symbol - self.first_unseen)
        return [self.byte_id[b] for b in c.encode()]

    def merged(self, text: str) -> list[str]:
        """Pieces of an escaped text, by an agenda of its adjacent pairs."""
        symbols = list(text)
        n = len(symbols)
        if n < 2:
            return symbols
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            r = rank.get(pair)
            if r is not None:
                agenda.append((r, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            if not left:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                r = rank.get(wider)
                if r is not None:
                    heapq.heappush(agenda, (r, i, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                r = rank.get(wider)
                if r is not None:
                    heapq.heappush(agenda, (r, h, wider))
        return [s for s in symbols if s]

    def ids_of(self, text: str) -> list[int]:
        """Ids of an escaped text."""
        out = []
        for s in self.merged(text):
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def bytes_of(self, ids) -> bytes:
        """UTF-8 bytes that ids stand for, space marks as spaces, prefix still there."""
        out, held = [], bytearray()
        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                continue
            if held:
                out.append(_repaired(bytes(held)))
                held.clear()
            if kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            elif kind != CONTROL:
                out.append(piece.replace(MARK, " ").encode())
        if held:
            out.append(_repaired(bytes(held)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        escaped = text.replace(" ", MARK)
        return self.ids_of(MARK + escaped if self.prefix else escaped)

    def decode(self, ids) -> str:
        text = self.bytes_of(ids).decode()
        return text[1:] if self.prefix and text.startswith(" ") else text


def _repaired(data: bytes) -> bytes:
    """Valid UTF-8 with each byte outside a character replaced."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for size in (4, 3, 2, 1):
                try:
                    out.append(data[i:i + size].decode().encode())
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�".encode())
                i += 1
        return b"".join(out)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + size[i] - 1 for every i, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class _ByteTable:
    """Byte strings by number, gathered as arrays."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.first = np.cumsum(self.size) - self.size

    def gather(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings one after another, and where each begins, with the end."""
        size = self.size[numbers]
        return self.data[spans(self.first[numbers], size)].tobytes(), np.concatenate(([0], np.cumsum(size)))


class Encoder:
    """Encodes string columns with a model, slice by slice."""

    def __init__(self, model: MergeModel):
        self.model = model
        self.id_text = _ByteTable([b"%d," % i for i in range(len(model.pieces))])
        # a byte piece stands for itself here: encoding never leaves part of a character
        self.id_bytes = _ByteTable([
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, k in model.pieces])

        self.odd = np.zeros(0, np.int64)  # rows of the last slice that went through the heap
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words
        self.first = np.zeros(0, np.int64)  # of a word's ids in self.ids
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words in the memo, and whether each is missing there."""
        if not len(self.known):
            return np.zeros(len(h), np.int64), np.ones(len(h), bool)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return at, self.known[at] != h

    def _learn(self, h: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> None:
        known = np.concatenate((self.known, h))
        order = np.argsort(known, kind="stable")  # merges two sorted runs
        self.known = known[order]
        self.first = np.concatenate((self.first, bound[:-1] + len(self.ids)))[order]
        self.length = np.concatenate((self.length, np.diff(bound).astype(np.int32)))[order]
        self.ids = np.concatenate((self.ids, ids))

    def slices(self, column):
        """For slices of rows: the slice, all rows' ids, and each row's first one, with the end."""
        for ch in chunks(column, SLICE_BYTES):
            yield ch, *self._slice(ch)

    def _slice(self, ch) -> tuple[np.ndarray, np.ndarray]:
        model, buf, n = self.model, ch.buf, len(ch.buf)
        space, feed = buf == 32, buf == 10
        row_start = ch.off[:-1][np.diff(ch.off) > 0]
        begins = np.zeros(n, bool)
        begins[1:] = space[:-1]
        begins |= feed
        begins[row_start] = True
        at = np.flatnonzero(begins)
        plain = np.full(ch.rows, model.prefix)
        if n:
            # a key that would be empty, a row that begins or ends with white space, a mark
            gap = np.zeros(n, bool)
            gap[:-1] = space[:-1] & (space[1:] | feed[1:])
            mark = np.zeros(n, bool)
            mark[:-2] = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
            bad = gap | mark
            bad[row_start] |= space[row_start] | feed[row_start]
            row_end = ch.off[1:][np.diff(ch.off) > 0] - 1
            bad[row_end] |= space[row_end]
            plain &= ch.per_row(bad) == 0
        stop = np.append(at[1:], n)
        after_space = np.zeros(n + 1, bool)
        after_space[1:n + 1] = space
        after_space[row_start] = False
        stop = stop - after_space[stop] if len(at) else stop
        if len(at):
            stop = np.where(np.append(at[1:], n) == n, n, stop)
        row = np.searchsorted(ch.off, at, "right") - 1
        plain[row[stop - at > 4 * LOCKSTEP_CHARS]] = False
        keep = plain[row]
        at, stop, row = at[keep], stop[keep], row[keep]
        keyed = np.bincount(row, minlength=ch.rows)
        if len(at):
            h, first, which = np.unique(ch.span_hash(at, stop), return_index=True, return_inverse=True)
            if len(self.known) > MEMO_WORDS:
                self._forget()
            new = self._find(h)[1]
            if new.any():
                codes = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
                char_at = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                word = first[new]
                lo, hi = char_at[at[word]], char_at[stop[word]]
                own = feed[at[word]]  # a key with its own line feed has no mark before it
                size = hi - lo + ~own
                chars = np.full(int(size.sum()), ord(MARK), np.uint32)
                begin = np.cumsum(size) - size
                chars[spans(begin + ~own, hi - lo)] = codes[spans(lo, hi - lo)]
                self._learn(h[new], *self._ids_of_symbols(*model.lockstep(chars, size)))
            found = self._find(h)[0][which]
            length = self.length[found].astype(np.int64)
            flat = self.ids[spans(self.first[found], length)]
            per_row = np.bincount(row, weights=length, minlength=ch.rows).astype(np.int64)
        else:
            flat, per_row = np.zeros(0, np.int32), np.zeros(ch.rows, np.int64)
        odd = self.odd = np.flatnonzero((keyed == 0) & (np.diff(ch.off) > 0))
        ends = np.cumsum(per_row)
        if len(odd):
            text = buf.tobytes()
            parts, done = [], 0
            for r in odd:
                parts.append(flat[done:ends[r]])
                done = ends[r]
                parts.append(np.array(model.encode(text[ch.off[r]:ch.off[r + 1]].decode()), np.int32))
                per_row[r] = len(parts[-1])
            parts.append(flat[done:])
            flat = np.concatenate(parts)
        return flat, np.concatenate(([0], np.cumsum(per_row)))

    def _ids_of_symbols(self, symbols: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in place of symbols; characters outside the vocabulary become bytes."""
        if not (symbols >= self.model.other).any():
            return symbols, bound
        known, which = np.unique(symbols, return_inverse=True)
        lists = [self.model.symbol_ids(s) for s in known.tolist()]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        table = np.array([i for x in lists for i in x], np.int32)
        ids = table[spans((np.cumsum(size) - size)[which], size[which])]
        return ids, np.concatenate(([0], np.cumsum(size[which])))[bound]


_models: dict = {}


def load(path: str) -> Encoder:
    """This process's encoder for the model at ``path``."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Encoder(MergeModel(f.read()))
    return _models[path]


def _checked_rows(ch, odd: np.ndarray, share: float) -> np.ndarray:
    """Rows of a slice that the library encodes too; see the module's text."""
    chosen = (ch.span_hash(ch.off[:-1], ch.off[1:]) >> np.uint64(40)) < share * (1 << 24)
    chosen[odd] = True
    return np.flatnonzero(chosen)


def _check_against_library(path: str, texts: list[str], ids: list[list[int]], decoded: list[str]) -> None:
    """Hold rows against the library's ids and texts."""
    import sentencepiece

    key = "library:" + path
    if key not in _models:
        _models[key] = sentencepiece.SentencePieceProcessor(model_file=path)
    library = _models[key]
    want = library.encode(texts, num_threads=1)
    for text, mine, theirs, back, again in zip(texts, ids, want, decoded, library.decode(want, num_threads=1)):
        if mine != theirs or back != again:
            raise ValueError(f"encoding differs from the sentencepiece library: {text[:200]!r}")


def _encoded(column, path: str, share: float):
    """For slices of a text column: ids, each row's first one, decoded bytes, each row's span of them."""
    encoder = load(path)
    prefix = encoder.model.prefix
    for ch, ids, first in encoder.slices(column):
        decoded, at = encoder.id_bytes.gather(ids)
        lo, hi = at[first[:-1]], at[first[1:]]
        if prefix:
            lead = np.frombuffer(decoded, np.uint8)
            some = np.flatnonzero(hi > lo)
            lo = lo.copy()
            lo[some] += lead[lo[some]] == 32
        rows = _checked_rows(ch, encoder.odd, share)
        if len(rows):
            text, off = ch.buf.tobytes(), ch.off
            _check_against_library(
                path, [text[off[r]:off[r + 1]].decode() for r in rows], [ids[first[r]:first[r + 1]].tolist() for r in rows],
                [decoded[lo[r]:hi[r]].decode("utf-8", "replace") for r in rows])
        yield ids, first, decoded, lo.tolist(), hi.tolist()


def piece_digests(docs: DataFrame, model_path: str, *, check_share: float = CHECK_SHARE) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the comma-joined ids and of the decoded text.

    ``check_share`` of the rows, and every row off the common path, are held against the
    library (1: all rows); the ids themselves never come from it.
    """
    def run(batches):
        encoder = load(model_path)
        for b in batches:
            n, a, d = [], [], []
            for ids, first, decoded, lo, hi in _encoded(b.column(1), model_path, check_share):
                text, at = encoder.id_text.gather(ids)
                n.append(np.diff(first))
                a += [hashlib.sha256(text[x:max(x, y - 1)]).hexdigest() for x, y in zip(at[first[:-1]].tolist(), at[first[1:]].tolist())]
                d += [hashlib.sha256(decoded[x:y]).hexdigest() for x, y in zip(lo, hi)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_pieces(docs: DataFrame, model_path: str, *, check_share: float = CHECK_SHARE) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every document."""
    def run(batches):
        for b in batches:
            rows, texts = [], []
            for ids, first, decoded, lo, hi in _encoded(b.column(1), model_path, check_share):
                rows += [ids[x:y] for x, y in zip(first[:-1], first[1:])]
                texts += [decoded[x:y].decode("utf-8", "replace") for x, y in zip(lo, hi)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>, decoded string")
