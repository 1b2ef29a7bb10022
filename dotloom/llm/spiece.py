"""SentencePiece encoding and decoding of a BPE model by suffix-array matching.

The words of a batch of texts are laid behind each other, equal words once, and indexed by a suffix array (prefix
doubling up to the longest piece). Every piece is found by binary search as a range of the array; the ranges'
positions are the edges of a lattice, sorted by where they end and relaxed in that order. A BPE model has no additive path score, so the
relaxation keeps, for each prefix of a word, the one piece that the model's own encoding of the prefix ends with: an
edge counts if the piece before it and its own piece stay apart when both are merged from characters. That gives the
ids of the SentencePiece library itself. Words of one text never merge with each other, since no piece has the word
mark inside. Nothing is remembered from batch to batch but which two pieces stay apart.

The model file is a parameter and is only read. Defined results: a null or empty text has no ids; characters outside
the vocabulary fall back to bytes; ids decode to the text again (U+2581 as a space, as in the library); equal texts
give equal ids; empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dotloom.llm.common import chunks, mix, with_only, word_hashes

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of the texts that are encoded together (one text may have more).
BATCH_BYTES = 600_000
_NONE = np.int64(1) << 40


@dataclass
class Model:
    """Tables of a vocabulary; their size depends on the vocabulary alone."""

    pieces: list[str]
    unk: int
    byte_ids: np.ndarray  # id of each byte's piece, or -1
    char_of: dict[str, int]  # character to dense id from 2 on; 1: any other, 0: end of a word
    single: np.ndarray  # piece of each dense character, or -1
    piece_ids: np.ndarray  # pieces that the lattice uses
    piece_keys: np.ndarray  # their characters, packed, four to a 64-bit word
    piece_len: np.ndarray  # by id
    rank: np.ndarray  # by id; -1 for single characters
    left: np.ndarray  # children of the last merge, by id
    right: np.ndarray
    pair_keys: np.ndarray  # sorted left * V + right
    pair_rank: np.ndarray
    runs: list[list[int]]  # ids of so many marks in a row; longer runs begin with the longest piece
    longest: int  # marks in that piece
    mark: int  # id of the single mark
    words: int  # packed words to a key
    order: dict[str, int]  # rank of each piece that merges make
    id_of: dict[str, int]

    @property
    def v(self) -> int:
        return len(self.pieces)


def merge(symbols: list[str], rank: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain BPE: the best pair merges, leftmost first, until none is in the vocabulary. Also the last merge."""
    last = None
    while len(symbols) > 1:
        best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            break
        k = best[1]
        last = (symbols[k], symbols[k + 1])
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
    return symbols, last


def _packed(chars: np.ndarray, words: int) -> np.ndarray:
    """Rows of 4 * words character ids as rows of 64-bit words, first character highest."""
    c = chars.reshape(len(chars), words, 4).astype(np.uint64)
    return (c[:, :, 0] << np.uint64(48)) | (c[:, :, 1] << np.uint64(32)) | (c[:, :, 2] << np.uint64(16)) | c[:, :, 3]


def load_model(path: str = DEFAULT_MODEL) -> Model:
    """Reads a BPE model's pieces. Raises ValueError for a model of another kind."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    v = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(v)]
    byte_ids = np.full(256, -1, np.int64)
    for i in range(v):
        if sp.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
    normal = [i for i in range(v) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if any(MARK in pieces[i].lstrip(MARK) for i in normal) or (byte_ids < 0).any():
        raise ValueError("a BPE model with byte pieces, and the word mark only ahead, is needed")
    score = {pieces[i]: -sp.get_score(i) for i in normal}
    run_score = {pieces[i]: score[pieces[i]] for i in normal if not pieces[i].strip(MARK) and pieces[i] != MARK}
    run_id = {pieces[i]: i for i in normal if not pieces[i].strip(MARK)}
    longest = max(map(len, run_id))
    runs = [[run_id[p] for p in merge([MARK] * r, run_score)[0]] for r in range(3 * longest + 1)]
    if MARK not in run_id or any(runs[r] != runs[longest] + runs[r - longest] for r in range(2 * longest, len(runs))):
        raise ValueError("long runs of the word mark need to begin with the longest piece")
    plain = [i for i in normal if pieces[i].strip(MARK) or pieces[i] == MARK]
    plain_rank = {pieces[i]: score[pieces[i]] for i in plain if len(pieces[i]) > 1}
    id_of = {pieces[i]: i for i in plain}
    rank = np.full(v, -1, np.int64)
    order = {p: k for k, p in enumerate(sorted(plain_rank, key=lambda p: (plain_rank[p], id_of[p])))}
    left, right, length = np.full(v, -1, np.int64), np.full(v, -1, np.int64), np.ones(v, np.int64)
    use, pairs = [], []
    for i in plain:
        p = pieces[i]
        length[i] = len(p)
        if len(p) == 1:
            use.append(i)
            continue
        rank[i] = order[p]
        done, last = merge(list(p), order)
        if len(done) == 1 and last is not None:
            left[i], right[i] = id_of[last[0]], id_of[last[1]]
            use.append(i)
        pairs += [(id_of[p[:k]] * v + id_of[p[k:]], order[p]) for k in range(1, len(p)) if p[:k] in id_of and p[k:] in id_of]
    pairs.sort()
    chars = sorted({c for i in use for c in pieces[i]})
    char_of = {c: k for k, c in enumerate(chars, 2)}
    single = np.full(len(chars) + 2, -1, np.int64)
    for c, k in char_of.items():
        single[k] = id_of.get(c, -1)
    words = -(-max(len(pieces[i]) for i in use) // 4)
    keys = np.zeros((len(use), 4 * words), np.int64)
    for k, i in enumerate(use):
        keys[k, : len(pieces[i])] = [char_of[c] for c in pieces[i]]
    return Model(pieces, sp.unk_id(), byte_ids, char_of, single, np.array(use, np.int64), _packed(keys, words), length, rank, left, right, np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64), runs, longest, run_id[MARK], words, order, id_of)


class Encoder:
    """Encodes batches of texts; keeps which pieces stay apart."""

    TABLE = 1 << 21

    def __init__(self, model: Model):
        m = self.m = model
        self.lookup = np.ones(0x110000 + 1, np.uint16)
        for c, k in m.char_of.items():
            self.lookup[ord(c)] = k
        self.other = m.v  # a character without piece
        self.apart_key = np.full(self.TABLE, -1, np.int64)
        self.apart_value = np.zeros(self.TABLE, bool)
        self.low = m.piece_keys
        mask = np.zeros_like(m.piece_keys)
        full = np.uint64(0xFFFF)
        for k, i in enumerate(m.piece_ids):
            n = int(m.piece_len[i])
            for c in range(n, 4 * m.words):
                mask[k, c // 4] |= full << np.uint64(48 - 16 * (c % 4))
        self.high = m.piece_keys | mask

    # -- which pieces stay apart
    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do pieces a and b, next to each other, come out of merging their characters as just these two?"""
        m = self.m
        out = np.ones(len(a), bool)
        l, r = a.copy(), b.copy()
        until_l, until_r = np.full(len(a), _NONE), np.full(len(a), _NONE)
        at = np.flatnonzero((a < m.v) & (b < m.v))
        while len(at):
            key = l[at] * m.v + r[at]
            k = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
            p = np.where(m.pair_keys[k] == key, m.pair_rank[k], _NONE)
            crossed = (p < until_l[at]) & (p <= until_r[at]) & (p < _NONE)
            out[at[crossed]] = False
            at = at[~crossed]
            rl, rr = m.rank[l[at]], m.rank[r[at]]
            go_on = (rl >= 0) | (rr >= 0)
            at, rl, rr = at[go_on], rl[go_on], rr[go_on]
            # The younger of the two goes back to what it was made of; of equals, the right one was made later.
            down_l = rl > rr
            x = at[down_l]
            until_l[x] = rl[down_l]
            l[x] = m.right[l[x]]
            x = at[~down_l]
            until_r[x] = rr[~down_l]
            r[x] = m.left[r[x]]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stay_apart`` through a table of earlier answers."""
        key = a * np.int64(self.m.v + 1) + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(self.TABLE - 1)).astype(np.int64)
        out = self.apart_value[slot]
        new = np.flatnonzero(self.apart_key[slot] != key)
        if len(new):
            found, back = np.unique(key[new], return_inverse=True)
            one = self._stay_apart(found // (self.m.v + 1), found % (self.m.v + 1))
            out[new] = one[back]
            s = (mix(found.astype(np.uint64)) & np.uint64(self.TABLE - 1)).astype(np.int64)
            self.apart_key[s] = found
            # Of several keys for one slot the last one stays; its answer must be the one beside it.
            stays = self.apart_key[s] == found
            self.apart_value[s[stays]] = one[stays]
        return out

    # -- suffix array
    def _suffixes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Suffix array by the longest piece's characters, its sorted keys, and each doubling's distinct keys before."""
        n, m = len(text), self.m
        t = np.zeros(n + 4, np.uint64)
        t[:n] = text
        key, known, tables = (t[:n] << np.uint64(48)) | (t[1 : n + 1] << np.uint64(32)) | (t[2 : n + 2] << np.uint64(16)) | t[3 : n + 3], 4, []
        while True:
            sa = np.argsort(key)
            s = key[sa]
            if known >= 4 * m.words:
                return sa, s, tables
            first = np.concatenate([[True], s[1:] != s[:-1]])
            tables.append(s[first])
            rank = np.empty(n, np.uint64)
            rank[sa] = np.cumsum(first).astype(np.uint64)
            later = np.zeros(n, np.uint64)
            later[: max(0, n - known)] = rank[known:]
            key = (rank << np.uint64(32)) | later
            known *= 2

    def _ranges(self, keys: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of every piece, the range of the suffix array that begins with it.

        The piece's blocks of four characters become ranges of ranks, blocks join in pairs as in the doubling, and the
        last range is searched in the array's keys. ``gone``: a block that no position has.
        """
        m, any_, size = self.m, np.uint64(0xFFFFFFFF), 4
        length = m.piece_len[m.piece_ids]
        lo, hi = list(self.low.T), list(self.high.T)
        for table in tables:
            if len(lo) % 2:
                lo, hi = [*lo, np.zeros_like(lo[0])], [*hi, np.full_like(hi[0], any_)]
            r_lo, r_hi = [], []
            for b, (x, y) in enumerate(zip(lo, hi, strict=True)):
                has = np.flatnonzero(length > b * size)
                u, v = np.zeros_like(x), np.full_like(x, any_)
                u[has], v[has] = np.searchsorted(table, x[has], "left") + 1, np.searchsorted(table, y[has], "right")
                r_lo.append(u)
                r_hi.append(v)
            lo, hi = [], []
            for b in range(0, len(r_lo), 2):
                on = length > (b + 1) * size
                gone = (r_lo[b] > r_hi[b]) | (on & (r_lo[b + 1] > r_hi[b + 1]))
                low = (r_lo[b] << np.uint64(32)) | np.where(on, r_lo[b + 1], np.uint64(0))
                high = (np.where(on, r_lo[b], r_hi[b]) << np.uint64(32)) | np.where(on, r_hi[b + 1], any_)
                low[gone], high[gone] = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
                lo.append(low)
                hi.append(high)
            size *= 2
        first = np.searchsorted(keys, lo[0], "left")
        return first, np.maximum(first, np.searchsorted(keys, hi[0], "right"))

    def _encode_words(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with the word mark ahead; characters without piece stay as ``other``."""
        m, n_words = self.m, len(starts)
        size = ends - starts + 2
        off = np.concatenate([[0], np.cumsum(size)])
        total = int(off[-1])
        text = np.zeros(total, np.uint16)
        within = np.arange(total) - np.repeat(off[:-1], size)
        body = (within > 0) & (within < np.repeat(size - 1, size))
        text[off[:-1]] = m.char_of[MARK]
        text[body] = self.lookup[chars[(np.repeat(starts - 1, size) + within)[body]]]
        sa, keys, tables = self._suffixes(text)
        lo, hi = self._ranges(keys, tables)
        del keys, tables
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        pos = sa[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        tok = m.piece_ids[which]
        lone = np.flatnonzero((text != 0) & (m.single[text] < 0))
        pos, tok = np.concatenate([pos, lone]), np.concatenate([tok, np.full(len(lone), self.other)])
        length = np.append(m.piece_len, 1)
        end = pos + length[tok]
        depth = within[end - 1] + 1  # characters from the word's start to the edge's end
        order = np.argsort(depth if int(size.max()) > 32000 else depth.astype(np.int16), kind="stable")
        pos, tok, end, depth = pos[order], tok[order], end[order], depth[order]
        last = np.full(total + 1, -1, np.int64)  # by end of a prefix
        first = within[pos] == 0
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(pos)]]), strict=True):
            if a == b:
                continue
            p, t = pos[a:b], tok[a:b]
            ok = first[a:b].copy()
            check = np.flatnonzero(~ok & (last[p] >= 0))
            ok[check] = self.apart(last[p[check]], t[check])
            last[end[a:b][ok]] = t[ok]
        # Back from each word's end.
        at, word = off[1:] - 1, np.arange(n_words)
        ids_back, word_back = [], []
        broken = np.zeros(n_words, bool)
        while len(at):
            t = last[at]
            broken[word[t < 0]] = True
            keep = t >= 0
            at, word, t = at[keep], word[keep], t[keep]
            ids_back.append(t)
            word_back.append(word)
            at = at - length[t]
            keep = at > off[word]
            at, word = at[keep], word[keep]
        ids, owner = np.concatenate(ids_back), np.concatenate(word_back)
        step = np.repeat(np.arange(len(ids_back)), [len(x) for x in ids_back])
        if broken.any():  # a model whose merges are not as expected: plain merging of these words
            keep = ~broken[owner]
            own = [(w, self._plain(chars[starts[w] : ends[w]])) for w in np.flatnonzero(broken).tolist()]
            ids = np.concatenate([ids[keep], *[x for _, x in own]])
            owner = np.concatenate([owner[keep], *[np.full(len(x), w) for w, x in own]])
            step = np.concatenate([step[keep], *[-np.arange(len(x)) for _, x in own]])
        order = np.lexsort((-step, owner))
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_words))])

    def _plain(self, chars: np.ndarray) -> np.ndarray:
        """Ids of one word by plain merging."""
        word = [MARK, *map(chr, chars.tolist())]
        return np.array([self.m.id_of.get(p, self.other) for p in merge(word, self.m.order)[0]], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's offsets among them."""
        m = self.m
        lens = np.array([len(t) for t in texts], np.int64)
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n_rows = len(texts)
        if not len(cps):
            return np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
        row_off = np.concatenate([[0], np.cumsum(lens)])
        blank = (cps == 32) | (cps == ord(MARK))
        edge = np.zeros(len(cps) + 1, bool)
        edge[row_off] = True
        begin = ~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1])
        finish = ~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])
        starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        row = np.searchsorted(row_off, starts, side="right") - 1
        # Word marks ahead of each word; a text has one more than spaces at its start.
        before = np.concatenate([[0], ends[:-1]])
        new_row = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        marks = np.where(new_row, starts - row_off[row] + 1, starts - before)
        first_at, back = _distinct(cps, starts, ends)
        ids, off = self._encode_words(cps, starts[first_at], ends[first_at]) if len(starts) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        return self._spread(cps, starts, row, marks, back, ids, off, row_off, ends, lens)

    def _run_split(self, r: int) -> tuple[int, int]:
        """Longest pieces ahead, and marks of the run that are left."""
        ahead = max(0, r // self.m.longest - 1)
        return ahead, r - ahead * self.m.longest

    def _run_size(self, run: np.ndarray) -> np.ndarray:
        """Pieces of runs of word marks."""
        sizes = np.array([len(x) for x in self.m.runs], np.int64)
        ahead = np.maximum(0, run // self.m.longest - 1)
        return ahead + sizes[run - ahead * self.m.longest]

    def _spread(self, cps, starts, row, marks, back, ids, off, row_off, ends, lens):
        """Puts the words' ids where the words stand, with the runs of word marks between them."""
        m = self.m
        alone = m.mark
        begin, count = off[:-1][back], np.diff(off)[back]
        # The mark ahead of a word joins a longer run only if no piece has taken it.
        free = ids[begin] == alone if len(ids) else np.zeros(len(back), bool)
        free &= marks > 1
        begin, count = begin + free, count - free
        run = np.where(free, marks, marks - 1)
        # Runs at the end of a text.
        has = np.bincount(row, minlength=len(lens)) if len(row) else np.zeros(len(lens), np.int64)
        last_word = np.cumsum(has) - 1
        tail = np.where(has > 0, row_off[1:] - (ends[np.maximum(last_word, 0)] if len(ends) else 0), np.where(lens > 0, lens + 1, 0))
        n_run, n_tail = self._run_size(run), self._run_size(tail)
        # Pieces in order: for each word its run and its ids, for each text its tail.
        per_row = np.zeros(len(lens), np.int64)
        np.add.at(per_row, row, n_run + count)
        out_off = np.concatenate([[0], np.cumsum(per_row + n_tail)])
        out = np.empty(out_off[-1], np.int64)
        seg = n_run + count
        seg_end = np.cumsum(seg) + (np.cumsum(n_tail) - n_tail)[row] if len(row) else np.zeros(0, np.int64)
        seg_at = seg_end - seg
        src, _ = _gather(ids, begin, count)
        put = np.repeat(seg_at + n_run - (np.cumsum(count) - count), count) + np.arange(len(src))
        out[put] = src
        for at, r in [*zip(seg_at[run > 0].tolist(), run[run > 0].tolist(), strict=True), *zip((out_off[1:] - n_tail)[tail > 0].tolist(), tail[tail > 0].tolist(), strict=True)]:
            ahead, rest = self._run_split(r)
            out[at : at + ahead] = m.runs[m.longest][0]
            out[at + ahead : at + ahead + len(m.runs[rest])] = m.runs[rest]
        lone = np.flatnonzero(out == self.other)
        if not len(lone):
            return out, out_off
        # Bytes for the characters without piece, in their order in the text.
        chars = cps[(m.single[self.lookup[cps]] < 0) & (cps != 32) & (cps != ord(MARK))]
        coded = [c.encode("utf-8", "surrogatepass") for c in map(chr, chars.tolist())]
        n_bytes = np.array([len(c) for c in coded], np.int64)
        grow = np.ones(len(out), np.int64)
        grow[lone] = n_bytes
        wide = np.repeat(out, grow)
        wide[wide == self.other] = m.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        new_end = np.concatenate([[0], np.cumsum(grow)])
        return wide, new_end[out_off]


def _distinct(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different word, and the number of each word among these: found by hash, then compared character by character."""
    _, first_at, back = np.unique(word_hashes(cps.view(np.uint8), 4 * starts, 4 * ends), return_index=True, return_inverse=True)
    like, size = first_at[back], ends - starts
    same = (size[like] == size).all()
    if same:
        mine, _ = _gather(cps, starts, size)
        theirs, _ = _gather(cps, starts[like], size)
        same = (mine == theirs).all()
    if not same:
        words = [cps[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        back = np.array([number[w] for w in words], np.int64)
        first_at = np.unique(back, return_index=True)[1]
    return first_at, back


def _gather(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces pool[begin : begin + count] behind each other, and their offsets."""
    off = np.concatenate([[0], np.cumsum(count)])
    return pool[np.repeat(begin - off[:-1], count) + np.arange(off[-1])], off


class Decoder:
    """Ids back to texts."""

    def __init__(self, model: Model):
        table = [p.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.byte_ids.tolist()):
            table[i] = bytes([b])
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in table])])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of each row of ids, without the space that encoding puts ahead."""
        count = np.diff(self.off)[ids]
        raw, at = _gather(self.data, self.off[:-1][ids], count)
        raw = raw.tobytes()
        cut = at[off].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(cut, cut[1:], strict=False)]


# ---------------------------------------------------------------- DataFrame operators
def _parts(batches):
    """Small slices of the batches, their texts, null as empty."""
    for part, _, _ in chunks(batches, limit=BATCH_BYTES):
        yield part, [t or "" for t in part.column("text").to_pylist()]


def _lists(off: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) to (doc_id, token_ids). The model's tables go to every worker; their size is the vocabulary's."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        encoder = Encoder(shared.value)
        for part, texts in _parts(batches):
            ids, off = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _lists(off, ids)], ["doc_id", "token_ids"])

    return with_only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(tokens: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, token_ids) to (doc_id, text); null ids are none."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        decoder = Decoder(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                col = batch.column("token_ids")
                if col.null_count:
                    col = pa.array([x or [] for x in col.to_pylist()], pa.list_(pa.int32()))
                off = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = decoder.decode(col.flatten().to_numpy(zero_copy_only=False), off)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"])

    return with_only(tokens, "doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256): ids of each text, and the SHA-256 of what they decode to, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for part, texts in _parts(batches):
            ids, off = encoder.encode(texts)
            digest = [hashlib.sha256(t).hexdigest() for t in decoder.decode(ids, off)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(off), pa.int64()), _lists(off, ids), pa.array(digest, pa.string())], ["doc_id", "n_tokens", "token_ids", "decoded_sha256"])

    return with_only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, and the digest of what they decode to."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
