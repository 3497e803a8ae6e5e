"""Operator 6: SentencePiece encoding by Aho-Corasick and Viterbi, and decoding.

The pieces of a model file form one Aho-Corasick automaton over characters.  A text is encoded in
a single pass: at each position the automaton's state lists, through its output links, all pieces
that end there, longest first; each relaxes the best score of the position from the position where
it starts.  A character that no single-character piece covers may also become byte pieces at the
unknown score.  The path with the best sum of piece scores is read back (ties go to the longer last
piece).

Space becomes the mark U+2581, one mark is put before a text, and no piece holds a mark behind
another character (checked when a model is loaded).  Between two characters that stand side by side
in no piece, no path can cross; there a text is cut into words, which are encoded one by one: the
distinct words of a block advance through the automaton together, one array operation per character
position, and results are kept for later blocks up to a bounded number of words, by their bytes.

Scores are those of the file.  The result is the best-scoring segmentation under them, as the
SentencePiece library gives for a model of type unigram.  A file of type BPE (whose scores are
negative merge ranks) is segmented by the same rule; the library would apply merges instead.

Defined results: null and empty texts have no pieces; every other text decodes to itself exactly
(texts that hold the mark itself decode to a space in its place); repeated rows are encoded one by
one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship
from .textkernel import blocks, joined, span_hashes

MARK = "▁"
#: Words whose pieces one worker keeps; the store starts anew when it is full.
KEPT_WORDS = 1 << 18
#: Added to the lowest piece score for a character that no piece covers.
UNKNOWN_PENALTY = -10.0


class Pieces:
    """Piece table of a model and its automaton as flat arrays."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """``pieces``: (text, score, kind) by id; kind is normal, byte or other."""
        self.text = [p[0] for p in pieces]
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        for _, p, _ in normal:
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} holds a mark behind another character")
        #: beside[b, c]: some piece holds a character that ends with byte b before one that starts with c
        self.beside = np.zeros((256, 256), bool)
        for _, p, _ in normal:
            for text in {p, p.replace(MARK, " ")}:
                chars = [c.encode() for c in text]
                for one, two in zip(chars[:-1], chars[1:], strict=True):
                    self.beside[one[-1], two[0]] = True
        self.byte_id = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_id[int(p[3:5], 16)] = i
        self.unknown_score = min((s for _, _, s in normal), default=0.0) + UNKNOWN_PENALTY
        self._automaton(normal)
        raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(MARK, " ").encode() if kind == "normal" else b"" for p, _, kind in pieces]
        self.raw_first = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._kept: dict[bytes, int] = {}
        self._ids, self._first = [np.empty(0, np.int32)], [0]

    def _automaton(self, normal: list[tuple[int, str, float]]) -> None:
        child: list[dict[int, int]] = [{}]
        piece, score, depth = [-1], [0.0], [0]
        for i, p, s in normal:
            at = 0
            for c in p:
                nxt = child[at].get(ord(c))
                if nxt is None:
                    nxt = len(child)
                    child[at][ord(c)] = nxt
                    child.append({})
                    piece.append(-1)
                    score.append(0.0)
                    depth.append(depth[at] + 1)
                at = nxt
            piece[at], score[at] = i, s
        fail, out = [0] * len(child), [0] * len(child)
        queue = list(child[0].values())
        for at in queue:  # breadth first: shorter states are finished before longer ones
            for c, nxt in child[at].items():
                f = fail[at]
                while f and c not in child[f]:
                    f = fail[f]
                fail[nxt] = child[f].get(c, 0)
                out[nxt] = fail[nxt] if piece[fail[nxt]] >= 0 else out[fail[nxt]]
                queue.append(nxt)
        key = np.array([(s << 21) | c for s, d in enumerate(child) for c in d], np.int64)
        to = np.array([t for d in child for t in d.values()], np.int64)
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]
        self.fail, self.out = np.array(fail), np.array(out)
        self.piece, self.score, self.depth = np.array(piece), np.array(score), np.array(depth)

    def _advance(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next automaton states: goto moves, through failure links where there is none."""
        new = np.zeros_like(state)
        todo = np.arange(state.size)
        while todo.size:
            want = (state[todo] << 21) | char[todo]
            at = np.minimum(np.searchsorted(self.key, want), self.key.size - 1)
            hit = self.key[at] == want
            new[todo[hit]] = self.to[at[hit]]
            todo = todo[~hit]
            todo = todo[state[todo] > 0]
            state = state.copy()
            state[todo] = self.fail[state[todo]]
        return new

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each word (a run of marks followed by other characters)."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        at = 0
        while at < len(words):
            longest = max(1, len(words[order[at]]))
            lanes = order[at : at + max(1, (1 << 18) // longest)]
            for i, ids in zip(lanes.tolist(), self._lanes([words[i] for i in lanes]), strict=True):
                out[i] = ids
            at += lanes.size
        return out

    def _lanes(self, words: list[str]) -> list[np.ndarray]:
        """Viterbi over words of descending length, all lanes one character at a time."""
        n = np.array([len(w) for w in words])
        text = np.zeros((len(words), int(n[0]) if n.size else 0), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        text[np.arange(text.shape[1])[None, :] < n[:, None]] = flat
        best = np.full((text.shape[1] + 1, len(words)), -np.inf)
        best[0] = 0
        back = np.zeros(best.shape, np.int64)  # length of the last piece; 0: unknown character
        last = np.full(best.shape, -1, np.int64)
        state = np.zeros(len(words), np.int64)
        for t in range(text.shape[1]):
            live = int(np.searchsorted(-n, -t, side="left"))  # lanes with n > t
            state = self._advance(state[:live], text[:live, t])
            lane = np.arange(live)
            single = np.zeros(live, bool)
            link, who = np.where(self.piece[state] >= 0, state, self.out[state]), lane
            while who.size:
                who, link = who[link > 0], link[link > 0]
                d = self.depth[link]
                value = best[t + 1 - d, who] + self.score[link]
                better = value > best[t + 1, who]
                w = who[better]
                best[t + 1, w], back[t + 1, w], last[t + 1, w] = value[better], d[better], self.piece[link[better]]
                single[who[d == 1]] = True
                link = self.out[link]
            value = best[t, :live] + self.unknown_score
            w = np.flatnonzero(~single & (value > best[t + 1, :live]))
            best[t + 1, w], back[t + 1, w], last[t + 1, w] = value[w], 0, -1
        # Read all paths back together: (lane, position, piece) in reverse.
        lane, place = np.arange(len(words)), n.copy()
        lanes, ids, where = [], [], []
        while (on := place > 0).any():
            lane, place = lane[on], place[on]
            lanes.append(lane)
            ids.append(last[place, lane])
            where.append(place)
            place = place - np.maximum(back[place, lane], 1)
        if not lanes:
            return [np.empty(0, np.int32)] * len(words)
        lanes, ids, where = (np.concatenate(x[::-1]) for x in (lanes, ids, where))
        unknown = np.flatnonzero(ids < 0)
        if unknown.size:
            spelled = {c: self.byte_id[list(chr(c).encode("utf-8"))] for c in np.unique(text[lanes[unknown], where[unknown] - 1]).tolist()}
            count = np.ones(ids.size, np.int64)
            chars = text[lanes[unknown], where[unknown] - 1].tolist()
            count[unknown] = [spelled[c].size for c in chars]
            lanes, where, ids = np.repeat(lanes, count), np.repeat(where, count), np.repeat(ids, count)
            ids[ids < 0] = np.concatenate([spelled[c] for c in chars])
        order = np.lexsort((where, lanes))
        return np.split(ids[order].astype(np.int32), np.cumsum(np.bincount(lanes, minlength=len(words)))[:-1])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of text i are first[i]:first[i + 1]."""
        data, doc_start, doc_end = joined(column)
        # A word starts where a text does, and at a character that follows its neighbour in no piece.
        edge = np.zeros(data.size + 1, bool)
        edge[1:-1] = ((data[1:] & 0xC0) != 0x80) & ~self.beside[data[:-1], data[1:]]
        edge[doc_start[doc_end > doc_start]] = True
        edge[doc_end] = False
        edge[-1] = False
        start = np.flatnonzero(edge)
        doc = np.searchsorted(doc_start, start, side="right") - 1
        end = np.minimum(np.append(start[1:], data.size), doc_end[doc])
        head = start == doc_start[doc]
        where, inverse = self._distinct(data, start, end, head)
        if len(self._kept) + where.size > KEPT_WORDS:
            self._kept, self._ids, self._first = {}, [np.empty(0, np.int32)], [0]
        raw = data.tobytes()
        words = [b"\1" * h + raw[a:b] for a, b, h in zip(start[where].tolist(), end[where].tolist(), head[where].tolist(), strict=True)]
        place = [self._kept.get(w, -1) for w in words]
        new = [i for i, p in enumerate(place) if p < 0]
        if new:
            texts = [(MARK if head[where[i]] else "") + words[i][int(head[where[i]]) :].decode().replace(" ", MARK) for i in new]
            for i, ids in zip(new, self.segment(texts), strict=True):
                place[i] = self._kept[words[i]] = len(self._first) - 1
                self._ids.append(ids)
                self._first.append(self._first[-1] + ids.size)
        store = np.concatenate(self._ids)
        self._ids = [store]
        first = np.array(self._first)
        at = np.array(place, np.int64)[inverse]
        size = (first[at + 1] - first[at]) if at.size else np.empty(0, np.int64)
        to = np.concatenate(([0], np.cumsum(size)))
        ids = store[np.repeat(first[at] - to[:-1], size) + np.arange(to[-1])] if at.size else store[:0]
        return ids, to[np.searchsorted(start, np.append(doc_start, data.size))]

    @staticmethod
    def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each distinct word, its number for every word); words are compared by two hashes,
        and by their bytes where these disagree."""
        key, check = (span_hashes(data, start, end, seed) ^ head.astype(np.uint64) for seed in (0, 1))
        _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if (check[where][inverse] == check).all():
            return where, inverse
        raw, number = data.tobytes(), {}
        inverse = np.array([number.setdefault((h, raw[a:b]), len(number)) for a, b, h in zip(start.tolist(), end.tolist(), head.tolist(), strict=True)], np.int64)
        return np.unique(inverse, return_index=True)[1], inverse

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Texts of id runs: piece bytes end to end without the mark put before the text."""
        size = self.raw_first[ids + 1] - self.raw_first[ids]
        to = np.concatenate(([0], np.cumsum(size)))
        out = self.raw[np.repeat(self.raw_first[ids] - to[:-1], size) + np.arange(to[-1])].tobytes()
        cut = to[first].tolist()
        return [out[a + 1 : b] if b > a and out[a : a + 1] == b" " else out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def load(model_path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return Pieces([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


def encode_documents(docs: DataFrame, *, model_path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, n_bytes_pieces, ids_crc32, round_trip[, ids]) of every text.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids; ``round_trip`` tells whether decoding
    gives the text again (a mark in the text counts as the space it decodes to).
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        is_byte = np.zeros(len(model.text) + 1, bool)
        is_byte[model.byte_id] = True
        for block in blocks(batches):
            text = block.column("text").fill_null("")
            ids, first = model.encode(text)
            raw = ids.astype("<u4").tobytes()
            spelled = np.concatenate(([0], np.cumsum(is_byte[ids])))
            back = model.decode(ids, first)
            columns = {
                "doc_id": block.column("doc_id"),
                "n_pieces": pa.array(np.diff(first)),
                "n_byte_pieces": pa.array(spelled[first[1:]] - spelled[first[:-1]]),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.int64()),
                "round_trip": pa.array([a == b or a == b.replace(MARK.encode(), b" ") for a, b in zip(back, (t.as_py().encode() for t in text), strict=True)]),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, *, model_path: str) -> DataFrame:
    """(doc_id, text) from ``ids``; null ids give null, bytes that aren't UTF-8 become U+FFFD."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            ids = batch.column("ids")
            n = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            back = model.decode(flat, np.concatenate(([0], np.cumsum(n))).astype(np.int64))
            text = [b.decode("utf-8", "replace") if v else None for b, v in zip(back, ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

