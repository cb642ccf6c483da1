"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, best score first, leftmost among
equals, and merges until no pair is a piece; what is no piece falls back to bytes. As no
piece of a merge vocabulary spans a word end, a text is cut where no merge can
cross (before a run of spaces; around characters that only stand alone) and each distinct
chunk is encoded once per worker. The agendas of many chunks are rows of one array, the
best entry of every row is taken at once; long chunks have a heap each. Every chunk that
is new is encoded by the sentencepiece library too, and a difference fails the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import lean, slices

SPACE = "▁"
#: Chunks a worker remembers in each of two generations; beyond it the older is forgotten, which costs time but changes nothing.
REMEMBERED = 250_000
#: Bytes of text that are cut into chunks at once.
PORTION = 2 << 20
#: Chunks longer than this are not remembered.
LONG_CHUNK = 64
#: Chunks up to this long are merged as rows of an array, as many at once.
ROW, ROWS = 48, 4096
#: Rank of a pair that doesn't merge.
NONE = np.iinfo(np.int32).max


#: Bits of an agenda entry that hold a position; the rank of the piece stands above them.
_PLACE = 32


def agenda_encode(chars: str, ranks: dict[str, int]) -> list[str]:
    """Pieces of ``chars`` by merging the adjacent pair of least rank first, the leftmost of equals.

    An entry is a rank and the place of the left symbol. It is stale if what stands there
    now doesn't merge with its neighbour into a piece of that rank.
    """
    n, rank_of = len(chars), ranks.get
    symbols: list[str] = list(chars)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda = [rank << _PLACE | i for i in range(n - 1) if (rank := rank_of(chars[i : i + 2])) is not None]
    heapq.heapify(agenda)
    push, pop, mask = heapq.heappush, heapq.heappop, (1 << _PLACE) - 1
    while agenda:
        entry = pop(agenda)
        left = entry & mask
        right = after[left]
        if not symbols[left] or right == n:
            continue
        merged = symbols[left] + symbols[right]
        if rank_of(merged) != entry >> _PLACE:
            continue
        symbols[left], symbols[right] = merged, ""
        right = after[left] = after[right]
        if right < n:
            before[right] = left
            if (rank := rank_of(merged + symbols[right])) is not None:
                push(agenda, rank << _PLACE | left)
        previous = before[left]
        if previous >= 0 and (rank := rank_of(symbols[previous] + merged)) is not None:
            push(agenda, rank << _PLACE | previous)
    return [x for x in symbols if x]


class PairTable:
    """Pairs of symbols that merge. Symbols are piece ids; characters that are no piece get numbers above those."""

    def __init__(self, ids: dict[str, int], ranks: dict[str, int]):
        self.first_extra = max(ids.values()) + 1
        self.symbol = {p: i for p, i in ids.items() if len(p) == 1}
        self.extra: list[str] = []
        for c in sorted({c for p in ids for c in p}):
            self._of(c)
        found = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = (self.symbol.get(x) if len(x) == 1 else ids.get(x) for x in (p[:cut], p[cut:]))
                if left is not None and right is not None:
                    found.append((left << _PLACE | right, ranks[p], i))
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.keys, self.rank, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

    def _of(self, char: str) -> int:
        i = self.symbol.get(char)
        if i is None:
            i = self.symbol[char] = self.first_extra + len(self.extra)
            self.extra.append(char)
        return i

    def char(self, symbol: int) -> str | None:
        """The character of a symbol that is no piece."""
        return self.extra[symbol - self.first_extra] if symbol >= self.first_extra else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where it doesn't merge."""
        key = left.astype(np.int64) << _PLACE | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (right >= 0) & (left >= 0)
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def merge_all(self, chunks: list[tuple[int, str]]) -> Iterator[tuple[list[int], list[list[int]]]]:
        """Merged symbols of each (number, chunk), padded by -1; chunks come by length."""
        of = self.symbol
        for n in range(0, len(chunks), ROWS):
            part = chunks[n : n + ROWS]
            width = max(len(c) for _, c in part)
            symbols = np.full((len(part), width + 1), -1, np.int32)
            for k, (_, c) in enumerate(part):
                symbols[k, : len(c)] = [of[x] if x in of else self._of(x) for x in c]
            rank, merged = self.look_up(symbols[:, :-1], symbols[:, 1:])
            active, columns = np.arange(len(part)), np.arange(width)
            while True:
                best = rank.argmin(1)  # the agenda's first entry: least rank, then leftmost
                go = rank[np.arange(len(best)), best] != NONE
                if not go.all():
                    active, rank, merged, best = active[go], rank[go], merged[go], best[go]
                if not len(active):
                    break
                rows = np.arange(len(active))
                row = symbols[active]
                row[rows, best] = merged[rows, best]
                shift = columns + (columns > best[:, None])  # what stands right of the pair moves up
                row = np.concatenate([np.take_along_axis(row, np.minimum(shift, width), 1), np.full((len(active), 1), -1, np.int32)], 1)
                symbols[active] = row
                shift = np.minimum(columns + (columns > best[:, None]), width - 1)
                rank, merged = np.take_along_axis(rank, shift, 1), np.take_along_axis(merged, shift, 1)
                rank[:, -1] = NONE
                for at in (best, np.maximum(best - 1, 0)):
                    rank[rows, at], merged[rows, at] = self.look_up(row[rows, at], row[rows, at + 1])
            yield [i for i, _ in part], symbols.tolist()


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str, checked: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file) if checked else None
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only merge-type vocabularies over text as it is are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        scores = sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        self.ranks = {p: place[model.pieces[i].score] for p, i in self.ids.items()}
        self.pairs = PairTable(self.ids, self.ranks)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the vocabulary has pieces that span a word end")
        self.alone = "\n" if not any("\n" in p for p in self.ids if len(p) > 1) else ""
        self.cut = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Chunks whose ids don't decode to their text.
        self.odd: set[str] = set()
        self.shown: dict[int, tuple[str, bytes]] = {}
        self.decoded: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)} | {i: bytes([b]) for b, i in self.bytes.items()}

    def fallback(self, piece: str) -> list[int]:
        """Ids of what is no piece."""
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def encode_chunks(self, chunks: list[str]) -> list[str]:
        """Ids of each chunk, joined by commas. They are decoded as well, and chunks that come back otherwise are noted as odd."""
        out, shown = [""] * len(chunks), self.shown
        for rows, symbols in self.pairs.merge_all([(i, c) for i, c in enumerate(chunks) if len(c) <= ROW]):
            for i, row in zip(rows, symbols, strict=True):
                ids, back = zip(*[shown[x] if x in shown else self._show(x) for x in row if x >= 0], strict=True)
                out[i] = ",".join(ids)
                if b"".join(back) != chunks[i].replace(SPACE, " ").encode():
                    self.odd.add(chunks[i])
        for i, c in enumerate(chunks):
            if len(c) > ROW:
                ids = [x for piece in agenda_encode(c, self.ranks) for x in ([self.ids[piece]] if piece in self.ids else self.fallback(piece))]
                out[i] = ",".join(map(str, ids))
                if b"".join([self.decoded[x] for x in ids]) != c.replace(SPACE, " ").encode():
                    self.odd.add(c)
        return out

    def _show(self, symbol: int) -> tuple[str, bytes]:
        """The ids of a symbol, joined by commas, and what they decode to."""
        char = self.pairs.char(symbol)
        ids = [symbol] if char is None else self.fallback(char)
        shown = self.shown[symbol] = ",".join(map(str, ids)), b"".join([self.decoded[i] for i in ids])
        return shown

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text, its ids joined by commas, and what they decode to."""
        if len(self.known) > REMEMBERED:
            self.known, self.older, self.odd = {}, self.known, self.odd & self.known.keys()
        known, older, cut = self.known, self.older, [self.chunks(t) for t in texts]
        new = set().union(*cut).difference(known)
        again = new.intersection(older)
        known.update({c: older[c] for c in again})
        fresh = sorted(new - again, key=len)
        rendered = dict(zip(fresh, self.encode_chunks(fresh), strict=True))
        self.verify(rendered)
        known.update(rendered)
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            joined = ",".join([known[c] for c in chunks])
            if self.odd and not self.odd.isdisjoint(chunks):
                out.append((joined, self.decode(list(map(int, joined.split(","))))))
            else:  # every chunk was decoded when it was encoded, and gave its characters back
                out.append((joined, text.replace(SPACE, " ")))
        for c in rendered:
            if len(c) > LONG_CHUNK:
                del known[c]
        if self.odd:
            self.odd = {c for c in self.odd if len(c) <= LONG_CHUNK}
        return out

    def verify(self, fresh: dict[str, str]) -> None:
        """Raise if the library encodes any of these chunks otherwise."""
        if self.library is None or not fresh:
            return
        head = self.library.encode("\n")
        asked = [c[1:] if c[0] == SPACE else "\n" + c for c in fresh]
        for (chunk, ids), theirs in zip(fresh.items(), self.library.encode(asked, num_threads=1), strict=True):
            if chunk == SPACE and self.alone:  # alone before a line break; the library takes it for no text
                theirs = head[:-1]
            if ids != ",".join(map(str, theirs if chunk[0] == SPACE else theirs[len(head) :])):
                raise ValueError(f"ids of {chunk!r} differ from the library's: {ids}, {theirs}")

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_batch([text or ""])[0][0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes that are no UTF-8 become U+FFFD, the space put before the text goes."""
        control = self.control
        text = b"".join([self.decoded[i] for i in ids if i not in control])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One codec for each model file and worker process."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """Encode and decode each row of ``docs`` (doc_id and text; other columns are not read).

    Returns doc_id, n_tokens, ids (if ``with_ids``), ids_sha256 (of the decimal ids, comma-joined),
    decoded_sha256 (of the decoded text) and same (whether decoding gave the text back). A
    null or empty text has no tokens; repeated rows are encoded each. ``model_file`` must be
    readable by every executor; no begin or end ids, no sampling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in slices(batches, PORTION):
            n, ids, coded, decoded, same = [], [], [], [], []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for text, (joined, back) in zip(texts, c.encode_batch(texts), strict=True):
                n.append(joined.count(",") + 1 if joined else 0)
                coded.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=","))
            columns = [b.column("doc_id"), pa.array(n, pa.int64())] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            columns += [pa.array(coded, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string, same boolean"
    return docs.select("doc_id", "text").mapInArrow(lean(run), out)
