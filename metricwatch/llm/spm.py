"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search keeps, for each boundary, the best way to reach it (the backpointer) and looks back no
further than the longest piece. Once every surviving boundary's chain of backpointers passes through
one boundary, the ids before it are final: they are committed and the window moves on, so memory
follows the window, not the text.

Two kinds of model are read. A unigram model picks the way with the highest sum of scores. A merge
(BPE) model has no additive score; there a piece may follow another only if merging their joint
text by rank leaves exactly these two pieces. Of all ways to a boundary at most one survives that
rule, and it is the model's own segmentation. Characters outside the vocabulary become byte pieces
(or the unknown id if the model has none).

If no piece of the vocabulary goes on past the space mark in front of a word, all ways meet there;
such stretches are searched on their own and remembered in a bounded table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
REMEMBERED = 400_000  # words whose ids, and pairs of pieces whose fit, a worker remembers at most
NEVER = 1 << 60  # the rank of what is no piece
UNSPELLED = {"": ""}  # where no piece begins with a character, it stands for itself
LOOK_EVERY = 64  # boundaries between two tests for convergence
LONGEST_REMEMBERED = 64
# Where public tokenizer files lie unless a path is given.
DEFAULT_FILE = "piece_bpe_32k.model"


def default_model() -> str:
    """Path of the public model file of this machine."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class Model:
    """Vocabulary and rules of a SentencePiece model file, given as bytes."""

    def __init__(self, content: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(content)
        kinds = proto.ModelProto.SentencePiece
        norm, kind = spec.normalizer_spec, spec.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or norm.normalization_rule_tsv or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is are read")
        if kind not in (proto.TrainerSpec.UNIGRAM, proto.TrainerSpec.BPE):
            raise ValueError("the model is neither a unigram nor a merge model")
        self.merges = kind == proto.TrainerSpec.BPE
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in spec.pieces]
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes: dict[int, int] = {}
        self.control: set[int] = set()
        self.unknown = 0
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.USER_DEFINED:
                raise ValueError("user-defined pieces are not read")
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes[i] = int(p.piece[3:5], 16)
            elif p.type == kinds.NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
            elif p.type == kinds.CONTROL:
                self.control.add(i)
        steps = {score: i for i, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: steps[score] for p, score in self.score.items()}
        # every beginning of a piece: its score (never positive) if it is one, else None
        self.begun: dict[str, float | None] = {p[:k]: None for p in self.score for k in range(1, len(p))}
        self.begun |= {p: min(score, 0.0) for p, score in self.score.items()}
        self.trie: dict = {}  # the pieces by their characters, each under "" where it ends
        for p in self.score:
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = p
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.unmade: set[str] = set()
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.score.values(), default=0.0) - 10.0  # of a character without a piece, as SentencePiece has it
        self.splits = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids)
        written = {i: bytes([b]) for i, b in self.bytes.items()} | {i: b"" for i in self.control} | {self.unknown: " ⁇ ".encode()}
        self.spelled = [written.get(i, p.encode()) for i, p in enumerate(self.pieces)]
        # two generations each: a full young one becomes the old one, and what is still asked for moves back
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.exact = True  # so far the ids of every stretch, decoded when they were found, spell the stretch

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts a piece was last merged from, None for a character; a piece that merging never gives is no candidate."""
        if piece in self.parts:
            return self.parts[piece]
        parts, last = list(piece), None
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
            best = min(ranks)
            if best == NEVER:
                self.unmade.add(piece)
                break
            at = ranks.index(best)
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.parts[piece] = last
        return last

    def follows(self, before: str, piece: str) -> bool:
        """Whether merging by rank leaves `piece` beside `before` ("" is the start of the text).

        Merges are undone from the latest on. If the neighbours at the border could have been merged
        before the one undone, they would have been; of equal ranks the left one comes first.
        """
        known = self.pairs.get((before, piece))
        if known is not None:
            return known
        self.last_merge(piece)
        known = piece not in self.unmade
        if known and before:
            left, right, limit, rank = before, piece, NEVER, self.rank
            while True:
                if rank.get(left + right, NEVER) < limit:
                    known = False
                    break
                a, b = (rank.get(x, -1) if len(x) > 1 else -1 for x in (left, right))
                if a > b:
                    limit, left = a, self.last_merge(left)[1]
                elif b >= 0:
                    limit, right = b + 1, self.last_merge(right)[0]
                else:
                    break
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[before, piece] = known
        return known

    def written(self, piece: str) -> list[int]:
        """The ids of a piece, or of a character without one."""
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def search(self, text: str) -> Iterator[str]:
        """The pieces of a text, committed as soon as no later character can change them."""
        n, longest, begun, merges, pairs = len(text), self.longest, self.begun, self.merges, self.pairs
        # of each boundary from `base` on: where its last piece begins, the piece, the best sum
        base, room = 0, min(n, longest) + 1
        begin, last, total = [0] + [-1] * room, [""] + [None] * room, [0.0] * (room + 1)
        for j in range(n):
            before = last[j - base]
            if before is not None:
                for k in range(j + 1, min(n, j + longest) + 1):
                    piece = text[j:k]
                    gain = begun.get(piece, 1.0)
                    if gain is None:
                        continue
                    if gain == 1.0:  # no piece begins like this
                        if k > j + 1:
                            break
                        gain = self.worst
                    if not merges:
                        gain += total[j - base]
                        if last[k - base] is None or gain > total[k - base]:
                            begin[k - base], last[k - base], total[k - base] = j, piece, gain
                    elif last[k - base] is None:
                        fits = pairs.get((before, piece))
                        if self.follows(before, piece) if fits is None else fits:
                            begin[k - base], last[k - base] = j, piece
            begin.append(-1)
            last.append(None)
            total.append(0.0)
            i = j + 1
            if i % LOOK_EVERY == 0 or i == n:
                # follow the chains of all live boundaries down from the largest until one is left
                meet = {n} if i == n else {k for k in range(max(base, i - longest + 1), i + 1) if last[k - base] is not None}
                while len(meet) > 1:
                    top = max(meet)
                    meet.remove(top)
                    meet.add(begin[top - base] if top > base else base)
                stop = k = meet.pop()
                chain = []
                while k > base:
                    chain.append(last[k - base])
                    k = begin[k - base]
                chain.reverse()
                yield from chain
                if i < n and stop > base:
                    drop = stop - base
                    begin, last, total, base = begin[drop:], last[drop:], total[drop:], stop
                    if not merges:  # sums start anew, so they stay exact on endless texts
                        total = [t - total[0] for t in total]

    def short(self, text: str) -> list[str]:
        """`search` for a merge model and a text of at most LOOK_EVERY characters: all ways meet at its end only, so nothing moves."""
        n, trie, pairs, follows = len(text), self.trie, self.pairs, self.follows
        begin, last = [0] * (n + 1), [""] + [None] * n
        for j in range(n):
            before = last[j]
            if before is None:
                continue
            k, node = j, trie.get(text[j], UNSPELLED)
            while node is not None:
                k += 1
                piece = node.get("")
                if piece is not None and last[k] is None:
                    piece = piece or text[j]
                    fits = pairs.get((before, piece))
                    if follows(before, piece) if fits is None else fits:
                        begin[k], last[k] = j, piece
                node = node.get(text[k]) if k < n else None
        chain, k = [], n
        while k:
            chain.append(last[k])
            k = begin[k]
        chain.reverse()
        return chain

    def _ids(self, part: str) -> bytes:
        """The ids of a stretch that no piece leaves, as little-endian 32-bit integers; short ones are remembered."""
        known = self.words.get(part)  # it may have come since
        if known is not None:
            return known
        known = self.old_words.get(part)
        if known is None:
            ids, found = self.ids, self.short(part) if self.merges and len(part) <= LOOK_EVERY else self.search(part)
            numbers = [i for piece in found for i in ([ids[piece]] if piece in ids else self.written(piece))]
            if self.exact:
                self.exact = b"".join(map(self.spelled.__getitem__, numbers)) == part.encode()
            known = array("i", numbers).tobytes()
        if len(part) <= LONGEST_REMEMBERED:
            if len(self.words) >= REMEMBERED // 2:
                self.old_words, self.words = self.words, {}
            self.words[part] = known
        return known

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return self.encoded(text).tolist()

    def encoded(self, text: str) -> np.ndarray:
        """The ids of a text as an array."""
        if not text:
            return np.zeros(0, np.int32)
        marked = (SPACE_MARK if self.prefix else "") + text.replace(" ", SPACE_MARK)
        parts = WORD.findall(marked) if self.splits else [marked]
        known = list(map(self.words.get, parts))
        if None in known:
            known = [self._ids(part) if ids is None else ids for part, ids in zip(parts, known)]
        return np.frombuffer(b"".join(known), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces are gathered into characters, control ids write nothing."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace").replace(SPACE_MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


    def returns(self, text: str, ids: np.ndarray) -> bool:
        """Whether decoding `ids`, which `encoded` gave for the text, gives it back.

        Every stretch was decoded when its ids were found. As long as all came back, a text does too unless
        it holds the space mark itself; otherwise it is decoded as a whole.
        """
        return SPACE_MARK not in text if self.exact else self.decode(ids.tolist()) == text


WORD = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


@lru_cache(maxsize=2)
def _model(content: bytes) -> Model:
    return Model(content)


def _content(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as file:
        return file.read()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def encode(docs: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, ids)` of each row; null and empty texts have no ids. The model file is read on the driver and sent along."""
    content = docs.sparkSession.sparkContext.broadcast(_content(model_path))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        for batch in batches:
            ids = _lists([model.encoded(t.as_py() or "") for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """`(id, text)` of rows `(id, ids)`; null ids give a null text."""
    content = encoded.sparkSession.sparkContext.broadcast(_content(model_path))
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        for batch in batches:
            texts = pa.array((None if ids.as_py() is None else model.decode(ids.as_py()) for ids in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def encode_checked(docs: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, ids, n_ids, returns)`: ids with their number and whether decoding gives the text back.

    A text that holds the space mark itself comes back with spaces instead; that is the format's.
    """
    content = docs.sparkSession.sparkContext.broadcast(_content(model_path))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            ids = [model.encoded(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), _lists(ids), pa.array(map(len, ids), pa.int32()),
                pa.array([model.returns(t, i) for i, t in zip(ids, texts)], pa.bool_()),
            ], names=["id", "ids", "n_ids", "returns"])

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, ids array<int>, n_ids int, returns boolean")
