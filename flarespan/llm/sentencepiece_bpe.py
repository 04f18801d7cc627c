"""Exact encoding with a SentencePiece merge (BPE) model by backtracking, and decoding.

At each position the longest piece is taken (found for all positions in one pass of an
Aho-Corasick automaton over the reversed text).  A piece may follow its neighbour only if merging
the two texts again gives back just these two pieces; as only merges across the joint can differ,
the check replays those, latest first; which of a piece's beginnings is the longest that may follow
another piece is remembered.  Where no piece fits,
the last one is taken back and its end position is marked as failed in a bitfield, so every
position fails at most once.  The result is the same as that of merging by score.

A null or empty text has no tokens and decodes to an empty text.  Long texts are encoded whole, segment by segment; a
segment without a space or mark to cut at is one however long it is, in time linear in its length.  Ties of equal scores go
to the leftmost merge, as in the library.  Equal texts have equal results; repeated rows are each encoded; a null doc_id stays.
"""

from __future__ import annotations

import hashlib
import re
import string
from functools import partial

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_texts

SPACE = "▁"
#: Entries kept by each of a worker's caches (segments, about 250 bytes each, where no other number is given; pairs of pieces).
CACHE, PAIRS = 240_000, 100_000


def read_model(path: str) -> dict:
    """Pieces, scores and byte ids of a model file, as plain values that are sent to the tasks (bounded by the vocabulary)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normaliser and a leading space are supported")
    if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback are supported")
    kind = pb.ModelProto.SentencePiece
    if any(p.type == kind.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece has a space after other characters")
    return {"pieces": pieces, "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}}


class Segments(dict):
    """Segment to its ids, as a string of the characters with these numbers, which takes little memory and is quickly joined.

    Short segments are kept in two generations of half of ``most``: when the young one is full it becomes the old one, whose
    segments move back as they are met again, so frequent ones are never encoded anew.
    """

    def __init__(self, encoder: "Encoder", most: int) -> None:
        super().__init__()
        self.encoder, self.most, self.old = encoder, most, {}

    def __missing__(self, text: str) -> str:
        found = self.old.get(text) or "".join(map(chr, self.encoder.ids(text)))
        if len(text) <= 64:
            if len(self) >= self.most // 2:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    def __init__(self, model: dict, most: int = CACHE) -> None:
        self.model, self.pieces, self.byte_ids = model, model["pieces"], model["bytes"]
        self.pairs: dict = {}
        self.segments, raws = Segments(self, most), Decoder(model).raws
        self.raws = [raws.get(i, "") for i in range(1 + max(raws))]
        self.written = [f"{i}," for i in range(len(self.raws))]
        order = {score: k for k, score in enumerate(sorted({score for _, score in self.pieces.values()}, reverse=True))}
        self.rank = {p: order[score] for p, (_, score) in self.pieces.items()}
        # the last merge that makes each piece; a piece that merging never makes is no candidate
        self.made = {p: parts for p in self.pieces if len(p) > 1 and len(parts := self.merge(p, 2)) == 2 and self.merge(p) == [p]}
        self.tokens = {p for p in self.pieces if len(p) == 1} | set(self.made)
        # in the tables tokens are numbers: their ids; beyond these, characters of pieces that are none, and last any other character
        self.most = 1 + max(i for i, _ in self.pieces.values())
        numbers = {p: self.pieces[p][0] for p in self.tokens}
        numbers |= {c: self.most + k for k, c in enumerate(sorted({c for p in self.pieces for c in p} - self.tokens))}
        self.other = max(self.most, 1 + max(numbers.values()))
        self.texts, self.shorter = ["\ud800"] * (self.other + 1), [-1] * (self.other + 1)
        for p, i in numbers.items():
            self.texts[i] = p
            self.shorter[i] = next((numbers[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.tokens or k == 1), -1)
        self.sizes, self.single = list(map(len, self.texts)), {p: i for p, i in numbers.items() if len(p) == 1}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in self.tokens:
            if len(p) > 1:
                self.find.add_word(p[::-1], numbers[p])
        self.find.make_automaton()
        # no piece has a space after other characters, so a text falls apart before each run of
        # spaces; also between marks that join no other characters and those; and before a mark
        # after a character that no piece has before it ("word" and ",")
        beside = {(p[i], p[i + 1]) for p in self.pieces for i in range(len(p) - 1)}
        some = string.punctuation + "\n"
        marks = set(some)
        while joined := {c for pair in beside for c in pair if c in marks and not {*marks, SPACE}.issuperset(pair)}:
            marks -= joined
        own, every = re.escape("".join(sorted(marks))), re.escape(some)
        before: dict = {}  # characters that pieces have before a mark, to such marks
        for m in sorted(set(some) - marks):
            before.setdefault("".join(sorted(a for a, c in beside if c == m and a != SPACE)), []).append(m)
        # the mark is looked for first, as most characters are none
        joins = [(re.escape(chars), re.escape("".join(ms))) for chars, ms in sorted(before.items()) if chars]
        stay = "|".join(f"[{ms}](?<=[{chars}][{ms}])" for chars, ms in joins)
        more = f"(?:(?:{stay})[^{SPACE}{every}]*)*+" if stay else ""  # possessive: no memory for each mark
        apart = f"{SPACE}*[{own}]+|" if marks else ""
        self.cut = re.compile(rf"{apart}(?:{SPACE}+[{every}]?|[^{SPACE}{own}])[^{SPACE}{every}]*{more}")

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Merge single characters by rank, leftmost on ties, down to ``least`` parts."""
        parts = list(text)
        while len(parts) > least:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fitting(self, last: int, token: int) -> int:
        """The longest of ``token`` and its beginnings that may follow ``last``, or -1."""
        fits = token
        while fits >= 0 and not self.stays(self.texts[last], self.texts[fits]):
            fits = self.shorter[fits]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[last * len(self.texts) + token] = fits
        return fits

    def stays(self, a: str, b: str) -> bool:
        """Whether no merge across the joint of a and b comes before those that make a and b.

        Going back in time, the later of the two merges at the joint is undone; the parts that then
        meet there must not have merged before it.  On equal ranks the left of two merges is first.
        """
        rank, made = self.rank, self.made
        before = len(rank)
        while True:
            across = rank.get(a + b)
            if across is not None and across < before:
                return False
            ra, rb = rank[a] if a in made else -1, rank[b] if b in made else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, made[a][1]
            else:
                before, b = rb + 1, made[b][0]

    def split(self, text: str) -> list[int]:
        """The numbers of the pieces (or single characters that are none) of a segment."""
        n = len(text)
        # matches at a place come longest first; turned round, the longest is the one that stays in the dict
        longest = dict(list(self.find.iter(text[::-1]))[::-1]).get
        known, shorter, sizes, many = self.pairs.get, self.shorter, self.sizes, len(self.texts)
        failed = 0  # bit p: no valid continuation from position p
        out: list[int] = []
        at, last, token = 0, -1, longest(n - 1)
        while True:
            if token is None:
                token = self.single.get(text[at], self.other)
            if token >= 0 and last >= 0:
                fits = known(last * many + token)
                token = self.fitting(last, token) if fits is None else fits
            if token >= 0:
                end = at + sizes[token]
                if failed and failed >> end & 1:
                    token = shorter[token]
                    continue
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest(n - 1 - end)
            else:
                failed |= 1 << at
                token = out.pop()
                at -= sizes[token]
                last, token = out[-1] if out else -1, shorter[token]

    def ids(self, text: str) -> list[int]:
        found = self.split(text)
        if max(found) < self.most:
            return found
        out, at = [], 0  # characters that are no pieces
        for i in found:
            out += [i] if i < self.most else [self.byte_ids[b] for b in text[at].encode("utf-8")]
            at += self.sizes[i]
        return out

    def cut_up(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.cut_up(text) for i in self.ids(part)]


class Decoder:
    """Ids back to text: spaces for their marks, runs of byte pieces as UTF-8, the leading space dropped."""

    def __init__(self, model: dict) -> None:
        self.text = {i: p.replace(SPACE, " ") for p, (i, _) in model["pieces"].items()}
        self.byte = {i: b for b, i in model["bytes"].items()}
        #: The text of an id, the leading space kept, of a byte that is no character its stand-in: joined, they give the bytes of the whole.
        self.raws = self.text | {i: bytes([b]).decode("utf-8", "surrogateescape") for i, b in self.byte.items()}

    def decode(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.text[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        whole = "".join(out)
        return whole[1:] if whole.startswith(" ") else whole


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and ``ids``, an array column of every token of each whole text."""
    return map_texts(docs, _task(docs, model_path, _ids), {"n_tokens": "long", "ids": "array<int>"})


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ``text`` of the ``ids`` column of ``encoded``; null ids give an empty text."""
    from pyspark.sql import functions as F

    packed = tokens.select("doc_id", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))

    def run(model, raw):
        decoder = Decoder(model)
        return {"text": [decoder.decode([int(i) for i in x.split(b",") if i]) for x in raw]}

    return map_texts(packed, _task(tokens, model_path, run), {"text": "string"}, text="ids")


def round_trip(docs: DataFrame, model_path: str, most: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the decoded text; ids and texts stay in the task, a worker keeps ``most`` segments."""
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_texts(docs, _task(docs, model_path, partial(_digests, most=most)), kinds)


def _task(df: DataFrame, model_path: str, fn):
    """Make ``fn(model, raw)`` a task function; the model is broadcast (its size is that of the vocabulary)."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        return lambda raw: fn(shared.value, raw)

    make.factory = True
    return make


_encoders: list = []


def _encoder(model: dict, most: int = CACHE) -> Encoder:
    """One encoder for each Python worker, with its caches."""
    if not _encoders or _encoders[0][0] is not model or _encoders[0][1].segments.most != most:
        _encoders[:] = [(model, Encoder(model, most))]
    return _encoders[0][1]


def _ids(model, raw):
    ids = [_encoder(model).encode(x.decode("utf-8", "replace")) for x in raw]
    return {"n_tokens": [len(x) for x in ids], "ids": ids}


def _digests(model, raw, most=CACHE):
    encoder = _encoder(model, most)
    segment, raws, written = encoder.segments.__getitem__, encoder.raws, encoder.written
    n_tokens, ids_sha, decoded_sha = [], [], []
    for x in raw:
        ids = "".join(map(segment, encoder.cut_up(x.decode("utf-8", "replace"))))
        n_tokens.append(len(ids))
        ids_sha.append(hashlib.sha256(ids.translate(written)[:-1].encode()).hexdigest())
        data = ids.translate(raws).removeprefix(" ").encode("utf-8", "surrogateescape")
        # runs of bytes are joined across segments; pieces are whole characters, so damage stays inside a run
        decoded_sha.append(hashlib.sha256(data.decode("utf-8", "replace").encode("utf-8")).hexdigest())
    return {"n_tokens": n_tokens, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}
