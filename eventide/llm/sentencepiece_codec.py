"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (wire format, a few fields) and rebuilt as
a tokenizers pipeline: normaliser, metaspace marker, unigram scores or BPE
merges in score order, byte fallback, atomic user-defined pieces. Texts are cut
before their markers where no piece goes over such a cut; a batch's distinct
parts are encoded and decoded by that library, and a worker keeps the parts it
has met lately. The reference library encodes every whole text; its ids and the
round trip are held against the result. Neither starts threads of its own:
Spark gives each core a task, so threads only add their own cost.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, unused

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Parts of texts that a worker keeps encoded, in two generations, and the longest that it keeps.
HELD_PARTS, HELD_CHARS = 800_000, 64
#: New parts of a BPE model that are encoded in one go.
JOINED = 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Model:
    """What the protobuf says that encoding depends on."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        found = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        if found is None:
            raise ValueError("the model has no unknown piece")
        return found

    @property
    def parts(self) -> re.Pattern | None:
        """What a normalised text is cut into: markers and what follows them; None if a piece goes over such a cut."""
        names = {p for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED)}
        crossing = any(SPACE in p.lstrip(SPACE) for p in names)
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if SPACE in names and self.escape and not crossing else None


def _fields(data: bytes):
    """(number, value) of every field of a message: int, or bytes for fixed and length-delimited ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        match key & 7:
            case 0:
                yield key >> 3, varint()
                continue
            case 1:
                n = 8
            case 2:
                n = varint()
            case 5:
                n = 4
            case other:
                raise ValueError(f"wire type {other}")
        yield key >> 3, data[at : at + n]
        at += n


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n in (3, 4, 5):
                    setattr(model, ("dummy_prefix", "squeeze", "escape")[n - 3], bool(v))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        pairs = sorted((ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids)
        found += [(-model.pieces[i][1], i, rank, left, right) for rank, (_, _, left, right) in enumerate(pairs)]
    return [x[3:] for x in sorted(found)]


def build(model: Model):
    """A tokenizers.Tokenizer that gives the model's ids."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = model.pieces[model.unknown][0]
    if model.kind == BPE:
        vocabulary = {p[0]: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        # control, unused and byte pieces never match text: a score that no path takes; user-defined ones are favoured as in the reference library
        never = 1000 * min((s for _, s, _ in model.pieces), default=0.0) - 1000
        best = max(0.0, *(s for _, s, kind in model.pieces if kind == NORMAL))
        scores = {CONTROL: lambda p, s: never, UNUSED: lambda p, s: never, BYTE: lambda p, s: never, USER: lambda p, s: len(p) * best - 0.1}
        core = models.Unigram([(p, scores.get(kind, lambda _, s: s)(p, s)) for p, s, kind in model.pieces], model.unknown, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    if model.kind == BPE:
        tokenizer.add_tokens([AddedToken(p, normalized=True) for p, _, kind in model.pieces if kind == USER])
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """Encoder and decoder of one model: whole texts, or the parts that a text is cut into."""

    def __init__(self, model: Model):
        from tokenizers import Tokenizer, decoders, normalizers

        self.model, self.cut = model, model.parts
        self.whole = build(model)
        self.normalizer = self.whole.normalizer
        self.part = Tokenizer(self.whole.model)  # what it gets is normalised already, and a part's first blank stays
        self.part.add_tokens([token for _, token in sorted(self.whole.get_added_tokens_decoder().items())])
        self.part.normalizer = normalizers.Sequence([])
        self.part.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])  # markers stay: a part is compared as it is
        names = [p for p, _, _ in model.pieces]
        self.leads = np.array([p.startswith(SPACE) for p in names])  # pieces that begin with a marker, and those of markers alone
        self.blanks = np.array([bool(p) and not p.strip(SPACE) for p in names])
        self.ids: dict[str, bytes] = {}  # of a part by its word (see words), as bytes of int32
        self.older: dict[str, bytes] = {}  # those of the generation before, until they are met again
        self.odd: dict[str, str] = {}  # what parts decode to that don't decode to themselves, by word

    def normalised(self, text: str) -> str:
        if not text or self.model.charsmap or self.model.squeeze:
            return self.normalizer.normalize_str(text)
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    def parts(self, normalised: str) -> list[str]:
        """What a normalised text is cut into. Where each marker has something behind it, a plain split finds the same as the expression."""
        return [SPACE + x for x in normalised[1:].split(SPACE)] if _plain(normalised) else self.cut.findall(normalised)

    def words(self, normalised: list[str]) -> pa.ListArray:
        """The parts of each text without the marker that they begin with; one that has none gets a blank, which no normalised text holds."""
        plain = np.array(list(map(_plain, normalised)), bool)
        kind = pa.large_string()
        split = pc.split_pattern(pa.array([x[1:].replace(SPACE, " ") for x, y in zip(normalised, plain, strict=True) if y], kind), " ")
        if plain.all():
            return split
        other = [[x[1:] if x[0] == SPACE else " " + x for x in self.parts(text)] for text, y in zip(normalised, plain, strict=True) if not y]
        rows = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        return pa.concat_arrays([split, pa.array(other, split.type)]).take(pa.array(rows))

    def run(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[str]]:
        """(ids of all texts, how many each has, decoded texts)."""
        if self.cut is None:
            found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.int32), [len(x) for x in found], self.whole.decode_batch(found, skip_special_tokens=False)
        normalised = [self.normalised(text) for text in texts]
        rows = self.words(normalised)
        coded = rows.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices
        found = list(map(self.ids.get, words))
        new = [word for word, x in zip(words, found, strict=True) if x is None]
        again = {word: x for word, x in zip(new, map(self.older.get, new), strict=True) if x is not None}
        self.ids.update(again)
        self._learn([word for word in new if word not in again])
        packed = pa.array([self.ids[word] if x is None else x for word, x in zip(words, found, strict=True)], pa.large_binary()).take(codes)
        bounds = np.append(0, np.cumsum(rows.value_lengths().to_numpy()))  # of the rows in words, and below in bytes
        ends = np.frombuffer(packed.buffers()[1], np.int64)[: len(packed) + 1]
        ids = np.frombuffer(packed.buffers()[2] or b"", np.int32)[: ends[-1] // 4]
        odd = np.array([word in self.odd for word in words], bool)[codes.to_numpy()] if self.odd else np.zeros(len(codes), bool)
        decoded = []
        for text, i, j in zip(normalised, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            back = text.replace(SPACE, " ")
            if odd[i:j].any():
                row = [words[code] for code in codes[i:j].to_numpy().tolist()]
                back = "".join([self.odd[word] if word in self.odd else _part(word).replace(SPACE, " ") for word in row])
            decoded.append(back[1:] if self.model.dummy_prefix and back[:1] == " " else back)
        for word in new:
            if len(word) >= HELD_CHARS:
                self.ids.pop(word), self.odd.pop(word, None)
        if len(self.ids) > HELD_PARTS // 2:
            self.ids, self.older = {}, self.ids
            self.odd = {word: x for word, x in self.odd.items() if word in self.older}
        return ids, (np.diff(ends[bounds]) // 4).tolist(), decoded

    def _learn(self, words: list[str]) -> None:
        """Encode and decode new parts. Of BPE models, JOINED at a time: pieces don't go over their markers, so ids can be told apart again.

        A unigram path's score is a sum over all that is joined, and rounding it could decide between equal paths by
        what stands beside a part; those parts are encoded alone.
        """
        bare, size = [w for w in words if w[:1] == " "], JOINED if self.model.kind == BPE else 1
        new = [*bare, *(w for w in words if w[:1] != " ")] if bare else words
        groups = [new[i : i + size] for i in range(0, len(new), size)]
        joined = ["".join(map(_part, g)) if g[0][:1] == " " else SPACE + SPACE.join(g) for g in groups]
        encoded = [e.ids for e in self.part.encode_batch_fast(joined, add_special_tokens=False)]
        back = self.part.decode_batch(encoded, skip_special_tokens=False)
        for group, given, ids, text in zip(groups, joined, encoded, back, strict=True):
            flat = np.array(ids, np.int32)
            begins = self.leads[flat]
            begins[1:] &= ~self.blanks[flat[:-1]]
            ends, packed = [*(np.flatnonzero(begins) * 4).tolist(), len(flat) * 4], flat.tobytes()
            found = [packed[i:j] for i, j in pairwise(ends)]
            if len(found) != len(group):  # a text that begins without a marker is alone in its lead
                found = [np.array(e.ids, np.int32).tobytes() for e in self.part.encode_batch_fast(list(map(_part, group)), add_special_tokens=False)]
            self.ids.update(zip(group, found, strict=True))
            if text != given:
                alone = self.part.decode_batch([np.frombuffer(x, np.int32) for x in found], skip_special_tokens=False)
                self.odd.update((w, x.replace(SPACE, " ")) for w, x in zip(group, alone, strict=True) if x != _part(w))


def _plain(normalised: str) -> bool:
    return normalised[:1] == SPACE and normalised[-1:] != SPACE and SPACE + SPACE not in normalised


def _part(word: str) -> str:
    return word[1:] if word[:1] == " " else SPACE + word


_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """(codec on the tokenizers library, sentencepiece's processor) of a model file, once for each worker."""
    if path not in _loaded:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            data = f.read()
        _loaded[path] = Codec(parse(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    return _loaded[path]


CODEC = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.bool_()), ("parity", pa.bool_())])


def codec(text: Column, path: str) -> Column:
    """Struct ``(ids, decoded, parity)``: the ids, if they decode to the text, and if the reference library gives the same ids."""

    @F.arrow_udf("struct<ids: array<int>, decoded: boolean, parity: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()  # rows of the same text share its result
        given = coded.dictionary.to_pylist()
        own, reference = load(path)
        ids, sizes, back = own.run(given)
        ends = np.cumsum([0, *sizes], dtype=np.int32)
        parity = np.zeros(len(given), bool)
        # one buffer of the reference's ids for the whole batch, compared row by row
        theirs = [reference.encode(x, out_type="numpy") for x in given]
        lengths = np.array([len(x) for x in theirs], np.int64)
        same = np.flatnonzero(lengths == np.diff(ends))
        if len(same) == len(given) and np.array_equal(np.concatenate([*theirs, ids[:0]]), ids):
            parity[:] = True
        else:
            for i in same:
                parity[i] = np.array_equal(ids[ends[i] : ends[i + 1]], theirs[i])
        decoded = np.array([x == y for x, y in zip(given, back, strict=True)], bool)
        columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())), pa.array(decoded), pa.array(parity)]
        return pa.StructArray.from_arrays(columns, fields=list(CODEC)).take(coded.indices)  # a null text has a null index and so a null result

    return run(text)


def tokenize(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with ``ids``, ``n_tokens``, ``decoded`` (round trip exact) and ``parity``.

    A null text has null ids and flags and no tokens; an empty one has the
    empty list. Texts that hold the marker U+2581 itself encode like blanks and
    so don't decode to themselves: decoded is false then. Whole texts are
    encoded, whatever their length; every row goes through both libraries.
    """
    bounded_batches(docs.sparkSession, rows=512, mb=1)
    inner = unused(docs, "_codec")
    out = docs.withColumn(inner, codec(F.col(text_col), path or default_model()))
    new = ("ids", "n_tokens", "decoded", "parity")
    names = [f"`{c}`" for c in docs.columns if c not in new]
    return out.select(*names, F.col(f"{inner}.ids").alias("ids"), F.coalesce(F.size(f"{inner}.ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col(f"{inner}.decoded").alias("decoded"), F.col(f"{inner}.parity").alias("parity"))
