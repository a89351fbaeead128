"""The codec against the reference library: models of both kinds, built piece by piece (never trained)."""

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
import sentencepiece
from eventide.llm import sentencepiece_codec as codec
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

LETTERS = "abcdefgh"


def unigram(byte_fallback=False, squeeze=True, dummy=True, user=(), marker=True):
    """A model over LETTERS: single letters, some syllables and words, each with a score of its own."""
    draw = random.Random(7)
    model = pb.ModelProto()
    add = lambda piece, score, kind=1: model.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    for piece in user:
        add(piece, 0, 4)
    for byte in range(256) if byte_fallback else ():
        add(f"<0x{byte:02X}>", 0, 6)
    pieces = {a + b + c for a in LETTERS for b in LETTERS[:4] for c in ("", "a", "e")} | {"▁" + a + b for a in LETTERS for b in LETTERS[:5]} | set(LETTERS) | {"▁the", "▁bed"}
    for piece in sorted((pieces | ({"▁"} if marker else set())) - set(user)):
        add(piece, -1 - draw.random() * 4 - 3 * (len(piece) == 1))
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, byte_fallback
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", dummy, squeeze, True
    return model.SerializeToString()


def texts(extra=""):
    draw = random.Random(8)
    made = ["".join(draw.choice(LETTERS + "   " + extra) for _ in range(draw.randrange(1, 80))) for _ in range(300)]
    return [*made, "", " ", "   ", "a", " edge blanks  inside and out  ", " a  b ", "bed" * 500, "abc " * 700]


@pytest.mark.parametrize(
    ("options", "extra"),
    [
        ({}, ""), ({}, "xyzé☃"), ({"byte_fallback": True}, "xyzé☃\n"), ({"squeeze": False}, "x"), ({"dummy": False}, "é"), ({"user": ["fad", "@@", "ab"], "byte_fallback": True}, "@"),
        ({"marker": False}, "x"), ({"byte_fallback": True, "squeeze": False, "user": ["ce"]}, "☃é\t"),
    ],
)
def test_unigram_models(options, extra):
    data = unigram(**options)
    own = codec.Codec(codec.parse(data))
    assert (own.cut is None) == (not options.get("marker", True))
    given = texts(extra)
    flat, sizes, decoded = own.run(given)
    want = sentencepiece.SentencePieceProcessor(model_proto=data)
    at = 0
    for text, n, back in zip(given, sizes, decoded, strict=True):
        assert list(flat[at : at + n]) == want.encode(text), text
        if options.get("byte_fallback") and not options.get("squeeze", True):
            assert back == text == want.decode(list(flat[at : at + n]))
        at += n
    assert at == len(flat)


@pytest.mark.parametrize("seed", [0, 1, 7, 18, 19, 23])
def test_ids_do_not_depend_on_hash_order(seed):
    """Workers hash strings with seeds of their own: ids of tied unigram paths stay those of the reference library."""
    here = Path(__file__).resolve()
    body = f"""
import sys
sys.path[:0] = [{str(here.parents[2])!r}, {str(here.parent)!r}]
import test_sentencepiece as t
from eventide.llm import sentencepiece_codec as codec
data = t.unigram(user=["fad", "@@", "ab"], byte_fallback=True)
own, want = codec.Codec(codec.parse(data)), t.sentencepiece.SentencePieceProcessor(model_proto=data)
flat, sizes, _ = own.run(t.texts("@"))
assert list(flat) == [i for text in t.texts("@") for i in want.encode(text)]
"""
    subprocess.run([sys.executable, "-c", body], env=os.environ | {"PYTHONHASHSEED": str(seed)}, check=True, timeout=120)


def test_parts_give_what_whole_texts_give():
    """The installed model: ids of parts are those of the whole text and of the reference library."""
    own, want = codec.load(codec.default_model())
    draw = random.Random(9)
    given = [" ".join("".join(draw.choice("etaoin shrdlu.,-éß漢\n") for _ in range(draw.randrange(1, 12))) for _ in range(50)) for _ in range(200)]
    given += ["▁ marked▁▁text ▁", "a" + " " * 40 + "b", "x" * 2000]
    flat, sizes, decoded = own.run(given)
    whole = [e.ids for e in own.whole.encode_batch(given, add_special_tokens=False)]
    assert list(flat) == [i for ids in whole for i in ids] == [i for t in given for i in want.encode(t)]
    assert decoded == [own.whole.decode(ids, skip_special_tokens=False) for ids in whole] == [x.replace("▁", " ") for x in given]
    assert sizes == list(map(len, whole)) and all(len(p) <= codec.HELD_CHARS for p in own.ids)


def test_a_batch_does_not_walk_over_held_parts():
    """A batch's work is that of its own parts, however many the worker holds; plain splits cut as the expression does."""

    class Held(dict):
        def keys(self):
            raise AssertionError("walks over all held parts")

        __iter__ = items = values = keys

    for data in (Path(codec.default_model()).read_bytes(), unigram(squeeze=False)):
        own, want = codec.Codec(codec.parse(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
        own.ids = Held()
        for given in (texts("@"), [*texts("xé"), "▁a", "a▁▁b▁", "漢 漢字 a"], ["bed the"]):
            flat, _, _ = own.run(given)
            assert list(flat) == [i for text in given for i in want.encode(text)]
            assert all(own.parts(t) == own.cut.findall(t) for t in map(own.normalised, given))


def test_a_part_is_looked_up_once_a_batch():
    """However often a batch repeats its parts, the worker's held ones are asked a few times for each distinct part."""

    class Counted(dict):
        asked = 0

        def get(self, *given):
            Counted.asked += 1
            return super().get(*given)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    data = unigram()
    own, want = codec.Codec(codec.parse(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    own.ids = Counted()
    given = ["abc bed " * 700, " bed  the " * 300, "the" + " bed" * 500] * 5
    flat, _, _ = own.run(given)
    assert list(flat) == [i for text in given for i in want.encode(text)]
    assert Counted.asked < 200


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_parts_that_are_met_again_stay_held(monkeypatch, byte_fallback):
    """A full generation of parts makes room, but those met since stay, with what they decode to."""
    monkeypatch.setattr(codec, "HELD_PARTS", 40)
    data = unigram(byte_fallback=byte_fallback, squeeze=False)
    own, want = codec.Codec(codec.parse(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    learnt, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda parts: (learnt.extend(parts), learn(parts)))
    draw = random.Random(10)
    for _ in range(60):
        given = ["bed ace ☃é", "cafe " + " ".join("".join(draw.choice(LETTERS) for _ in range(6)) for _ in range(10)), " bed  ☃é "]
        flat, _, decoded = own.run(given)
        assert list(flat) == [i for text in given for i in want.encode(text)]
        assert (decoded == given) == byte_fallback and decoded[1] == given[1]
        assert len(own.ids) + len(own.older) <= 40 + 2 * 20 and len(own.odd) <= 4
    assert sum(part.strip("▁") == "bed" for part in learnt) == 2


def test_rows_of_one_text_share_its_result(spark):
    """Copies side by side, which a batch encodes once, and nulls each get their own row."""
    docs = spark.range(400).select("id", F.concat(F.lit("same text "), (F.col("id") % 4).cast("string")).alias("text"))
    docs = docs.union(spark.range(400, 410).select("id", F.lit(None).cast("string")))
    got = codec.tokenize(docs).groupBy("text", "ids", "n_tokens", "decoded", "parity").count().collect()
    own, _ = codec.load(codec.default_model())
    want = {f"same text {i}": own.whole.encode(f"same text {i}", add_special_tokens=False).ids for i in range(4)} | {None: None}
    assert {r.text: r.ids for r in got} == want and sorted(r["count"] for r in got) == [10, 100, 100, 100, 100]
    assert all(r.n_tokens == len(r.ids or ()) and r.decoded is r.parity is (None if r.text is None else True) for r in got)


def test_a_model_without_unknown_piece_is_refused():
    model = pb.ModelProto()
    model.pieces.add(piece="a", score=-1.0, type=1)
    with pytest.raises(ValueError, match="unknown"):
        codec.Codec(codec.parse(model.SerializeToString()))


def test_rows(spark):
    """Repeats, nulls, very long texts and columns named like the results."""
    long = "A very long text without end. " * 20_000
    rows = [(1, "twice"), (1, "twice"), (2, None), (3, ""), (4, long), (5, "unbroken" * 30_000), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "parity", "decoded", "n_tokens")})
    got = sorted(codec.tokenize(docs).collect(), key=str)
    assert len(got) == len(rows)
    assert all((r.ids is None, r.decoded, r.parity) == (r.text is None, *([None] * 2 if r.text is None else [True] * 2)) for r in got)
    assert [r.ids for r in got if r.doc_id == 3] == [[]]
