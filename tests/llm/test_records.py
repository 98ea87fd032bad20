import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sessionlake.llm import records
from sessionlake.llm.common import scratch_path
from sessionlake.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "x.\n\n Y", "it's we'll DON'T", "1 22 333", "naïve  straße\t\tß", "a b  c", "<|endoftext|>", "a <|endoftext|> b", "日本語 テスト", "emoji 😀 😀😀", "tab\t x", "a\x1cb \x1c c", "a  b", "p | q || r", "word," * 50, "&&& *** $$$", "é a​b", "\r\n x \r\n"]


def test_stretches_give_the_library_s_ids(library, texts):
    own = records.Encoder(tokenizer_path())
    for text in [*ODD, *texts.values()]:
        assert np.frombuffer(own.encode(text), dtype=own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


def any_character(rng):
    """Of all of Unicode, surrogates left out; half of them such that the pattern tells apart."""
    if rng.random() < 0.5:
        return rng.choice("aB é,.!'1\n\t   ß日😀-_|sdtl\x1c\x85\xa0\u180e\u200b\u2028\u3000\ufeff")
    point = rng.choice((rng.randrange(0x3000), rng.randrange(0x10000), rng.randrange(0x10000, 0x20000), rng.randrange(0x110000)))
    return "x" if 0xD800 <= point < 0xE000 else chr(point)


def test_random_strings_give_the_library_s_ids(library):
    import random

    rng, own = random.Random(4), records.Encoder(tokenizer_path())
    for _ in range(40):
        texts = ["".join(any_character(rng) for _ in range(rng.randrange(1, 30))) for _ in range(1000)]
        for text, whole in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(own.encode(text), dtype=own.kind).tolist() == whole.ids, repr(text)


def whole_array(own, texts):
    data, at = own.encode_all(texts)
    return [np.frombuffer(data[a:b], dtype=own.kind).tolist() for a, b in zip(at[:-1], at[1:])]


def test_arrays_give_the_library_s_ids(library, texts):
    import random

    rng, own = random.Random(5), records.Encoder(tokenizer_path(), most=100)
    words = [*ODD, "the", "the,", "naïve", "日本", "x", "'s", "\n", "12"]
    for n in range(60):
        made = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(50)]
        made += ["".join(any_character(rng) for _ in range(rng.randrange(30))) for _ in range(50)]
        made += [None, "", *ODD, *(texts.values() if n == 0 else ())]
        rng.shuffle(made)
        found = whole_array(own, pa.array(made, pa.string()).slice(3))
        assert found == [library.encode(t or "", add_special_tokens=False).ids for t in made[3:]]
    assert whole_array(own, pa.array([], pa.string())) == []
    assert whole_array(own, pa.array(["a b", None], pa.large_string())) == [library.encode("a b").ids, []]


def test_an_array_s_stretches_are_encoded_once(library, monkeypatch):
    """Also those that are not remembered."""
    own, asked = records.Encoder(tokenizer_path(), most=0), []
    monkeypatch.setattr(own, "_stretch", lambda s, f=own._stretch: asked.append(s) or f(s))
    made = [f"w{k} some, more words" for k in range(300)]
    assert whole_array(own, pa.array(made)) == [library.encode(t).ids for t in made]
    assert sorted(asked) == sorted([*(f"w{k}" for k in range(300)), " some,", " more", " words"])


def test_letters_newer_than_a_library_s_tables(library):
    own = records.Encoder(tokenizer_path())
    for text in ("\U00010940'll", "a \U00010940'll b \U00010d40 c", "x \U0001fae9'd y", " \u1c89 's"):
        assert np.frombuffer(own.encode(text), dtype=own.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_against_brute_force(spark, documents, texts, library):
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in records.encoded(documents, tokenizer_path()).collect()}
    start = 0
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        assert found[doc] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len(found) == len(texts)


def test_offset_index_reads_single_records(spark, documents, texts, library):
    folder = scratch_path(spark, "test-records")
    index = records.write_shards(documents, tokenizer_path(), folder).collect()
    assert len(index) == len(texts)
    for r in index[::17]:
        doc, ids = records.record_at(folder, r["shard"], r["offset"], r["bytes"], 2)
        assert doc == r["doc_id"] and ids.tolist() == [*library.encode(texts[doc], add_special_tokens=False).ids, 0]


def test_damage_is_found():
    good = records.framed(b"some payload") + records.framed(b"")
    assert list(records.unframed(io.BytesIO(good))) == [b"some payload", b""]
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            list(records.unframed(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(records.unframed(io.BytesIO(good[:-3])))
    assert records.masked(b"") == 0xA282EAD8 and struct.calcsize("<QI") == 12


def test_awkward_rows(spark, awkward, nothing):
    found = records.encoded(awkward, tokenizer_path()).collect()
    assert len(found) == awkward.count()
    one = {r["doc_id"]: r["n_tokens"] for r in found}
    assert one[3] == one[4] == 1 and one[None] > 1 and one[8] > 30_000
    assert sorted(r["start"] for r in found)[0] == 0
    assert records.encoded(nothing, tokenizer_path()).count() == 0
