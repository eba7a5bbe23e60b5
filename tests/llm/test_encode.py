"""The encoder on Arrow columns, and what it remembers."""

from __future__ import annotations

import pytest

pa = pytest.importorskip("pyarrow")
pytest.importorskip("public_tokenizers")

from tapelib.llm import encode  # noqa: E402
from tapelib.llm.queries import BYTE_BPE, WORD_BPE, vocabulary  # noqa: E402

TEXTS = ["a ", "b", "end  ", "next", "x.\n", "Y. z\n\nW\nv", None, "", " ", "don't (see) \"it.\" 'S", "é, naïve  x  y 　z", "a<|endoftext|>, b.\nc",
         "<|startoftext|>", "1,234.5 a1,b", "日本 語, x", "q́. ≠ ́x", "tab\t. \r\n x", "w" * 300 + ", " + "é" * 40]


@pytest.mark.parametrize("name,spaced", [(WORD_BPE, False), (BYTE_BPE, True)])
@pytest.mark.parametrize("limit", [1, 30, 1 << 20])
def test_columns_are_encoded_as_the_tokenizer_does(name, spaced, limit, monkeypatch):
    monkeypatch.setattr(encode, "CHUNK_BYTES", limit)
    monkeypatch.setattr(encode, "GROUP_BYTES", 20)
    e = encode.Encoder(vocabulary(name), spaced, 8)
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["left out", *TEXTS, "as well"], kind).slice(1, len(TEXTS))
        assert [x.tolist() for x in e.encode(column)] == want
        assert len(e.known) <= 16 + len(TEXTS) * 10 and all(len(p) <= encode.LONGEST for p in e.known)
    assert list(e.encode(pa.array([], pa.string()))) == []


def test_pieces_in_use_stay_known():
    e, often = encode.Encoder(vocabulary(BYTE_BPE), True, 200), ["x" + " of the words that come often" * 50]
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3))
    first = [x.tolist() for x in e.encode(often)]
    for n in range(0, 1000, 250):
        list(e.encode(["x " + " ".join(map(word, range(n, n + 250)))]))
    asked, merges = [], e.merges

    class Asked:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return merges.encode_batch_fast(texts, **more)

    e.merges = Asked()
    assert [x.tolist() for x in e.encode(often)] == first
    assert not asked
