import random

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm.bpe import Vocabulary, bpe_decode, bpe_encode


def encoded(v, texts):
    ids, counts = v.encode(texts, {})
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_equals_the_library(vocabulary, prose):
    rng, kinds = random.Random(3), [(0x20, 0x7F), (1, 0x250), (0x370, 0xD7FF), (0xE000, 0xFFFF), (0x1F300, 0x1F600)]
    noise = ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(80)) for _ in range(300)]
    texts = [*prose, *noise, "", "aaaa" * 99, "I'll <|endoftext|><|endoftext|>  we've \n\n x ", " " * 50 + "\u00a0\u2003y"]
    library = Tokenizer.from_file(vocabulary)
    v = Vocabulary(vocabulary)
    assert encoded(v, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, counts = v.encode(texts, {})
    assert v.decode(ids.astype(np.int64), counts) == [library.decode(x, skip_special_tokens=False) for x in encoded(v, texts)]


def test_ranks_at_once_and_one_by_one_agree(vocabulary, prose, monkeypatch):
    import tidemark.llm.bpe as bpe

    v, texts = Vocabulary(vocabulary), [*prose, "aaaaaaaa aaaaa ......... ----------", " " * 33, "hahahahaha the the"]
    found = []
    for common in (0, 3, 200, 60_000):
        monkeypatch.setattr(bpe, "COMMON", common)
        found.append(encoded(v, texts))
    assert found[0] == found[1] == found[2] == found[3]


def test_known_words_do_not_change_results(vocabulary, prose, monkeypatch):
    import tidemark.llm.bpe as bpe

    v, known = Vocabulary(vocabulary), {}
    whole = encoded(v, prose)
    monkeypatch.setattr(bpe, "CACHE", 50)
    parts = []
    for i in range(0, len(prose), 7):
        ids, counts = v.encode(prose[i : i + 7], known)
        parts += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert parts == whole


def test_odd_rows(odd_docs, no_docs, vocabulary):
    found = bpe_decode(bpe_encode(odd_docs, vocabulary), vocabulary).collect()
    assert len(found) == 8
    assert all(r["decoded"] == (r["text"] or "") for r in found)
    assert [list(r["ids"]) for r in found if r["doc_id"] == 2] == [[]]
    assert bpe_encode(no_docs, vocabulary).count() == 0
    clash = odd_docs.withColumnRenamed("source", "ids")
    assert bpe_encode(clash, vocabulary).schema["ids"].dataType.simpleString() == "array<int>"
