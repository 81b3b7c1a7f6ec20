"""Cross-tokenizer alignment against the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from urnframe.llm import pair_align


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from public_tokenizers import path
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def _byte_level():
    """The usual byte-level alphabet: printable bytes stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(other)}}


def _tokens(text, libraries, table):
    a, b = libraries
    if not text:
        return None
    got = a.encode(" " + text, add_special_tokens=False)
    bytes_a = [bytes(table[c] for c in t) for t in got.tokens]
    ids_b = b.encode(text)
    bytes_b = []
    for i in ids_b:
        p = b.id_to_piece(i)
        bytes_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    return got.ids, np.cumsum([len(x) for x in bytes_a]).tolist(), ids_b, np.cumsum([len(x) for x in bytes_b]).tolist()


def _want(rows, libraries):
    table, links, found = _byte_level(), Counter(), []
    for doc_id, text, *_ in rows:
        got = _tokens(text, libraries, table)
        own, groups = [], []
        if got:
            a, ends_a, b, ends_b = got
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                own.append((a[p - 1], b[q - 1]))
                i, j = p, q
        links.update(own)
        found.append((doc_id, len(got[0]) if got else 0, len(got[2]) if got else 0, own, groups))
    top = defaultdict(int)
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return Counter(
        (i, na, nb, len(g), len(o), sum(links[x] == top[x[1]] for x in o), sum(links[x] for x in o),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, na, nb, o, g in found
    )


def _rows():
    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\t", "　", "▁", "\x1c", " ", "a", "the", "über", "日本", "🙂", "<0x41>", "<s>", "'s",
             "<|endoftext|>", "12", "…", "tion", "é", "ﬁ", "\x00", "\r\n", ",", "​", "Ġ"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 25)))) for i in range(600)]
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(200)]
    rows += [(600 + i, " ".join(rng.choices(words, k=200))) for i in range(40)]
    rows += [(700, None), (701, ""), (702, " "), (703, "  "), (704, "\n"), (705, "a "), (None, "no id"), rows[5], rows[610]]
    return rows + [(706, "long text " * 4000)]


@pytest.mark.parametrize("size,fan", [(pair_align.BLOCK, pair_align.FAN), (2000, 3)])
def test_alignment_equals_whole_texts(spark, libraries, size, fan, monkeypatch):
    monkeypatch.setattr(pair_align, "parts_for", lambda docs, each: 5)
    rows = _rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, cell int, block string").repartition(3)
    got = pair_align.align(docs, size, fan).collect()
    assert Counter(map(tuple, got)) == _want(rows, libraries)
    assert pair_align.align(docs.limit(0)).count() == 0


def test_units_make_up_texts():
    rng = random.Random(5)
    own = pair_align.Aligner()
    texts = [None, ""] + ["".join(rng.choices(" \n\tab　\x1cé!", k=rng.randint(1, 14))) for _ in range(2000)]
    codes, bounds = own.units(texts, False)
    names = {c: u for u, c in own.code.items()}
    for text, a, b in zip(texts, bounds, bounds[1:]):
        units = [names[c] for c in codes[a:b]]
        assert "".join(units) == (" " + text if text else "") and all(u.startswith(" ") for u in units)
        assert all("!" <= p[-1] <= "~" for p in units[:-1])


def test_minimal_hash_is_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        hashed = pair_align.MinimalHash(keys)
        assert hashed.size == len(keys) and sorted(hashed.numbers(keys)) == list(range(len(keys)))
        assert sum(len(bits) for _, bits, _ in hashed.levels) <= max(400, len(keys))
    with pytest.raises(ValueError):
        import pyarrow as pa

        built = pair_align._built(pa.table({"cell": pa.array([1]), "keys": pa.array([keys.tobytes()])}))
        pair_align._found(np.setdiff1d(rng.integers(0, 2**63, 50).astype(np.uint64), keys), built)
