import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordmill.llm import bpe, queries, tokenfile

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def noise(seed, n):
    rng = random.Random(seed)
    kinds = ["aeiou'tsrlmd 0123.!<|>endoftext", "aaab ", "".join(map(chr, range(0x20, 0x250))), "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(80)), "\u0085\u00a0 ẛ́ΣσİßЖж中文 \U0001f600\u2028", "the tion ing "]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(0, 50))) + rng.choice(["", "<|endoftext|>", " <|startoftext|>x", "<|EndOfText|>"])


@pytest.mark.parametrize("make", [lambda: bpe.Encoder(PATH), lambda: bpe.Encoder(PATH, tokenfile.LibraryWords(PATH))], ids=["trie", "library words"])
def test_same_as_library(make, library):
    texts = [*noise(1, 3000), *("".join(chr(c) + "a" for c in range(k, k + 400) if not 0xD800 <= c < 0xE000) for k in range(1, 0x30000, 400))]
    got = make().batch([t.encode() for t in texts])
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [list(bpe.unpack(x)) for x in got] == [w.ids for w in want]
    show = bpe.vocabulary(PATH).decode
    assert [show(w.ids) for w in want[:500]] == [library.decode(w.ids, skip_special_tokens=False) for w in want[:500]]


@pytest.mark.parametrize(("known", "window"), [(20, 1 << 20), (1 << 20, 16), (5, 7)])
def test_forgetting_and_windows_stay_right(library, known, window):
    coder = bpe.Encoder(PATH, known=known, window=window)
    texts = [*noise(2, 300), "", "x" * 70 + " " + "é" * 40, "don't l'homme l'métro we'll they're''s ''t '", "", "a'", "s b", "<|endoftext|>x<|", "word\x00x \x1f", "1234,56"]
    want = [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    for k in (1, 50, len(texts)):
        got = [list(bpe.unpack(x)) for at in range(0, len(texts), k) for x in coder.batch([t.encode() for t in texts[at : at + k]])]
        assert got == want
        assert len(coder.table) <= max(known, 4000)


def test_words_table_grows():
    table = bpe.Words()
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(1, 17))) for _ in range(60_000)})
    both = np.frombuffer(b"".join(w.ljust(16, b"\0") for w in words), "<u8").reshape(-1, 2)
    for at in range(0, len(words), 7000):
        first = table.add([(i, i) for i in range(at, min(at + 7000, len(words)))])
        table.low[first : table.count], table.high[first : table.count] = both[at : at + 7000].T
        table.enter(np.arange(first, table.count))
    assert table.find(both[:, 0], both[:, 1]).tolist() == list(range(len(words)))
    assert (table.find(both[:, 0] + np.uint64(1 << 63), both[:, 1]) == -1).all()


def test_dataframe(spark, library):
    long = "wörd " * 200_000
    rows = [(1, "Hello World", "x"), (2, None, "x"), (3, "", None), (None, "a", "y"), (1, "Hello World", "x"), (4, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = bpe.encode(docs, PATH).collect()
    assert len(out) == 6
    by = {(r["doc_id"], r["lang"]): r for r in out}
    assert (by[2, "x"]["n_tokens"], bytes(by[2, "x"]["ids"]), by[2, "x"]["decoded"]) == (0, b"", "")
    want = library.encode(long, add_special_tokens=False).ids
    assert list(bpe.unpack(bytes(by[4, "z"]["ids"]))) == want
    assert by[1, "x"]["decoded"] == "hello</w> world</w>"
    assert bpe.decode(bpe.encode(docs, PATH, decode=False), PATH).where("doc_id = 1").first()["text"] == "hello</w> world</w>"
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)), PATH)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op1_bpe(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
