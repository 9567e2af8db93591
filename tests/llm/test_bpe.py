import random

import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plebis.llm import bpe


def texts():
    rng = random.Random(2)
    parts = list("abcdeTHE thing  \n\t\r\x1c\x1f\x85\xa0\u2003'strevllmd0123456789²½Ⅷäöéñß中文字🙂\u200d!?$%-_") + ["<|endoftext|>", " the", " and", "'s", " don't", "\n\n", "  x"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)] + ["", "a" * 5000, " " * 700, "ab" * 3000 + "\n", "Words, in one line.\nAnd in the next."]


def test_ids_are_the_librarys(spark, docs_of):
    library = Tokenizer.from_file(bpe.default_path())
    given = texts()
    got = bpe.encode(docs_of([*given, None]).withColumn("ids", F.lit("x"))).orderBy("doc_id").collect()
    for r, t in zip(got, [*given, ""], strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, docs_of):
    import hashlib

    r = bpe.digests(docs_of(["Hello world", None])).orderBy("doc_id").collect()
    ids = Tokenizer.from_file(bpe.default_path()).encode("Hello world", add_special_tokens=False).ids
    assert r[0]["n_tokens"] == len(ids) and r[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert r[0]["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    assert r[1]["n_tokens"] == 0 and r[1]["ids_sha256"] == r[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs_of([])).count() == 0


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    words = bpe.Vocabulary(bpe.default_path())
    library = Tokenizer.from_file(bpe.default_path())
    for base in range(0, 60, 7):
        given = " ".join(f"word{(base + k) % 97}s" for k in range(40))
        assert words.encode(pa.array([given]))[0][0].as_py() == ",".join(map(str, library.encode(given, add_special_tokens=False).ids))
        assert len(words.known.pieces) <= 90 and len(words.pair_codes) <= 90


def test_parted_and_whole_texts():
    """Texts of runs parted by blanks, beside texts with white space at either side of a blank."""
    rng = random.Random(5)
    words = ["a", "The", "don't", "x\n", "\ny", "1\n2", "", "\t", "<|endoftext|>", "z<|endoftext|>", "\x1c", "\u2003q", "ß,", "9.9"]
    given = [" ".join(rng.choices(words[: rng.choice((3, 6, 14))], k=rng.randint(0, 12))) for _ in range(3000)]
    library = Tokenizer.from_file(bpe.default_path())
    found = bpe.vocabulary(bpe.default_path())
    for part in bpe.slices(pa.array(given), 500):
        ids, raw = found.encode(part)
        for t, i, r in zip(part.to_pylist(), ids.to_pylist(), raw.to_pylist(), strict=True):
            wanted = library.encode(t, add_special_tokens=False).ids
            assert i == ",".join(map(str, wanted)) and r.decode() == library.decode(wanted, skip_special_tokens=False)
