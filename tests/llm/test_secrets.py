import hashlib
import random
import re

from pyspark.sql import functions as F

from plebis.llm import secrets

BASE = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
)


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, keep) in enumerate(BASE) for m in p.finditer(text) if keep(m))


def texts():
    rng = random.Random(3)
    parts = ["token=token:abcdefgh", "PassWord : 'abc.def=1'", "api_key=\"x\"", "AKIA" + "A1B2" * 4, "AKIAAKIA" + "Z" * 9, "0123456789abcdef" * 2, "é🙂 ",
             "secret=", "apikey:aaaaaa", "passwd = short", "plain words here", "\n", "ABCDEF0123456789abcdef0123", "TOKEN==abcdef", "𝒳"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(300)] + [None, "", "x" * 50_000 + "token=abcdef123", "\x01token=abcdefg\x02"]


def test_base_spans_against_python(spark, docs_of):
    given = texts()
    got = secrets.scan(docs_of(given)).select("doc_id", "text", "spans").collect()
    assert len(got) == len(given)
    for r in got:
        own = [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] != "random"]
        assert own == base_spans(r["text"] or "")
        assert [(s["start"], secrets.KINDS.index(s["kind"])) for s in r["spans"]] == sorted((s["start"], secrets.KINDS.index(s["kind"])) for s in r["spans"])


def test_random_runs_but_no_words(docs_of):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(letters, k=40)) for _ in range(60)]
    words = ["internationalizationofcommunications", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345678901234567890123456", "this-is-a-long-name-in-an-address-of-a-page", "abcabcabcabcabcabcabcabcabc"]
    got = secrets.scan(docs_of([f"see {k} there" for k in keys] + words)).orderBy("doc_id").collect()
    found = [any(s["kind"] == "random" for s in r["spans"]) for r in got]
    assert sum(found[: len(keys)]) >= 54 and not any(found[len(keys) :])


def test_random_keys_of_any_length(docs_of):
    rng = random.Random(8)
    lengths = (20, 40, 100, 400, 800, 1600, 3000, 10_000)
    planted = []
    for name in ("BASE62", "BASE64", "BASE64_URL", "DIGITS", "BASE58", "LOWER"):
        for n in lengths:
            for _ in range(20):
                planted.append((name, n, "".join(rng.choices(getattr(secrets, name), k=n))))
    planted += [("joined", n, "sk_live-" + "".join(rng.choices(secrets.BASE62, k=n))) for n in lengths for _ in range(20)]
    got = secrets.scan(docs_of([f"see {key} there" for _, _, key in planted])).orderBy("doc_id").collect()
    found = {}
    for (name, n, _), r in zip(planted, got, strict=True):
        found[name, n] = found.get((name, n), 0) + any(s["kind"] == "random" and s["end"] - s["start"] >= n for s in r["spans"])
    # On 20 digits or 26 letters chance says little.
    assert all(hits >= 18 for (name, n), hits in found.items() if n >= (100 if name in ("DIGITS", "LOWER") else 20)), found
    plain = ["1234567890" * 3, "0" * 40, "20240101" * 5, "00112233445566778899", "0246813579" * 20, "the-quick-brown-fox/" * 40, "loremipsumdolorsitamet" * 20]
    assert not any(s["kind"] == "random" for r in secrets.scan(docs_of(plain)).collect() for s in r["spans"])


def test_redaction(docs_of):
    given = ["a password=abcdefg1 b token=0123456789abcdef01234567 c", "clean", None, ""]
    got = [r["text"] for r in secrets.redact(docs_of(given)).orderBy("doc_id").collect()]
    assert got == ["a [SECRET] b [SECRET] c", "clean", None, ""]


def test_digest_columns(spark, docs_of, tmp_path):
    docs_of(["token=abcdef", None]).withColumn("spans", F.lit(7)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in secrets.op3_secrets(spark, str(tmp_path)).collect()}
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:0:12").hexdigest() and got[0]["spans"] == "assign:0:12" and got[0]["n_assign"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == ""
    assert secrets.scan(docs_of([])).count() == 0


def test_false_discoveries_over_the_table(docs_of):
    """Of ordinary letters in their usual shares few are reported, beside keys."""
    rng = random.Random(11)
    shares = dict(zip("etaoinshrdlcumwfgypbvk", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8)))
    ordinary = ["".join(rng.choices(list(shares), list(shares.values()), k=rng.randint(20, 60))) for _ in range(3000)]
    keys = ["".join(rng.choices(secrets.BASE62, k=40)) for _ in range(100)]
    got = secrets.scan(docs_of([f"{r} {s}" for r, s in zip(ordinary[::2], ordinary[1::2])] + keys)).orderBy("doc_id").collect()
    hits = [sum(s["kind"] == "random" for s in r["spans"]) for r in got]
    false, true = sum(hits[:1500]), sum(hits[1500:])
    assert true >= 90 and false <= 0.1 * (false + true)


def test_redaction_with_a_clashing_column(docs_of):
    docs = docs_of(["token=abcdefgh"]).withColumn("__secret_spans", F.lit("kept")).withColumn("__secret_bar", F.lit(1))
    r = secrets.redact(docs).first()
    assert r["text"] == "[SECRET]" and r["__secret_spans"] == "kept"
